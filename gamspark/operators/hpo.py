"""Configuration grids, trial tables, selection and votes."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c


def expand_grid(grid: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by..., config_id, params) from rows (by..., param, values): the product of the value lists.

    The product is folded inside one row per model; a grid is configuration, not data. Parameters
    are taken in name order, the last one varies fastest.
    """
    lists = grid.groupBy(*[c(b) for b in by]).agg(
        F.array_sort(F.collect_list(F.struct("param", "values"))).alias("__lists")
    )
    empty = F.array(F.create_map().cast("map<string,string>"))
    product = F.aggregate(
        "__lists",
        empty,
        lambda acc, item: F.flatten(
            F.transform(
                acc,
                lambda m: F.transform(
                    item["values"],
                    lambda v: F.map_concat(m, F.map_from_arrays(F.array(item["param"]), F.array(v.cast("string")))),
                ),
            )
        ),
    )
    return lists.select(*[c(b) for b in by], F.posexplode(product).alias("config_id", "params"))


def invalid_logistic(solver: Column, penalty: Column, l1_ratio: Column) -> Column:
    """Combinations no solver accepts."""
    ratio = l1_ratio.try_cast("double").isNotNull()
    bad = [
        (solver == "lbfgs") & penalty.isin("l1", "elasticnet"),
        (solver == "liblinear") & penalty.isin("elasticnet", "none"),
        ratio & (penalty != "elasticnet"),
        ~ratio & (penalty == "elasticnet"),
    ]
    return F.coalesce(bad[0] | bad[1] | bad[2] | bad[3], F.lit(False))


def drop_invalid_configs(configs: DataFrame, params: str = "params", task: str = "classification") -> DataFrame:
    """Logistic rules for rows whose params name a solver; balanced class weights only for classification."""
    get = lambda key: F.try_element_at(c(params), F.lit(key))
    bad = get("solver").isNotNull() & invalid_logistic(get("solver"), get("penalty"), get("l1_ratio"))
    if task == "regression":
        bad = bad | F.coalesce(get("class_weight") == "balanced", F.lit(False))
    return configs.where(~bad)


def typed_params(params: dict[str, str]) -> dict:
    """Parameters of a parsed grid as Python values: whole numbers, numbers, true and false, none, lists; other text stays."""

    def value(text: str | None):
        if text is None or text.strip() in ("None", "null", "none"):
            return None
        try:
            return ast.literal_eval(text.strip())
        except (ValueError, SyntaxError):
            low = text.strip().lower()
            return {"true": True, "false": False}.get(low, text)

    return {k: value(v) for k, v in params.items()}


def select_best(trials: DataFrame, by: Sequence[str] = ("dataset", "model", "fold")) -> DataFrame:
    """(by..., config_id, loss): smallest loss, the first configuration among equals; failed ones are skipped."""
    ok = trials.where(~F.col("failed") & F.col("loss").isNotNull() & ~F.isnan("loss"))
    return ok.groupBy(*[c(b) for b in by]).agg(F.min(F.struct("loss", "config_id")).alias("b")).select(
        *[c(b) for b in by], "b.config_id", "b.loss"
    )


def format_config(params: Column) -> Column:
    """Map to text lines 'key': value in key order; text values are quoted."""
    entries = F.array_sort(F.map_entries(params))
    line = F.transform(
        entries,
        lambda e: F.concat(
            F.lit("'"), e["key"], F.lit("': "),
            F.when(e["value"].try_cast("double").isNotNull() | e["value"].startswith("["), e["value"])
            .otherwise(F.concat(F.lit("'"), e["value"], F.lit("'"))),
        ),
    )
    return F.array_join(line, "\n")


def parse_config(text: Column) -> Column:
    """Text lines to a map; NULL when a line is not exactly 'key: value'.

    Line breaks inside square brackets belong to the value. Keys lose quotes and blanks, text values too.
    """
    flat = F.regexp_replace(text, r"\n(?=[^\[\]]*\])", " ")
    flat = F.regexp_replace(flat, "_x000D_", "")
    pairs = F.transform(F.split(flat, "\n"), lambda line: F.split(line, ": "))
    strip = lambda s: F.regexp_replace(s, r"^[' ]+|[' ]+$", "")
    value = lambda v: F.when(v.try_cast("double").isNotNull(), F.trim(v)).otherwise(strip(v))
    parsed = F.map_from_entries(F.transform(pairs, lambda p: F.struct(strip(F.get(p, F.lit(0))), value(F.get(p, F.lit(1))))))
    return F.when(F.forall(pairs, lambda p: F.size(p) == 2), parsed)


def value_kind(value: Column) -> Column:
    """int, float or text: the narrowest reading of a configuration value."""
    return (
        F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), "int")
        .when(value.try_cast("double").isNotNull(), "float")
        .otherwise("text")
    )


def majority_config(cells: DataFrame, params: str = "params", by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """(by..., key, value, votes, tie): the most frequent value of each parameter over the folds.

    The value seen in the earliest fold wins a tie, and the tie is flagged. A fold without the
    parameter does not vote. ``cells`` has fold and a params map.
    """
    keys = [c(b) for b in by]
    votes = cells.select(*keys, "fold", F.explode(c(params)).alias("key", "value")).groupBy(*keys, "key", "value").agg(
        F.count(F.lit(1)).alias("votes"), F.min("fold").alias("__first")
    )
    best = votes.groupBy(*keys, "key").agg(
        F.min(F.struct((-F.col("votes")).alias("neg"), "__first", "value")).alias("b")
    )
    top = best.select(*keys, "key", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("votes"))
    second = votes.join(top.select(*by, "key", F.col("votes").alias("__top")), [*by, "key"]).groupBy(*by, "key").agg(
        (F.count_if(F.col("votes") == F.col("__top")) > 1).alias("tie")
    )
    return top.join(second, [*by, "key"])


def stopping_round(losses: DataFrame, patience: int, initial: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., best_round, stop_round) from (by..., round, val_loss).

    Training stops once more than ``patience`` rounds in a row did not improve on the best loss; the
    best round is the first minimum up to there. A round table is as long as the training.
    """
    group = [c(b) for b in by] or [F.lit(0)]
    order = Window.partitionBy(*group).orderBy("round")
    before = F.least(
        F.min("val_loss").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(initial).cast("double"),
    )
    improved = before.isNull() | (F.col("val_loss") < before)
    steps = losses.withColumn("__imp", improved).withColumn(
        "__last", F.coalesce(F.max(F.when(F.col("__imp"), F.col("round"))).over(order), F.lit(0))
    )
    steps = steps.withColumn("__stop", (F.col("round") - F.col("__last") > patience))
    ended = F.min(F.when(F.col("__stop"), F.col("round"))).over(Window.partitionBy(*group))
    steps = steps.withColumn("__end", F.coalesce(ended, F.max("round").over(Window.partitionBy(*group))))
    kept = steps.where(F.col("round") <= F.col("__end"))
    return kept.groupBy(*[c(b) for b in by]).agg(
        F.coalesce(F.max(F.when(F.col("__imp"), F.col("round"))), F.lit(0)).alias("best_round"),
        F.max("round").alias("stop_round"),
    )


def select_by_validation(scored: DataFrame, y: str, prediction: str, path: str = "lambda", squared: bool = True) -> DataFrame:
    """(path, loss) of the first minimum along a penalty path, from rows scored under every penalty."""
    if squared:
        loss = (c(y) - c(prediction)) * (c(y) - c(prediction))
    else:
        loss = F.when(c(y) == 1, -F.log(c(prediction))).otherwise(-F.log(1 - c(prediction)))
    errors = scored.groupBy(c(path)).agg(F.avg(loss).alias("loss"))
    return errors.agg(F.min(F.struct("loss", path)).alias("b")).select(f"b.{path}", "b.loss")


def trial_summary(trials: DataFrame, by: Sequence[str] = ("dataset", "model", "fold")) -> DataFrame:
    """(by..., trials, failures): failed fits stay in the log and are only left out of the selection."""
    return trials.groupBy(*[c(b) for b in by]).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col("failed")).alias("failures")
    )
