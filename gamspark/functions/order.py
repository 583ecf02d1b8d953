"""Ranks, prefix sums and order statistics that never put all rows into one task.

* ``exact_rank`` ranks rows by a hash key: the leading hex digits of the key are balanced buckets.
* ``value_prefix`` sums measures over all smaller values: values are aggregated first (a hot value
  becomes one row) and then partitioned by range; the partition is the bucket.
* ``hash_thresholds`` finds the k-th smallest hash of each of several seeds by counting leading digits.
* ``exact_quantiles`` selects order statistics by narrowing a bracket: each pass is one aggregate
  over bounded sketches, without any shuffle of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .scalars import c
from .small import reused


def exact_rank(
    df: DataFrame,
    order_col: str,
    within: Sequence[str] = (),
    name: str = "rank",
    digits: int = 4,
    total: str | None = None,
) -> DataFrame:
    """1-based rank by a unique hex hash column, over all rows or within groups.

    The offset table has at most 16**digits rows per group; ``total`` names an optional column
    with the group size. Raise ``digits`` when rows / 16**digits no longer sorts in one task.
    """
    within = list(within)
    bucketed = df.withColumn("__b", F.substring(c(order_col), 1, digits))
    sizes = bucketed.groupBy(*[c(w) for w in within], "__b").agg(F.count(F.lit(1)).alias("__n"))
    part = Window.partitionBy(*[c(w) for w in within]) if within else Window.partitionBy(F.lit(0))
    before = part.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[c(w).alias(f"__w{i}") for i, w in enumerate(within)],
        F.col("__b").alias("__ob"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(part).alias("__total"),
    )
    inside = Window.partitionBy(*[c(w) for w in within], "__b").orderBy(c(order_col))
    ranked = bucketed.withColumn("__rn", F.row_number().over(inside))
    on = F.col("__b") == F.col("__ob")
    for i, w in enumerate(within):
        on = on & c(w).eqNullSafe(F.col(f"__w{i}"))
    joined = ranked.join(offsets, on, "inner").withColumn(name, F.col("__rn") + F.col("__off"))
    if total:
        joined = joined.withColumn(total, F.col("__total"))
    return joined.drop("__b", "__ob", "__rn", "__off", "__total", *[f"__w{i}" for i in range(len(within))])


RANGE_ROWS = 1 << 20
SMALL_RANGE_ROWS = 1 << 15


THRESHOLD_DIGITS = 2
THRESHOLD_ROWS = 4096


def hash_thresholds(df: DataFrame, group: str, order_col: str, frac: float) -> dict:
    """group -> the ceil(frac * n)-th smallest hex hash of its n rows (None where that is 0). ``group`` has few values.

    A pass counts rows by the next THRESHOLD_DIGITS digits below each group's bracket, a common beginning of hashes; the digits that
    hold the wanted rank are appended. A bracket of THRESHOLD_ROWS rows or fewer, or of one repeated hash, is finished from its sorted
    hashes. Rows are only scanned: what is shuffled is 16**THRESHOLD_DIGITS counts a group and the last bracket.
    """
    found, prefix, rank, digits = {}, None, {}, 0
    while prefix is None or prefix:
        rows = df if prefix is None else df.where(F.substring(c(order_col), 1, digits) == by_group(group, prefix))
        step = F.substring(c(order_col), digits + 1, THRESHOLD_DIGITS).alias("d")
        counts: dict = {}
        for r in rows.groupBy(c(group).alias("g"), step).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["g"], []).append((r["d"], r["n"]))
        if prefix is None:
            prefix = dict.fromkeys(counts, "")
            rows_of = {g: sum(n for _, n in some) for g, some in counts.items()}
            rank = {g: min(n, math.ceil(frac * n)) for g, n in rows_of.items()}
            found = {g: None for g in counts if rank[g] < 1}
            prefix = {g: "" for g in counts if g not in found}
        last = {}
        for g in list(prefix):
            for digit, n in sorted(counts[g]):
                if rank[g] <= n:
                    break
                rank[g] -= n
            prefix[g] += digit
            if n <= THRESHOLD_ROWS or len(digit) < THRESHOLD_DIGITS:
                last[g] = prefix.pop(g)
        digits += THRESHOLD_DIGITS
        if last:
            few = df.where(c(order_col).startswith(by_group(group, last))).groupBy(c(group).alias("g"), c(order_col).alias("h"))
            hashes: dict = {}
            for r in few.agg(F.count(F.lit(1)).alias("n")).collect():
                hashes.setdefault(r["g"], []).append((r["h"], r["n"]))
            for g, some in hashes.items():
                for h, n in sorted(some):
                    if rank[g] <= n:
                        found[g] = h
                        break
                    rank[g] -= n
    return found


def by_group(group: str, values: dict) -> Column:
    """The value of the row's group, NULL for groups without one."""
    pairs = [F.lit(x) for g, v in values.items() if v is not None for x in (str(g), v)]
    return F.create_map(*pairs)[c(group).cast("string")] if pairs else F.lit(None).cast("string")


def value_ranges(df: DataFrame, key: str, ranges: int | None = None, name: str = "__vb") -> tuple[DataFrame, int]:
    """``df`` written to the shared folder with the number of its value range, which grows with ``key``; and how many ranges there are.

    Spark's range partitioning cuts the values, and the partition is the range: no cut list is kept, equal values share a range.
    ``df`` should hold each value a bounded number of times (aggregate first). Without ``ranges`` a range has about RANGE_ROWS rows,
    on small inputs fewer, so that all cores have one; an input of SMALL_RANGE_ROWS rows is one range and is not shuffled here.
    """
    rows = materialise(df)
    if ranges is None:
        n = rows.count()
        ranges = max(math.ceil(n / RANGE_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / SMALL_RANGE_ROWS)))
    if ranges <= 1:
        return rows.withColumn(name, F.lit(0)), 1
    return materialise(rows.repartitionByRange(ranges, c(key)).withColumn(name, F.spark_partition_id())), ranges


def value_prefix(
    df: DataFrame,
    key: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Per (group, value): the measures and ``<measure>_below``, their sum over smaller values.

    Measures must be sums or counts. NULL and NaN keys are left out. Ranges hold about RANGE_ROWS pairs of group and value,
    whatever group they belong to: one hot group is spread over all ranges, and a hot value is one row. Sums inside a range and
    sums of whole ranges add up to the result.
    """
    by = list(by)
    source = df.where(c(key).isNotNull() & ~F.isnan(c(key).cast("double")))
    totals = source.groupBy(*[c(b) for b in by], c(key)).agg(*[m.alias(n) for n, m in measures.items()])
    totals, ranges = value_ranges(totals, key, buckets)
    group = [c(b) for b in by] or [F.lit(0)]
    inside = Window.partitionBy(*group, "__vb").orderBy(c(key)).rowsBetween(Window.unboundedPreceding, -1)
    below = {n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in measures}
    if ranges == 1:
        return totals.withColumns({f"{n}_below": b for n, b in below.items()}).drop("__vb")
    earlier = Window.partitionBy(*group).orderBy("__vb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.groupBy(*[c(b) for b in by], "__vb").agg(*[F.sum(n).alias(f"__s_{n}") for n in measures])
    base = base.select(
        *[c(b).alias(f"__g{i}") for i, b in enumerate(by)], F.col("__vb").alias("__ob"),
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in measures],
    )
    on = F.col("__vb") == F.col("__ob")
    for i, b in enumerate(by):
        on = on & c(b).eqNullSafe(F.col(f"__g{i}"))
    out = totals.withColumns({f"{n}_below": b for n, b in below.items()}).join(base, on)
    out = out.withColumns({f"{n}_below": F.col(f"{n}_below") + F.col(f"__o_{n}") for n in measures})
    return out.drop("__vb", "__ob", *[f"__g{i}" for i in range(len(by))], *[f"__o_{n}" for n in measures])


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    collect_limit: int = 100_000,
    accuracy: int = 20_000,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles (position p*(n-1)) of numeric columns, NULLs ignored.

    Every wanted rank keeps a bracket of two data values. A pass counts the rows below, inside and
    on the ends of all brackets; a bracket with few rows (its share of ``collect_limit``) is finished from its distinct values, a
    larger one is replaced by a sketched bracket strictly inside it.
    """
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    with reused(df.select(*[c(n).cast("double").alias(n) for n in cols])) as rows:
        return _select_ranks(rows, cols, probs, collect_limit, accuracy)


def _select_ranks(df, cols, probs, collect_limit, accuracy) -> dict[str, list[float | None]]:
    eps = 4.0 / accuracy
    grid = [x for p in probs for x in (max(0.0, p - eps), min(1.0, p + eps))]
    aggs = []
    for i, name in enumerate(cols):
        x = c(name).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
            F.percentile_approx(x, grid, accuracy).alias(f"q{i}"),
        ]
    first = df.agg(*aggs).first()
    open_ranks, solved = {}, {}
    for i in range(len(cols)):
        n = first[f"n{i}"]
        for j, p in enumerate(probs):
            if n == 0:
                continue
            pos = p * (n - 1)
            for k in {math.floor(pos), math.ceil(pos)}:
                open_ranks[i, k] = {
                    "outer": (first[f"lo{i}"], first[f"hi{i}"]),
                    "lo": first[f"q{i}"][2 * j],
                    "hi": first[f"q{i}"][2 * j + 1],
                    "eps": eps,
                }
    while open_ranks:
        _count_pass(df, cols, open_ranks)
        few, many = {}, {}
        for (i, k), b in list(open_ranks.items()):
            if b["below"] > k or b["below"] + b["inside"] <= k:  # the sketch missed: widen
                b["lo"], b["hi"] = b["outer"]
                b["eps"] *= 8
                continue
            if b["below"] + b["at_lo"] > k:
                solved[i, k] = b["lo"]
            elif b["below"] + b["inside"] - b["at_hi"] <= k:
                solved[i, k] = b["hi"]
            elif b["inside"] - b["at_lo"] - b["at_hi"] <= max(1, collect_limit // len(open_ranks)):
                few[i, k] = b
                continue
            else:
                many[i, k] = b
                continue
            del open_ranks[i, k]
        if few:
            solved.update(_finish(df, cols, few))
            for key in few:
                del open_ranks[key]
        if many:
            _narrow(df, cols, many, accuracy)
    out = {}
    for i, name in enumerate(cols):
        out[name] = []
        for p in probs:
            n = first[f"n{i}"]
            if n == 0:
                out[name].append(None)
                continue
            low = math.floor(p * (n - 1))
            a, b = solved[i, low], solved[i, math.ceil(p * (n - 1))]
            out[name].append(a + (b - a) * (p * (n - 1) - low))
    return out


def _count_pass(df, cols, brackets) -> None:
    aggs = []
    for (i, _), b in brackets.items():
        x, lo, hi = c(cols[i]).cast("double"), F.lit(b["lo"]), F.lit(b["hi"])
        aggs += [F.count_if(x < lo), F.count_if(x.between(lo, hi)), F.count_if(x == lo), F.count_if(x == hi)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    for pos, b in enumerate(brackets.values()):
        b["below"], b["inside"], b["at_lo"], b["at_hi"] = row[4 * pos : 4 * pos + 4]


def _finish(df, cols, brackets) -> dict:
    """Order statistics from the (few) values strictly inside each bracket."""
    items = list(brackets.items())
    tagged = []
    for pos, ((i, _), b) in enumerate(items):
        x = c(cols[i]).cast("double")
        inside = (x > F.lit(b["lo"])) & (x < F.lit(b["hi"]))
        tagged.append(F.when(inside, F.struct(F.lit(pos).alias("b"), x.alias("x"))))
    rows = (
        df.select(F.explode(F.array_compact(F.array(*tagged))).alias("t"))
        .groupBy(F.col("t.b").alias("b"), F.col("t.x").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    out = {}
    for pos, ((i, k), b) in enumerate(items):
        seen = b["below"] + b["at_lo"]
        for row in sorted((r for r in rows if r["b"] == pos), key=lambda r: r["x"]):
            seen += row["n"]
            if k < seen:
                out[i, k] = row["x"]
                break
    return out


def _narrow(df, cols, brackets, accuracy) -> None:
    """Replaces each bracket by a sketched one around the wanted rank, strictly inside it."""
    items = list(brackets.items())
    aggs = []
    for (i, k), b in items:
        x = c(cols[i]).cast("double")
        p = (k - b["below"] - b["at_lo"]) / (b["inside"] - b["at_lo"] - b["at_hi"])
        inside = F.when((x > F.lit(b["lo"])) & (x < F.lit(b["hi"])), x)
        aggs.append(F.percentile_approx(inside, [max(0.0, p - b["eps"]), min(1.0, p + b["eps"])], accuracy))
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    for (_, b), (lo, hi) in zip(items, row):
        b["outer"], b["lo"], b["hi"] = (b["lo"], b["hi"]), lo, hi
