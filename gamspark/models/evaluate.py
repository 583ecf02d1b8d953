"""Nested evaluation: candidates on an inner split, the best one refitted and tested on the outer fold."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators import clean, encode, metrics, split
from ..operators.hpo import drop_invalid_configs, expand_grid, select_best, typed_params
from ..session import cut_lineage
from .additive import Fitted
from .boosting import fit_binned_boosting
from .fused import fit_fused
from .hidden import fit_hidden_gam
from .histograms import fit_newton_boosting
from .linear import fit_elastic_net, fit_logistic, fit_ridge
from .smooth import fit_smooth_gam
from .spline import fit_regression_spline, fit_spline_gam
from .trees import fit_boosted_trees, fit_forest, fit_perceptron, fit_tree

TRIAL_SCHEMA = (
    "dataset string, model string, fold int, config_id int, params map<string,string>, loss double, seconds double, "
    "failed boolean, message string"
)
REPORT_SCHEMA = "dataset string, model string, fold int, row string, metric string, value double"
SCHEMAS = {"trials": TRIAL_SCHEMA, "reports": REPORT_SCHEMA}


def _no_task(fit):
    def run(df, target, numeric, categorical, task, **params):
        return fit(df, target, numeric, categorical, **params)

    return run


def _logistic(df, target, numeric, categorical, task, **params):
    if task != "classification":
        raise ValueError("logistic regression needs class labels")
    return fit_logistic(df, target, numeric, categorical, **params)


FITS: dict[str, Callable[..., Fitted]] = {
    "logistic": _logistic,
    "elastic_net": _no_task(fit_elastic_net),
    "ridge": _no_task(fit_ridge),
    "tree": fit_tree,
    "forest": fit_forest,
    "boosted_trees": fit_boosted_trees,
    "newton_boosting": fit_newton_boosting,
    "stump_gam": lambda *a, **k: fit_boosted_trees(*a, **{**k, "max_depth": 1}),
    "perceptron": lambda df, target, numeric, categorical, task, **k: fit_perceptron(df, target, numeric, categorical, **k),
    "spline_gam": fit_spline_gam,
    "regression_spline": fit_regression_spline,
    "smooth_gam": fit_smooth_gam,
    "binned_boosting": fit_binned_boosting,
    "fused": fit_fused,
    "hidden_boosting": fit_hidden_gam,
}


@dataclass
class Trial:
    config_id: int
    params: dict
    loss: float | None
    seconds: float
    failed: bool
    message: str = ""
    model: Fitted | None = None

    def row(self, dataset: str, name: str, fold: int) -> tuple:
        text = {k: str(v) for k, v in self.params.items()}
        return dataset, name, fold, self.config_id, text, self.loss, self.seconds, self.failed, self.message


def run_trial(fit, train: DataFrame, val: DataFrame, target: str, numeric, categorical, task: str, config_id: int, params: dict) -> Trial:
    """Fits and scores one configuration; a failed fit is recorded instead of ending the search, an error in scoring is not."""
    start = time.perf_counter()
    try:
        model = fit(train, target, numeric, categorical, task, **params)
    except Exception as error:  # noqa: BLE001 - the trial log keeps the message
        return Trial(config_id, params, None, time.perf_counter() - start, True, f"{type(error).__name__}: {error}")
    seconds = time.perf_counter() - start
    return Trial(config_id, params, model.loss(val, target), seconds, False, model=model)


class TrialStore:
    """Finished trials and fold reports in a folder, so that a search that broke off goes on where it was.

    Every trial, and every report of a model on a fold, is a table of its own below a name made from its key, parameters included. It
    counts once Spark has committed it, and writing it again changes nothing. A changed grid or seed therefore finds only what is
    the same. ``folder`` must be one that a later driver sees.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.lock = threading.Lock()
        self.rows: dict[str, dict[str, list[tuple]]] = {"trials": {}, "reports": {}}
        for kind, schema in SCHEMAS.items():
            for r in self._table(kind, schema).collect():  # a row per trial and report line
                values = tuple(r)
                self.rows[kind].setdefault(values[0], []).append(values[1:])

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _table(self, kind: str, schema: str) -> DataFrame:
        whole = f"store_key string, {schema}"
        root = self._path(f"{self.folder}/{kind}")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return self.spark.createDataFrame([], whole)
        done = [str(s.getPath()) for s in files.listStatus(root) if files.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return self.spark.read.schema(whole).parquet(*done) if done else self.spark.createDataFrame([], whole)

    @staticmethod
    def key(*parts) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, kind: str, key: str) -> list[tuple] | None:
        return self.rows[kind].get(key)

    def put(self, kind: str, key: str, rows: Sequence[tuple]) -> None:
        frame = self.spark.createDataFrame([(key, *r) for r in rows], f"store_key string, {SCHEMAS[kind]}")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{kind}/{key}")
        with self.lock:
            self.rows[kind][key] = [tuple(r) for r in rows]

    def trials(self) -> DataFrame:
        """All finished trials."""
        return self._table("trials", TRIAL_SCHEMA).drop("store_key")


def grid_search(fit, train: DataFrame, val: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str],
                task: str, candidates: Sequence[dict], parallelism: int = 2, store: TrialStore | None = None,
                name: tuple[str, str, int] = ("", "", 0)) -> list[Trial]:
    """All candidates on the same frames. A few fits run at once, so that small ones share the cluster.

    With a ``store``, trials of (dataset, model, fold) ``name`` that it has are not run again (they come without a model), and each
    other is stored as soon as it is done.
    """
    def one(item):
        config_id, params = item
        key = TrialStore.key(*name, task, target, [*numeric], [*categorical], config_id, params)
        known = store.get("trials", key) if store else None
        if known:
            loss, seconds, failed, message = known[0][5:9]
            return Trial(config_id, params, loss, seconds, failed, message)
        done = run_trial(fit, train, val, target, numeric, categorical, task, config_id, params)
        if store:
            store.put("trials", key, [done.row(*name)])
        return done

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(inheritable_thread_target(train.sparkSession)(one), enumerate(candidates)))


def grid_candidates(grid: DataFrame, model: str, task: str) -> list[dict]:
    """Typed candidates of one model from grid rows (model, param, values): the product without combinations no solver accepts."""
    configs = drop_invalid_configs(expand_grid(grid.where(F.col("model") == model)), task=task)
    return [typed_params(r["params"]) for r in configs.orderBy("config_id").collect()]


def best_trial(trials: Sequence[Trial]) -> Trial:
    """Smallest loss, the first of equals; failed fits are skipped."""
    good = [t for t in trials if not t.failed and t.loss is not None and t.loss == t.loss]
    if not good:
        raise RuntimeError("every configuration failed: " + "; ".join(sorted({t.message for t in trials})))
    return min(good, key=lambda t: (t.loss, t.config_id))


def retry_next_seed(run: Callable[[int], object], seed: int, step: int = 10, attempts: int = 10):
    """Result of the first seed that works: seed, seed+step, ..."""
    last = None
    for i in range(attempts):
        try:
            return run(seed + i * step), seed + i * step
        except Exception as error:  # noqa: BLE001 - the next split may work
            last = error
    raise RuntimeError(f"no seed worked in {attempts} attempts") from last


def fold_report(scored: DataFrame, target: str, task: str) -> list[tuple[str, str, float]]:
    """(row, metric, value) of one test fold."""
    if task == "regression":
        line = metrics.regression_report(scored, target, "prediction").first().asDict()
        return [("0", k, v) for k, v in line.items() if k not in ("n", "n_unscored")]
    out = []
    y = scored.withColumn("__y", c(target).cast("int")).withColumn("__p", F.col("prediction").cast("int"))
    for r in metrics.classification_report(y, "__y", "__p").collect():
        out += [(r["row"], k, r[n]) for k, n in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1_score"), ("support", "support"))]
    out.append(("accuracy", "ROC_AUC", metrics.roc_auc(y, "__y", "probability").first()[0]))
    return out


def nested_evaluation(
    df: DataFrame,
    dataset: str,
    key: Sequence[str],
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    task: str,
    grids: dict[str, Sequence[dict]],
    folds: int = 5,
    val_share: float = 0.25,
    seed: int = 42,
    parallelism: int = 2,
    store: TrialStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trials, reports) over outer folds. With a ``store``, what an earlier, broken evaluation has finished is not run again.

    Per fold: cleaning statistics and the target scale come from the training part only, candidates are
    compared on an inner split, the best configuration is refitted on all training rows. The folded frame
    is written out once; every fit of a fold reads the same cached part.
    """
    spark = df.sparkSession
    narrow = df.select(*[c(n) for n in dict.fromkeys([*key, *numeric, *categorical, target])])
    if task == "classification":
        folded = split.stratified_kfold(narrow, key, target, folds, seed)
    else:
        folded = split.kfold(narrow, key, folds, seed)
    folded = cut_lineage(folded)
    trials, reports = [], []
    for fold in range(folds):
        cleaner = clean.fit_cleaner(folded, numeric, categorical, train=F.col("fold") != fold)
        rows = cleaner.transform(folded, keep=[*[k for k in key if k not in (*numeric, *categorical)], target, "fold"])
        if task == "regression":
            rows = encode.standard_scale(rows.where(F.col("fold") != fold), [target]).transform(rows)
        whole, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        inner_key = [k for k in key if k in whole.columns]
        parts = split.train_val_split(whole, inner_key, val_share, target if task == "classification" else None).persist()
        train, val = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "val")
        for name, candidates in grids.items():
            own = (f"{dataset} {folds} {val_share} {seed}", name, fold) if store else (dataset, name, fold)
            done = grid_search(FITS[name], train, val, target, cleaner.numeric, cleaner.categorical, task, candidates, parallelism, store, own)
            trials += [t.row(dataset, name, fold) for t in done]
            if all(t.failed for t in done):  # the trials say why; the other models go on
                continue
            best = best_trial(done)
            stored = TrialStore.key(*own, task, target, cleaner.numeric, cleaner.categorical, [t.params for t in done])
            if store and store.get("reports", stored):
                reports += store.get("reports", stored)
                continue
            refit = run_trial(FITS[name], parts, parts, target, cleaner.numeric, cleaner.categorical, task, -1, best.params)
            if refit.failed:
                trials.append(refit.row(dataset, name, fold))
                continue
            lines = fold_report(refit.model.predict(test), target, task)
            seconds = [t.seconds for t in done if not t.failed]
            lines += [("timing", "timing_best_model", best.seconds), ("timing", "mean_timing_all_hpo_configs", sum(seconds) / len(seconds))]
            found = [(dataset, name, fold, row, metric, float(v)) for row, metric, v in lines if v is not None]
            reports += found
            if store:
                store.put("reports", stored, found)
        parts.unpersist()
    return spark.createDataFrame(trials, TRIAL_SCHEMA), spark.createDataFrame(reports, REPORT_SCHEMA)


def best_configs(trials: DataFrame) -> DataFrame:
    """(dataset, model, fold, config_id, loss, params) of the selected configurations."""
    return select_best(trials).join(
        trials.select("dataset", "model", "fold", "config_id", "params"), ["dataset", "model", "fold", "config_id"]
    )


def report_tables(spark: SparkSession, reports: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    from ..operators import reports as rp

    by = ("dataset", "model", "row", "metric")
    return rp.model_dataset_table(rp.metric_rows(rp.fold_mean_std(reports, by), metric), models)
