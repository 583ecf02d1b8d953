"""Every family as an estimator and model of Spark's own machine learning library: in pipelines, cross-validation, saved and loaded.

What is saved are the parameters, the fitted model as JSON (bases, coefficients, trees) and, for Spark's own trees, their files.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from ..operators import encode
from . import additive, bagging, design, hidden, histograms, smooth, trees
from .additive import TASKS, Fitted
from .evaluate import FITS

TYPES = {
    kind.__name__: kind
    for kind in (
        design.Constant, design.Linear, design.Levels, design.Bins, design.PairBins, design.Spline, design.Hidden, design.HiddenPair, design.Design,
        smooth.Smooth, additive.AdditiveModel, bagging.BaggedModel, bagging.SubspaceEnsemble, hidden.HiddenModel, hidden.EncodedHidden,
        histograms.Binning, histograms.Tree, histograms.HistogramModel, trees.TreeModel, encode.OneHot, encode.Scaler, encode.ColumnTransformer,
    )
}


def pack(x):
    """A fitted model as plain JSON values; a model of Spark's is only named."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return {"~array": x.dtype.str, "shape": list(x.shape), "values": x.ravel().tolist()}
    if isinstance(x, tuple):
        return {"~tuple": [pack(v) for v in x]}
    if isinstance(x, list):
        return [pack(v) for v in x]
    if isinstance(x, dict):
        return {"~dict": [[pack(k), pack(v)] for k, v in x.items()]}
    if isinstance(x, Model):
        return {"~spark": type(x).__name__}
    if dataclasses.is_dataclass(x) and type(x).__name__ in TYPES:
        return {"~type": type(x).__name__, "fields": {f.name: pack(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    raise TypeError(f"{type(x).__name__} cannot be saved")


def unpack(x, spark_model=None):
    if isinstance(x, list):
        return [unpack(v, spark_model) for v in x]
    if not isinstance(x, dict):
        return x
    if "~array" in x:
        return np.array(x["values"], dtype=np.dtype(x["~array"])).reshape(x["shape"])
    if "~tuple" in x:
        return tuple(unpack(v, spark_model) for v in x["~tuple"])
    if "~dict" in x:
        return {unpack(k, spark_model): unpack(v, spark_model) for k, v in x["~dict"]}
    if "~spark" in x:
        return spark_model(x["~spark"])
    return TYPES[x["~type"]](**{k: unpack(v, spark_model) for k, v in x["fields"].items()})


def save_fitted(spark: SparkSession, model: Fitted, path: str) -> None:
    """Writes a fitted model below ``path``."""
    spark.createDataFrame([(json.dumps(pack(model)),)], "model string").coalesce(1).write.parquet(f"{path}/data")
    if isinstance(model, trees.TreeModel):
        model.model.write().save(f"{path}/spark")


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    text = spark.read.schema("model string").parquet(f"{path}/data").first()["model"]

    def spark_model(name: str) -> Model:
        return (getattr(mlr, name, None) or getattr(mlc, name)).load(f"{path}/spark")

    return unpack(json.loads(text), spark_model)


class _Settings(Params):
    family = Param(Params._dummy(), "family", "name of the family, one of evaluate.FITS", typeConverter=TypeConverters.toString)
    target = Param(Params._dummy(), "target", "column to predict", typeConverter=TypeConverters.toString)
    numeric = Param(Params._dummy(), "numeric", "numeric features", typeConverter=TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "features with levels", typeConverter=TypeConverters.toListString)
    task = Param(Params._dummy(), "task", "regression or classification", typeConverter=TypeConverters.toString)
    options = Param(Params._dummy(), "options", "parameters of the family, by name")

    def __init__(self):
        super().__init__()
        self._setDefault(family="spline_gam", target="label", numeric=[], categorical=[], task="regression", options={})


class GamEstimator(_Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one of the families. ``options`` are its parameters; a grid over whole ``options`` searches them.

    The model adds raw, prediction and, for classes, probability (a number, that of class 1).
    """

    @keyword_only
    def __init__(self, *, family: str | None = None, target: str | None = None, numeric: list[str] | None = None,
                 categorical: list[str] | None = None, task: str | None = None, options: dict | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "GamModel":
        get = self.getOrDefault
        if get("family") not in FITS:
            raise ValueError(f"family must be one of {sorted(FITS)}, not {get('family')!r}")
        if get("task") not in TASKS:
            raise ValueError(f"task must be one of {TASKS}, not {get('task')!r}")
        fitted = FITS[get("family")](dataset, get("target"), get("numeric"), get("categorical"), get("task"), **get("options"))
        return self._copyValues(GamModel(fitted))


class GamModel(_Settings, Model, MLReadable, MLWritable):
    """A fitted family: ``fitted`` has its effects, coefficients and surfaces."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: GamModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 - the library's name
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        save_fitted(spark, self.instance.fitted, path)


class _Reader(MLReader):
    def load(self, path: str) -> GamModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = GamModel(load_fitted(spark, path))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
