"""Readers for delimited data, fold reports, parameter files and rater grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import c

FOLD_PATH = r"/([a-z]+)/([A-Za-z_]+)_Folds/"
GRID_TYPE = "map<string,map<string,array<string>>>"


#: Texts that mean a missing value in delimited files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema=None, missing: Sequence[str] = MISSING, **options) -> DataFrame:
    """Delimited text with a header row. Without a schema every column stays text: no inference scan.

    Text cells that say ``missing`` become NULL.
    """
    reader = spark.read.option("header", True).option("sep", sep).options(**options)
    frame = (reader.schema(schema) if schema is not None else reader).csv(path)
    text = {f.name for f in frame.schema.fields if f.dataType.simpleString() == "string"}
    return frame.select(*[F.when(~c(n).isin(*missing), c(n)).alias(n) if n in text and missing else c(n) for n in frame.columns])


def keys_from_path(path: Column) -> tuple[Column, Column]:
    """(dataset, model) from a report path like .../<dataset>/<MODEL>_Folds/<file>."""
    return (
        F.regexp_extract(path, FOLD_PATH, 1).alias("dataset"),
        F.regexp_extract(path, FOLD_PATH, 2).alias("model"),
    )


def read_fold_reports(spark: SparkSession, folder: str, timing: bool = False) -> DataFrame:
    """All per-fold report files below ``folder`` as long rows (dataset, model, fold, row, metric, value).

    Report files differ in their columns, so each line is zipped with the header of its own file.
    """
    lines = spark.read.text(f"{folder}/*/*_Folds/*_Fold_*[0-9].csv").select(
        F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("cells")
    )
    is_timing = F.col("file").contains("/Timing_")
    lines = lines.where(is_timing if timing else ~is_timing)
    is_header = F.col("cells")[0] == ""
    header = lines.where(is_header).select("file", F.col("cells").alias("names"))
    cell = F.explode(F.arrays_zip(F.expr("slice(names, 2, size(names))"), F.expr("slice(cells, 2, size(cells))")))
    dataset, model = keys_from_path(F.col("file"))
    long = lines.where(~is_header).join(header, "file").select(
        dataset,
        model,
        F.regexp_extract("file", r"_Fold_(\d+)\.csv", 1).try_cast("int").alias("fold"),
        F.col("cells")[0].alias("row"),
        cell.alias("cell"),
    )
    return long.select(
        "dataset", "model", "fold", "row", F.col("cell")["0"].alias("metric"),
        F.col("cell")["1"].try_cast("double").alias("value"),
    ).where(F.col("value").isNotNull())


def read_param_grid(df: DataFrame, json_col: str) -> DataFrame:
    """Grid JSON {model: {parameter: [values]}} to rows (model, param, values)."""
    parsed = df.select(*[c(n) for n in df.columns if n != json_col], F.from_json(c(json_col), GRID_TYPE).alias("__g"))
    models = parsed.select(*[c(n) for n in df.columns if n != json_col], F.explode("__g").alias("model", "__p"))
    return models.select("*", F.explode("__p").alias("param", "values")).drop("__p")


def read_param_cells(matrix: DataFrame, index: str) -> DataFrame:
    """Best-configuration matrix (one row per dataset, one column per model) to long rows.

    Empty cells and cells that are only a number are not configurations and are skipped.
    """
    models = [n for n in matrix.columns if n != index]
    long = matrix.unpivot([index], models, "model", "params") if len(models) > 1 else matrix.select(
        c(index), F.lit(models[0]).alias("model"), c(models[0]).alias("params")
    )
    text = F.trim(F.col("params"))
    return long.where(F.col("params").isNotNull() & (text != "") & text.try_cast("double").isNull()).withColumn(
        "params", F.regexp_replace("params", "\n", "")
    )


def read_rater_blocks(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Rater grid text to (rater, unit, value).

    The file is a list of blocks separated by empty lines; the first cell of a block names the
    rater, the following lines hold ratings, '-' means missing. Such a grid is typed by hand, so
    one file is one split; several files are read in parallel.
    """
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
        .withColumn("empty", F.regexp_replace("text", f"[{sep}\\s]", "") == "")
    )
    by_file = Window.partitionBy("file").orderBy("line")
    blocks = lines.withColumn("block", F.sum(F.col("empty").cast("int")).over(by_file)).where(~F.col("empty"))
    in_block = Window.partitionBy("file", "block").orderBy("line")
    tagged = blocks.withColumn("at", F.row_number().over(in_block)).withColumn(
        "rater", F.first(F.split("text", sep)[0]).over(in_block)
    )
    cells = tagged.where(F.col("at") > 1).select(
        F.trim("rater").alias("rater"),
        (F.col("at") - 1).alias("item"),
        F.posexplode(F.slice(F.split("text", sep), 2, F.size(F.split("text", sep)))).alias("pos", "cell"),
    )
    return cells.select(
        "rater",
        F.concat_ws(":", F.col("item").cast("string"), F.col("pos").cast("string")).alias("unit"),
        F.when(F.trim("cell") != "-", F.trim("cell")).try_cast("double").alias("value"),
    )

