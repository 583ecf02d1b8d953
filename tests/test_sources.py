import json

import pytest
from pyspark.sql import functions as F

from gamspark.operators import clean
from gamspark.operators.agreement import krippendorff_alpha
from gamspark.sources import readers, writers
from gamspark.sources.spec import REGISTRY, drop_special_rows, find_spec, load_dataset


def test_registry():
    assert len(REGISTRY) == 22
    assert find_spec("bike_sharing").task == "regression" and find_spec("adult").target == "income"
    assert len(REGISTRY["mimic"].numeric) == 34
    with pytest.raises(ValueError):
        find_spec("nothing")


def test_loads_a_declared_csv(spark, tmp_path):
    (tmp_path / "data").mkdir()
    names = [*REGISTRY["bank"].numeric, *REGISTRY["bank"].categorical, "y"]
    lines = [";".join(names), ";".join(["1"] * 6 + ["a"] * 9 + ["yes"]), ";".join(["x"] * 6 + [""] * 9 + ["no"])]
    (tmp_path / "data" / "bank-full.csv").write_text("\n".join(lines))
    df, spec = load_dataset(spark, "bank", str(tmp_path))
    assert sorted(r["y"] for r in df.collect()) == [0, 1]
    out = clean.fit_cleaner(df, spec.numeric, spec.categorical).transform(df, keep=["y"])
    assert out.where(F.col("age").isNull() | F.col("job").isNull()).count() == 0
    assert {r["job"] for r in out.collect()} == {"a", "unknown"}


def test_difference_tokens_and_marker_rows(spark):
    crimes, spec = load_dataset(spark, "crimes", frame=spark.createDataFrame(
        [("1", "?", "0.5", "0.1")], "state string, county string, pop string, ViolentCrimesPerPop string"))
    assert spec.numeric == ("pop",) and crimes.first()["county"] is None
    fico = REGISTRY["fico"]
    names = [*fico.numeric, *fico.categorical]
    rows = [tuple(["-9"] * len(names) + ["Good"]), tuple(["-9"] * (len(names) - 1) + ["3", "Bad"])]
    df, spec = load_dataset(spark, "fico", frame=spark.createDataFrame(rows, [*names, "RiskPerformance"]))
    assert [r["RiskPerformance"] for r in drop_special_rows(df, spec).collect()] == [0]


def test_fold_reports_with_different_columns(spark, tmp_path):
    folder = tmp_path / "bike" / "TABNET_Folds"
    folder.mkdir(parents=True)
    (folder / "TABNET_Fold_1.csv").write_text(",RMSE,R2\n0,0.5,0.25\n")
    (folder / "TABNET_Fold_2.csv").write_text(",RMSE\n0,0.7\n")
    (folder / "TABNET_Fold_mean.csv").write_text(",0\nRMSE,0.6\n")
    (folder / "Timing_TABNET_Fold_1.csv").write_text(",model,timing_best_model\n0,TABNET,1.5\n")
    rows = {(r["model"], r["fold"], r["metric"]): r["value"] for r in readers.read_fold_reports(spark, str(tmp_path)).collect()}
    assert rows == {("TABNET", 1, "RMSE"): 0.5, ("TABNET", 1, "R2"): 0.25, ("TABNET", 2, "RMSE"): 0.7}
    timing = readers.read_fold_reports(spark, str(tmp_path), timing=True).collect()
    assert [(r["dataset"], r["metric"], r["value"]) for r in timing] == [("bike", "timing_best_model", 1.5)]


def test_rater_blocks_and_textbook_alpha(spark, tmp_path):
    ratings = {
        "A": "1 2 3 3 2 1 4 1 2 - - -", "B": "1 2 3 3 2 2 4 1 2 5 - 3",
        "C": "- 3 3 3 2 3 4 2 2 5 1 -", "D": "1 2 3 3 2 4 4 1 2 5 1 -",
    }
    blocks = []
    for name, line in ratings.items():
        v = line.split()
        blocks.append(f"{name};;;;\n" + "\n".join(";" + ";".join(v[i : i + 4]) for i in range(0, 12, 4)))
    (tmp_path / "grid.csv").write_text("\n;;;;\n".join(blocks))
    out = readers.read_rater_blocks(spark, str(tmp_path / "grid.csv"))
    assert out.count() == 48 and out.where("value IS NULL").count() == 7
    alpha = krippendorff_alpha(out).first()
    assert abs(alpha["alpha"] - 0.815) < 1e-3 and alpha["n"] == 40


def test_perfect_agreement(spark):
    df = spark.createDataFrame([(str(u), float(u % 4)) for u in range(40) for _ in range(3)], "unit string, value double")
    assert krippendorff_alpha(df).first()["alpha"] == 1.0


def test_grid_file_and_cells(spark):
    text = json.dumps({"DT": {"max_depth": [2, None, "x"]}, "LR": {"C": [0.1, 1]}})
    rows = readers.read_param_grid(spark.createDataFrame([(text,)], "g string"), "g").collect()
    assert {(r["model"], r["param"]): r["values"] for r in rows} == {("DT", "max_depth"): ["2", None, "x"], ("LR", "C"): ["0.1", "1"]}
    cells = spark.createDataFrame([("bike", "'a': 1\n", None), ("car", "3.5", "'b': 2")], "dataset string, DT string, LR string")
    assert sorted((r["dataset"], r["model"], r["params"]) for r in readers.read_param_cells(cells, "dataset").collect()) == [
        ("bike", "DT", "'a': 1"), ("car", "LR", "'b': 2")]


def test_latest_config_wins(spark, tmp_path):
    schema = "fold int, dataset string, model string, params string, written_at int"
    path = str(tmp_path / "log")
    writers.append_best_config(spark.createDataFrame([(1, "bike", "DT", "old", 1)], schema), path)
    writers.append_best_config(spark.createDataFrame([(1, "bike", "DT", "new", 2)], schema), path)
    assert writers.config_matrix(writers.latest_config(spark.read.parquet(path)), ["DT"]).first()["DT"] == "new"


def test_names():
    assert clean.clean_names(["a b", "a-b", "c"]) == ["a_b", "a_b_2", "c"]
    assert clean.clean_names(["x<3"], "trees") == ["xunder3"]
    assert clean.clean_names(["-a(b).c$"], "formula") == ["s_a_lq_b_rq__dot_c"]


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("1d",), ("abc",), ("NaN",), ("1e3",), (None,)], "x string")
    assert [r["x"] for r in clean.coerce_numeric(df, ["x"]).collect()] == [1.5, 2.0, None, None, None, 1000.0, None]


def test_cleaner_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, True), (100.0, False), (None, False)], "x double, train boolean")
    cleaner = clean.fit_cleaner(df, ["x"], [], train=F.col("train"))
    assert cleaner.medians == {"x": 2.0}
    assert sorted(r["x"] for r in cleaner.transform(df).collect()) == [1.0, 2.0, 3.0, 100.0]
