"""Declarations of the benchmark datasets and the generic loader.

A dataset is a plain declaration: where the file is, which columns are numeric or categorical, how
the target text becomes a number, and which rows or tokens are special. One loader serves all.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..operators import clean
from .readers import read_delimited

STATISTICS = ("mean", "std")


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    task: str
    path: str
    target: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    sep: str = ","
    target_map: dict[str, int] = field(default_factory=dict)
    null_tokens: tuple[str, ...] = ()
    drop_null_target: bool = False
    drop_rows_all_equal: float | None = None
    not_predictive: tuple[str, ...] = ()
    numeric_by_difference: bool = False

    def resolve(self, columns: list[str]) -> "DatasetSpec":
        """Fills the numeric list from the file's columns when it is declared as a difference."""
        if not self.numeric_by_difference:
            return self
        names = clean.feature_set_difference(columns, self.not_predictive)
        return replace(self, numeric=tuple(names), numeric_by_difference=False)


# File names, feature roles and target codes of the 22 datasets.
SPECS = [
    DatasetSpec(
        "water", "classification", "data/water_potability.csv", "Potability",
        numeric=("ph", "Hardness", "Solids", "Chloramines", "Sulfate", "Conductivity", "Organic_carbon",
                 "Trihalomethanes", "Turbidity"),
    ),
    DatasetSpec(
        "college", "classification", "data/college_data.csv", "will_go_to_college",
        numeric=("parent_age", "parent_salary", "house_area", "average_grades"),
        categorical=("type_school", "school_accreditation", "gender", "interest", "residence",
                     "parent_was_in_college"),
    ),
    DatasetSpec(
        "stroke", "classification", "data/healthcare-dataset-stroke-data.csv", "stroke",
        numeric=("age", "avg_glucose_level", "bmi"),
        categorical=("gender", "hypertension", "heart_disease", "ever_married", "work_type", "Residence_type",
                     "smoking_status"),
    ),
    DatasetSpec(
        "telco", "classification", "data/WA_Fn-UseC_-Telco-Customer-Churn.csv", "Churn",
        numeric=("tenure", "MonthlyCharges", "TotalCharges"),
        categorical=("gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
                     "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                     "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod"),
        target_map={"Yes": 1, "No": 0},
    ),
    DatasetSpec(
        "fico", "classification", "data/fico_heloc_dataset_v1.csv", "RiskPerformance",
        numeric=("ExternalRiskEstimate", "MSinceOldestTradeOpen", "MSinceMostRecentTradeOpen", "AverageMInFile",
                 "NumSatisfactoryTrades", "NumTrades60Ever2DerogPubRec", "NumTrades90Ever2DerogPubRec",
                 "PercentTradesNeverDelq", "MSinceMostRecentDelq", "NumTotalTrades", "NumTradesOpeninLast12M",
                 "PercentInstallTrades", "MSinceMostRecentInqexcl7days", "NumInqLast6M", "NumInqLast6Mexcl7days",
                 "NetFractionRevolvingBurden", "NetFractionInstallBurden", "NumRevolvingTradesWBalance",
                 "NumInstallTradesWBalance", "NumBank2NatlTradesWHighUtilization", "PercentTradesWBalance"),
        categorical=("MaxDelq2PublicRecLast12M", "MaxDelqEver"),
        target_map={"Good": 1, "Bad": 0},
        drop_rows_all_equal=-9.0,
    ),
    DatasetSpec(
        "adult", "classification", "data/adult_census_income.csv", "income",
        numeric=("age", "fnlwgt", "education.num", "capital.gain", "capital.loss", "hours.per.week"),
        categorical=("workclass", "education", "marital.status", "occupation", "relationship", "race", "sex",
                     "native.country"),
        target_map={" <=50K": 0, " >50K": 1},
    ),
    DatasetSpec(
        "bank", "classification", "data/bank-full.csv", "y",
        numeric=("age", "balance", "day", "campaign", "pdays", "previous"),
        categorical=("job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome"),
        sep=";",
        target_map={"yes": 1, "no": 0},
    ),
    DatasetSpec(
        "compas", "classification", "data/compas-scores-two-years.csv", "two_year_recid",
        numeric=("age", "juv_fel_count", "juv_misd_count", "juv_other_count", "priors_count",
                 "days_b_screening_arrest", "c_days_from_compas"),
        categorical=("sex", "age_cat", "race", "c_charge_degree", "c_charge_desc"),
    ),
    DatasetSpec(
        "airline", "classification", "data/airline_train.csv", "satisfaction",
        numeric=("Age", "Flight Distance", "Inflight wifi service", "Departure/Arrival time convenient",
                 "Ease of Online booking", "Gate location", "Food and drink", "Online boarding", "Seat comfort",
                 "Inflight entertainment", "On-board service", "Leg room service", "Baggage handling",
                 "Checkin service", "Inflight service", "Cleanliness", "Departure Delay in Minutes",
                 "Arrival Delay in Minutes"),
        categorical=("Gender", "Customer Type", "Type of Travel", "Class"),
        target_map={"satisfied": 1, "neutral or dissatisfied": 0},
    ),
    DatasetSpec(
        "weather", "classification", "data/weatherAUS.csv", "RainTomorrow",
        numeric=("MinTemp", "MaxTemp", "Rainfall", "Evaporation", "Sunshine", "WindGustSpeed", "WindSpeed9am",
                 "WindSpeed3pm", "Humidity9am", "Humidity3pm", "Pressure9am", "Pressure3pm", "Cloud9am", "Cloud3pm",
                 "Temp9am", "Temp3pm"),
        categorical=("Location", "WindGustDir", "WindDir9am", "WindDir3pm", "RainToday"),
        target_map={"No": 0, "Yes": 1},
        drop_null_target=True,
    ),
    DatasetSpec(
        "car", "regression", "data/car.data", "price",
        numeric=("wheel-base", "length", "width", "height", "curb-weight", "engine-size", "bore", "stroke",
                 "compression-ratio", "horsepower", "peak-rpm", "city-mpg", "highway-mpg"),
        categorical=("symboling", "make", "fuel-type", "aspiration", "num-of-doors", "body-style", "drive-wheels",
                     "engine-location", "engine-type", "num-of-cylinders", "fuel-system"),
        null_tokens=("?",),
    ),
    DatasetSpec(
        "student", "regression", "data/student-por.csv", "G3",
        numeric=("age", "Medu", "Fedu", "traveltime", "studytime", "failures", "famrel", "freetime", "goout", "Dalc",
                 "Walc", "health", "absences"),
        categorical=("school", "sex", "address", "famsize", "Pstatus", "Mjob", "Fjob", "reason", "guardian",
                     "schoolsup", "famsup", "paid", "activities", "nursery", "higher", "internet", "romantic"),
        sep=";",
    ),
    DatasetSpec(
        "productivity", "regression", "data/garments_worker_productivity.csv", "actual_productivity",
        numeric=("targeted_productivity", "smv", "wip", "over_time", "incentive", "idle_time", "idle_men",
                 "no_of_style_change", "no_of_workers"),
        categorical=("quarter", "department", "day", "team"),
    ),
    DatasetSpec(
        "medical", "regression", "data/insurance.csv", "charges",
        numeric=("age", "bmi", "children"),
        categorical=("sex", "smoker", "region"),
    ),
    DatasetSpec(
        "crimes", "regression", "data/communities.data", "ViolentCrimesPerPop",
        null_tokens=("?",),
        numeric_by_difference=True,
        not_predictive=("state", "county", "community", "communityname string", "fold", "ViolentCrimesPerPop"),
    ),
    DatasetSpec(
        "crab", "regression", "data/CrabAgePrediction.csv", "Age",
        numeric=("Length", "Diameter", "Height", "Weight", "Shucked Weight", "Viscera Weight", "Shell Weight"),
        categorical=("Sex",),
    ),
    DatasetSpec(
        "wine", "regression", "data/winequality-white.csv", "quality",
        numeric=("fixed acidity", "volatile acidity", "citric acid", "residual sugar", "chlorides",
                 "free sulfur dioxide", "total sulfur dioxide", "density", "pH", "sulphates", "alcohol"),
        sep=";",
    ),
    DatasetSpec(
        "bike", "regression", "data/bike.csv", "cnt",
        numeric=("mnth", "hr", "temp", "atemp", "hum", "windspeed", "weekday"),
        categorical=("season", "yr", "holiday", "workingday", "weathersit"),
    ),
    DatasetSpec(
        "housing", "regression", "data/cal_housing.data", "medianHouseValue",
        numeric=("longitude", "latitude", "housingMedianAge", "totalRooms", "totalBedrooms", "population",
                 "households", "medianIncome"),
    ),
    DatasetSpec(
        "diamond", "regression", "data/Diamonds Prices2022.csv", "price",
        numeric=("carat", "depth", "table", "x", "y", "z"),
        categorical=("cut", "color", "clarity"),
    ),
    DatasetSpec(
        "mimic", "classification", "data/IHM-complete.csv", "target",
        numeric=tuple(
            f"{measure}+100%{stat}"
            for measure in (
                "Capillary refill rate", "Diastolic blood pressure", "Fraction inspired oxygen",
                "Glascow coma scale eye opening", "Glascow coma scale motor response", "Glascow coma scale total",
                "Glascow coma scale verbal response", "Glucose", "Heart Rate", "Height", "Mean blood pressure",
                "Oxygen saturation", "Respiratory rate", "Systolic blood pressure", "Temperature", "Weight", "pH",
            )
            for stat in STATISTICS
        ),
    ),
    DatasetSpec(
        "diabetes", "regression", "data/diabetes.csv", "Progression",
        numeric=("Age", "Bmi", "Bp", "Tc", "Ldl", "Hdl", "Tch", "Ltg", "Glu"),
        categorical=("Sex",),
    ),
]

REGISTRY = {spec.name: spec for spec in SPECS}


def find_spec(name: str) -> DatasetSpec:
    """The declared dataset whose name occurs in ``name`` (the longest one when several do)."""
    hits = [spec for key, spec in REGISTRY.items() if key in name.lower()]
    if not hits:
        raise ValueError(f"no dataset is declared for {name!r}; known: {', '.join(REGISTRY)}")
    return max(hits, key=lambda spec: len(spec.name))


def load_dataset(
    spark: SparkSession,
    dataset: str | DatasetSpec,
    base: str = ".",
    frame: DataFrame | None = None,
) -> tuple[DataFrame, DatasetSpec]:
    """Reads a declared dataset (or takes ``frame``) and applies its own row and target rules.

    Everything that needs statistics (imputation, column drops) is left to ``clean.fit_cleaner``.
    """
    spec = dataset if isinstance(dataset, DatasetSpec) else find_spec(dataset)
    if frame is None:
        path = f"{base}/{spec.path}"
        frame = spark.read.parquet(path) if path.endswith(".parquet") else read_delimited(spark, path, spec.sep)
    spec = spec.resolve(frame.columns)
    if spec.null_tokens:
        frame = clean.null_tokens(frame, spec.null_tokens)
    if spec.target_map:
        frame = clean.map_target(frame, spec.target, spec.target_map)
    else:
        frame = frame.withColumn(spec.target, c(spec.target).try_cast("double"))
        if spec.task == "classification":
            frame = frame.withColumn(spec.target, c(spec.target).cast("int"))
    if spec.drop_null_target:  # after the map, so that an unknown label is a missing one
        frame = clean.drop_null_target(frame, spec.target)
    keys = [n for n in frame.columns if n not in {*spec.numeric, *spec.categorical, spec.target}]
    for name in spec.categorical:
        frame = frame.withColumn(name, c(name).cast("string"))
    return frame.select(*[c(n) for n in (*keys, *spec.numeric, *spec.categorical, spec.target)]), spec


def drop_special_rows(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Row rule that applies after cleaning: every feature equals the declared marker."""
    if spec.drop_rows_all_equal is None:
        return df
    names = [n for n in (*spec.numeric, *spec.categorical) if n in df.columns]
    return clean.drop_all_equal(df, names, spec.drop_rows_all_equal)
