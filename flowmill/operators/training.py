"""Training, selection, calibration and experiments with MLlib, on datasets of label, split, weight and feature columns."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.operators.boosting import HistogramBoosting
from flowmill.operators.forest import DecisionTree, RandomForest
from flowmill.operators.evaluate import macro_metrics, threshold_choice, threshold_sweep
from flowmill.operators.flows import pad_overhead, pad_sizes


#: Strength of the logistic candidate's penalty is 1 / (this * rows); the deepest tree that MLlib grows.
STRENGTH, DEEPEST = 1.0, 30


def candidates(trees: int = 300, rounds: int = 200, depth: int = DEEPEST) -> dict:
    """Name to (rank of simplicity, estimator); a caller may replace any. Weights balance the classes for all but boosting. A
    logistic model without a penalty of its own gets its penalty from the number of rows when it is fitted."""
    how = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic": (0, LogisticRegression(weightCol="weight", maxIter=2000, **how)),
        "tree": (1, DecisionTree(depth, seed=7, weightCol="weight", **how)),
        "forest": (2, RandomForest(trees, depth, seed=7, weightCol="weight", **how)),
        "boosted": (3, HistogramBoosting(rounds=rounds, **how)),
    }


def balanced(rows: DataFrame) -> DataFrame:
    """rows with weight: n / (classes * rows of the class) over the train split."""
    n = rows.where("split = 'train'").groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = n.crossJoin(F.broadcast(total)).select("label", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(w), "label", "left").fillna(1.0, ["weight"])


def fit(rows: DataFrame, features: list[str], estimator) -> PipelineModel:
    train = balanced(rows).where("split = 'train'")
    if isinstance(estimator, LogisticRegression) and not estimator.isSet("regParam"):
        estimator = estimator.copy({estimator.regParam: 1 / (STRENGTH * max(train.count(), 1))})
    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator]
    return Pipeline(stages=steps).fit(train)


def score(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """One row for each of rows: key, truth, predicted, confidence, split; probabilities where the model has them, else
    its margins through a softmax. rows that lack a feature of the model are an error."""
    lacking = sorted(set(model.stages[0].getInputCols()) - set(rows.columns))
    if lacking:
        raise ValueError(f"the model needs columns {lacking}")
    out = model.transform(rows)
    p = "probability" if "probability" in out.columns else "rawPrediction"
    p = F.col(p) if out.schema[p].dataType.typeName() == "array" else vector_to_array(p)
    if "probability" not in out.columns:
        e = F.transform(p, lambda x: F.exp(x - F.array_max(p)))
        p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    return out.select(key, F.col("label").alias("truth"), F.col("prediction").cast("int").alias("predicted"), F.round(F.array_max(p), 6).alias("confidence"), F.transform(p, lambda x: F.round(x, 6)).alias("probabilities"), "split")


def _measured(scored: DataFrame) -> dict:
    """Macro measures of scored rows, from one pass over them."""
    return macro_metrics(scored.select("truth", "predicted")).first().asDict()


def compare(rows: DataFrame, features: list[str], key: str, models: dict) -> DataFrame:
    """name, rank, score (macro F1 on the validation split), error; a candidate that can't be fitted or scored is a row without
    a score that says why."""
    spark, table = rows.sparkSession, []
    for name, (rank, estimator) in models.items():
        value = error = None
        try:
            value = _measured(score(fit(rows, features, estimator), rows.where("split = 'validation'"), key))["macro_f1"]
        except (Py4JJavaError, PySparkException, ValueError) as e:  # the failure is the result
            error = f"{type(e).__name__}: {e}"
        table.append((name, rank, value, error))
    return spark.createDataFrame(table, "name string, rank int, score double, error string")


def ablation(rows: DataFrame, sets: dict[str, list[str]], key: str, estimator) -> DataFrame:
    """Macro F1 on the validation split with each set of features alone, and its distance from the first set's."""
    table = [(n, _measured(score(fit(rows, f, estimator), rows.where("split = 'validation'"), key))["macro_f1"]) for n, f in sets.items()]
    return rows.sparkSession.createDataFrame([(n, v, round(v - table[0][1], 6)) for n, v in table], "features string, macro_f1 double, delta double")


def importances(model: PipelineModel, features: list[str], groups: dict[str, str]) -> DataFrame:
    """Importance of each feature's group: of trees their importances, else mean absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficientMatrix.toArray()).mean(0)
    spark = SparkSession.active()
    df = spark.createDataFrame([(f, groups.get(f, "other"), float(v)) for f, v in zip(features, values)], "feature string, family string, importance double")
    return df.groupBy("family").agg(F.round(F.sum("importance"), 6).alias("importance"), F.count("*").alias("features"))



#: Rows of a class that sigmoid and isotonic calibration need: fixed values.
SIGMOID_ROWS, ISOTONIC_ROWS = 20, 100


def calibration_feasibility(rows: DataFrame, label: str) -> DataFrame:
    """For each class its rows, and which kinds of calibration they are enough for."""
    n = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return n.select("class", "n", (F.col("n") >= SIGMOID_ROWS).alias("sigmoid_ok"), (F.col("n") >= ISOTONIC_ROWS).alias("isotonic_ok"))


def disjoint(a: DataFrame, b: DataFrame, group: str) -> None:
    """ValueError if a group has rows on both sides."""
    shared = a.select(group).intersect(b.select(group)).limit(3).collect()
    if shared:
        raise ValueError(f"groups on both sides: {[r[0] for r in shared]}")


def latest_model(cards: DataFrame, family: str, model: str, made: str, schema: str | None = None, wanted: str | None = None) -> DataFrame:
    """The newest model of each family, of equal times the one with the highest id; with schema and wanted, only cards whose
    feature schema is the wanted one."""
    if schema is not None:
        cards = cards.where(F.col(schema) == wanted)
    return cards.groupBy(family).agg(F.max_by(model, F.struct(made, model)).alias("model"))


def feature_columns(rows: DataFrame, wanted: list[str], shortcuts: tuple[str, ...] = ()) -> list[str]:
    """Those of the wanted columns that rows has, in the order wanted, without the shortcuts: columns that give the label
    away."""
    return [c for c in wanted if c in rows.columns and c not in shortcuts]


# Columns that are never features, and parts of names that give an answer away.
FORBIDDEN = (
    "traffic_class", "label", "traffic_label", "traffic_type", "class", "class_label", "class_name", "application", "application_label", "app_label", "ground_truth", "label_basis", "experiment", "experiment_id",
    "experiment_name", "split", "split_key", "capture", "capture_id", "capture_filename", "capture_path", "pcap", "pcap_path", "output", "output_path", "manifest",
)
MARKERS = ("label", "ground_truth", "truth", "class", "traffic_type", "application")


def leakage_audit(columns: list[str], allowed: list[str], shortcuts: tuple[str, ...]) -> list[tuple[str, str]]:
    """Columns that must not be features, each with its first reason: a shortcut, forbidden by name whatever is allowed, named
    after the answer and not allowed, or not allowed."""
    def reason(c: str) -> str | None:
        if c in shortcuts:
            return "shortcut"
        if c in FORBIDDEN:
            return "forbidden"
        if c in allowed:
            return None
        return "named after the answer" if any(m in c.lower() for m in MARKERS) else "not allowed"

    return [(c, r) for c in columns if (r := reason(c))]


def calibrate(scores: DataFrame, key: str, classes: int, method: str = "sigmoid", applied: tuple[str, ...] = ("test",), among: list[int] | None = None) -> DataFrame:
    """One-against-rest calibration of probabilities, fitted on the validation split and scaled to sum to 1; for the rows
    of the splits in applied: key, truth, split, class, p. among: the classes there are, if not all."""
    long = scores.select(key, "truth", "split", F.posexplode("probabilities").alias("class", "p")).where(F.col("class") < classes)
    out, known = [], list(range(classes)) if among is None else among
    for c in known:
        one = long.where(F.col("class") == c).withColumn("hit", (F.col("truth") == c).cast("double"))
        x = VectorAssembler(inputCols=["p"], outputCol="x").transform(one)
        train = x.where("split = 'validation'")
        if method == "isotonic":
            q = IsotonicRegression(featuresCol="x", labelCol="hit").fit(train).transform(x).withColumn("q", F.col("prediction"))
        else:
            q = LogisticRegression(featuresCol="x", labelCol="hit", maxIter=50).fit(train).transform(x).withColumn("q", vector_to_array("probability")[1])
        out.append(q.where(F.col("split").isin(*applied)).select(key, "truth", "split", "class", "q"))
    every = out[0]
    for q in out[1:]:
        every = every.union(q)
    total = every.groupBy(key).agg(F.sum("q").alias("t"))
    return every.join(total, key).select(key, "truth", "split", "class", F.round(F.when(F.col("t") > 0, F.col("q") / F.col("t")).otherwise(1.0 / len(known)), 6).alias("p"))


def heldout_class(rows: DataFrame, features: list[str], key: str, held: int, estimator, thresholds: list[float]) -> DataFrame:
    """Trains without a class, calibrates on known validation rows if each class has enough of them, chooses the threshold
    on those rows, and says what happens to the class: all its rows, with the known rows of the test split."""
    known, model = F.col("label") != held, fit(rows.where(F.col("label") != held), features, estimator)
    validation = rows.where(known & (F.col("split") == "validation"))
    pool = rows.where(~known | (F.col("split") == "test")).withColumn("split", F.lit("test"))
    scored = score(model, validation.unionByName(pool), key)
    counts = {r["class"]: r["sigmoid_ok"] for r in calibration_feasibility(validation, "label").collect()}
    if counts and all(counts.values()):
        p = calibrate(scored, key, 1 + max(counts), applied=("validation", "test"), among=sorted(counts))
        best = F.max(F.struct("p", "class"))
        scored = p.groupBy(key).agg(F.first("truth").alias("truth"), F.first("split").alias("split"), best.alias("b")).select(key, "truth", "split", F.col("b.class").alias("predicted"), F.col("b.p").alias("confidence"))
    chosen = threshold_choice(threshold_sweep(scored.where("split = 'validation'"), thresholds, F.col("truth") != held))
    return threshold_sweep(scored.where("split = 'test'"), thresholds, F.col("truth") != held).join(chosen, "threshold")


def heldout_config(rows: DataFrame, features: list[str], key: str, held: F.Column, estimator, group: str | None = None) -> DataFrame:
    """Macro measures on configurations that training has not seen; an error if either side is empty, or, with group, if a
    group has rows on both sides."""
    inside, outside = rows.where(~held), rows.where(held)
    if inside.isEmpty() or outside.isEmpty():
        raise ValueError("both partitions need rows")
    if group is not None:
        disjoint(inside, outside, group)
    return macro_metrics(score(fit(inside.withColumn("split", F.lit("train")), features, estimator), outside, key))


class Countermeasure:
    """What hides traffic: a change of features, what it costs, and where its results come from. Subclasses give apply and
    overhead; those that stand for captured traffic set measured."""

    name, measured = "none", False

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows

    def overhead(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def describe(self) -> dict:
        return {"name": self.name, "provenance": "measured" if self.measured else "simulated", **vars(self)}

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.apply(rows)


class Padding(Countermeasure):
    """Sizes raised to a multiple of target, or to target."""

    name = "padding"

    def __init__(self, target: int, bucket: bool = True):
        if target <= 0:
            raise ValueError("target must be above 0")
        self.target, self.bucket = target, bucket

    def apply(self, rows: DataFrame) -> DataFrame:
        return pad_sizes(rows, self.target, self.bucket)

    def overhead(self, rows: DataFrame) -> DataFrame:
        return pad_overhead(rows, self.apply(rows))


def mitigation(rows: DataFrame, features: list[str], key: str, estimator, change, measured: bool = False, claim: bool = False) -> DataFrame:
    """Accuracy and macro F1 of an attacker on plain data, of the same on changed data, and of one trained on changed data;
    and how many rows the change touched. measured: change stands for what was captured, not for a computation on
    features; a result is claimed as an experiment (claim) only then, else it is an error."""
    if claim and not measured:
        raise ValueError("a simulated change gives no experimental evidence")
    changed = change(rows)
    told = changed.select(F.col(key).alias("_key"), F.struct(*features).alias("_new"))
    touched = rows.join(told, F.col(key) == F.col("_key")).where(~F.struct(*features).eqNullSafe(F.col("_new"))).count()
    plain, again = fit(rows, features, estimator), fit(changed, features, estimator)
    table = []
    for n, m, r in (("baseline", plain, rows), ("frozen", plain, changed), ("retrained", again, changed)):
        x = _measured(score(m, r.where("split = 'test'"), key))
        table.append((n, x["accuracy"], x["macro_f1"]))
    first = table[0]
    out = [(n, v, round(v - first[1], 6), f, round(f - first[2], 6), touched, "measured" if measured else "simulated") for n, v, f in table]
    return rows.sparkSession.createDataFrame(out, "attacker string, accuracy double, delta double, macro_f1 double, macro_f1_delta double, changed_rows long, provenance string")
