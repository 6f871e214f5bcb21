"""Classifier evaluation, calibration and open-world decisions.

scores: row_id, truth, class, p in long form, one row for each row and class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.columns import first_reason, ratio, reasons, rounded


def top_label(scores: DataFrame) -> DataFrame:
    """The most probable class of each row; of equal ones the largest name."""
    best = F.max(F.struct("p", "class"))
    return scores.groupBy("row_id").agg(F.first("truth").alias("truth"), best.alias("b")).select("row_id", "truth", F.col("b.class").alias("predicted"), F.col("b.p").alias("confidence"))


def ranked(scores: DataFrame) -> DataFrame:
    """Top two classes of each row and their margin; of equal ones the smallest name first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "class")))
    best = scores.groupBy("row_id").agg(F.first("truth").alias("truth"), order.alias("o"))
    one, two = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    return best.select("row_id", "truth", one["class"].alias("top1"), (-one["m"]).alias("p1"), two["class"].alias("top2"), (-two["m"]).alias("p2"), F.round(F.coalesce(two["m"] - one["m"], -one["m"]), 6).alias("margin"))


def entropy_bits(scores: DataFrame) -> DataFrame:
    return scores.groupBy("row_id").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)), 6).alias("entropy"))


def brier(scores: DataFrame) -> DataFrame:
    hit = (F.col("class") == F.col("truth")).cast("double")
    return scores.groupBy("row_id").agg(F.sum(F.pow(F.col("p") - hit, 2)).alias("s")).agg(F.round(F.avg("s"), 6).alias("brier"))


def log_loss(scores: DataFrame, least: float = 1e-15) -> DataFrame:
    own = scores.where(F.col("class") == F.col("truth"))
    return own.agg(F.round(F.avg(-F.ln(F.greatest(F.col("p"), F.lit(least)))), 6).alias("log_loss"))


def reliability_curve(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy in equal bins of the top label's confidence; empty bins are left out."""
    t = top_label(scores).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"))
    return t.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg((F.col("predicted") == F.col("truth")).cast("double")), 6).alias("accuracy"))


def ece(scores: DataFrame, bins: int = 10) -> DataFrame:
    c = reliability_curve(scores, bins)
    return c.agg(F.round(ratio(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))), F.sum("n")), 6).alias("ece"))


def confidence_block(scores: DataFrame) -> DataFrame:
    e = entropy_bits(scores).agg(F.round(F.avg("entropy"), 6).alias("mean_entropy"))
    return brier(scores).crossJoin(log_loss(scores)).crossJoin(ece(scores)).crossJoin(e)


def calibration_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each measure before and after, and the difference."""
    names = ("brier", "ece", "log_loss", "mean_entropy")
    rows = lambda df, v: confidence_block(df).unpivot([], list(names), "measure", v)
    return rows(before, "before").join(rows(after, "after"), "measure").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def _counted(labels: DataFrame, declared: list | None = None) -> DataFrame:
    """One row from one pass over labels: pairs (array of truth, predicted, n: every pair of classes that occurs, and 0 for each
    pair that may), rows and hits. Pairs of classes are few, whatever the rows."""
    n = labels.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    hit = F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.lit(0))
    one = n.agg(F.collect_list(F.struct("truth", "predicted", "n")).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), hit.alias("hits"))
    kind = labels.schema["truth"].dataType
    seen = F.array_distinct(F.concat(F.transform("m", lambda x: x["truth"]), F.transform("m", lambda x: x["predicted"].cast(kind))))
    classes = F.filter(seen, lambda c: c.isNotNull()) if declared is None else F.array(*(F.lit(c).cast(kind) for c in dict.fromkeys(declared)))
    one = one.withColumn("c", classes)
    none = F.flatten(F.transform("c", lambda a: F.transform("c", lambda b: F.struct(a.alias("truth"), b.alias("predicted"), F.lit(0).cast("long").alias("n")))))
    own = F.filter("m", lambda x: F.array_contains("c", x["truth"]) & F.array_contains("c", x["predicted"]))
    return one.select(F.concat(none, own.cast(f"array<struct<truth:{kind.simpleString()},predicted:{kind.simpleString()},n:bigint>>")).alias("pairs"), "rows", "hits")


def confusion_matrix(labels: DataFrame, declared: list | None = None) -> DataFrame:
    """labels: truth, predicted. Every pair of the declared classes (of those that occur, if none are declared), also those
    that never meet; rows with another class or none are not counted. labels are read once."""
    return _counted(labels, declared).select(F.explode("pairs").alias("p")).select("p.*").groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def _per_class(labels: DataFrame, declared: list | None = None) -> DataFrame:
    """From the counts of pairs, so labels are read once; with rows and hits of all labels in each row."""
    n = F.col("p.n")
    hit = F.when(F.col("p.truth") == F.col("p.predicted"), n).otherwise(0)
    sides = F.array(F.struct(F.col("p.truth").alias("class"), hit.alias("tp"), n.alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("p.predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), n.alias("called")))
    x = _counted(labels, declared).select(F.explode("pairs").alias("p"), "rows", "hits").select(F.explode(sides).alias("s"), "rows", "hits")
    x = x.groupBy("s.class").agg(*(F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "called")), F.max("rows").alias("rows"), F.max("hits").alias("hits"))
    x = x.select("class", ratio("tp", "called").alias("precision"), ratio("tp", "support").alias("recall"), "support", "rows", "hits")
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class_metrics(labels: DataFrame, declared: list | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every declared class, else of every class that occurs; 0 where a class is never
    predicted."""
    return rounded(_per_class(labels, declared).select("class", "precision", "recall", "f1", "support"), "precision", "recall", "f1")


def macro_metrics(labels: DataFrame, declared: list | None = None) -> DataFrame:
    """Means over the declared classes, else over those that occur; the accuracy is over all rows. labels are read once."""
    means = [F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    share = F.round(F.max("hits").cast("double") / F.max("rows"), 6)
    return _per_class(labels, declared).agg(*means, share.alias("accuracy"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))


def open_world_decide(scores: DataFrame, confidence: float = 0.16, margin: float | None = 0.01, entropy: float | None = 3.2, enabled: bool = True) -> DataFrame:
    """KNOWN, or UNKNOWN with reasons in a fixed order: low confidence, small margin, high entropy."""
    x = ranked(scores).join(entropy_bits(scores), "row_id")
    checks = [(F.col("p1") < confidence, "low_confidence")]
    checks += [(F.col("margin") < margin, "small_margin")] * (margin is not None)
    checks += [(F.col("entropy") > entropy, "high_entropy")] * (entropy is not None)
    why = reasons(*checks) if enabled else F.array().cast("array<string>")
    out = x.select("row_id", "truth", F.col("top1").alias("predicted"), F.col("p1").alias("confidence"), F.concat_ws(",", why).alias("reasons"))
    return out.withColumn("decision", F.when(F.col("reasons") == "", "KNOWN").otherwise("UNKNOWN"))


def _selective(known, accepted, hit) -> list:
    n = lambda c: F.count_if(c)
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    taken = F.coalesce(share(n(known & accepted), n(known)), F.lit(0.0))
    return [
        F.round(share(n(accepted), F.count("*")), 6).alias("coverage"), F.round(taken, 6).alias("known_acceptance"), F.round(1 - taken, 6).alias("false_rejection"),
        F.round(F.coalesce(share(n(known & accepted & hit), n(known & accepted)), F.lit(0.0)), 6).alias("accuracy_when_accepted"), F.round(share(n(~known & ~accepted), n(~known)), 6).alias("unknown_rejection"),
    ]


def open_world_metrics(decisions: DataFrame, known) -> DataFrame:
    """Rates over decisions (truth, predicted, decision); known tells a row's truth is a class of the model. Without
    known rows acceptance and accuracy are 0; without unknown ones their rate is null."""
    return decisions.agg(*_selective(known, F.col("decision") == "KNOWN", F.col("truth") == F.col("predicted")))


def threshold_sweep(labels: DataFrame, thresholds: list[float], known) -> DataFrame:
    """The rates for each threshold of the confidence, in one pass over labels."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    x = labels.select("*", t)
    return x.groupBy("threshold").agg(*_selective(known, F.col("confidence") >= F.col("threshold"), F.col("truth") == F.col("predicted")))


def threshold_choice(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest accuracy of what it accepts, then acceptance, then the lowest."""
    key = F.struct(F.coalesce("accuracy_when_accepted", F.lit(-1.0)), F.coalesce("known_acceptance", F.lit(-1.0)), -F.col("threshold"))
    return sweep.agg(F.max_by("threshold", key).alias("threshold"))


def prediction_contract(predictions: DataFrame, answers: tuple[str, ...] = ("label", "truth")) -> DataFrame:
    """predictions: row_id, predicted, confidence, p2, margin, model_id. Refusals and bits of surprise. A row that has a value
    in a column of answers is refused: predictions must not come with what they are to be measured by."""
    labelled = F.lit(False)
    for c in answers:
        labelled = labelled | (F.col(c).isNotNull() if c in predictions.columns else F.lit(False))
    why = first_reason((labelled, "carries an answer"), (F.col("confidence").isNull() | F.isnan("confidence"), "confidence is missing"), ((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"), (F.col("predicted").isNull(), "no class"))
    bits = F.when(F.col("confidence") > 0, F.round(-F.log2("confidence"), 4))
    return predictions.select("row_id", "predicted", why.alias("refused"), bits.alias("surprise_bits"), "margin", (F.col("model_id").isNotNull() & why.isNull()).alias("complete"))


def majority_baseline(rows: DataFrame) -> DataFrame:
    """rows: split, label. The most frequent label of the train split (of equal ones the smallest), scored on each."""
    top = rows.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"))
    return rows.crossJoin(F.broadcast(top)).groupBy("split", "majority").agg(F.round(F.avg((F.col("label") == F.col("majority")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def select_candidate(table: DataFrame, band: float = 0.01) -> DataFrame:
    """table: name, rank, score (null: failed). Of those within band of the best, the simplest rank, then the name."""
    w = Window.partitionBy(F.lit(1))
    close = table.where("score is not null").withColumn("best", F.max("score").over(w)).where(F.col("score") >= F.col("best") - band)
    return close.agg(F.min_by("name", F.struct("rank", "name")).alias("chosen"))
