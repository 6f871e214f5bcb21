"""Models that are stored and found again by their cards."""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowmill.functions.shared import shared_folder
from flowmill.operators.training import score

#: What a card says: fixed values.
CARD = """model_id string, model_version string, feature_schema string, feature_names array<string>, classes array<string>, algorithm string, trained_at string,
 dataset map<string,string>, metrics map<string,double>, calibration string, notes array<string>"""
NAMES = re.findall(r"(\w+) (?:string|array|map)", CARD)
#: What a card must say.
NEEDED = ("model_id", "feature_schema", "classes", "trained_at")


class ModelStore:
    """Fitted pipelines in a shared folder, a directory for each: its pipeline, and its card, which is written last. What has no
    card, as after a writer that was lost, is never found; directories are never written twice."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def save(self, directory: str, model: PipelineModel, card: dict, allowed: list[str]) -> None:
        """Writes a model whose first stage assembles its features. ValueError, before anything is written, if the card lacks what
        it must say, names what cards do not have or has no classes, if a feature is not allowed or comes twice, or if
        features are not in the order of allowed."""
        features = list(model.stages[0].getInputCols())
        lacking, unknown = [n for n in NEEDED if not card.get(n)], sorted(set(card) - set(NAMES))
        if lacking or unknown:
            raise ValueError(f"the card lacks {lacking} and has unknown entries {unknown}")
        if card.get("feature_names", features) != features:
            raise ValueError("the card names other features than the model's")
        strange = sorted(set(features) - set(allowed))
        if strange or len(set(features)) < len(features):
            raise ValueError(f"columns that are not allowed {strange}, or twice the same")
        if features != [c for c in allowed if c in features]:
            raise ValueError("features are not in the order of the allowed ones")
        if "/" in directory or directory.startswith((".", "_")):
            raise ValueError(f"no name of a directory: {directory}")
        model.save(f"{self.where}/{directory}/pipeline")
        self.card(directory, {**card, "feature_names": features})

    def card(self, directory: str, card: dict) -> None:
        """Writes a card alone: the last step of save, or the card of a model whose pipeline is brought by other means."""
        text = json.dumps({**card, "classes": [str(c) for c in card["classes"]]})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.where}/{directory}/card")

    def _read(self, reader, pattern: str, schema: str) -> DataFrame:
        """directory and the file's rows; none if no file is there."""
        own = F.regexp_extract("_metadata.file_path", r"([^/]+)/(?:card|pipeline/metadata)/[^/]+$", 1)
        try:
            return reader(f"{self.where}/{pattern}").select(own.alias("directory"), "*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"directory string, {schema}")

    def cards(self, schema: str) -> DataFrame:
        """A row for each card: directory, what it says, payload (its pipeline is there), problem (the first that keeps it from
        being used, or null: the card can't be read or lacks what it must say; it was made for another feature schema than
        schema; no pipeline)."""
        cards = self._read(self.spark.read.schema(f"{CARD}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json, "*/card", f"{CARD}, _corrupt string")
        held = self._read(self.spark.read.text, "*/pipeline/metadata", "value string").select(F.col("directory").alias("_d")).distinct()
        out = cards.join(held, F.col("directory") == F.col("_d"), "left").withColumn("payload", F.col("_d").isNotNull())
        bad = F.col("_corrupt").isNotNull() | F.coalesce(F.size("classes"), F.lit(0)).isin(0, -1)
        for n in NEEDED:
            bad = bad | F.col(n).isNull()
        why = F.when(bad, "broken card").when(F.col("feature_schema") != schema, "other feature schema").when(~F.col("payload"), "no pipeline")
        return out.select("directory", *NAMES, "payload", why.alias("problem"))

    def status(self, schema: str) -> DataFrame:
        """One row: available, selected (the directory of the newest card that can be used, of equal times the last name's),
        cards, incompatible, broken, and reason: why none can be used, or null."""
        ok, other = F.col("problem").isNull(), F.col("problem") == "other feature schema"
        newest = F.max(F.when(ok, F.struct("trained_at", "directory")))["directory"]
        x = self.cards(schema).agg(newest.alias("selected"), F.count("*").alias("cards"), F.count_if(other).alias("incompatible"), F.count_if(~ok & ~other).alias("broken"))
        why = F.when(F.col("selected").isNotNull(), None).when(F.col("cards") == 0, "no model").when(F.col("broken") == 0, "no model of this feature schema").otherwise("no model can be loaded")
        return x.select(F.col("selected").isNotNull().alias("available"), "selected", "cards", "incompatible", "broken", why.alias("reason"))

    def load(self, directory: str) -> PipelineModel:
        return PipelineModel.load(f"{self.where}/{directory}/pipeline")

    def latest(self, schema: str) -> PipelineModel:
        """The newest model that can be used; LookupError, with the reason, if there is none."""
        s = self.status(schema).first()
        if not s.available:
            raise LookupError(s.reason)
        return self.load(s.selected)

    def score_latest(self, rows: DataFrame, key: str, schema: str) -> DataFrame:
        """rows (with label and split) scored by the newest model that can be used."""
        return score(self.latest(schema), rows, key)


def new_store(spark: SparkSession) -> ModelStore:
    """A store in a new folder that all executors share."""
    return ModelStore(spark, shared_folder(spark))
