"""The history of analyses as a stored table: rows from bundle documents, insert or replace, delete, lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowmill.functions.shared import shared_folder
from flowmill.operators.records import latest

#: The columns of a history row: fixed values.
COLUMNS = """analysis_id string, created_at string, source_mode string, display_filename string, capture_size long, capture_hash string, bundle_schema string, bundle_path string, protocol_summary string,
 traffic_prediction string, traffic_confidence double, security_score double, risk_band string, privacy_band string, analysis_state string"""
NAMES = [c.split()[0] for c in COLUMNS.split(",")]
#: What a list can be filtered by, how many rows it gives at most, and buckets of a new table.
FILTERS, MOST, BUCKETS = ("source_mode", "risk_band", "traffic_prediction", "analysis_state"), 500, 64
#: The fields of a bundle document and of its parts that a row needs.
READ = ("analysis_id", "created_at", "schema_version", "status", "protocol", "source", "traffic", "security", "privacy")
PARTS = {
    "protocol": ("ipsec_detected", "ike_version", "esp_packets", "esp_flows"), "source": ("kind", "filename", "size_bytes", "sha256"),
    "traffic": ("predicted_class", "confidence"), "security": ("security_score", "risk_level"), "privacy": ("privacy_risk",),
}
#: Rows of a bucket that one task writes, about.
FILE_ROWS = 250_000


def history_rows(bundles: DataFrame, document: str = "document", path: str | None = None) -> DataFrame:
    """A history row for each bundle document (JSON): each column is read out of the document, so what an analysis did not give
    is null; source mode and file name are blank and the size 0 where it does not name them. path: the column with the
    bundle's place. Documents without an id are left out."""
    # one parse gives the fields of a document and of its parts; a list of documents is none
    kinds = ", ".join(f"{k}: struct<{', '.join(f'{c}: string' for c in PARTS[k])}>" if k in PARTS else f"{k}: string" for k in READ)
    one = F.when(~F.ltrim(document).startswith("["), F.col(document))
    flat = bundles.select(F.col(path).alias("_path") if path else F.lit(None).cast("string").alias("_path"), F.from_json(one, f"struct<{kinds}>").alias("_d"))
    at = lambda p: F.col(f"_d.{p}")
    text = lambda p: F.nullif(at(p), F.lit(""))
    true = lambda p: F.coalesce(at(p), F.lit("")).isin("true", "1")
    version, packets = text("protocol.ike_version"), at("protocol.esp_packets").try_cast("long")
    flows = F.size(F.from_json(at("protocol.esp_flows"), "array<string>"))
    parts = F.array_compact(F.array(
        F.when(true("protocol.ipsec_detected"), "IPsec"), F.when(version.rlike("^[0-9]+$") & (version != "0"), F.concat(F.lit("IKEv"), version)).when(~version.rlike("^[0-9]+$"), version),
        F.when(packets > 0, F.concat(packets.cast("string"), F.lit(" ESP"))), F.when(flows > 0, F.concat(flows.cast("string"), F.lit(" flow(s)"))),
    ))
    values = {
        "analysis_id": text("analysis_id"), "created_at": at("created_at"), "source_mode": F.coalesce(at("source.kind"), F.lit("")), "display_filename": F.coalesce(at("source.filename"), F.lit("")),
        "capture_size": F.coalesce(at("source.size_bytes").try_cast("long"), F.lit(0).cast("long")), "capture_hash": text("source.sha256"), "bundle_schema": at("schema_version"), "bundle_path": F.col("_path"),
        "protocol_summary": F.nullif(F.array_join(parts, ", "), F.lit("")), "traffic_prediction": text("traffic.predicted_class"), "traffic_confidence": at("traffic.confidence").try_cast("double"),
        "security_score": at("security.security_score").try_cast("double"), "risk_band": text("security.risk_level"), "privacy_band": at("privacy.privacy_risk"), "analysis_state": at("status"),
    }
    return flat.select(*(v.alias(n) for n, v in values.items())).where("analysis_id is not null")


class History:
    """A history table in a shared folder, one row for each analysis_id. Rows lie in buckets by the hash of their id, so a change
    reads and rewrites the buckets of the ids it names, and no others; doing the same change again changes nothing. There
    is one writer at a time; a change that was broken off is made whole by doing it again."""

    def __init__(self, spark: SparkSession, where: str, buckets: int = BUCKETS):
        self.spark, self.where, self.buckets = spark, where.rstrip("/"), buckets

    def _bucket(self) -> F.Column:
        # as repartition() deals ids to a number of tasks that the buckets divide, so a task has rows of one bucket
        return F.pmod(F.hash("analysis_id"), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{COLUMNS}, bucket int").parquet(f"{self.where}/rows")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{COLUMNS}, bucket int")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows, written beside the table: what several steps read is computed once."""
        where = f"{self.where}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def _rewrite(self, named: DataFrame, new: DataFrame | None = None) -> None:
        """In the buckets of the ids in named, rows of these ids give way to the newest of each id in new. Both are written
        tables. Rows move once, to the tasks that write them: several for a large bucket."""
        touched = [r[0] for r in named.select(self._bucket()).distinct().collect()]
        if not touched:
            return
        old = self._stored().where(F.col("bucket").isin(touched))
        n = old.count()
        files = max(1, -(-(n + (new.count() if new is not None else 0)) // (len(touched) * FILE_ROWS)))
        dealt = lambda rows: rows.repartition(self.buckets * files, "analysis_id")
        parts = []
        if n:
            gone = dealt(named.select("analysis_id")).hint("shuffle_hash")
            parts.append(dealt(old.where("analysis_id is not null").select(*NAMES)).join(gone, "analysis_id", "left_anti").select(*NAMES))
        if new is not None:
            parts.append(latest(dealt(new), "analysis_id", "created_at").select(*NAMES))
        rows = [p.withColumn("bucket", self._bucket()) for p in parts]
        if new is None:
            # a row without an id, so that a bucket from which all rows go is rewritten too
            rows.append(self.spark.createDataFrame([(*[None] * len(NAMES), b) for b in touched], f"{COLUMNS}, bucket int").coalesce(1))
        made = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.where}/rows")

    def put(self, rows: DataFrame) -> None:
        """Inserts rows, or replaces those that share their id; of rows with the same id the newest counts."""
        new = self._kept(rows.where("analysis_id is not null").select(*NAMES))
        self._rewrite(new, new)

    def delete(self, ids: DataFrame) -> None:
        """ids: analysis_id. Unknown ids change nothing."""
        self._rewrite(self._kept(ids.select("analysis_id").where("analysis_id is not null")))

    def rows(self) -> DataFrame:
        return self._stored().where("analysis_id is not null").select(*NAMES)

    def point(self, analysis_id: str) -> DataFrame:
        """The row of one id, from its bucket alone."""
        own = self.spark.range(1).select(F.lit(analysis_id).alias("analysis_id")).select(self._bucket()).first()[0]
        return self._stored().where((F.col("bucket") == own) & (F.col("analysis_id") == analysis_id)).select(*NAMES)

    def listed(self, limit: int = 50, **filters: str | None) -> DataFrame:
        """Newest first, then by id from the largest; filters that are None do not filter; the limit is held to 1..MOST."""
        unknown = sorted(set(filters) - set(FILTERS))
        if unknown:
            raise ValueError(f"no filters of the history: {unknown}")
        out = self.rows()
        for c, v in filters.items():
            out = out.where(F.col(c) == v) if v is not None else out
        return out.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(max(1, min(MOST, int(limit))))

    def count(self) -> int:
        return self.rows().count()


def new_history(spark: SparkSession, buckets: int = BUCKETS) -> History:
    """A history in a new folder that all executors share."""
    return History(spark, shared_folder(spark), buckets)
