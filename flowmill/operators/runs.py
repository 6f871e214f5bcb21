"""What runs left behind: their documents, logs and captures, and what these say about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.columns import first_reason, reasons

#: Names of protocols in logs that mean IKE, ESP and the two versions of IP: fixed values.
IKE_NAMES, ESP_NAMES, V4_NAMES, V6_NAMES = ("isakmp", "ike", "ikev2"), ("esp",), ("ip",), ("ipv6",)
#: The evidence gates of a run, in their order: fixed values.
GATES = ("ike_sa_verified", "child_sa_verified", "xfrm_state_verified", "xfrm_policy_verified", "protected_payload_verified", "esp_verified")


def log_counts(lines: DataFrame, key: str) -> DataFrame:
    """lines (key, line): the most frames that protocol-hierarchy lines state for each protocol; other lines do not count."""
    x = lines.select(key, F.regexp_extract("line", r"^\s*(\w+)\s+frames:", 1).alias("proto"), F.regexp_extract("line", r"frames:(\d+)", 1).try_cast("long").alias("n"))
    return x.where("proto <> ''").groupBy(key, "proto").agg(F.max("n").alias("logged"))


def capture_verdict(scanned: DataFrame, logged: DataFrame, key: str, min_packets: int = 1, require_ike: bool = True, require_esp: bool = True, ip_version: int | None = None) -> DataFrame:
    """scanned: key, packets, ike, esp, ipv4, ipv6 (counts). logged: key, proto, logged, as log_counts gives them. For each
    capture that either source knows: packets, verdict and reasons.

    A capture is INVALID with too few packets or without what is required in both sources, UNVERIFIED if the sources
    disagree about the presence of IKE or ESP, else VALID. Where one source is missing there is nothing to disagree;
    without a log a reason says so."""
    have = lambda names: F.coalesce(F.sum(F.when(F.col("proto").isin(*names), F.col("logged"))), F.lit(0))
    log = logged.groupBy(F.col(key).alias("_key")).agg(have(IKE_NAMES).alias("_ike"), have(ESP_NAMES).alias("_esp"), have(V4_NAMES).alias("_v4"), have(V6_NAMES).alias("_v6"), F.max("logged").alias("_most"))
    x = scanned.withColumn("_scanned", F.lit(True)).join(log, F.col(key) == F.col("_key"), "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    seen = {"ike": n("ike") + n("_ike"), "esp": n("esp") + n("_esp"), "v4": n("ipv4") + n("_v4"), "v6": n("ipv6") + n("_v6")}
    packets = F.greatest(n("packets"), n("_most"))
    bad = [(packets < min_packets, "too few packets"), (F.lit(require_ike) & (seen["ike"] == 0), "no IKE"), (F.lit(require_esp) & (seen["esp"] == 0), "no ESP")]
    bad += [(F.lit(ip_version == v) & (seen[f"v{v}"] == 0), f"no IPv{v}") for v in (4, 6)]
    invalid = F.size(reasons(*bad)) > 0
    both = F.col("_scanned").isNotNull() & F.col("_key").isNotNull()
    differ = ~invalid & both & (((n("ike") > 0) != (n("_ike") > 0)) | ((n("esp") > 0) != (n("_esp") > 0)))
    why = reasons(*bad, (differ, "sources disagree about IKE or ESP"), (F.col("_key").isNull() & ~invalid, "no log"))
    return x.select(F.coalesce(key, "_key").alias(key), packets.alias("packets"), F.when(invalid, "INVALID").when(differ, "UNVERIFIED").otherwise("VALID").alias("verdict"), F.concat_ws("; ", why).alias("reasons"))


def gate_state(runs: DataFrame, key: str) -> DataFrame:
    """runs: key, ike_established, child_installed, xfrm_state, xfrm_policy (texts), protected_payload, esp_observed, failed.
    The six gates, those unmet in their order, and the state: FAILED, FINALIZED if all are met, else INCOMPLETE. Nulls
    meet no gate. A payload counts only where a child association was installed."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    met = dict(zip(GATES, (yes("ike_established"), yes("child_installed"), text("xfrm_state"), text("xfrm_policy"), yes("protected_payload") & yes("child_installed"), yes("esp_observed"))))
    unmet = F.concat_ws(",", F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in met.items()))))
    return runs.select(key, *(ok.alias(name) for name, ok in met.items()), unmet.alias("unmet"), F.when(yes("failed"), "FAILED").when(unmet == "", "FINALIZED").otherwise("INCOMPLETE").alias("state"))


def run_status(runs: DataFrame, key: str) -> DataFrame:
    """runs: the gates, unmet and state as gate_state gives them, with blocked and esp_in_capture (null: there is no capture).
    status: INVALID for a failed run, else BLOCKED, else VALID if all gates are met and the capture shows ESP, else
    INCOMPLETE; refused: why a run must not be written down as it is, its gates claiming more than its capture shows, or
    null."""
    failed, blocked = F.col("state") == "FAILED", F.coalesce("blocked", F.lit(False))
    every, esp = F.col("unmet") == "", F.col("esp_in_capture")
    status = F.when(failed, "INVALID").when(blocked, "BLOCKED").when(every & F.coalesce(esp, F.lit(False)), "VALID").otherwise("INCOMPLETE")
    why = first_reason((every & esp.isNull(), "all gates but no capture"), (F.col("esp_verified") & ~esp, "no ESP in the capture"))
    return runs.select(key, status.alias("status"), F.when(~failed, why).alias("refused"))


def scan_documents(spark: SparkSession, pattern: str, schema: str, required: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """Every JSON document under pattern, one to a file or with lines one to a line, with its file and reason: broken, or
    the first required field it lacks; null if it is usable. A broken document is a row, not an error."""
    docs = spark.read.schema(f"{schema}, _broken string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_broken").json(pattern)
    why = first_reason((F.col("_broken").isNotNull(), "broken"), *((F.col(c).isNull(), f"no {c}") for c in required))
    return docs.select("*", F.col("_metadata.file_path").alias("file")).withColumn("reason", why).drop("_broken")


def stage_documents(stages: DataFrame, key: str, order: str) -> DataFrame:
    """stages: key, order, component, status. One document for each key, its stages in order, as JSON."""
    s = F.array_sort(F.collect_list(F.struct(order, "component", "status")))
    return stages.groupBy(key).agg(F.to_json(s).alias("document"))


def document_stages(documents: DataFrame, key: str, order: str, kind: str = "long") -> DataFrame:
    """The stages of documents as stage_documents writes them; a document that is no such list has none."""
    s = F.from_json("document", f"array<struct<{order}:{kind},component:string,status:string>>")
    return documents.select(key, F.explode(s).alias("s")).select(key, "s.*")


def config_values(rows: DataFrame, key: str, config: str, fields: dict, blocks: tuple[str, ...] = ("", "identity", "ipsec")) -> DataFrame:
    """Fields (name: type, or type and the keys that may hold it) of a configuration in JSON: the first value that is not null,
    block by block ("" is the document itself), and in a block key by key. A value of another type is null; on, yes, 1 and
    off, no, 0 are booleans too; blank text stays. _given: whether the document is a JSON object."""
    def value(name: str, kind: str, keys: tuple[str, ...]) -> F.Column:
        found = F.coalesce(*(F.get_json_object(config, f"$.{b}.{k}" if b else f"$.{k}") for b in blocks for k in keys))
        if kind == "boolean":
            text = F.lower(F.trim(found))
            return F.when(text.isin("on", "true", "yes", "1"), True).when(text.isin("off", "false", "no", "0"), False).alias(name)
        return found.try_cast(kind).alias(name)

    wanted = {c: (f, (c,)) if isinstance(f, str) else f for c, f in fields.items()}
    given = F.coalesce(F.get_json_object(config, "$").startswith("{"), F.lit(False))
    return rows.select(key, *(value(c, kind, keys) for c, (kind, keys) in wanted.items()), given.alias("_given"))


def by_kind(rows: DataFrame, key: str, order: str, kind: str, value: str, names: dict[str, str]) -> DataFrame:
    """For each key, an array for each of names (column: kind): the values of that kind in order; and others, how many
    values are of no such kind. Null values are left out."""
    s = F.array_sort(F.collect_list(F.struct(order, kind, value)))
    g = rows.where(F.col(value).isNotNull()).groupBy(key).agg(s.alias("_s"))
    pick = lambda k: F.transform(F.filter("_s", lambda x: x[kind] == k), lambda x: x[value])
    rest = F.size(F.filter("_s", lambda x: ~F.coalesce(x[kind].isin(*names.values()), F.lit(False)))).cast("long")
    return g.select(key, *(pick(k).alias(c) for c, k in names.items()), rest.alias("others"))
