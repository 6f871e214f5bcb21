"""What is known about each capture, in the form that the rule catalogue reads, and the whole assessment that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators import assess as a
from flowmill.operators.flows import flow_summary, sequence_health
from flowmill.operators.rules import DEGENERATE, GROUP_NUMBERS, IDENTITY_V1, rule_verdicts, wire_name
from flowmill.operators.runs import config_values

# Registered numbers of algorithms, kinds of transforms, and exchanges that do not show which offer was chosen.
ENCRYPTION_IDS = {1: "ENCR_DES_IV64", 2: "ENCR_DES", 3: "ENCR_3DES", 12: "ENCR_AES_CBC", 18: "ENCR_AES_GCM_16", 19: "ENCR_AES_GCM_12", 20: "ENCR_AES_GCM_8", 28: "ENCR_CHACHA20_POLY1305"}
PRF_IDS = {1: "PRF_HMAC_MD5", 2: "PRF_HMAC_SHA1", 4: "PRF_HMAC_SHA2_256", 5: "PRF_HMAC_SHA2_384", 6: "PRF_HMAC_SHA2_512", 7: "PRF_AES128_XCBC", 8: "PRF_AES128_CMAC"}
INTEGRITY_IDS = {0: "NONE", 1: "AUTH_HMAC_MD5_96", 2: "AUTH_HMAC_SHA1_96", 12: "AUTH_HMAC_SHA2_256_128", 13: "AUTH_HMAC_SHA2_384_192", 14: "AUTH_HMAC_SHA2_512_256"}
TRANSFORMS = {"encryption": (1, ENCRYPTION_IDS, "ENCR_"), "prf": (2, PRF_IDS, "PRF_"), "integrity": (3, INTEGRITY_IDS, "AUTH_"), "groups": (4, GROUP_NUMBERS, "DH_GROUP_")}
OFFERING = ("IKE_SA_INIT", "IKEV1_EXCHANGE_1", "IKEV1_EXCHANGE_2")
#: Fields of a configuration: type, and the keys that may hold it, by precedence.
CONFIG = {
    "encryption": ("string", ("encryption",)), "integrity": ("string", ("integrity",)), "prf": ("string", ("prf",)), "dh_group": ("string", ("dh_group", "ike_dh_group")), "pfs": ("boolean", ("pfs",)),
    "child_group": ("string", ("pfs_dh_group", "child_dh_group")), "ike_version": ("int", ("ike_version",)), "replay_protection": ("boolean", ("replay_protection", "replay_window")),
    "ike_lifetime": ("long", ("ike_sa_lifetime_s", "ike_lifetime_s")), "child_lifetime": ("long", ("child_sa_lifetime_s", "child_lifetime_s")),
}
#: Where a field is looked for: the document itself, then its identity, then its ipsec block.
BLOCKS = ("", "identity", "ipsec")


def configured(documents: DataFrame, document: str = "document", key: str = "capture_id") -> DataFrame:
    """key and config, the struct of rules.FACTS, from configurations in JSON, flat or nested: algorithms by their wire names,
    however they are written; null for a document that is none."""
    flat = config_values(documents, key, document, CONFIG, BLOCKS)
    kinds = {"encryption": "encryption", "integrity": "integrity", "prf": "prf", "dh_group": "group", "child_group": "group"}
    named = {c: F.when(F.col(c).isNotNull(), F.nullif(wire_name(F.col(c), k), F.lit(""))).alias(c) for c, k in kinds.items()}
    given = F.col("_given")
    return flat.select(key, F.when(given, F.struct(*(named.get(c, F.col(c)) for c in CONFIG))).alias("config"))


def _offers(exchanges: DataFrame) -> DataFrame:
    """Distinct wire names on offer, by scope and kind; as many as there are numbers of algorithms at most."""
    x = exchanges.select("capture_id", F.explode("ike.proposals").alias("p")).select("capture_id", F.col("p.protocol").alias("protocol"), F.explode("p.transforms").alias("t"))
    out = []
    for scope, protocols in (("ike", (1,)), ("child", (2, 3))):
        for kind, (number, registry, unknown) in TRANSFORMS.items():
            name = F.coalesce(a.lookup("t.id", registry), F.concat(F.lit(unknown), F.col("t.id").cast("string")))
            out.append(F.array_sort(F.collect_set(F.when(F.col("protocol").isin(*protocols) & (F.col("t.type") == number), name))).alias(f"{scope}_{kind}"))
    return x.groupBy("capture_id").agg(*out).drop("child_prf")


def assemble_facts(packets: DataFrame, configs: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """A row of rules.FACTS for each capture of packets, as decode.packets_of gives them (written, as they are read three
    times). configs: capture_id, config, as configured() gives them; predictions: capture_id, confidence, model_id,
    model_version, feature_schema, decision; a row for each capture at most.

    What a capture may have any number of is summed up to what rules ask for: of exchanges the distinct kinds, of their
    payloads the identity alone, of flows' numbers the degenerate ones. Captures without IKE or ESP have nulls there."""
    ike = packets.where("ike_parsed")
    hidden = F.col("ike.encrypted")
    identity = F.when(F.array_contains("ike.payloads", IDENTITY_V1), F.array(F.lit(IDENTITY_V1))).otherwise(F.array().cast("array<int>"))
    said = F.struct(F.col("ike.exchange").alias("exchange"), F.col("ike.version").alias("version"), identity.alias("payloads"), hidden.alias("encrypted"))
    offers, child = F.size("ike.proposals"), F.exists("ike.proposals", lambda p: p["protocol"].isin(2, 3))
    messages = ike.groupBy("capture_id").agg(
        F.collect_set(said).alias("exchanges"), F.array_sort(F.collect_set("ike.version")).alias("ike_versions"), F.sum(offers).cast("long").alias("proposals"),
        F.bool_or(~F.col("ike.exchange").isin(*OFFERING) & (offers > 0) & ~hidden).alias("selection_observable"), F.bool_or(child).alias("_child"),
    )
    every = packets.groupBy("capture_id").agg(F.count_if("ike_parsed").alias("ike_packets"), F.count_if(F.col("proto") == "ESP").alias("esp_packets"))
    spi = F.lpad(F.lower(F.hex("spi_int")), 8, "0")
    flows = flow_summary(packets).join(sequence_health(packets), ["capture_id", "spi_int"]).groupBy("capture_id").agg(
        F.collect_set(F.when(spi.isin(*DEGENERATE), spi)).alias("spis"), F.count("*").alias("flows"), F.count_if("udp_encapsulated").alias("encapsulated"), F.sum("sequence_gaps").alias("gaps"),
        F.sum("sequence_replays").alias("replays"), F.count_if(~F.col("sequence_monotonic")).alias("disordered"),
    )
    out = every.join(messages, "capture_id", "left").join(_offers(ike), "capture_id", "left").join(flows, "capture_id", "left")
    pfs = F.when(F.size("child_groups") > 0, "OBSERVED").when(F.col("_child"), "DISABLED").otherwise("NOT_VERIFIABLE")
    out = out.withColumn("pfs_status", pfs).drop("_child")
    if configs is not None:
        out = out.join(configs.select("capture_id", "config"), "capture_id", "left")
    else:
        out = out.withColumn("config", F.lit(None).cast("struct<encryption:string,integrity:string,prf:string,dh_group:string,pfs:boolean,child_group:string,ike_version:int,replay_protection:boolean,ike_lifetime:long,child_lifetime:long>"))
    if predictions is None:
        return out.withColumn("predicted", F.lit(None).cast("struct<confidence:double,complete:boolean,unknown:boolean>"))
    known = F.lit(True)
    for c in ("model_id", "model_version", "feature_schema"):
        known = known & (F.coalesce(c, F.lit("")) != "")
    told = F.struct("confidence", (known & F.col("confidence").isNotNull()).alias("complete"), (F.coalesce("decision", F.lit("")) == "UNKNOWN").alias("unknown"))
    return out.join(predictions.select("capture_id", told.alias("predicted")), "capture_id", "left")


def settled_findings(facts: DataFrame) -> DataFrame:
    """The findings of all rules, priced and settled."""
    return a.settle(a.collapse(a.price(rule_verdicts(facts))))


def assess_captures(settled: DataFrame, threats: DataFrame, advice: dict[str, str] | None = None, severity: Column | None = None, exposure: DataFrame | None = None) -> DataFrame:
    """The whole assessment, a row for each capture: security_score and risk_score (whole numbers), risk_level, evidence_coverage,
    evidence (a count of each grade), findings, categories, threats, recommendations (arrays of structs, findings in the
    rules' order, threats by id, advice by priority), and exposure: the struct of what that table, with a row for each
    capture, says.

    settled should be a written table, so that verdicts are not worked out anew for each part; a capture has as many
    findings as there are rules, so its arrays are small. Advice needs the severity of findings."""
    by = settled.groupBy("capture_id")
    nested = lambda df, name, first, *cols: df.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(first, *cols))).alias(name))
    covered = F.round(F.avg(a.lookup("evidence_status", a.COVERAGE_WEIGHTS, 0.0)), 4)
    tally = F.struct(*(F.count_if(F.col("evidence_status") == k).alias(k.lower()) for k in a.EVIDENCE_FACTORS))
    found = F.array_sort(F.collect_list(F.struct("ordinal", "rule_id", "category", "property_key", "status", "evidence_status", "base", "points", "suppressed_by")))
    out = by.agg(covered.alias("evidence_coverage"), tally.alias("evidence"), found.alias("findings"))
    scores = a.security_score(settled).select("capture_id", F.col("rounded_score").alias("security_score"), (100 - F.col("rounded_score")).alias("risk_score"), F.col("rounded_level").alias("risk_level"))
    parts = [scores, nested(a.category_scores(settled), "categories", "category", "score", "deducted", "fails", "warnings", "unverified", "coverage")]
    parts.append(nested(a.threat_matrix(settled, threats), "threats", "threat_id", "risk", "rules", "evidence", "points"))
    if advice is not None and severity is not None:
        parts.append(nested(a.recommendations(settled.withColumn("severity", severity), advice), "recommendations", "priority", "advice", "severity", "lead_rule", "rules"))
    if exposure is not None:
        parts.append(exposure.select("capture_id", F.struct(*(c for c in exposure.columns if c != "capture_id")).alias("exposure")))
    for p in parts:
        out = out.join(p, "capture_id", "left")
    return out.withColumn("threats", F.coalesce("threats", F.array()))
