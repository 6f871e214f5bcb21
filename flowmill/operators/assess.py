"""Evidence-graded findings: registries, tiers, pricing, settling, scores, threats and recommendations.

findings: capture_id, rule_id, ordinal, category, property_key, status, evidence_status, base, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
STATUS_FACTORS = {"FAIL": 1.0, "WARNING": 0.4, "PASS": 0.0, "NOT_VERIFIABLE": 0.0}
EVIDENCE_FACTORS = {"OBSERVED": 1.0, "CONFIGURED": 0.85, "INFERRED": 0.5, "NOT_VERIFIABLE": 0.0}
COVERAGE_WEIGHTS = {"OBSERVED": 1.0, "CONFIGURED": 0.75, "INFERRED": 0.5, "NOT_VERIFIABLE": 0.0}
CATEGORY_WEIGHTS = {"CRYPTOGRAPHY": 0.28, "KEY_EXCHANGE": 0.24, "SA_SECURITY": 0.14, "REPLAY_PROTECTION": 0.12, "CONFIGURATION": 0.12, "METADATA_PRIVACY": 0.10}
RISK_BANDS = ((85.0, "LOW"), (70.0, "MODERATE"), (50.0, "HIGH"), (0.0, "CRITICAL"))
STRENGTH = {"FAIL": 3, "WARNING": 2, "PASS": 1, "NOT_VERIFIABLE": 0}
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
TIER_RANK = {"FORBIDDEN": 4, "DEPRECATED": 3, "UNKNOWN": 2, "ACCEPTABLE": 1, "RECOMMENDED": 0}
EVIDENCE_RANK = {"OBSERVED": 0, "CONFIGURED": 1, "INFERRED": 2, "NOT_VERIFIABLE": 3}
THREATS = (  # id, category, likelihood, impact, rules, whether rules that could not verify their property confirm it
    ("T-IKE-CIPHER", "CRYPTOGRAPHY", "HIGH", "HIGH", ("CRYPTO-001",), False),
    ("T-IKE-INTEGRITY", "CRYPTOGRAPHY", "MEDIUM", "HIGH", ("CRYPTO-002",), False),
    ("T-PRF-WEAK", "CRYPTOGRAPHY", "MEDIUM", "HIGH", ("CRYPTO-003",), False),
    ("T-TUNNEL-CIPHER", "CRYPTOGRAPHY", "HIGH", "HIGH", ("CRYPTO-004",), False),
    ("T-TUNNEL-INTEGRITY", "CRYPTOGRAPHY", "MEDIUM", "HIGH", ("CRYPTO-005",), False),
    ("T-DH-WEAK", "KEY_EXCHANGE", "MEDIUM", "HIGH", ("KEYX-001", "KEYX-002"), False),
    ("T-NO-FORWARD-SECRECY", "KEY_EXCHANGE", "MEDIUM", "HIGH", ("KEYX-003", "KEYX-004"), False),
    ("T-KEY-EXPOSURE", "KEY_EXCHANGE", "MEDIUM", "MEDIUM", ("KEYX-005", "KEYX-006"), False),
    ("T-IDENTITY-UNVERIFIED", "KEY_EXCHANGE", "MEDIUM", "HIGH", ("KEYX-007",), True),
    ("T-IKE-VERSION", "KEY_EXCHANGE", "HIGH", "MEDIUM", ("KEYX-008",), False),
    ("T-DOWNGRADE", "CONFIGURATION", "MEDIUM", "HIGH", ("CONFIG-002",), False),
    ("T-CONFIG-DRIFT", "CONFIGURATION", "MEDIUM", "MEDIUM", ("CONFIG-003",), False),
    ("T-PLAINTEXT-TRAFFIC", "SA_SECURITY", "HIGH", "HIGH", ("SA-001",), False),
    ("T-SPI-GUESS", "SA_SECURITY", "MEDIUM", "MEDIUM", ("SA-002",), False),
    ("T-NAT-BINDING", "SA_SECURITY", "MEDIUM", "LOW", ("SA-003",), False),
    ("T-SEQUENCE-REUSE", "REPLAY_PROTECTION", "MEDIUM", "MEDIUM", ("REPLAY-001",), False),
    ("T-REPLAY-WINDOW-UNKNOWN", "REPLAY_PROTECTION", "MEDIUM", "MEDIUM", ("REPLAY-002", "REPLAY-003", "REPLAY-004"), True),
    ("T-SPI-VISIBILITY", "METADATA_PRIVACY", "HIGH", "LOW", ("META-001",), False),
    ("T-VOLUME-EXPOSURE", "METADATA_PRIVACY", "HIGH", "LOW", ("META-002",), False),
    ("T-CLASS-INFERENCE", "METADATA_PRIVACY", "MEDIUM", "MEDIUM", ("META-003",), False),
)
IKE_LIFETIME = (28800, 86400, 604800)
CHILD_LIFETIME = (1800, 3600, 86400)


def lookup(column, table: dict, default=None) -> F.Column:
    """The value of a column in a small fixed table."""
    return F.coalesce(F.get(F.array(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column) if isinstance(column, str) else column)), F.lit(0)), F.lit(default))


def dimension(spark: SparkSession, table: dict, key: str, value: str) -> DataFrame:
    """A fixed table as a DataFrame, for joins."""
    return spark.createDataFrame(sorted(table.items()), f"{key} {'int' if isinstance(next(iter(table)), int) else 'string'}, {value} string")


def registry_names(rows: DataFrame, registry: DataFrame, key: str, name: str, unknown: str) -> DataFrame:
    """rows with the name of a number; a number that the registry lacks is named after itself."""
    return rows.join(registry, key, "left").withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(unknown), F.col(key).cast("string"))))


def lifetime_tier(seconds, ceilings: tuple[int, int, int]) -> F.Column:
    s, (best, fine, most) = F.col(seconds), ceilings
    return F.when(s.isNull(), "UNKNOWN").when(s <= 0, "FORBIDDEN").when(s <= best, "RECOMMENDED").when(s <= fine, "ACCEPTABLE").when(s <= most, "DEPRECATED").otherwise("FORBIDDEN")


def worst_tier(rows: DataFrame, key: str, name: str, tier: str) -> DataFrame:
    """The worst tier of each key and the name that has it: highest rank, then the largest name."""
    top = F.max(F.struct(lookup(tier, TIER_RANK, 2).alias("rank"), F.col(name).alias("name"), F.col(tier).alias("tier")))
    return rows.groupBy(key).agg(top.alias("w")).select(key, F.col("w.name").alias("worst"), F.col("w.tier").alias("tier"))


def price(findings: DataFrame) -> DataFrame:
    """findings with points: base by status, by evidence, and for inferred ones by confidence; 2 places."""
    sure = F.when(F.col("evidence_status") == "INFERRED", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).otherwise(1.0)
    points = F.col("base") * lookup("status", STATUS_FACTORS, 0.0) * (lookup("evidence_status", EVIDENCE_FACTORS, 0.0) * sure)
    return findings.withColumn("points", F.round(points, 2))


def collapse(priced: DataFrame, keys: tuple[str, ...] = ("capture_id", "rule_id")) -> DataFrame:
    """The dearest finding of each rule and subject; of equal ones the first. The subject is in dedup_key, where findings have
    that column: a rule that names several subjects keeps one finding for each, null being a subject too."""
    keys = (*keys, "dedup_key") if "dedup_key" in priced.columns and "dedup_key" not in keys else keys
    w = Window.partitionBy(*keys).orderBy(F.desc("points"), "ordinal")
    return priced.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def settle(priced: DataFrame) -> DataFrame:
    """One rule of each property pays: the one with the strongest verdict, then the first. The others pass, cost nothing
    and name the winner; other findings of the winning rule still pay."""
    w = Window.partitionBy("capture_id", "property_key").orderBy(F.desc(lookup("status", STRENGTH, 0)), "ordinal")
    lost = F.col("_winner") != F.col("rule_id")
    out = priced.withColumn("_winner", F.first("rule_id").over(w))
    return out.withColumns({"property_status": F.first("status").over(w), "suppressed_by": F.when(lost, F.col("_winner")), "points": F.when(lost, 0.0).otherwise(F.col("points")), "status": F.when(lost, "PASS").otherwise(F.col("status"))}).drop("_winner")


def category_scores(settled: DataFrame) -> DataFrame:
    """Points by category, capped at its weight, with counts and mean coverage of evidence."""
    agg = settled.groupBy("capture_id", "category").agg(
        F.round(F.sum("points"), 2).alias("raw"), F.count_if(F.col("status") == "FAIL").alias("fails"), F.count_if(F.col("status") == "WARNING").alias("warnings"),
        F.count_if(F.col("status") == "NOT_VERIFIABLE").alias("unverified"), F.round(F.avg(lookup("evidence_status", COVERAGE_WEIGHTS, 0.0)), 4).alias("coverage"),
    )
    cap = F.round(lookup("category", CATEGORY_WEIGHTS, 0.0) * 100, 2)
    return agg.withColumn("deducted", F.round(F.least("raw", cap), 2)).withColumn("score", F.round(cap - F.col("deducted"), 2))


def risk_band(score) -> F.Column:
    out = None
    for floor, level in RISK_BANDS:
        out = F.when(F.col(score) >= floor, level) if out is None else out.when(F.col(score) >= floor, level)
    return out.otherwise("CRITICAL")


def security_score(settled: DataFrame) -> DataFrame:
    """100 less what the categories deduct; the band of the score and of the score as a whole number."""
    s = category_scores(settled).groupBy("capture_id").agg(F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.sum("deducted")), 2).alias("security_score"))
    return s.withColumn("risk_level", risk_band("security_score")).withColumn("rounded_score", F.bround("security_score", 0).cast("int")).withColumn("rounded_level", risk_band("rounded_score"))


def ledger(settled: DataFrame) -> DataFrame:
    return settled.select("capture_id", "rule_id", "category", "property_key", F.col("status").alias("verdict"), "property_status", "evidence_status", "base", "points", "suppressed_by")


def evidence_tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id").agg(*(F.count_if(F.col("evidence_status") == k).alias(k.lower()) for k in EVIDENCE_FACTORS))


def worst_first(settled: DataFrame) -> DataFrame:
    """settled (with severity and title) with position: by status from the worst, then severity, then title; ties by rule.
    Unknown statuses and severities come last."""
    w = Window.partitionBy("capture_id").orderBy(F.desc(lookup("status", STRENGTH, -1)), F.desc(lookup("severity", SEVERITY_RANK, -1)), F.coalesce("title", F.lit("")), "rule_id")
    return settled.withColumn("position", F.row_number().over(w))


def recommendations(settled: DataFrame, advice: dict[str, str]) -> DataFrame:
    """Each advice once for each capture: priority by the highest severity, then the highest points, then the text; the rules
    that ask for it, the highest severity and the rule that leads, by severity and points, of equal ones the first.
    Only failures and warnings ask. settled needs severity."""
    weak = settled.where(F.col("status").isin("FAIL", "WARNING")).withColumn("advice", lookup("rule_id", advice, None)).where("advice is not null")
    rank = lookup("severity", SEVERITY_RANK, -1)
    g = weak.groupBy("capture_id", "advice").agg(
        F.max("points").alias("points"), F.max(rank).alias("_rank"), F.max_by("severity", rank).alias("severity"), F.max_by("rule_id", F.struct(rank, "points", -F.col("ordinal"))).alias("lead_rule"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules")
    )
    return g.withColumn("priority", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("_rank"), F.desc("points"), "advice"))).drop("_rank")


def strongest(evidence) -> F.Column:
    """An aggregate: the strongest of the evidence grades; NOT_VERIFIABLE if there is none."""
    rank = lookup(evidence, EVIDENCE_RANK)
    return F.coalesce(F.min_by(F.col(evidence), rank), F.lit("NOT_VERIFIABLE"))


def catalogue(spark: SparkSession, threats=THREATS) -> DataFrame:
    """The threats as a table; a caller may give others of the same form."""
    return spark.createDataFrame([(*t[:4], list(t[4]), t[5]) for t in threats], "threat_id string, category string, likelihood string, impact string, rule_ids array<string>, from_unverified boolean")


def threat_matrix(settled: DataFrame, threats: DataFrame) -> DataFrame:
    """threats: as catalogue() gives them. Those that a finding of their rules confirms, for each capture: a failure or a
    warning, or for threats from_unverified a property that could not be verified. With the confirming rules, the
    strongest evidence and the points. Rule ids are exploded, so it is an equality join with a small table."""
    t = threats.select("threat_id", "likelihood", "impact", "from_unverified", F.explode("rule_ids").alias("rule_id"))
    level = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
    x = lookup("likelihood", level, 1) + lookup("impact", level, 1)
    risk = F.when(x == 6, "CRITICAL").when(x == 5, "HIGH").when(x == 4, "MODERATE").otherwise("LOW")
    named = settled.select("capture_id", "rule_id", "status", "evidence_status", "points").join(t, "rule_id")
    found = named.where(F.when(F.col("from_unverified"), F.col("status") == "NOT_VERIFIABLE").otherwise(F.col("status").isin("FAIL", "WARNING")))
    g = found.groupBy("capture_id", "threat_id", "likelihood", "impact").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), strongest("evidence_status").alias("evidence"), F.round(F.sum("points"), 2).alias("points"))
    return g.withColumn("risk", risk)


def worst_risk(rows: DataFrame, key: str, risk: str) -> DataFrame:
    rank = {"LOW": 0, "MODERATE": 1, "HIGH": 2, "CRITICAL": 3}
    return rows.groupBy(key).agg(F.max_by(risk, lookup(risk, rank, 0)).alias("worst_risk"))


def resolve_evidence(rows: DataFrame, key: str, observed: str, configured: str) -> DataFrame:
    """The observed value, else the configured one, else none, with the grade of what was taken."""
    grade = F.when(F.col(observed).isNotNull(), "OBSERVED").when(F.col(configured).isNotNull(), "CONFIGURED").otherwise("NOT_VERIFIABLE")
    return rows.select(key, F.coalesce(observed, configured).alias("value"), grade.alias("evidence_status"))


def set_difference(rows: DataFrame, key: str, item: str, left, right) -> DataFrame:
    """Items of each key on the left side that are not on the right one. Each item is settled by itself, however often it comes,
    and only those that are extra are brought together. Null items are on neither side."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = rows.groupBy(key, F.col(item).alias("_item")).agg((has(left) & ~has(right)).alias("_only"))
    extra = F.array_sort(F.collect_list(F.when(F.col("_only"), F.col("_item"))))
    return each.groupBy(key).agg(extra.alias("_extra")).select(key, F.array_join("_extra", ",").alias("extra"), F.size("_extra").cast("long").alias("n"))


def drift(rows: DataFrame, key: str, configured: str, observed: str) -> DataFrame:
    """Keys whose configured value (the largest, of several) is not among the observed ones; unknown where either side has none.
    A key's values are only counted, never brought together."""
    each = rows.groupBy(key, F.col(configured).alias("_set"), F.col(observed).alias("_seen")).agg(F.lit(1).alias("_one"))
    seen = each.select(F.col(key).alias("_k"), "_seen").where("_seen is not null").distinct()
    wanted = each.groupBy(key).agg(F.max("_set").alias("configured"), F.count("_seen").alias("_n"))
    hit = wanted.join(seen, F.col(key).eqNullSafe(F.col("_k")) & (F.col("configured") == F.col("_seen")), "left")
    state = F.when(F.col("configured").isNull() | (F.col("_n") == 0), "NOT_VERIFIABLE").when(F.col("_seen").isNotNull(), "PASS").otherwise("WARNING")
    return hit.select(key, "configured", state.alias("status"))


def stage_rollup(stages: DataFrame, key: str) -> DataFrame:
    """stages: key, component, status, required. failed, ok or partial for each key."""
    fine = F.col("status") == "ok"
    g = stages.groupBy(key).agg(F.bool_or(F.col("required") & ~fine).alias("lacks"), F.bool_and(fine).alias("all"), F.bool_or(fine).alias("some"))
    return g.select(key, F.when(F.col("lacks"), "failed").when(F.col("all"), "ok").when(~F.col("some"), "failed").otherwise("partial").alias("status"))
