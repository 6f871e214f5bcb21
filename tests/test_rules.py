"""The rule catalogue on captures whose verdicts are known, and over a whole table."""

import pytest

from flowmill.operators import assess
from flowmill.operators.rules import FACTS, RULES, rule_verdicts
from flowmill.plans.wire import rule_catalogue

NONE = {"config": None, "predicted": None}
CONFIG = {"encryption": "ENCR_3DES", "integrity": "AUTH_HMAC_MD5_96", "prf": None, "dh_group": "MODP_1024", "pfs": True, "child_group": None, "ike_version": 1, "replay_protection": False, "ike_lifetime": 259200, "child_lifetime": 90000}
STRONG = {
    "ike_encryption": ["ENCR_AES_GCM_16"], "ike_integrity": [], "ike_prf": ["PRF_HMAC_SHA2_256"], "ike_groups": ["ECP_256"], "child_encryption": ["ENCR_AES_GCM_16"], "child_integrity": None, "child_groups": ["ECP_256", "MODP_2048"],
    "proposals": 1, "selection_observable": False, "pfs_status": "OBSERVED", "exchanges": [("IKE_AUTH", 2, [46], True)], "ike_versions": [2], "ike_packets": 4, "esp_packets": 40, "spis": ["c0ffee01"],
    "flows": 1, "encapsulated": 0, "gaps": 0, "replays": 0, "disordered": 0, "predicted": (0.91, True, False),
}
OFFERS = {"ike_encryption": ["ENCR_AES_GCM_16", "ENCR_DES", None], "ike_integrity": ["odd"], "child_encryption": ["ENCR_AES_CBC"], "proposals": 2, "ike_packets": 2, "esp_packets": 25, "flows": 2, "encapsulated": 1, "spis": ["FFFFFFFF"], "replays": 1, "exchanges": [("IKE_AUTH", 1, [5], False)], "ike_versions": [1]}
WANT = {
    "none": {r[0]: "NOT_VERIFIABLE" for r in RULES},
    "config": {"CRYPTO-001": "FAIL", "CRYPTO-002": "FAIL", "CRYPTO-003": "NOT_VERIFIABLE", "KEYX-001": "FAIL", "KEYX-002": "NOT_VERIFIABLE", "KEYX-003": "PASS", "KEYX-004": "PASS", "KEYX-005": "WARNING", "KEYX-006": "FAIL", "KEYX-008": "FAIL", "REPLAY-002": "FAIL", "CONFIG-001": "PASS", "CONFIG-002": "NOT_VERIFIABLE", "CONFIG-003": "PASS"},
    "strong": {"CRYPTO-001": "PASS", "CRYPTO-002": "PASS", "CRYPTO-003": "PASS", "CRYPTO-005": "PASS", "KEYX-001": "PASS", "KEYX-002": "PASS", "KEYX-003": "PASS", "KEYX-004": "NOT_VERIFIABLE", "KEYX-007": "NOT_VERIFIABLE", "KEYX-008": "PASS", "SA-001": "PASS", "SA-002": "PASS", "SA-003": "PASS", "REPLAY-001": "PASS", "CONFIG-002": "PASS", "META-001": "WARNING", "META-002": "WARNING", "META-003": "WARNING"},
    "offers": {"CRYPTO-001": "WARNING", "CRYPTO-002": "NOT_VERIFIABLE", "CRYPTO-004": "PASS", "CRYPTO-005": "FAIL", "KEYX-007": "WARNING", "KEYX-008": "FAIL", "SA-002": "WARNING", "SA-003": "WARNING", "REPLAY-001": "WARNING", "CONFIG-002": "PASS"},
    "drift": {"CONFIG-003": "WARNING", "KEYX-004": "FAIL", "KEYX-003": "FAIL", "SA-001": "FAIL"},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [NONE | {"capture_id": "none"}, {"capture_id": "config", "config": CONFIG}, STRONG | {"capture_id": "strong"}, OFFERS | {"capture_id": "offers"}]
    rows.append({"capture_id": "drift", "config": CONFIG, "ike_encryption": ["ENCR_AES_CBC"], "proposals": 1, "pfs_status": "DISABLED", "ike_packets": 1})
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FACTS.replace("\n", " "))
    full = [tuple(r.get(f.name) for f in schema) for r in rows]
    return rule_verdicts(spark.createDataFrame(full, schema))


def test_verdicts(found):
    rows = found.collect()
    got = {(r["capture_id"], r["rule_id"]): r for r in rows}
    assert len(rows) == len(got) == 5 * len(RULES)
    for capture, want in WANT.items():
        assert {k: got[capture, k]["status"] for k in want} == want, capture
    assert got["config", "CRYPTO-001"]["base"] == 12.0 and got["config", "CRYPTO-001"]["evidence_status"] == "CONFIGURED"
    assert got["config", "KEYX-006"]["base"] == 20.0 and got["offers", "CRYPTO-001"]["base"] == 20.0 and got["offers", "KEYX-008"]["base"] == 14.0
    assert got["strong", "META-003"]["confidence"] == 0.91 and got["strong", "META-003"]["evidence_status"] == "INFERRED"
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "").replace("ExistingRDD", "")


def test_verdicts_are_priced_and_settled(found):
    score = {r["capture_id"]: r["security_score"] for r in assess.security_score(assess.settle(assess.collapse(assess.price(found)))).collect()}
    assert score["none"] == 100.0 and score["strong"] > score["offers"] > 0 and score["drift"] < 100


def test_over_a_whole_table(spark):
    rows = rule_catalogue(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("count(distinct date_format(ts,'yyyy-MM-dd'), user_id % 4) n").first()[0]
    assert rows.count() == 26 * n and rows.where("status is null or evidence_status is null or base is null").count() == 0
