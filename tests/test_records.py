"""Records, datasets and findings on hand-made rows: repeats, nulls, ties, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from flowmill.operators import assess, dataset, flows, records, rules, runs, training


def test_versions_skip_refused_rows(spark):
    rows = [(1, "x", "a"), (2, "x", "b"), (3, "y", "a"), (4, "x", "b"), (5, "x", None), (6, "y", "c"), (7, "x", None), (8, "x", "d")]
    got = {r.id: (r.refused, r.version) for r in dataset.content_versions(spark.createDataFrame(rows, "id int, k string, t string"), "k", "id", "t").collect()}
    assert got == {1: (False, 1), 2: (False, 2), 3: (True, None), 4: (True, None), 5: (False, 3), 6: (False, 1), 7: (False, 4), 8: (False, 5)}


def test_upsert_takes_the_last_repeat(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 9), (2, "z", 7), (4, "w", 1), (None, "n", 1)], "id int, v string, at int")
    assert sorted(map(tuple, records.upsert_latest(old, new, "id", "at").collect())) == [(1, "a", 1), (2, "y", 9), (3, "c", 1), (4, "w", 1)]
    assert records.upsert_latest(old, new.limit(0), "id", "at").count() == 3


def test_policy_rules(spark):
    rows = [(1, 80, 100, "Private", "S", "P"), (2, 80, 100, "Public", "S", "P"), (3, None, 100, "Private", "S", "P"), (4, 80, None, "Private", "T", "P"), (5, 75, 100, "Private", None, "P")]
    docs = spark.createDataFrame(rows, "id int, amount long, required long, category string, segment string, priority string")
    rules = [("A", 1, "{}", 1, None), ("A", 2, "{}", None, '{"private_leased_property": true, "private_leased_property_percent": 25}'), ("B", 1, '{"segment": "T"}', 10, None)]
    table = spark.createDataFrame(rules, "rule_id string, version int, condition string, required long, adjustments string")
    got = {(r.id, r.rule_id): (r.required, r.reason, r.result) for r in records.evaluate_policies(docs, table).collect()}
    assert got == {(1, "A"): (75.0, "meets", "PASS"), (2, "A"): (100.0, "below", "FAIL"), (3, "A"): (75.0, "amount not declared", "FAIL"), (4, "A"): (None, "rule has no amount", "FAIL"), (4, "B"): (10.0, "meets", "PASS"), (5, "A"): (75.0, "meets", "PASS")}


def test_reconciliation(spark):
    schema = "id int, declared long, extracted long, external long, external_available boolean, code_format_ok boolean, code_conflicts boolean"
    rows = [(1, 5, 5, 5, True, True, False), (2, 5, 6, 6, True, True, False), (3, 5, None, 5, True, True, False), (4, 5, 5, None, False, True, False), (5, 5, 5, 5, True, True, True), (6, 5, 5, 5, True, False, None), (7, None, None, None, None, True, None), (8, 5, 5, 6, True, True, False)]
    df = spark.createDataFrame(rows, schema)
    found = records.reconcile_findings(df, "id")
    assert {r.id: (r.status, r.findings) for r in records.reconcile_status(df, found, "id").collect()} == {
        1: ("matched", 0), 2: ("conflicting", 1), 3: ("requires_human_review", 1), 4: ("requires_human_review", 1), 5: ("requires_human_review", 1), 6: ("conflicting", 1), 7: ("requires_human_review", 1), 8: ("conflicting", 1),
    }
    assert {(r.id, r.finding_type) for r in found.collect()} >= {(2, "amount_mismatch_declared_vs_extracted"), (8, "amount_mismatch_extracted_vs_external"), (7, "external_evidence_unavailable"), (6, "ifsc_invalid_format")}


def test_wire_names(spark):
    cases = [("AES-256-GCM", "encryption", "ENCR_AES_GCM_16"), ("3des", "encryption", "ENCR_3DES"), ("encr aes cbc", "encryption", "ENCR_AES_CBC"), ("sha256", "integrity", "AUTH_HMAC_SHA2_256_128"), ("sha256", "prf", "PRF_HMAC_SHA2_256"), ("14", "group", "MODP_2048"), ("group14", "group", "MODP_2048"), ("x25519", "group", "CURVE25519"), ("99", "group", "DH_GROUP_99"), ("twofish", "encryption", "TWOFISH"), ("  ", "group", ""), (None, "encryption", "")]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "i int, n string")
    for kind in ("encryption", "integrity", "prf", "group"):
        got = {r.i: r.w for r in df.select("i", rules.wire_name(F.col("n"), kind).alias("w")).collect()}
        assert all(got[i] == want for i, (_, k, want) in enumerate(cases) if k == kind)


def test_threats(spark):
    rows = [("c", "CRYPTO-001", "FAIL", "OBSERVED", 5.0), ("c", "KEYX-003", "WARNING", "INFERRED", 1.0), ("c", "KEYX-004", "FAIL", "CONFIGURED", 2.0), ("c", "KEYX-007", "NOT_VERIFIABLE", "NOT_VERIFIABLE", 0.0), ("c", "REPLAY-002", "FAIL", "OBSERVED", 3.0), ("c", "SA-003", "PASS", "OBSERVED", 0.0), ("d", "REPLAY-003", "NOT_VERIFIABLE", None, 0.0), ("d", "META-001", "WARNING", "OBSERVED", 1.0)]
    settled = spark.createDataFrame(rows, "capture_id string, rule_id string, status string, evidence_status string, points double")
    got = {(r.capture_id, r.threat_id): (r.rules, r.evidence, r.points, r.risk) for r in assess.threat_matrix(settled, assess.catalogue(spark)).collect()}
    assert got == {
        ("c", "T-IKE-CIPHER"): ("CRYPTO-001", "OBSERVED", 5.0, "CRITICAL"), ("c", "T-NO-FORWARD-SECRECY"): ("KEYX-003,KEYX-004", "CONFIGURED", 3.0, "HIGH"), ("c", "T-IDENTITY-UNVERIFIED"): ("KEYX-007", "NOT_VERIFIABLE", 0.0, "HIGH"),
        ("d", "T-REPLAY-WINDOW-UNKNOWN"): ("REPLAY-003", "NOT_VERIFIABLE", 0.0, "MODERATE"), ("d", "T-SPI-VISIBILITY"): ("META-001", "OBSERVED", 1.0, "MODERATE"),
    }
    listed = {r for t in assess.THREATS for r in t[4]}
    assert len(assess.THREATS) == 20 and listed <= {r[0] for r in rules.RULES}


def test_exposure_bands_and_sizes(spark):
    points = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", None)]
    rows = spark.createDataFrame([(k, "o", p) for k, p in points], "capture_id string, observation string, points int")
    assert {r.capture_id: (r.privacy_risk, r.band) for r in flows.exposure_score(rows).collect()} == {"a": (25, "moderate"), "b": (50, "elevated"), "c": (75, "high"), "d": (100, "high"), "e": (0, "low")}
    sizes = spark.createDataFrame([(-1.0,)], "esp_bytes double")
    with pytest.raises(Exception, match="negative"):
        flows.pad_sizes(sizes, 64).collect()


def test_capture_verdicts(spark):
    scanned = spark.createDataFrame([(1, 90, 3, 5, 9, 0), (2, 90, 0, 0, 9, 0), (3, 5, 1, 1, 0, 5), (4, 90, 3, 0, 9, 0), (5, 90, 1, 1, 9, 0)], "run int, packets long, ike long, esp long, ipv4 long, ipv6 long")
    lines = [(1, "  isakmp   frames:3 bytes:9"), (1, "esp frames:5"), (2, "x"), (4, " esp  frames:7 bytes:1"), (4, "isakmp frames:2"), (4, "isakmp frames:1"), (6, "esp frames:70"), (6, "ikev2 frames:2"), (6, "ip frames:72")]
    logged = runs.log_counts(spark.createDataFrame(lines, "run int, line string"), "run")
    got = {r.run: (r.packets, r.verdict, r.reasons) for r in runs.capture_verdict(scanned, logged, "run", 60, ip_version=4).collect()}
    assert got == {1: (90, "VALID", ""), 2: (90, "INVALID", "no IKE; no ESP"), 3: (5, "INVALID", "too few packets; no IPv4"), 4: (90, "UNVERIFIED", "sources disagree about IKE or ESP"), 5: (90, "VALID", "no log"), 6: (72, "VALID", "")}


def test_gates(spark):
    rows = [(1, True, True, "s", "p", True, True, False), (2, True, False, "s", "", True, True, None), (3, True, True, "s", "p", True, True, True), (4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, ike_established boolean, child_installed boolean, xfrm_state string, xfrm_policy string, protected_payload boolean, esp_observed boolean, failed boolean")
    got = {r.id: (r.state, r.unmet) for r in runs.gate_state(df, "id").collect()}
    assert got == {1: ("FINALIZED", ""), 2: ("INCOMPLETE", "child_sa_verified,xfrm_policy_verified,protected_payload_verified"), 3: ("FAILED", ""), 4: ("INCOMPLETE", ",".join(runs.GATES))}


def test_broken_documents_are_rows(spark, tmp_path):
    for name, text in {"a": '{"run": "r1", "n": 3}', "b": '{"run": "r2", ', "c": '{\n "n": 4\n}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file[-6]: r.reason for r in runs.scan_documents(spark, str(tmp_path), "run string, n int", ("run",)).collect()}
    assert got == {"a": None, "b": "broken", "c": "no run"}


def test_guards(spark):
    rows = spark.createDataFrame([(i, i % 3, ["train", "validation"][i % 2], float(i), i % 4) for i in range(60)], "id int, label int, split string, f double, g int")
    with pytest.raises(ValueError, match="both sides"):
        training.heldout_config(rows, ["f"], "id", F.col("id") < 30, training.candidates()["tree"][1], group="g")
    with pytest.raises(ValueError, match="needs columns"):
        training.score(training.fit(rows, ["f"], training.candidates()["tree"][1]), rows.drop("f"), "id")
    assert training.feature_columns(rows, ["g", "f", "x"], ("g",)) == ["f"]
    assert training.leakage_audit(["f", "g", "q"], ["f", "g"], ("g",)) == [("g", "shortcut"), ("q", "not allowed")]


def test_columns_named_after_the_answer():
    from flowmill.operators import training

    names = ["f", "label", "Traffic_Class_proxy", "capture_id", "esp_class", "x"]
    assert training.leakage_audit(names, ["f", "label", "esp_class"], ()) == [("label", "forbidden"), ("Traffic_Class_proxy", "named after the answer"), ("capture_id", "forbidden"), ("x", "not allowed")]


def test_status_of_runs(spark):
    from flowmill.operators import runs

    rows = [(1, "FINALIZED", "", True, False, True), (2, "FINALIZED", "", True, False, False), (3, "FINALIZED", "", True, False, None), (4, "FAILED", "", True, True, None), (5, "INCOMPLETE", "a", False, True, True), (6, "INCOMPLETE", "a", True, None, False), (7, "INCOMPLETE", "a", False, None, None)]
    got = runs.run_status(spark.createDataFrame(rows, "run int, state string, unmet string, esp_verified boolean, blocked boolean, esp_in_capture boolean"), "run")
    want = [("VALID", None), ("INCOMPLETE", "no ESP in the capture"), ("INCOMPLETE", "all gates but no capture"), ("INVALID", None), ("BLOCKED", None), ("INCOMPLETE", "no ESP in the capture"), ("INCOMPLETE", None)]
    assert [(r.status, r.refused) for r in got.orderBy("run").collect()] == want
