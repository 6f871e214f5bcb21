"""Findings, audits, fields and exposure on hand-made rows: subjects, severities, declared classes, nulls and empty tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowmill.operators import assess, dataset, decode, evaluate, flows, records, rules, training
from flowmill.sources import captures

FOUND = "capture_id string, rule_id string, ordinal int, status string, severity string, title string, points double, dedup_key string"


def test_subjects_of_a_rule_stay_apart(spark):
    rows = [("c", "R", 1, "FAIL", "LOW", "t", 1.0, "a"), ("c", "R", 2, "FAIL", "LOW", "t", 3.0, "a"), ("c", "R", 3, "FAIL", "LOW", "t", 3.0, "a"), ("c", "R", 4, "FAIL", "LOW", "t", 0.5, None), ("c", "R", 5, "FAIL", "LOW", "t", 0.0, "b")]
    df = spark.createDataFrame(rows, FOUND)
    assert sorted(r.ordinal for r in assess.collapse(df).collect()) == [2, 4, 5]
    assert [r.ordinal for r in assess.collapse(df.drop("dedup_key")).collect()] == [2]


def test_worst_findings_and_advice_come_first(spark):
    rows = [("c", "R1", 1, "WARNING", "CRITICAL", "b", 1.0, None), ("c", "R2", 2, "FAIL", "LOW", "z", 9.0, None), ("c", "R3", 3, "FAIL", "HIGH", None, 2.0, None), ("c", "R4", 4, "FAIL", "HIGH", "a", 2.0, None), ("c", "R5", 5, "PASS", "INFO", "a", 0.0, None), ("c", "R6", 6, "odd", None, "a", 0.0, None)]
    df = spark.createDataFrame(rows, FOUND)
    assert [r.rule_id for r in assess.worst_first(df).orderBy("position").collect()] == ["R3", "R4", "R2", "R1", "R5", "R6"]
    got = assess.recommendations(df, {"R1": "one", "R2": "two", "R3": "three", "R4": "three", "R5": "five"}).orderBy("priority").collect()
    assert [(r.advice, r.severity, r.lead_rule, r.rules, r.points) for r in got] == [("one", "CRITICAL", "R1", "R1", 1.0), ("three", "HIGH", "R3", "R3,R4", 2.0), ("two", "LOW", "R2", "R2", 9.0)]
    assert assess.recommendations(df.limit(0), {"R1": "one"}).count() == 0


def test_reasons_against_runs(spark):
    schema = "id int, experiment_id string, pcap_path string, valid_capture boolean, error_code string, reasons array<string>, dry_run boolean, file_found boolean"
    rows = [(1, None, "p", True, None, None, False, True), (2, "e", "", True, None, None, False, True), (3, "e", "p", None, None, None, True, False), (4, "e", "p", False, "E1", ["a", "b"], False, True), (5, "e", "p", True, None, None, True, False), (6, "e", "p", True, None, None, None, None), (7, "e", "p", True, "E1", ["a"], False, True)]
    got = {r.id: r.reason for r in dataset.manifest_verdict(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "no experiment_id", 2: "no capture path", 3: "not valid: capture was not validated", 4: "not valid: E1: a; b", 5: "dry run", 6: "capture file is missing", 7: None}


def test_audit(spark):
    fine = [("train", c, f"{c}{i}", 1.0) for c in "ab" for i in range(4)] + [(s, c, f"{s}{c}{i}", 2.0) for s in ("validation", "test") for c in "ab" for i in range(2)]
    found = lambda rows: sorted(tuple(r) for r in dataset.audit_findings(spark.createDataFrame(rows, "s string, c string, k string, v double"), "s", "c", "k", ("v",)).collect())
    assert found(fine) == []
    assert found([*fine, ("test", "new", "a0", float("inf")), ("train", "one", "x", 1.0)]) == [("problem", "a feature value is not finite"), ("problem", "classes never seen in training: new"), ("problem", "groups in several splits"), ("shortage", "classes with few training rows: one")]
    empty = found([])
    assert ("problem", "the train split is empty") in empty and ("problem", "fewer than two training classes") in empty and ("shortage", "a single training group") in empty


def test_fields_of_pages(spark):
    page = "BANK : Left: right \r\nbank without mark\nthe Ifsc code of the bank: ab12\n\nbank:"
    docs = spark.createDataFrame([(1, page), (2, ""), (3, None)], "id int, t string")
    got = sorted(map(tuple, records.extract_fields(docs, "id", "t", {"bank_name": ("bank", False), "ifsc": ("ifsc", True)}).collect()))
    assert got == [(1, 0, "bank_name", "Left: right", "Left: right"), (1, 2, "bank_name", "ab12", "ab12"), (1, 2, "ifsc", "ab12", "AB12"), (1, 4, "bank_name", "", "")]


def test_predictions_decide_the_risk(spark):
    schema = "capture_id string, frame_index long, ts_s double, proto string, spi_int long, src string, length long, seq long, udp_encapsulated boolean"
    packets = spark.createDataFrame([(c, i, float(i), "ESP", 1, "A", 100, i, False) for c in "abcd" for i in range(3)], schema)
    told = spark.createDataFrame([("a", 0.9, "m", "1", "s"), ("b", 0.7, "m", "1", "s"), ("c", 0.9, None, "1", "s")], "capture_id string, confidence double, model_id string, model_version string, feature_schema string")
    got = {r.capture_id: (r.inference_risk, r.ml_available, r.ml_confidence) for r in flows.fingerprintability(packets, predictions=told).collect()}
    assert got == {"a": ("HIGH", True, 0.9), "b": ("MODERATE", True, 0.7), "c": ("LOW", False, None), "d": ("LOW", False, None)}
    assert {r.inference_risk for r in flows.fingerprintability(packets).collect()} == {"LOW"}
    seen = {r.capture_id: r.exposure for r in flows.exposure_observations(packets, predictions=told).where("observation = 'class-inference'").collect()}
    assert seen == {"a": "high", "b": "medium", "c": "high", "d": "unknown"}


def test_declared_classes(spark):
    labels = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "truth int, predicted int")
    assert {tuple(r) for r in evaluate.confusion_matrix(labels, [0, 1]).collect()} == {(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)}
    assert evaluate.macro_metrics(labels, [0, 1, 2, 3]).first()["macro_recall"] == 0.125
    assert evaluate.per_class_metrics(labels, [0, 7]).count() == 2


def test_rates_of_empty_sides(spark):
    rows = spark.createDataFrame([(0, 0, "UNKNOWN")], "truth int, predicted int, decision string")
    known, none = (evaluate.open_world_metrics(rows, F.lit(k)).first() for k in (True, False))
    assert (known.known_acceptance, known.false_rejection, known.accuracy_when_accepted, known.unknown_rejection) == (0.0, 1.0, 0.0, None)
    assert (none.known_acceptance, none.false_rejection, none.accuracy_when_accepted, none.unknown_rejection) == (0.0, 1.0, 0.0, 1.0)


def test_groups_by_scope(spark):
    rows = [("a", 1, 4, 14), ("a", 1, 4, 2), ("a", 1, 1, 12), ("a", 3, 4, 19), ("a", 2, 4, 5), ("b", None, None, None)]
    got = {r.capture_id: (r.ike_groups, r.child_groups) for r in decode.dh_groups(spark.createDataFrame(rows, "capture_id string, protocol_id int, transform_type int, transform_id int")).collect()}
    assert got == {"a": ("2,14", "5,19"), "b": ("", "")}


def test_files_of_a_dataset(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "x", 0.5, "g"), (2, "test", "y", None, "h"), (3, "train", "y", 2.0, "g")], "id int, split string, label string, f double, k string")
    captures.write_csv(rows.coalesce(1), f"file://{tmp_path}/csv", ["label", "id", "f"])
    text = next(Path(tmp_path, "csv").glob("*.csv")).read_text()
    assert text.splitlines() == ["label,id,f", "x,1,0.5", "y,2,", "y,3,2.0"]
    captures.write_summary(rows, f"file://{tmp_path}/summary", "split", "label", "k")
    lines = [line for p in Path(tmp_path, "summary").glob("*.json") for line in p.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [{"rows": 3, "groups": 2, "by_split": {"train": 2, "test": 1}, "by_label": {"x": 1, "y": 2}}]


def test_malformed_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": \nnot json\n{"a": 2}\n')
    got = captures.read_jsonl(spark, f"file://{tmp_path}/x.json", "a int").collect()
    assert sorted(r.a for r in got if r._corrupt is None) == [1, 2] and sum(r._corrupt is not None for r in got) == 2


def test_admission(spark):
    files = [("e", 0, b""), ("n", 4, b"\x0a\x0d\x0d\x0a"), ("o", 4, b"abcd"), ("b", captures.MOST_BYTES + 1, b"\xd4\xc3\xb2\xa1"), ("f", 4, b"\xd4\xc3\xb2\xa1")]
    got = {r.path: r.reason for r in captures.admit(spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in files], "path string, length long, content binary")).collect()}
    assert got == {"e": "empty", "n": "PCAPNG is not supported", "o": "not a capture", "b": "too large", "f": None}


def test_mitigation_states_what_it_is(spark):
    rows = spark.createDataFrame([(i, i % 2, ("train", "validation", "test")[i % 3], float(i % 2) + 0.01 * i) for i in range(60)], "id int, label int, split string, f double")
    how = (rows, ["f"], "id", training.candidates()["logistic"][1], lambda r: r.withColumn("f", F.when(F.col("id") < 30, 0.0).otherwise(F.col("f"))))
    got = {r.attacker: r for r in training.mitigation(*how).collect()}
    assert set(got) == {"baseline", "frozen", "retrained"} and got["baseline"].delta == 0 and {(r.changed_rows, r.provenance) for r in got.values()} == {(29, "simulated")}
    with pytest.raises(ValueError):
        training.mitigation(*how, claim=True)


def test_rules_of_a_caller(spark):
    facts = spark.createDataFrame([("a", 1), ("b", None), ("c", 5)], "capture_id string, n int")
    own = [rules.Rule("X", "C", "p", {"FAIL": 3.0}, F.when(F.col("n") < 3, "FAIL").when(F.col("n") >= 3, "PASS"), F.lit("OBSERVED")), rules.Rule("Y", "C", "q", {}, F.lit("WARNING"), F.lit(None).cast("string"), F.col("n") > 3)]
    got = sorted((r.capture_id, r.rule_id, r.ordinal, r.status, r.evidence_status, r.base) for r in rules.caller_verdicts(facts, own).collect())
    assert got == [("a", "X", 1, "FAIL", "OBSERVED", 3.0), ("b", "X", 1, "NOT_VERIFIABLE", "OBSERVED", 0.0), ("c", "X", 1, "PASS", "OBSERVED", 0.0), ("c", "Y", 2, "WARNING", "NOT_VERIFIABLE", 0.0)]
    assert rules.caller_verdicts(facts, []).count() == 0
    assert assess.price(rules.caller_verdicts(facts, own)).count() == 4


def test_design(spark):
    schema = "mode string, encryption string, integrity string, dh_group int, pfs boolean, ip_version int, traffic string"
    rows = [(m, e, i, g, p, v, t) for m in ("tunnel", "transport") for e, i in (("aes128gcm", "none"), ("aes256cbc", "hmac_sha256")) for g in (14, 19, 31) for p in (True, False) for v in (4, 6) for t in ("web", "voip")]
    failed = lambda rows: {r.key for r in dataset.design_coverage(spark.createDataFrame(rows, schema), ["web", "voip"], ["aes128gcm", "aes256cbc"]).collect() if not r.passed}
    assert failed(rows) == set()
    assert failed([*rows, ("tunnel", "aes128gcm", "hmac_sha256", 14, True, 4, "web"), ("tunnel", "aes128cbc", None, None, None, None, None)]) == {"aead_without_separate_hmac", "cbc_requires_hmac", "config_traffic_cross", "traffic_config_cross"}
    assert len(failed([])) == 20


def test_answers_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 0.1, 0.4, "m", None), (2, 0, 0.5, 0.1, 0.4, "m", 1)], "row_id int, predicted int, confidence double, p2 double, margin double, model_id string, label int")
    assert {r.row_id: r.refused for r in evaluate.prediction_contract(rows).collect()} == {1: None, 2: "carries an answer"}


def test_countermeasures(spark):
    rows = spark.createDataFrame([("a", 100.0), ("b", 130.0)], "capture_id string, esp_avg_len double")
    pad = training.Padding(64)
    assert [r.esp_avg_len for r in pad(rows).orderBy("capture_id").collect()] == [128.0, 192.0] and pad.describe() == {"name": "padding", "provenance": "simulated", "target": 64, "bucket": True}
    assert pad.overhead(rows).first()["mean_after"] == 160.0
    with pytest.raises(ValueError):
        training.Padding(0)
