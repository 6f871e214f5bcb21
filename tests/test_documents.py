"""Numbers over ranges, versions of documents, windows of a stream that close, reconciliation from pages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowmill.operators import assess, dataset, records
from flowmill.streaming import flows as sf


def test_numbers_of_a_hot_key_come_from_many_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.lit(0) - F.col("id")).alias("o"), "id")
    got = {r.o: (r.k, r.n) for r in dataset.numbered(rows, "k", "o", "n").collect()}
    seen, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        seen[r.k] = seen.get(r.k, 0) + 1
        want[r.o] = (r.k, seen[r.k])
    assert got == want
    plan = dataset.numbered(rows, "k", "o", "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan and "hashpartitioning(k#" not in plan
    assert dataset.numbered(rows.where("false"), "k", "o", "n").count() == 0


def test_versions_with_copies_nulls_and_columns_of_other_names(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "x", 1), (3, "a", "y", 2), (4, "a", None, 3), (5, "a", None, 4), (6, None, "z", 5), (7, None, "x", 6), (8, "b", "", 7)], "id long, k string, t string, refused_ int")
    got = {r.id: (r.refused, r.version) for r in dataset.content_versions(rows, "k", "id", "t").collect()}
    assert got == {1: (False, 1), 2: (True, None), 3: (False, 2), 4: (False, 3), 5: (False, 4), 6: (False, 1), 7: (True, None), 8: (False, 1)}


def test_windows_close_once_and_late_packets_are_counted(spark, tmp_path):
    schema = "capture_id string, ts timestamp, length long"
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)

    def arrive(*rows):
        spark.createDataFrame([(c, None if m is None else t(m), n) for c, m, n in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        out = sf.closed_windows(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", "10 minutes", "1 hour")
        return sorted((r.capture_id or "", r.start.hour, r.packets, r.bytes, r.late) for r in out.collect())

    assert arrive(("a", 5, 1), ("a", 59, 2), (None, 30, 9), ("a", None, 7), ("b", 65, 4)) == []

    assert arrive(("a", 50, 8), ("a", 75, 1)) == [("", 0, 1, 9, 0), ("a", 0, 3, 11, 0)]
    assert arrive(("a", 58, 1), ("c", 10, 1), ("a", 80, 1)) == [("", 0, 1, 9, 0), ("a", 0, 3, 11, 1), ("c", 0, 0, 0, 1)]
    assert arrive(("b", 66, 6), ("z", 200, 1)) == [("", 0, 1, 9, 0), ("a", 0, 3, 11, 1), ("a", 1, 2, 2, 0), ("b", 1, 2, 10, 0), ("c", 0, 0, 0, 1)]


def test_only_the_last_document_counts_and_its_last_line(spark):
    declared = spark.createDataFrame([(i, a, b, r, c) for i, a, b, r, c in (
        ("m", "12.50", "Bank", None, "ABCD0000001"), ("x", "7", "Bank", None, "ABCD0000001"), ("n", None, " ", "", "nope"), ("o", "3", "bank ", "Other", "ABCD0000001"), ("e", "1e2", None, None, "ABCD0000002"))], "instrument string, amount string, bank string, branch string, code string")
    docs = spark.createDataFrame([
        (1, "m", 1, "amount: 99"), (2, "m", 2, "Amount: 1\r\nno\nAMOUNT due:  12.500 "), (3, "x", 1, "amount: 7"), (4, "x", 3, None), (5, "o", 1, "amount 3\namount: 1,000"), (6, "e", 1, "amount: 100.00"), (7, "gone", 1, "amount: 1"), (8, None, 1, "amount: 1"),
    ], "document long, instrument string, version int, text string")
    outside = spark.createDataFrame([("m", "12.5"), ("o", None), ("e", "101")], "instrument string, amount string")
    codes = spark.createDataFrame([("ABCD0000001", "BANK", "Main"), ("ABCD0000002", None, None)], "code string, bank string, branch string")
    out = records.reconcile_documents(declared, docs, outside, codes, {"amount": ("amount", False)}, "^[A-Z]{4}0[A-Z0-9]{6}$")
    got = {r.instrument: (r.document, r.extracted, r.declared_vs_extracted, r.extracted_vs_external, [f.finding_type for f in r.findings], r.status) for r in out.collect()}
    low, mism, none = "requires_human_review", "amount_mismatch_extracted_vs_external", "external_evidence_unavailable"
    assert got == {
        "m": (2, "12.500", "matched", "matched", [], "matched"),
        "x": (4, None, "unconfirmed", "matched", ["amount_unconfirmed", none], low),
        "n": (None, None, "matched", "matched", [none, "ifsc_invalid_format"], "conflicting"),
        "o": (5, "1,000", "unconfirmed", "matched", ["amount_unconfirmed", "ifsc_mismatch"], low),
        "e": (6, "100.00", "matched", "conflicting", [mism], "conflicting"),
    }
    assert out.where("false").count() == 0


def test_amounts_of_text(spark):
    rows = spark.createDataFrame([("1",), (" -2.50 ",), ("1e3",), (".5",), ("1,0",), ("",), (None,), ("1" * 60,), ("NaN",)], "t string")
    assert [None if r[0] is None else float(r[0]) for r in rows.select(records.amount_of("t")).collect()] == [1.0, -2.5, 1000.0, 0.5, None, None, None, None, None]


def test_firsts_differences_and_drift(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", 3, 3), (None, 2, 4), ("b", None, 5), ("b", None, 6), ("c", 9, 0)], "k string, i int, o long")
    assert sorted((r.k, r.o, r.verdict) for r in dataset.first_wins(rows, "k", "o").collect()) == [("a", 1, "accepted"), ("a", 2, "duplicate"), ("a", 3, "duplicate"), ("b", 5, "accepted"), ("b", 6, "duplicate"), ("c", 0, "accepted")]
    got = {r.k: (r.extra, r.n) for r in assess.set_difference(rows, "k", "i", F.col("o") > 0, F.col("o") == 2).collect()}
    assert got == {"a": ("3", 1), None: ("2", 1), "b": ("", 0), "c": ("", 0)}
    seen = spark.createDataFrame([("p", "x", "y"), ("p", "x", "x"), ("w", "x", "y"), ("w", None, "y"), ("n", "x", None), ("m", None, "x"), (None, "x", "x"), ("q", "a", "a"), ("q", "b", "c")], "k string, s string, o string")
    assert {r.k: r.status for r in assess.drift(seen, "k", "s", "o").collect()} == {"p": "PASS", "w": "WARNING", "n": "NOT_VERIFIABLE", "m": "NOT_VERIFIABLE", None: "PASS", "q": "WARNING"}
    assert assess.drift(seen.where("false"), "k", "s", "o").count() == 0
