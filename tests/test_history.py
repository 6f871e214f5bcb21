"""The stored history: replace by id, delete, lists, and that only touched buckets are rewritten."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowmill.operators import history as hi


def rows_of(spark, *rows):
    docs = [(json.dumps({"analysis_id": i, "created_at": t, "status": s, "source": {"kind": k}}),) for i, t, s, k in rows]
    return hi.history_rows(spark.createDataFrame(docs, "document string"))


def files(h):
    root = h.where.removeprefix("file://") + "/rows"
    return {f"{d}/{f}" for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def state(h):
    return sorted((r.analysis_id, r.created_at, r.analysis_state) for r in h.rows().collect())


def test_put_replace_and_delete(spark):
    h = hi.new_history(spark, 8)
    assert h.count() == 0 and h.listed().collect() == []
    h.put(rows_of(spark, *((f"a{k}", f"t{k % 3}", "ok", "x" if k % 2 else "y") for k in range(40)), (None, "t", "ok", "x"), ("a1", "t9", "newest", "x")))
    assert h.count() == 40 and h.point("a1").first().analysis_state == "newest" and h.point("none").count() == 0
    before, old = state(h), files(h)
    h.put(rows_of(spark, ("a5", "t7", "again", "x")))
    assert [r for r in state(h) if r not in before] == [("a5", "t7", "again")] and h.count() == 40
    assert len(old - files(h)) == 1
    once = state(h)
    h.put(rows_of(spark, ("a5", "t7", "again", "x")))
    assert state(h) == once
    h.delete(rows_of(spark, *((f"a{k}", "", "", "") for k in range(0, 40, 2)), ("unknown", "", "", "")))
    assert state(h) == [r for r in once if int(r[0][1:]) % 2]
    h.delete(h.rows())
    assert h.count() == 0
    h.put(rows_of(spark))
    h.delete(rows_of(spark))
    assert h.count() == 0


def test_rows_are_computed_once_and_large_buckets_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(hi, "FILE_ROWS", 10, raising=False)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(i):
        seen.add(1)
        return i

    h = hi.new_history(spark, 2)
    h.put(rows_of(spark, *((f"a{k}", "t", "ok", "x") for k in range(100))).withColumn("bundle_path", read("analysis_id")))
    assert seen.value == 100 and h.count() == 100 and len(files(h)) > 4
    h.put(rows_of(spark, ("a5", "u", "again", "x")))
    h.delete(rows_of(spark, ("a6", "", "", "")))
    assert h.count() == 99 and [r for r in state(h) if r[2] == "again"] == [("a5", "u", "again")]


def test_lists(spark):
    h = hi.new_history(spark, 4)
    h.put(rows_of(spark, *((f"a{k}", f"t{k % 3}", "ok" if k % 4 else "bad", "x" if k % 2 else "y") for k in range(12))))
    assert [r.analysis_id for r in h.listed(4).collect()] == ["a8", "a5", "a2", "a11"]
    assert {r.analysis_id for r in h.listed(source_mode="y", analysis_state="bad", risk_band=None).collect()} == {"a0", "a4", "a8"}
    assert len(h.listed(0).collect()) == 1 and len(h.listed(10**6).collect()) == 12
    with pytest.raises(ValueError, match="no filters"):
        h.listed(color="red")


@pytest.mark.parametrize("document,want", [
    ({"analysis_id": "a", "protocol": {"ipsec_detected": True, "ike_version": 2, "esp_packets": 9, "esp_flows": [{}, {}]}, "source": {"size_bytes": 12}}, ("IPsec, IKEv2, 9 ESP, 2 flow(s)", 12, "", None)),
    ({"analysis_id": "a", "protocol": {"ike_version": "IKEv1", "esp_packets": 0, "esp_flows": []}, "traffic": {"predicted_class": "web"}}, ("IKEv1", 0, "", "web")), ({"analysis_id": "a"}, (None, 0, "", None)),
])
def test_rows_of_documents(spark, document, want):
    r = hi.history_rows(spark.createDataFrame([(json.dumps(document),), ("broken",), (None,)], "document string")).collect()
    assert [(x.protocol_summary, x.capture_size, x.source_mode, x.traffic_prediction) for x in r] == [want] and r[0].asDict().keys() == set(hi.NAMES)


def test_a_document_is_parsed_once_and_odd_parts_are_null(spark):
    odd = ['[{"analysis_id": "a"}]', '{"analysis_id": "b", "protocol": "x", "traffic": [1], "security": {"security_score": 7.50}}', '{"analysis_id": "c", "status": ', '{"analysis_id": 5, "source": {"size_bytes": "9"}}']
    rows = hi.history_rows(spark.createDataFrame([(d,) for d in odd], "document string"))
    assert sorted((r.analysis_id, r.protocol_summary, r.security_score, r.capture_size) for r in rows.collect()) == [("5", None, None, 9), ("b", None, 7.5, 0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple" not in plan


def test_a_change_writes_the_table_once(spark):
    """Only what is put is written beside the table, not the table's rows."""
    h = hi.new_history(spark, 4)
    h.put(rows_of(spark, *((f"a{k}", "t", "ok", "x") for k in range(20))))
    h.put(rows_of(spark, ("a1", "u", "again", "x"), ("b", "u", "new", "x")))
    h.delete(rows_of(spark, ("a2", "", "", "")))
    root = h.where.removeprefix("file://")
    staged = sum(spark.read.parquet(f"{root}/{d}").count() for d in os.listdir(root) if d.startswith("staged"))
    assert staged == 20 + 2 + 1 and h.count() == 20
