"""Features and sequence health against plain versions, with flows spread over many ranges of frames."""

import math
import random
import statistics

import pytest

from flowmill.operators import flows as fl
from flowmill.streaming import flows as sf

SCHEMA = "capture_id string, frame_index long, ts_s double, proto string, spi_int long, src string, length long, seq long, udp_encapsulated boolean"


def packets(n=400, seed=1):
    rng = random.Random(seed)
    out, at, seq = [], 0.0, {}
    for i in range(n):
        c, spi = rng.choice("ab"), rng.choice([1, 2, None])
        at += rng.choice([0.0, 0.25, 1000.5])
        seq[c, spi] = seq.get((c, spi), 0) + rng.choice([1, 1, 1, 0, 5, -2])
        out.append((c, i, at, rng.choice(["ESP", "ESP", "ESP", "IKE", None]), spi, rng.choice(["A", "B", None]), 1500, None if rng.random() < 0.05 else seq[c, spi], rng.random() < 0.5))
    return out


def plain_health(rows):
    flows = {}
    for r in sorted(rows, key=lambda r: r[1]):
        if r[3] == "ESP":
            flows.setdefault((r[0], r[4]), []).append(r[7])
    out = {}
    for k, numbers in flows.items():
        steps = [b - a for a, b in zip(numbers, numbers[1:]) if a is not None and b is not None]
        seen = [x for x in numbers if x is not None]
        out[k] = (sum(s - 1 for s in steps if s > 1), sum(s < 0 for s in steps), len(seen) - len(set(seen)), len(numbers))
    return out


@pytest.fixture(params=[4, 1 << 16])
def spread(request, monkeypatch):
    monkeypatch.setattr(fl, "RANGE", request.param)


def test_sequence_health(spark, spread):
    rows = packets()
    got = {(r[0], r[1]): tuple(r)[2:] for r in fl.sequence_health(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (gaps, again, back == 0) for k, (gaps, back, again, _) in plain_health(rows).items()}


def test_sequence_health_of_a_stream_of_several_batches(spark, spread, tmp_path):
    rows = packets()
    for k in range(3):
        part = spark.createDataFrame(rows[k * 150 : k * 150 + 150], SCHEMA).repartition(3)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r[0], r[1]): tuple(r)[2:] for r in sf.stream_sequence_health(stream, f"file://{tmp_path}/out").collect()}
    assert got == {k: (gaps, back, again, n) for k, (gaps, back, again, n) in plain_health(rows).items()}


def test_features_against_plain_ones(spark, spread):
    rows = packets()
    got = {r.capture_id: r for r in fl.features_all(spark.createDataFrame(rows, SCHEMA)).collect()}
    health = plain_health(rows)
    assert set(got) == {"a", "b"}
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        esp = [x for x in own if x[3] == "ESP"]
        steps = [b[2] - a[2] for a, b in zip(esp, esp[1:])]
        per_flow = {}
        for x in esp:
            per_flow[x[4]] = per_flow.get(x[4], 0) + 1
        first = [x for x in esp if x[5] == esp[0][5]]
        want = {
            "capture_packets": len(own), "capture_bytes": sum(x[6] for x in own), "capture_duration_s": own[-1][2] - own[0][2], "esp_packet_share": len(esp) / len(own), "ike_packet_share": sum(x[3] == "IKE" for x in own) / len(own),
            "esp_packets": len(esp), "esp_flow_count": len(per_flow), "esp_largest_flow_share": max(per_flow.values()) / len(esp), "esp_len_std": 0.0, "esp_fwd_packets": len(first), "esp_bwd_packets": len(esp) - len(first),
            "esp_iat_mean_s": statistics.fmean(steps), "esp_iat_std_s": statistics.pstdev(steps), "esp_iat_max_s": max(steps), "esp_span_s": esp[-1][2] - esp[0][2],
            "esp_seq_gap_total": sum(v[0] for k, v in health.items() if k[0] == c), "esp_seq_replay_total": sum(v[2] for k, v in health.items() if k[0] == c), "esp_nonmonotonic_flow_share": statistics.fmean(v[1] > 0 for k, v in health.items() if k[0] == c), "esp_udp_encap_share": sum(x[8] for x in esp) / len(esp),
        }
        for name, value in want.items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-9), (c, name, r[name], value)


def test_features_of_no_packets(spark):
    assert fl.features_all(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fl.sequence_health(spark.createDataFrame([], SCHEMA)).collect() == []
