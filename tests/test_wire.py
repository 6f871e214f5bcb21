"""From bytes to verdicts: IKE messages good and bad, packets from frames, facts, and the assessment of one weak capture."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from flowmill.operators import assess, decode, facts, rules
from flowmill.operators.decode import exchange_of
from flowmill.plans import wire
from tests.test_decode import ether, udp, v4

DATA = "/root/testdata/sf0.001"
CONFIG = {"encryption": "3des", "integrity": "hmac_md5", "dh_group": 2, "pfs": True, "ike_version": 2, "ike_sa_lifetime_s": 259200, "child_sa_lifetime_s": 86400}


def transform(kind, number, tail=b"", size=None):
    return struct.pack("!BBHBBH", 0, 0, 8 + len(tail) if size is None else size, kind, 0, number) + tail


def proposal(protocol, transforms, spi=b"", size=None, spi_size=None):
    body = spi + b"".join(transforms)
    return struct.pack("!BBHBBBB", 0, 0, 8 + len(body) if size is None else size, 1, protocol, len(spi) if spi_size is None else spi_size, len(transforms)) + body


def payload(body, following=0, size=None):
    return struct.pack("!BBH", following, 0, 4 + len(body) if size is None else size) + body


def message(*payloads, first=33, kind=34, version=2, responder=bytes(8), flags=8, number=7, size=None):
    body = b"".join(payloads)
    return b"\x11" * 8 + responder + struct.pack("!BBBBII", first, version << 4, kind, flags, number, 28 + len(body) if size is None else size) + body


WEAK = proposal(3, [transform(1, 3), transform(2, 2), transform(3, 1), transform(4, 2)], bytes.fromhex("c0a81401"))


def test_a_whole_message():
    got = exchange_of(message(payload(WEAK, 40), payload(b"nonce"), flags=40))
    assert (got["version"], got["exchange"], got["initiator"], got["response"], got["message_id"], got["payloads"], got["encrypted"]) == (2, "IKE_SA_INIT", True, True, 7, [33, 40], False)
    assert got["initiator_spi"] == "11" * 8 and got["responder_spi"] == "00" * 8
    assert got["proposals"] == [{"number": 1, "protocol": 3, "spi": "c0a81401", "transforms": [{"type": t, "id": i, "key_bits": None} for t, i in ((1, 3), (2, 2), (3, 1), (4, 2))]}]
    long = exchange_of(message(payload(proposal(1, [transform(1, 12, b"\x80\x0e\x01\x00")]))))
    assert long["proposals"][0]["transforms"] == [{"type": 1, "id": 12, "key_bits": 256}]


@pytest.mark.parametrize("bad", [None, b"", message()[:27], message(kind=177), message(kind=33), message(kind=42), message(kind=35), message(version=3), message(version=0)])
def test_what_is_no_message(bad):
    assert exchange_of(bad) is None


def test_messages_of_version_one_and_with_a_responder():
    assert exchange_of(message(kind=177, version=1))["exchange"] == "IKEV1_EXCHANGE_177"
    assert exchange_of(message(kind=35, responder=b"\2" * 8))["exchange"] == "IKE_AUTH"
    assert exchange_of(message(payload(b"x"), first=46, kind=35, responder=b"\2" * 8))["encrypted"]


def test_cut_and_odd_parts():
    whole = payload(WEAK)
    cut = exchange_of(message(whole[:20], size=28 + 20))
    assert cut["payloads"] == [33] and cut["proposals"] == []
    assert exchange_of(message(whole, size=28))["payloads"] == [] and exchange_of(message(whole, size=27))["payloads"] == [33] == exchange_of(message(whole, size=9999))["payloads"]
    assert exchange_of(message(whole, first=0))["payloads"] == []
    assert exchange_of(message(payload(b"", 5, size=3), whole))["payloads"] == [33]
    sizes = lambda p: [len(x["transforms"]) for x in exchange_of(message(payload(p)))["proposals"]]
    assert sizes(WEAK + WEAK) == [4, 4] and sizes(WEAK + WEAK[:-1]) == [4] and sizes(proposal(3, [], size=7)) == []
    assert sizes(proposal(3, [transform(1, 3)], spi_size=200)) == []
    assert sizes(proposal(3, [transform(1, 3, size=3), transform(4, 2)])) == [2] and sizes(proposal(3, [transform(1, 3, size=500), transform(4, 2)])) == [1]
    assert sizes(b"".join([WEAK] * 40)) == [4] * 32 and sizes(proposal(3, [transform(1, 3)] * 70)) == [64]
    assert len(exchange_of(message(*[payload(b"", 33)] * 40))["payloads"]) == 32


def weak_capture(natt=False):
    first = udp(500, 500, message(payload(WEAK))) if not natt else udp(4500, 4500, bytes(4) + message(payload(WEAK))[4:])
    rows = [ether(0x0800, v4(17, first))] + [ether(0x0800, v4(50, struct.pack("!II", 0xAABBCCDD, n) + b"\xaa" * 16)) for n in range(1, 25)]
    return rows + [ether(0x0800, v4(50, b"\0" * 7)), b"", None]


SCHEMA = "capture_id string, frame_index long, ts double, linktype int, incl_len long, orig_len long, frame binary"


def frames_of(spark, captures):
    return spark.createDataFrame([(c, i, float(i), 1, len(f or b""), len(f or b"") + i % 2, f) for c, fs in captures.items() for i, f in enumerate(fs)], SCHEMA)


def test_packets_of_frames(spark):
    rows = decode.packets_of(frames_of(spark, {"weak": weak_capture()})).orderBy("frame_index").collect()
    assert len(rows) == 28 and [r.proto for r in rows[:3]] == ["IKE", "ESP", "ESP"] and rows[0].ike_parsed and rows[0].ike.exchange == "IKE_SA_INIT"
    assert (rows[1].spi_int, rows[1].seq, rows[1].src, rows[1].dst, rows[1].truncated, rows[2].truncated, rows[1].length) == (0xAABBCCDD, 1, "10.10.10.1", "10.10.10.2", True, False, 58)
    assert [(r.proto, r.length, r.ike_parsed) for r in rows[25:]] == [("OTHER", 41, False), ("OTHER", 0, False), ("OTHER", 0, False)]


def test_a_message_whose_first_number_is_the_marker(spark):
    rows = decode.packets_of(frames_of(spark, {"natt": weak_capture(True), "marked": [ether(0x0800, v4(17, udp(4500, 4500, bytes(4) + message(payload(WEAK)))))]})).where("frame_index = 0").collect()
    assert {r.capture_id: (r.proto, r.ike.initiator_spi) for r in rows} == {"natt": ("IKE", "00000000" + "11" * 4), "marked": ("IKE", "11" * 8)}


@pytest.mark.parametrize("document,want", [
    (CONFIG, ("ENCR_3DES", "AUTH_HMAC_MD5_96", "MODP_1024", True, 2, 259200)),
    ({"identity": {"encryption": "aes256gcm16", "ike_dh_group": "14"}, "ipsec": {"encryption": "des", "pfs": "off", "ike_lifetime_s": "60"}}, ("ENCR_AES_GCM_16", None, "MODP_2048", False, None, 60)),
    ({"encryption": None, "identity": {"encryption": "des"}, "ike_version": "x", "pfs": "maybe"}, ("ENCR_DES", None, None, None, None, None)), ([1], None), ("no json", None), (None, None),
])
def test_configurations(spark, document, want):
    text = document if document is None or isinstance(document, str) else json.dumps(document)
    c = facts.configured(spark.createDataFrame([("a", text)], "capture_id string, document string")).first().config
    assert (None if c is None else (c.encryption, c.integrity, c.dh_group, c.pfs, c.ike_version, c.ike_lifetime)) == want


def test_one_weak_capture_from_bytes_to_score(spark):
    empty = [ether(0x0800, v4(1, b"ping" * 2))]
    packets = decode.packets_of(frames_of(spark, {"weak": weak_capture(), "none": empty})).persist()
    documents = spark.createDataFrame([("weak", json.dumps(CONFIG))], "capture_id string, document string")
    predictions = spark.createDataFrame([("weak", 0.91, "m", "1", "s", "KNOWN"), ("none", 0.5, "", "1", "s", None)], "capture_id string, confidence double, model_id string, model_version string, feature_schema string, decision string")
    table = facts.assemble_facts(packets, facts.configured(documents), predictions).persist()
    row = {r.capture_id: r for r in table.collect()}
    assert row["weak"].child_encryption == ["ENCR_3DES"] and row["weak"].child_groups == ["MODP_1024"] and row["weak"].ike_encryption == [] and row["weak"].pfs_status == "OBSERVED"
    assert (row["weak"].ike_packets, row["weak"].esp_packets, row["weak"].proposals, row["weak"].selection_observable, row["weak"].flows, row["weak"].spis) == (1, 24, 1, False, 1, [])
    assert row["none"].pfs_status == "NOT_VERIFIABLE" and row["none"].exchanges is None and not row["none"].predicted.complete
    settled = facts.settled_findings(table).persist()
    exposure = spark.createDataFrame([("weak", 70)], "capture_id string, privacy_risk int")
    advice = {r[0]: f"mend {r[2]}" for r in rules.RULES}
    out = {r.capture_id: r for r in facts.assess_captures(settled, assess.catalogue(spark), advice, F.when(F.col("status") == "FAIL", "HIGH").otherwise("LOW"), exposure).collect()}
    weak, none = out["weak"], out["none"]
    found = {f.rule_id: f for f in weak.findings}
    assert len(found) == len(none.findings) == 26 and [f.ordinal for f in weak.findings] == list(range(1, 27))
    assert (found["CRYPTO-004"].status, found["CRYPTO-004"].evidence_status, found["CRYPTO-004"].points) == ("FAIL", "OBSERVED", 12.0)
    assert found["CRYPTO-001"].evidence_status == "CONFIGURED" and found["CRYPTO-001"].points == round(12 * 0.85, 2) and found["KEYX-005"].evidence_status == "CONFIGURED"
    assert 0 < weak.security_score < 60 and weak.security_score + weak.risk_score == 100 and weak.risk_level == "CRITICAL"
    assert all(f.points == 0 for f in weak.findings if f.status == "NOT_VERIFIABLE") and 0 < weak.evidence_coverage < 1
    assert {"T-TUNNEL-CIPHER", "T-DH-WEAK", "T-REPLAY-WINDOW-UNKNOWN"} <= {t.threat_id for t in weak.threats} and weak.exposure.privacy_risk == 70
    assert all(c.deducted <= 100 * assess.CATEGORY_WEIGHTS[c.category] for c in weak.categories)
    assert [r.priority for r in weak.recommendations] == list(range(1, len(weak.recommendations) + 1)) and weak.recommendations[0].severity == "HIGH"
    assert none.security_score == 100 and {t.evidence for t in none.threats} <= {"NOT_VERIFIABLE"} and none.exposure is None
    alone = facts.assemble_facts(packets).where("capture_id = 'weak'").first()
    assert alone.config is None and alone.predicted is None


def test_every_verdict_occurs(spark):
    rows = wire.rule_catalogue(spark, DATA).select("rule_id", "status").distinct().collect()
    assert {r.status for r in rows} == {"PASS", "FAIL", "WARNING", "NOT_VERIFIABLE"} and {r.rule_id for r in rows} == {r[0] for r in rules.RULES}
