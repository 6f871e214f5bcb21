"""Header decoding on hand-made frames: both versions of IP, every link type, lengths of 0, cut and odd packets."""

import struct

import pytest

from flowmill.operators import decode as dc
from flowmill.sources import captures as src

A4, B4 = bytes([10, 10, 10, 1]), bytes([10, 10, 10, 2])
A6, B6 = bytes.fromhex("fd001010000000000000000000000001"), bytes.fromhex("fd001010000000000000000000000002")
ESP = struct.pack("!II", 0xC0FFEE01, 7) + b"data"


def udp(sport, dport, body):
    return struct.pack("!4H", sport, dport, 8 + len(body), 0) + body


def v4(proto, body, total=None, ihl=5):
    n = 4 * ihl + len(body) if total is None else total
    return bytes([0x40 | ihl, 0]) + struct.pack("!H", n) + bytes(5) + bytes([proto]) + bytes(2) + A4 + B4 + bytes(4 * (ihl - 5)) + body


def v6(proto, body, length=None, src=A6, dst=B6):
    return b"\x60\0\0\0" + struct.pack("!H", len(body) if length is None else length) + bytes([proto, 64]) + src + dst + body


def ether(kind, packet, tag=b""):
    return bytes(12) + tag + struct.pack("!H", kind) + packet


def run(spark, cases):
    """Each case: linktype, frame. The decoded rows in their order."""
    df = spark.createDataFrame([(i, link, frame) for i, (link, frame) in enumerate(cases)], "i int, linktype int, frame binary")
    rows = dc.decode_esp(dc.classify(dc.decode_ip(dc.strip_link(df)))).collect()
    return sorted(rows, key=lambda r: r.i)


def test_mixed_capture(spark):
    ike = b"\1" * 8 + bytes(8) + bytes([33, 0x20, 34, 8]) + bytes(8)
    frames = [
        ether(0x0800, v4(17, udp(500, 500, ike))), ether(0x0800, v4(17, udp(500, 500, ike))), ether(0x0800, v4(50, ESP)), ether(0x0800, v4(1, b"ping")),
        ether(0x0800, v4(50, ESP)), ether(0x86DD, v6(17, udp(4500, 4500, bytes(4) + ike))), ether(0x86DD, v6(50, ESP)),
    ]
    rows = run(spark, [(dc.ETHERNET, f) for f in frames])
    assert [r.kind for r in rows] == ["IKE", "IKE", "ESP", "ICMP", "ESP", "IKE", "ESP"]
    assert [r.ip_version for r in rows] == [4, 4, 4, 4, 4, 6, 6] and (rows[6].src, rows[6].dst) == ("fd00:1010::1", "fd00:1010::2")
    assert {(r.spi, r.sequence_number) for r in rows if r.kind == "ESP"} == {(0xC0FFEE01, 7)}
    assert bytes(rows[0].body) == bytes(rows[5].body) == ike


def test_link_types(spark):
    p4, p6 = v4(50, ESP), v6(50, ESP)
    cases = [
        (dc.ETHERNET, ether(0x0800, p4, b"\x81\0\0\1")), (dc.ETHERNET, ether(0x86DD, p6, b"\x88\xa8\0\1")), (dc.RAW, p4), (dc.RAW, p6), (dc.SLL, bytes(14) + b"\x08\0" + p4), (dc.SLL2, b"\x86\xdd" + bytes(18) + p6),
        (dc.NULL, b"\2\0\0\0" + p4), (dc.NULL, b"\x1e\0\0\0" + p6), (147, p4), (147, bytes(14) + p6), (None, p4),
    ]
    rows = run(spark, cases)
    assert [r.ip_version for r in rows] == [4, 6, 4, 6, 4, 6, 4, 6, 4, 6, 4] and all(r.spi == 0xC0FFEE01 for r in rows)
    bad = [(dc.ETHERNET, ether(0x0806, p4)), (dc.ETHERNET, b"\0" * 13), (dc.NULL, b"\3\0\0\0" + p4), (dc.SLL, bytes(15)), (dc.SLL2, bytes(10)), (dc.RAW, b""), (dc.ETHERNET, None), (147, b"abc")]
    assert all((r.ip_version, r.protocol, r.src, r.payload, r.kind) == (None, None, None, None, "OTHER") for r in run(spark, bad))


def test_lengths_versions_and_chains(spark):
    chain = lambda *kinds: b"".join(bytes([k, 0]) + bytes(6) for k in kinds)
    cases = [
        v4(50, ESP, total=0), v4(50, ESP, total=20), v4(50, ESP + b"pad", total=20 + len(ESP)), v4(50, ESP, total=4000), v4(50, ESP, ihl=7), v6(50, ESP, length=0), v6(50, ESP + b"pad", length=len(ESP)), v6(50, ESP, length=4000),
        v6(0, chain(43, 44, 60, 135, 139, 140, 50) + ESP), v6(44, bytes([50, 9]) + bytes(6) + ESP), v6(0, bytes([50, 1]) + bytes(14) + ESP), v6(0, chain(*[0] * 8)),
    ]
    rows = run(spark, [(dc.RAW, c) for c in cases])
    assert [bytes(r.payload) for r in rows[:11]] == [ESP] * 11 and [r.protocol for r in rows] == [50] * 11 + [0]
    wrong = [b"\x90" + v4(50, ESP)[1:], v4(50, ESP)[:19], v4(50, b"", ihl=15)[:40], v6(50, b"")[:39], v6(0, b"\x32"), v6(0, bytes([50, 200]) + bytes(20))]
    assert all(r.protocol is None and r.kind == "OTHER" for r in run(spark, [(dc.RAW, c) for c in wrong]))


def test_ports_and_short_headers(spark):
    cases = [udp(500, 4500, ESP), udp(4500, 500, ESP), udp(4500, 1, ESP), udp(1, 4500, bytes(4) + b"x"), udp(4500, 4500, ESP[:11]), udp(53, 53, b"q"), b"\x11\x94\x11"]
    rows = run(spark, [(dc.RAW, v4(17, c)) for c in cases])
    assert [r.kind for r in rows] == ["IKE", "IKE", "ESP", "IKE", "OTHER", "OTHER", "OTHER"]
    assert [r.udp_encapsulated for r in rows] == [False, False, True, False, False, False, False]
    short = run(spark, [(dc.RAW, v4(50, ESP[:7]))])[0]
    assert (short.kind, short.spi) == ("ESP", None)


@pytest.mark.parametrize("address,text", [
    ("00" * 16, "::"), ("00" * 15 + "01", "::1"), ("fe80" + "00" * 14, "fe80::"), ("20010db8000000000001000000000001", "2001:db8::1:0:0:1"), ("20010000000000010000000000000002", "2001:0:0:1::2"),
    ("00010002000300040005000600070008", "1:2:3:4:5:6:7:8"), ("00010000000300040005000600070000", "1:0:3:4:5:6:7:0"), ("00" * 10 + "ffff0a0a0a01", "::ffff:10.10.10.1"), ("00100000000001000000000000000a00", "10:0:0:100::a00"),
])
def test_addresses(spark, address, text):
    assert run(spark, [(dc.RAW, v6(59, b"", src=bytes.fromhex(address)))])[0].src == text


def test_capture_files(spark, tmp_path):
    """Files on disk: both byte orders and units of time, a cut tail, and every reason to refuse one."""
    frame = ether(0x0800, v4(50, ESP))

    def capture(order, magic, unit, tail=b""):
        head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
        return head + b"".join(struct.pack(order + "4I", 1700000000 + k, k * unit // 2, len(frame), len(frame) + k) + frame for k in range(3)) + tail

    files = {"a.pcap": capture("<", 0xA1B2C3D4, 10**6), "b.pcap": capture(">", 0xA1B23C4D, 10**9, b"\0" * 9), "c.pcap": capture("<", 0xA1B2C3D4, 0, struct.pack("<4I", 1, 0, 1 << 20, 1)), "empty.pcap": b"", "ng.pcap": b"\x0a\x0d\x0d\x0a" + bytes(30), "text.pcap": b"hello, no capture"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = src.capture_frames(spark, str(tmp_path / "*.pcap")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.frame_index, round(r.ts, 3), r.incl_len, r.orig_len, r.linktype, bytes(r.frame)))
    want = [(k, 1700000000 + k + k / 2, len(frame), len(frame) + k, 1, frame) for k in range(2)]
    assert set(got) == {"a.pcap", "b.pcap", "c.pcap"} and all(len(v) == 3 for v in got.values())
    assert sorted(got["a.pcap"])[:2] == sorted(got["b.pcap"])[:2] == want
    # Spark's reader leaves empty files out
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pcap")).select("path", "length", "content").union(spark.createDataFrame([("/empty.pcap", 0, bytearray()), ("/huge.pcap", src.MOST_BYTES + 1, bytearray(files["a.pcap"]))], "path string, length long, content binary"))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in src.admit(files).collect()} == {"a.pcap": None, "b.pcap": None, "c.pcap": None, "empty.pcap": "empty", "huge.pcap": "too large", "ng.pcap": "PCAPNG is not supported", "text.pcap": "not a capture"}
