"""Capture files by byte ranges against reading them whole: both byte orders, cut tails, and bytes that imitate headers."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowmill.sources import captures as src
from flowmill.sources import ranges as rg


def capture(order, frames, tail=b"", magic=0xA1B2C3D4):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "4I", 1700000000 + k, k, len(f), len(f)) + f for k, f in enumerate(frames)) + tail


def imitation(order, n=12):
    """A frame that holds a chain of headers of records without bytes."""
    return b"\1" + b"".join(struct.pack(order + "4I", 1, 1, 0, 1) for _ in range(n))


@pytest.mark.parametrize("size", [40, 97, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, size):
    rng = random.Random(5)
    files = {}
    for i, order in enumerate("<>"):
        files[f"plain{i}"] = capture(order, [rng.randbytes(rng.randrange(0, 120)) for _ in range(30)])
        files[f"cut{i}"] = capture(order, [rng.randbytes(30) for _ in range(9)], struct.pack(order + "4I", 1, 1, 60, 60) + b"x" * 59)
        files[f"huge{i}"] = capture(order, [b"abc"] * 7, struct.pack(order + "4I", 1, 1, 1 << 20, 1 << 20) + bytes(400) + capture(order, [b"zz"] * 5)[24:])
        files[f"imitated{i}"] = capture(order, [b"q" * 50, imitation(order), b"r" * 40, imitation(order, 40), b"s"])
        files[f"long{i}"] = capture(order, [bytes(1000), b"end"])
    files |= {"none": capture("<", []), "nano": capture(">", [b"n" * 20] * 4, magic=0xA1B23C4D), "ng": b"\x0a\x0d\x0d\x0a" + bytes(30), "text": b"hello", "short": capture("<", [])[:20]}
    for name, content in files.items():
        (tmp_path / f"{name}.pcap").write_bytes(content)
    pattern = str(tmp_path / "*.pcap")
    plain = lambda df: sorted((r.path.rsplit("/", 1)[1], r.frame_index, r.ts, r.incl_len, r.orig_len, r.linktype, bytes(r.frame)) for r in df.collect())
    assert plain(rg.frames_by_range(spark, pattern, size)) == plain(src.capture_frames(spark, pattern))
    refused = {r.path.rsplit("/", 1)[1]: r.reason for r in rg.capture_files(spark, pattern).where("reason is not null").collect()}
    assert refused == {"ng.pcap": "PCAPNG is not supported", "text.pcap": "not a capture", "short.pcap": "not a capture"}


def test_no_files_that_are_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"hello")
    assert rg.frames_by_range(spark, str(tmp_path / "*.pcap")).count() == 0


def test_short_ranges_are_read_by_many_tasks(spark, tmp_path):
    """Rows of ranges are few bytes, but what they stand for is not: they are not put into one task."""
    for k in range(3):
        (tmp_path / f"{k}.pcap").write_bytes(capture("<", [bytes(60)] * 400))
    got = rg.frames_by_range(spark, str(tmp_path / "*.pcap"), 1 << 10).select("path", "frame_index", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 1200 and len({(r.path, r.frame_index) for r in got}) == 1200
    assert len({r.task for r in got}) > 8
