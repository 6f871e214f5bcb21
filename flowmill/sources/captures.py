"""Capture files: admission and frames. And labelled rows as JSON lines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_FRAME = 256 << 20, 262_144
FRAMES = "path string, frame_index long, ts double, incl_len long, orig_len long, linktype int, frame binary"
_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}


def admit(files: DataFrame) -> DataFrame:
    """files (path, length, content) with reason: why a file is refused, or null."""
    magic = F.lower(F.hex(F.substring("content", 1, 4)))
    return files.withColumn("reason", F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(magic == "0a0d0d0a", "PCAPNG is not supported").when(~magic.isin(*(m.hex() for m in _MAGIC)), "not a capture"))


def frames(files: DataFrame) -> DataFrame:
    """A row for each frame of each capture file, in either byte order; a file ends at a cut record or at a length
    above MOST_FRAME. A file is not splittable: it is one row of input, and admission bounds its size."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                order, unit = _MAGIC.get(bytes(content[:4]), (None, None))
                if order is None or len(content) < 24:
                    continue
                link = struct.unpack(order + "I", content[20:24])[0] & 0xFFFF
                at, rows = 24, []
                while at + 16 <= len(content):
                    sec, part, incl, orig = struct.unpack(order + "4I", content[at : at + 16])
                    if incl > MOST_FRAME or at + 16 + incl > len(content):
                        break
                    rows.append((path, len(rows), sec + part / unit, incl, orig, link, bytes(content[at + 16 : at + 16 + incl])))
                    at += 16 + incl
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])

    return admit(files).where("reason is null").select("path", "content").mapInPandas(run, FRAMES)


def capture_frames(spark: SparkSession, pattern: str) -> DataFrame:
    return frames(spark.read.format("binaryFile").load(pattern))


def write_jsonl(rows: DataFrame, where: str, order: list[str]) -> None:
    """rows with their columns in a fixed order."""
    rows.select(*order).write.json(where)


def write_csv(rows: DataFrame, where: str, order: list[str]) -> None:
    """The flat view of rows: a header, and columns in a fixed order; numbers as Spark writes them, null as nothing."""
    rows.select(*order).write.option("header", True).csv(where)


def write_summary(rows: DataFrame, where: str, split: str, label: str, key: str) -> None:
    """One JSON document: rows, groups, and rows by split and by label. Only counts are gathered."""
    by = rows.groupBy(split, label).agg(F.count("*").alias("n"))
    of = lambda c: by.groupBy(F.col(c).cast("string").alias("k")).agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias(c))
    total = rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("groups"))
    pairs = lambda c: F.map_from_entries(F.filter(c, lambda x: x["k"].isNotNull())).alias(f"by_{c}")
    total.crossJoin(of(split)).crossJoin(of(label)).select("rows", "groups", pairs(split), pairs(label)).write.json(where)


def read_jsonl(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """Rows with the given schema and _corrupt, a line that does not fit it."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(where)
