"""Capture files read by byte ranges: no task holds a file, and large files are read by many."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.functions.shared import shared_folder
from flowmill.sources.captures import _MAGIC, FRAMES, MOST_FRAME

#: Bytes of a range, bytes that are read at once, and frames that are handed on at once.
RANGE, READ, FRAMES_AT_ONCE = 64 << 20, 1 << 20, 2048
#: Bytes that a task reads, about, where ranges are short; tasks for each core at least, where there are so many ranges.
TASK, TASKS = 16 << 20, 4
#: Headers that must follow each other where a range begins amid a file, and what comes before a file's first record.
CHAIN, HEAD = 4, 24
SCANNED = "path string, length long, begin long, end long, start long, next long, count long"


class _File:
    """A file of any store that Arrow knows, read in stretches."""

    def __init__(self, uri: str, ahead: int = READ):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/"))
        self.file, self.at, self.data, self.ahead = system.open_input_file(path), 0, b"", min(ahead, READ)

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from at, fewer where the file ends."""
        if not self.at <= at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(n, self.ahead), at)
        return self.data[at - self.at : at - self.at + n]

    def head(self):
        """Byte order, unit of fractions of a second, link type; None if it is no capture."""
        head = self.get(0, HEAD)
        order, unit = _MAGIC.get(head[:4], (None, None))
        return None if order is None or len(head) < HEAD else (order, unit, struct.unpack(order + "I", head[20:])[0] & 0xFFFF)

    def record(self, order: str, at: int):
        """(seconds, fraction, captured length, original length) at a place; None where no whole record lies."""
        raw = self.get(at, 16)
        if len(raw) < 16:
            return None
        head = struct.unpack(order + "4I", raw)
        return head if head[2] <= MOST_FRAME else None


def _plausible(f: _File, order: str, unit: float, size: int, at: int) -> bool:
    """Whether CHAIN records follow each other from a place, or as many as there are up to the file's end."""
    for _ in range(CHAIN):
        if at == size:
            return True
        head = f.record(order, at)
        if head is None or head[1] >= unit or not head[3] or at + 16 + head[2] > size:
            return False
        at += 16 + head[2]
    return True


def _scan(f: _File, order: str, size: int, at: int, end: int) -> tuple[int, int]:
    """From the record at a place: how many begin before end, and where the first behind them begins; -1 if the file's records
    end before, at a cut one or a length above MOST_FRAME."""
    n = 0
    while at < end:
        head = f.record(order, at)
        if head is None or at + 16 + head[2] > size:
            return n, -1
        n, at = n + 1, at + 16 + head[2]
    return n, at


def _scanned(batches):
    """Rows of SCANNED with next and count; start is looked for where it is null."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            start = None if pd.isna(r.start) else int(r.start)
            f = _File(r.path, r.end - r.begin)
            order, unit, _ = f.head()
            if start is None:
                start = next((c for c in range(r.begin, r.end) if _plausible(f, order, unit, r.length, c)), None)
            if start is None:
                n, following = 0, None
            elif start < 0 or start >= r.end:
                n, following = 0, start
            else:
                n, following = _scan(f, order, r.length, start, r.end)
            out.append((r.path, r.length, r.begin, r.end, start, following, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCANNED.split(", ")]).astype({"start": "Int64", "next": "Int64"})


def capture_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and reason: why a file is refused, or null. Only the first bytes of files are read; empty files are listed
    too."""

    def look(batches):
        for pdf in batches:
            reasons = []
            for path, n in zip(pdf.path, pdf.length):
                f = _File(path)
                magic = f.get(0, 4)
                reasons.append("empty" if not n else "PCAPNG is not supported" if magic == b"\x0a\x0d\x0d\x0a" else "not a capture" if f.head() is None else None)
            yield pd.DataFrame({"path": pdf.path, "length": pdf.length, "reason": pd.Series(reasons, dtype=object)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.mapInPandas(look, "path string, length long, reason string")


def _dealt(ranges: DataFrame, *by: str) -> DataFrame:
    """ranges, dealt singly over a fixed number of tasks: rows of ranges are few bytes, so that Spark left to itself would put
    all of them into one task, however many bytes they stand for."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    tasks = max(TASKS * ranges.sparkSession.sparkContext.defaultParallelism, -(-size // TASK))
    return ranges.repartition(max(1, min(n, tasks)), *by)


def capture_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The byte ranges of the admitted files with their first record (start; -1 behind the file's end) and first, the number
    of the range's first frame in its file.

    A range that begins amid a file looks for a chain of headers, which frames' bytes may imitate. So what each range found
    is held against where the range before it ended: one that began elsewhere is scanned again from there, until all agree
    from the file's beginning on. Only headers are looked at, and only numbers of ranges to be mended reach the driver."""
    good = files.where("reason is null")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes).cast("long"))).alias("k")
    rows = good.select("path", "length", cuts).withColumns({"begin": F.col("k") * range_bytes, "end": F.least((F.col("k") + 1) * range_bytes, "length")})
    rows = rows.withColumn("start", F.when(F.col("k") == 0, F.lit(HEAD).cast("long"))).select("path", "length", "begin", "end", "start")
    ahead = Window.partitionBy("path").orderBy("begin")

    def kept(df: DataFrame) -> DataFrame:
        where = shared_folder(spark)
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    # files' ranges are dealt out singly: a file of many ranges is scanned by many tasks
    table = kept(_dealt(kept(rows), "path", "begin").mapInPandas(_scanned, SCANNED))
    while True:
        held = table.withColumn("_want", F.when(F.col("begin") == 0, F.lit(HEAD).cast("long")).otherwise(F.lag("next").over(ahead)))
        wrong = ~F.col("start").eqNullSafe(F.col("_want")) & F.col("_want").isNotNull()
        if held.where(wrong).isEmpty():
            break
        again = held.where(wrong).withColumn("start", F.col("_want")).drop("_want").mapInPandas(_scanned, SCANNED)
        table = kept(held.where(~wrong).drop("_want").unionByName(again))
    return table.withColumn("first", F.coalesce(F.sum("count").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _read(batches):
    names = [c.split()[0] for c in FRAMES.split(", ")]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            f, rows, at = _File(r.path, r.end - r.begin), [], r.start
            order, unit, link = f.head()
            for k in range(r.count):
                sec, part, incl, orig = f.record(order, at)
                rows.append((r.path, r.first + k, sec + part / unit, incl, orig, link, f.get(at + 16, incl)))
                at += 16 + incl
                if len(rows) == FRAMES_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)


def frames_by_range(spark: SparkSession, pattern: str, range_bytes: int = RANGE) -> DataFrame:
    """A row for each frame of each capture file that pattern names, as captures.frames gives them, whatever the size of a
    file: a task reads a range of it, in stretches. Files must lie in a store that Arrow knows (local or shared disks, HDFS,
    S3 and others); refused ones are left out, capture_files lists them."""
    ranges = capture_ranges(spark, capture_files(spark, pattern), range_bytes)
    return _dealt(ranges.where("count > 0").select("path", "begin", "end", "start", "count", "first"), "path", "start").mapInPandas(_read, FRAMES)
