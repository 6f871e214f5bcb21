"""Token counts of documents in flat token files that have no index."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm.common import part_offsets
from flowmill.llm.tokens import encoder, in_blocks, texts_of

#: The end-of-document identifier of the files. Ids are stored plus 1, so no token has it.
END = 0
#: The largest id that 16 bits hold beside END.
MOST = 65534
#: Identifiers that are searched at once.
BLOCK = 1 << 20
#: Documents of a flat file, at most: a partition of many goes to several files, so that what one task reads whole does
#: not grow with the partitions.
FILE_DOCS = 8192


def flat_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, plus 1, as little-endian unsigned 16-bit numbers; ValueError if one does not fit."""
    ids = [np.frombuffer(i, "<u4") for i in encoder(path, False).encode(texts)]
    if any(i.max(initial=0) > MOST for i in ids):
        raise ValueError(f"an id above {MOST} does not fit a flat file of 16-bit numbers")
    return [(i + 1).astype("<u2").tobytes() for i in ids]


def write_flat(docs: DataFrame, where: str, path: str) -> None:
    """Writes where/flat: in each partition of docs, the ids of its texts as little-endian unsigned 16-bit numbers, each
    text followed by END, one after the other and nothing else, FILE_DOCS texts to a file; and where/keys: doc_id with
    its file and the row's number in it. The separator is written as the line separator of Spark's text writer, so any file system that
    Spark knows will do.

    docs are read twice, and must give the same rows in the same order each time, as a scan does; if the two readings
    differ it is a ValueError (write docs to a table first). Null and empty texts are END alone. Repeated rows and rows without
    doc_id are documents like others; other columns are not read; without rows there are no documents. A text with an id
    above MOST is a ValueError."""

    def run(frames):
        for pdf in in_blocks(frames):
            yield pd.DataFrame({"value": flat_ids(texts_of(pdf.text), path)})

    def seen(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """df with its rows' places, and a sum over them that two readings must share."""
        as_read = Observation(f"{name}-{uuid.uuid4().hex}")
        df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
        digest = F.sum(F.xxhash64("doc_id", F.length("text"), "at").cast("decimal(38,0)"))
        return df.observe(as_read, F.coalesce(digest, F.lit(0)).alias("digest"), F.count(F.lit(1)).alias("rows")), as_read

    texts, first = seen(docs, "texts")
    flat = texts.select("text").mapInPandas(run, "value binary").select(F.col("value").cast("string"))
    flat.write.option("lineSep", "\0\0").option("maxRecordsPerFile", FILE_DOCS).text(f"{where}/flat")
    keys, again = seen(docs, "keys")
    row = F.col("at").bitwiseAND((1 << 33) - 1)
    part = F.shiftleft(F.shiftright("at", 33), 24) + F.floor(row / FILE_DOCS)
    keys.select("doc_id", part.alias("part"), (row % FILE_DOCS).alias("nth")).write.parquet(f"{where}/keys")
    if first.get != again.get:
        raise ValueError("docs came in another order when they were read again")


def scan(flat: DataFrame, block: int = BLOCK) -> DataFrame:
    """flat: part, content (a flat file). One row per document: part, nth, start (ids before it in its file), n_tokens
    (with the separator).

    Each file is searched in blocks, each by one vectorised comparison where it lies in Arrow's memory. A block says how
    many separators it has, where the last one is and how long the documents are that begin and end in it; the document
    that a block's first separator ends may have begun in any block before, so its start is the last separator of the
    blocks before, a running maximum over the file's blocks, as its number is a running sum. What follows a file's last
    separator is not a document. Empty files have none."""

    def run(batches):
        for b in batches:
            for part, content in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(content.as_buffer(), "<u2", content.as_buffer().size // 2)
                for k in range(-(-len(ids) // block)):
                    ends = np.flatnonzero(ids[k * block : (k + 1) * block] == END) + k * block
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "block": pa.array([k], pa.int32()), "ends": pa.array([ends], pa.list_(pa.int64())), "n": pa.array([len(ends)], pa.int64()), "last": pa.array([int(ends[-1]) if len(ends) else -1], pa.int64())})

    blocks = flat.select(F.col("part").cast("long").alias("part"), "content").mapInArrow(run, "part long, block int, ends array<long>, n long, last long")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("part", "ends", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("carried"))
    ends = blocks.select("part", "before", F.posexplode(F.transform("ends", lambda x, i: F.struct(F.when(i == 0, F.col("carried")).otherwise(F.get("ends", i - 1)).alias("from"), x.alias("to")))).alias("k", "at"))
    return ends.select("part", (F.col("before") + F.col("k")).alias("nth"), (F.col("at.from") + 1).alias("start"), (F.col("at.to") - F.col("at.from")).alias("n_tokens"))


def count_tokens(spark: SparkSession, where: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), n_tokens (with the separator), from the files
    that write_flat made. Raises if a file has more or fewer separators than documents."""
    files = spark.read.format("binaryFile").load(f"{where}/flat")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    files = files.withColumn("part", F.shiftleft(number(r"/part-(\d+)-[^/]*$"), 24) + number(r"-c(\d+)[^/-]*$"))
    found = scan(files, block)
    sizes = files.groupBy(F.col("part").alias("_part")).agg(F.sum((F.col("length") / 2).cast("long")).alias("n"))
    before = part_offsets(sizes, "n")
    keys = spark.read.parquet(f"{where}/keys").withColumnRenamed("part", "_p").withColumnRenamed("nth", "_n")
    out = found.join(keys, (F.col("part") == F.col("_p")) & (F.col("nth") == F.col("_n")), "full")
    bad = F.raise_error(F.lit("a flat file does not hold as many documents as were written"))
    out = out.withColumn("part", F.when(F.col("part").isNull() | F.col("_p").isNull(), bad).otherwise(F.col("part")))
    out = out.join(F.broadcast(before), F.col("part") == F.col("_part"))
    return out.select("doc_id", (F.col("start") + F.col("before_n")).alias("start"), "n_tokens")
