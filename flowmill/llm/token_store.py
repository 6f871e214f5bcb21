"""Token ids in files of separately compressed documents with a shared dictionary."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm.common import part_offsets, smallest_hashes
from flowmill.llm.tokens import Encoder, encoder, in_blocks, texts_of

#: Documents the dictionary is trained on, at most; none of them longer than so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
DICTIONARY_BYTES = 1 << 16
#: Payload of a row of the store, at least, but for the last of a file.
SHARD_BYTES = 1 << 20
SHARDS = "part int, shard int, first_doc long, last_doc long, part_start long, dictionary_sha256 string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample of documents: those with the smallest hash of
    their id. Empty where the sample is too small to train on."""
    sample = smallest_hashes(docs.where(F.length("text") <= SAMPLE_CHARS), SAMPLE_DOCS, "text").select("text")
    ids = [i + end_id.to_bytes(4, "little") for i in Encoder(path, False).encode([r[0] for r in sample.collect()])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(4)
def _codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def write_store(docs: DataFrame, where: str, path: str, end_id: int) -> None:
    """Writes where/dictionary and where/shards. Each text's ids and end_id are one zstandard frame of little-endian
    unsigned 32-bit numbers; a row of shards holds the frames of some documents one after the other (payload), with
    offsets, ids and token counts to find each, and the SHA-256 of the dictionary. Shards are in ascending order of
    doc_id, null first, over all files. Null texts count as empty: end_id alone. Repeated rows are stored each for itself; an
    empty table leaves shards without rows. Other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(digest, dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{where}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def run(frames):
        pack = _codec(shared.value)[0]
        shard, start, rows, held = 0, 0, [], 0
        part = -1

        def close():
            ids, n, frames_ = zip(*rows)
            known = [i for i in ids if i is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames_])])
            return pd.DataFrame([(part, shard, min(known, default=None), max(known, default=None), start, digest, list(ids), list(n), offsets, b"".join(frames_))], columns=[c.split()[0] for c in SHARDS.split(", ")]).astype({"first_doc": "Int64", "last_doc": "Int64"})

        for pdf in in_blocks(frames):
            part = int(pdf["_part"].iloc[0]) if len(pdf) else part
            for doc, ids in zip(pdf.doc_id, encoder(path, False).encode(texts_of(pdf.text))):
                ids += end_id.to_bytes(4, "little")
                frame = pack.compress(ids)
                rows.append((None if pd.isna(doc) else int(doc), len(ids) // 4, frame))
                held += len(frame)
                if held >= SHARD_BYTES:
                    yield close()
                    start += sum(r[1] for r in rows)
                    shard, rows, held = shard + 1, [], 0
        if rows:
            yield close()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_part", F.spark_partition_id())
    ordered.mapInPandas(run, SHARDS).write.option("compression", "none").parquet(f"{where}/shards")


def _dictionary(spark: SparkSession, where: str) -> bytes:
    row = spark.read.parquet(f"{where}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def read_store(spark: SparkSession, where: str, wanted: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary). With wanted, only
    those documents: shards are chosen by first and last id and frames by offset, so no other frame is decompressed."""
    shards = spark.read.parquet(f"{where}/shards")
    totals = shards.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = part_offsets(totals.withColumnRenamed("part", "_part"), "n")
    if wanted is not None:
        ids = F.array(*map(F.lit, wanted))
        shards = shards.where(F.exists(ids, lambda x: (F.col("first_doc") <= x) & (x <= F.col("last_doc"))))
    shared = spark.sparkContext.broadcast(_dictionary(spark, where))
    choose = None if wanted is None else set(wanted)

    def run(frames):
        digest = hashlib.sha256(shared.value).hexdigest()
        unpack = _codec(shared.value)[1]
        for pdf in frames:
            for r in pdf.itertuples():
                if r.dictionary_sha256 != digest:
                    raise ValueError("a shard was written with another dictionary")
                starts = r.part_start + np.concatenate([[0], np.cumsum(r.n_tokens)])
                picked = [k for k, d in enumerate(r.doc_ids) if choose is None or d in choose]
                for at in range(0, len(picked), 256):
                    rows = [(r.doc_ids[k], r.part, starts[k], r.n_tokens[k], unpack.decompress(r.payload[r.offsets[k] : r.offsets[k + 1]])) for k in picked[at : at + 256]]
                    yield pd.DataFrame(rows, columns=["doc_id", "_part", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    out = shards.mapInPandas(run, "doc_id long, _part int, start long, n_tokens long, ids binary")
    return out.join(F.broadcast(before), "_part").select("doc_id", (F.col("start") + F.col("before_n")).alias("start"), "n_tokens", "ids")
