"""Shared folders, lineage cuts and ordered offsets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session (as in
    tests) takes a temporary folder and puts it into the setting; on a cluster, whose machines have folders of their
    own, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(taken, *names: str) -> list[str]:
    """The names, made longer where one is taken already (by a column of the caller, in whatever case)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later stages do not recompute it when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_in_order(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """df range-partitioned and sorted by keys, written, with its partition's number in _part. The write fixes the
    ranges: they come from a sample, which another run of the same plan may draw differently."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("_part", F.spark_partition_id()), name)


def part_offsets(parts: DataFrame, *sums: str) -> DataFrame:
    """parts has one row per _part with the columns in sums. Adds before_<c>: the sum of c over smaller _part. There are
    as many rows as partitions, never as rows of data, so one task adds them up and the result may be broadcast."""
    from pyspark.sql import Window

    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"before_{c}") for c in sums))


def smallest_hashes(df: DataFrame, n: int, *then: str) -> DataFrame:
    """The n rows of df with the smallest hash of doc_id, ties by the columns in then. The nth hash is found first, from
    hashes alone, so that no task sends n whole rows to be merged; rows beyond it are left out before they are sorted."""
    h = F.xxhash64("doc_id")
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last).cast("long")).orderBy(h, *then).limit(n)


def join_split(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: int = 1000, listed: bool = False) -> DataFrame:
    """rows joined with table, which has one row for each key and in weight the number of rows that have it; total is
    the sum of weight. The result has rows' columns and those of table but for weight. Keys with over 1/share of all
    rows, of which there are fewer than share, are broadcast, so their rows stay where they are; the other keys are
    shuffled, and none of them is hot. Null keys join with nothing.

    listed: the hot keys themselves come to the driver and part the rows, so no join passes over all of them; for tables
    that are written already and keys of a simple type."""
    extra = [c for c in table.columns if c not in (key, weight)]
    hot = F.col(weight) * share > total
    if listed:
        keys = [r[0] for r in table.where(hot).select(key).collect()]
        rest = rows.join(table.drop(weight), key) if not keys else rows.where(~F.col(key).isin(keys)).join(table.where(~hot).drop(weight), key)
        if keys:
            rest = rest.unionByName(rows.where(F.col(key).isin(keys)).join(F.broadcast(table.where(hot).drop(weight)), key))
        return rest.select(*rows.columns, *extra)
    mark, rest = fresh([*rows.columns, *extra], "_hot", "_extra")
    few = table.where(hot).select(F.col(key).alias(mark), F.struct(*extra).alias(rest))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col(mark), "left")
    here = marked.where(F.col(mark).isNotNull()).select(*rows.columns, f"{rest}.*")
    return here.unionByName(marked.where(F.col(mark).isNull()).select(*rows.columns).join(table.where(~hot).drop(weight), key))


def one_of_each(docs: DataFrame, who, keep: DataFrame) -> DataFrame:
    """One row of docs, as it is, for each value in keep, whose only column holds values of the column who without repeats
    or nulls. Rows that share a value may differ in other columns; one of them stays."""
    mine, theirs = fresh(docs.columns, "_who", "_keep")
    kept = docs.withColumn(mine, who).join(keep.toDF(theirs), F.col(mine) == F.col(theirs), "left_semi")
    return kept.dropDuplicates([mine]).drop(mine)
