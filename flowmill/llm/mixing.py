"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import WORD, cut, join_split, part_offsets, put_in_order

#: A document is never emitted more often than this, so a source's target stops at this times its size.
MOST = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of an MD5 value that make the coin: 52 bits, all of them kept by a double.
DIGITS = 13


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs: source, size. One row per source: source, source_size, rows, weight, target.

    Sources are ordered by code point, null last, and given the weights in turn. Targets share the sum of all sizes by
    weight; those above most times their source's size stop there and the excess is shared anew among the others until
    none is above. Only sums over sources reach the driver, once a round, and every round but the last stops a source."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sums = sums.withColumn("_null", F.col("source").isNull())
    ordered = put_in_order(sums, "_null", "source", name="sources")
    before = part_offsets(ordered.groupBy("_part").agg(F.count("*").alias("n")), "n")
    nth = F.col("before_n") + F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1
    cycle = F.array(*map(F.lit, weights))
    out = ordered.join(F.broadcast(before), "_part").withColumn("weight", F.get(cycle, (nth % len(weights)).cast("int")).cast("long"))
    out = cut(out.select("source", "source_size", "rows", "weight"), "weighted")
    total = out.agg(F.sum("source_size")).first()[0] or 0
    left, shared, stopped = total, None, 0
    while True:
        above = F.lit(False) if shared is None else F.col("weight").cast("double") * left / shared > most * F.col("source_size")
        n, full, rest = out.agg(F.count_if(above), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if shared is not None and n == stopped:
            break
        stopped, left, shared = n, total - (full or 0), rest or 1
    share = F.col("weight").cast("double") * F.lit(left).cast("double") / F.lit(shared).cast("double")
    return out.withColumn("target", F.when(share > most * F.col("source_size"), (most * F.col("source_size")).cast("double")).otherwise(share))


def coin(key, seed: int) -> F.Column:
    """A number in [0, 1) that depends on the key and the seed only. A null key counts as an empty one."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**DIGITS))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """One row per row of docs: row (all its columns), size, source_size, target, copies.

    A document is to be emitted floor(target / source size) times and once more if its coin falls below the fraction.
    Null and empty texts have size 0; a source of size 0 emits nothing; a null source is a source of its own. Rows that
    repeat a doc_id share its coin. An empty table gives an empty one. Sources with many rows stay where they are when
    the targets are joined."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"))
    targets = source_targets(docs.select("source", n_words(F.col("text")).alias("size")), weights, most)
    targets = cut(targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "rows"), "targets")
    total = targets.agg(F.sum("rows")).first()[0] or 0
    joined = join_split(sized, targets, "key", "rows", total, share=100, listed=True)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (coin("row.doc_id", seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """Each document as often as plan_mix says, with the columns of docs, whatever their names."""
    planned = plan_mix(docs, **how).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
