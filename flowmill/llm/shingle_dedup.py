"""Near copies by Jaccard similarity of sets of word shingles: SimHash fingerprints within a Hamming distance name pairs first,
MinHash buckets name what is still apart, exact sets decide."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, join_split, one_of_each
from flowmill.llm.components import components
from flowmill.llm.simhash import BLOCK, NO_ID, group_links, simhash_of

WIDTH = 5
#: Two sets are near from a similarity of LEAST / OF.
LEAST, OF = 4, 5
#: Bits that fingerprints of a named pair differ in at most, and segments of the table that finds them.
DISTANCE, SEGMENTS = 5, 3
#: A pair shares a bucket if all ROWS minima of one of BANDS bands agree: at 0.8 all but (1 - 0.8**5)**24 = 7.4e-5 do.
BANDS, ROWS = 24, 5
_RNG = np.random.default_rng(42)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
#: Members of a bucket, still apart, whose pairs may be rows; larger buckets are compared in blocks of so many members and
#: shingles at most, on average.
SMALL, BLOCK_MEMBERS, BLOCK_SHINGLES = 24, 256, 1 << 20
#: Cells of the table of permuted values that are in memory at once.
CELLS = 1 << 12


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles, by the words of simhash.simhash; no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    parts = []
    for at in range(0, len(words) - width + 1, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width))))
        parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(0)), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def buckets(s: np.ndarray) -> np.ndarray:
    """One key for each band of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CELLS):
        least = np.minimum(least, ((s[None, at : at + CELLS] ^ _FLIP) * _TIMES).min(1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k + 1) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _sketches(texts: pd.Series) -> pd.DataFrame:
    """fp names the set of shingles: 0 if it is empty; print is its SimHash."""
    out = []
    for t in texts:
        s = shingles(t)
        keys = buckets(s).view(np.int64) if len(s) else np.zeros(0, np.int64)
        out.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64) if len(s) else 0, len(s), simhash_of(s), keys))
    return pd.DataFrame(out, columns=["fp", "size", "print", "keys"])


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have a similarity of LEAST / OF at least. The sets of hot nodes go
    to their pairs, all others are shuffled."""
    for end in ("a", "b"):
        uses = pairs.groupBy(F.col(end).alias("fp")).agg(F.count("*").alias("uses"))
        named = sets.join(uses, "fp").select(F.col("fp").alias(end), F.col("s").alias(f"s{end}"), "uses")
        pairs = join_split(pairs, named, end, "uses", pairs.count(), share=100)
        if end == "a":
            pairs = cut(pairs, "half_pairs")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(both * (LEAST + OF) >= LEAST * (F.size("sa") + F.size("sb"))).select("a", "b")


def _pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes na and nb: distinct, ordered, and of sizes that admit the similarity."""
    fits = F.least("na", "nb") * OF >= F.greatest("na", "nb") * LEAST
    return pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """nodes: fp, size, print. Pairs (a, b) of sets that admit the similarity and whose fingerprints are the same or linked by
    at most DISTANCE bits: a fingerprint's least set stands for it in its links, its other sets are paired with that one.
    Fingerprints of a hot key of the table are linked as group_links does, by fewer links than there are fingerprints."""
    lead = cut(nodes.groupBy("print").agg(F.min(F.struct("fp", "size")).alias("lead"), F.count("*").alias("n")), "prints")
    n = lead.agg(F.sum("n")).first()[0] or 0
    same = join_split(nodes, lead.where("n > 1"), "print", "n", n, listed=True).where("fp <> lead.fp")
    same = same.select(F.col("fp").alias("a"), F.col("size").alias("na"), F.col("lead.fp").alias("b"), F.col("lead.size").alias("nb"))
    linked = group_links(lead.select(F.col("print").alias("fp")), DISTANCE, SEGMENTS)
    linked = cut(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print_links")
    for end in ("a", "b"):
        uses = linked.groupBy(F.col(end).alias("print")).agg(F.count("*").alias("uses"))
        named = lead.join(uses, "print").select(F.col("print").alias(end), F.col("lead").alias(f"l{end}"), "uses")
        linked = join_split(linked, named, end, "uses", linked.count())
        if end == "a":
            linked = cut(linked, "half_links")
    return _pairs(same.union(linked.select(F.col("la.fp").alias("a"), F.col("la.size").alias("na"), F.col("lb.fp").alias("b"), F.col("lb.size").alias("nb"))))


def near_links(sets: DataFrame, members: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all near pairs in named and of all that share a bucket. sets: fp, s for each
    fp in members and named; members: key, fp, size and lead (fp, size), the least member, of buckets with two members
    at least; named: pairs (a, b), the first to be tested.

    Then every member is tested against its bucket's least one, and then all pairs of a bucket whose ends are still apart:
    pairs that are linked already, directly or not, cannot change a component. Those of large buckets are compared in
    blocks."""
    first = cut(_near(named, sets), "first_links")
    star = members.where("fp <> lead.fp")
    star = cut(_pairs(star.select(F.col("fp").alias("a"), F.col("size").alias("na"), F.col("lead.fp").alias("b"), F.col("lead.size").alias("nb"))).join(named, ["a", "b"], "left_anti"), "star_pairs")
    links = cut(first.union(_near(star, sets)), "links")
    roots = components(links)
    rooted = members.join(roots, members.fp == roots.node, "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("all")).where("lo <> hi")
    left = cut(rooted.join(apart.select("key", "n", "all"), "key"), "apart")
    few = left.where(F.col("n") <= SMALL)
    a = few.select("key", F.col("fp").alias("a"), F.col("size").alias("na"), F.col("root").alias("ra"))
    b = few.select("key", F.col("fp").alias("b"), F.col("size").alias("nb"), F.col("root").alias("rb"))
    rest = cut(_pairs(a.join(b, "key").where("a < b and ra <> rb")).join(star, ["a", "b"], "left_anti"), "apart_pairs")
    return links.union(_near(rest, sets)).union(_block_links(left.where(F.col("n") > SMALL), sets))


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members: key, fp, n and all, the members and shingles of the key's bucket. Links (a, b) whose components are those of
    all near pairs of a bucket. Members are dealt over blocks, each pair of blocks is compared by itself, and passes on
    one link for each member at most; its pairs are not rows."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("all") / BLOCK_SHINGLES)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("x", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("blocks")).cast("int"))
    dealt = own.select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("x", j).alias("i"), F.greatest("x", j).alias("j")))).alias("at"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, found = pdf.fp.to_numpy(np.int64), pdf.s.to_list()
        near = similar(found)
        label = np.arange(len(fp))
        while True:
            now = np.where(near, label[None, :], len(fp)).min(1)
            now = now[now]
            if np.array_equal(now, label):
                break
            label = now
        other = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[other], "b": fp[label[other]]})

    with_sets = dealt.join(sets, "fp").select("key", "at.i", "at.j", "fp", "s")
    return with_sets.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def similar(found: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Which of the sets (arrays without repeats) are near which, all with all, themselves included: shared values are
    counted as products of rows of a table with a column for each value, some columns at a time."""
    n = np.array([len(s) for s in found], np.int64)
    of, (values, at) = np.repeat(np.arange(len(found)), n), np.unique(np.concatenate(found), return_inverse=True)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(found), len(found)), np.float64)
    for lo in range(0, len(values), width):
        k = slice(*np.searchsorted(at, [lo, lo + width]))
        table = np.zeros((len(found), width), np.float32)
        table[of[k], at[k] - lo] = 1
        both += table @ table.T
    return both * (LEAST + OF) >= LEAST * (n[:, None] + n[None, :])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all rows but one of each group that links of near texts reach; all columns stay as they are, whatever
    their names. The row with the smallest id stays (null ids last), of rows that repeat an id the one with the smallest
    hash of its text. Equal sets of shingles are one node; null and empty texts have the empty set."""
    who = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    sketch, shingle_set = F.pandas_udf(_sketches, "fp long, size int, print long, keys array<long>"), F.pandas_udf(_sets, "array<long>")
    rows = cut(docs.select(who.alias("who"), sketch(F.col(text_col)).alias("k")).select("who", "k.*"), "sketches")
    nodes = cut(rows.groupBy("fp").agg(F.min("who").alias("least"), F.any_value("size").alias("size"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys")), "nodes")
    filed = nodes.select("fp", "size", F.explode("keys").alias("key"))
    # a bucket of one node names no pair
    leads = cut(filed.groupBy("key").agg(F.min(F.struct("fp", "size")).alias("lead"), F.count("*").alias("m")).where("m > 1"), "leads")
    n_filed = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    members = cut(join_split(filed, leads, "key", "m", n_filed, listed=True), "members")
    # the empty set has no near one
    pairs = cut(simhash_pairs(nodes.where("size > 0").select("fp", "size", "print")), "simhash_pairs")
    ends = members.select("fp").union(pairs.select("a")).union(pairs.select("b")).distinct()
    asked = nodes.join(ends, "fp", "left_semi").select("fp", F.col("least").alias("_least"))
    texts = docs.select(who.alias("_who"), F.col(text_col).alias("_text"))
    # rows that repeat both id and text are one row here
    sets = texts.join(asked, F.col("_who") == F.col("_least")).select("fp", shingle_set("_text").alias("s")).dropDuplicates(["fp"])
    roots = components(near_links(cut(sets, "shingle_sets"), members, pairs))
    groups = nodes.join(roots, nodes.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    keep = groups.groupBy("root").agg(F.min("least").alias("_keep")).select("_keep")
    return one_of_each(docs, who, keep)
