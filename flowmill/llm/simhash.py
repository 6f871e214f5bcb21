"""SimHash fingerprints and links within a Hamming distance by multi-index hashing."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, join_split, one_of_each
from flowmill.llm.components import components

#: Takes the place of a null id while the smallest id is looked for.
NO_ID = (1 << 63) - 1
#: Fingerprints of a key of the table that may be paired by a plain join, so a look-up makes so many rows at most.
HOT = 16
#: Fingerprints of a block.
BLOCK_PRINTS = 512
#: Shingles that are in memory at once, whatever the length of the text.
BLOCK = 1 << 16


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's shingles (repeats count); A-Z are lowered,
    words end at ASCII white space. Fewer words than width: one shingle of them all. No words: 0. As a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def simhash_of(values: np.ndarray) -> int:
    """The fingerprint of a set of hashes, each counted once; of none 0. As a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), BLOCK):
        ones += np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text, width: int = 3, seed: int = 42):
    """The column of fingerprints of a column of texts."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width, seed) for t in texts], dtype="int64")

    return of(text)


def _balls(bits: int, radius: int) -> list[tuple[int, int]]:
    """Masks of up to radius of so many bits, each with its highest bit alone."""
    return [(sum(1 << i for i in c), 1 << max(c, default=0)) for r in range(radius + 1) for c in combinations(range(bits), r)]


def hamming_links(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """prints: distinct longs in fp. Returns every pair (a, b) that differs in at most distance of 64 bits.

    Fingerprints are cut into segments. In one segment at least, a pair within the distance differs in at most
    distance // segments bits, so each fingerprint is filed under its segments and looks up the Hamming ball of that
    radius about each of them; complete distances decide. Of two segments that differ, only the one holding the highest
    differing bit looks the other up, and a pair counts in the first segment that finds it."""
    if segments < 2:
        raise ValueError("at least two segments are needed")
    probe, table, close = _filed(prints, distance, segments)
    near = probe.join(table, ["seg", "key"]).where(close)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _filed(prints: DataFrame, distance: int, segments: int) -> tuple[DataFrame, DataFrame, str]:
    """What each fingerprint looks up (seg, key, a), under what it is filed (seg, key, b), and SQL for a match that counts."""
    edges = np.linspace(0, 64, segments + 1).astype(int)
    parts = [(int(lo), int(hi - lo)) for lo, hi in zip(edges, edges[1:])]
    radius = distance // segments

    def seg(fp: str, k: int) -> str:
        lo, n = parts[k]
        return f"(shiftrightunsigned({fp}, {lo}) & {(1 << n) - 1}L)"

    def ball(k: int) -> str:
        masks = ", ".join(f"named_struct('m', {m}L, 't', {t}L)" for m, t in _balls(parts[k][1], radius))
        own = f"filter(array({masks}), x -> x.m = 0 or (x.t & {seg('fp', k)}) <> 0)"
        return f"transform({own}, x -> named_struct('seg', {k}, 'key', x.m ^ {seg('fp', k)}))"

    table = prints.select("fp", F.expr("explode(array(" + ", ".join(f"named_struct('seg', {k}, 'key', {seg('fp', k)})" for k in range(segments)) + ")) as at"))
    table = table.select("at.seg", "at.key", F.col("fp").alias("b"))
    probe = prints.select("fp", F.explode(F.expr("concat(" + ", ".join(ball(k) for k in range(segments)) + ")")).alias("at"))
    probe = probe.select("at.seg", "at.key", F.col("fp").alias("a"))
    own = [f"({seg('a', k)} ^ {seg('b', k)})" for k in range(segments)]
    first = " + ".join(f"case when seg > {k} and bit_count({own[k]}) <= {radius} then 1 else 0 end" for k in range(segments))
    same = "case seg " + " ".join(f"when {k} then {own[k]} = 0" for k in range(segments)) + " end"
    return probe, table, f"bit_count(a ^ b) <= {distance} and a <> b and ({first}) = 0 and (a < b or not {same})"


def _forest(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, distance: int) -> np.ndarray:
    """Of the pairs (one of a, one of b) within the distance those few that join all that these pairs join, where what has
    the same root (ra, rb) is joined already: fewer than there are roots. Rounds of minima: every root takes the smallest label
    among its neighbours and its own, and keeps the pair that brought it."""
    roots = np.unique(np.concatenate([ra, rb]))
    x, y = np.searchsorted(roots, ra), np.searchsorted(roots, rb)
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= distance
    label, far = np.arange(len(roots)), len(roots)
    via = np.zeros((len(roots), 2), np.int64)
    if not near.size:
        return via[:0]
    while True:
        now = label.copy()
        for own, other, close, one, two in ((x, y, near, a, b), (y, x, near.T, b, a)):
            seen = np.where(close, label[other][None, :], far)
            at = seen.argmin(1)
            least = seen[np.arange(len(own)), at]
            k = np.flatnonzero(least < now[own])
            k = k[np.argsort(-least[k])]  # the smallest is assigned last
            now[own[k]] = least[k]
            via[own[k]] = np.stack([one[k], two[at[k]]], 1)
        if np.array_equal(now, label):
            return via[label != np.arange(far)]
        label = now


def _block_links(filed: DataFrame, asked: DataFrame, distance: int) -> DataFrame:
    """filed, asked: at, fp, root. Links (a, b) within the distance that join, together with what has the same root, all that
    pairs of a filed and an asked fingerprint of a key join. Both are dealt over blocks, each pair of blocks is compared
    by itself, and passes on fewer links than it has roots; its pairs are not rows."""
    n = filed.groupBy("at").agg(F.count("*").alias("n")).join(asked.groupBy("at").agg(F.count("*").alias("p")), "at")
    size = cut(n.select("at", *(F.ceil(F.col(c) / BLOCK_PRINTS).cast("int").alias(k) for c, k in (("n", "i"), ("p", "j"))), (F.col("n") + F.col("p")).alias("w")), "hot_sizes")
    total = size.agg(F.sum("w")).first()[0] or 0
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_split(filed, size, "at", "w", total, listed=True).select("at", F.lit(True).alias("filed"), "fp", "root", _block("i").alias("x"), every("j").alias("y"))
    right = join_split(asked, size, "at", "w", total, listed=True).select("at", F.lit(False), "fp", "root", every("i").alias("x"), _block("j").alias("y"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.filed.to_numpy(bool)
        fp, root = pdf.fp.to_numpy(np.int64), pdf.root.to_numpy(np.int64)
        return pd.DataFrame(_forest(fp[own], fp[~own], root[own], root[~own], distance), columns=["a", "b"])

    return left.union(right).groupBy("at", "x", "y").applyInPandas(compare, "a long, b long")


def _block(n: str):
    return F.pmod(F.xxhash64("fp", F.lit(5)), F.col(n)).cast("int")


def group_links(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """prints: distinct longs in fp. Links (a, b) whose components are those of all links of hamming_links. Where a key of
    the table has over HOT fingerprints, their pairs are not emitted: its fingerprints, and those that look it up, are
    compared in blocks (_block_links). Where that is several blocks, what looks the key up is compared with the first one,
    and then only what that left apart: pairs without those of the key's largest component, each component one root. So
    the links grow with the members of a group, not with its pairs."""
    if segments < 2:
        raise ValueError("at least two segments are needed")
    probe, table, close = _filed(prints, distance, segments)
    at = F.concat_ws(":", "seg", "key").alias("at")
    big = cut(table.groupBy(at).agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot_keys")
    if big.isEmpty():
        return probe.join(table, ["seg", "key"]).where(close).select("a", "b")
    rest = table.select("*", at).join(big.select("at"), "at", "left_anti").drop("at")
    usual = probe.join(rest, ["seg", "key"]).where(close).select("a", "b")
    filed, asked = (cut(t.select(at, F.col(c).alias("fp"), F.col(c).alias("root")).join(big.select("at"), "at", "left_semi"), name) for t, c, name in ((table, "b", "hot_filed"), (probe, "a", "hot_asked")))
    wide = big.where(F.col("n") > BLOCK_PRINTS).select("at", F.ceil(F.col("n") / BLOCK_PRINTS).alias("i"), "n")
    if wide.isEmpty():
        return usual.union(_block_links(filed, asked, distance))
    total = big.agg(F.sum("n")).first()[0]
    more = cut(join_split(filed, wide, "at", "n", total, listed=True).where(_block("i") > 0).drop("i"), "hot_more")
    first = cut(_block_links(filed.join(more.select("at", "fp"), ["at", "fp"], "left_anti"), asked, distance), "hot_links")
    roots = components(first)
    rooted = lambda t: t.drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("at", "fp", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted(asked.join(wide, "at", "left_semi")), "hot_rooted")
    main = named.groupBy("at", "root").agg(F.count("*").alias("n")).groupBy("at").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"))
    main = cut(main, "hot_main")
    total = main.agg(F.sum("n")).first()[0]
    more, named = (cut(join_split(t, main, "at", "n", total, listed=True), "hot_parted") for t in (rooted(more), named))
    apart, inside = F.col("root") != F.col("main"), F.col("root") == F.col("main")
    left = _block_links(more.where(apart), named, distance).union(_block_links(more.where(inside), named.where(apart), distance))
    return usual.union(first).union(left)


def near_groups(docs: DataFrame, distance: int = 3, segments: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp (long), component_id, kept.

    component_id is the smallest id that links of at most distance bits reach; kept marks the row that has it (of rows
    that repeat an id, the one with the smallest text_hash; exact repeats of a row are all marked). Equal fingerprints
    are one node, so groups of copies are never paired. Null and empty texts have fingerprint 0 and link like others. A
    null id sorts last; component_id is null where no member has an id, and the member with the smallest text_hash is
    kept. Columns of docs other than the two named are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), fingerprint(F.col(text_col), width, seed).alias("fp"))
    rows = cut(rows, "fingerprints")
    first = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("h"))
    prints = cut(rows.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")), "prints")
    roots = components(group_links(prints.select("fp"), distance, segments))
    member = prints.join(roots, prints.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    member = cut(member, "members")
    least = member.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("prints"))
    n_rows, n_prints = member.agg(F.sum("n"), F.count("*")).first()
    named = join_split(member.select("fp", "n", "root"), least, "root", "prints", n_prints).select("fp", "n", "least")
    kept = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("least.id")) & (F.col("text_hash") == F.col("least.h"))
    return join_split(rows, named, "fp", "n", n_rows or 0).select("doc_id", "text_hash", "fp", F.nullif("least.id", F.lit(NO_ID)).alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs without all rows but one of each group of near copies (see near_groups); all columns stay as they are, whatever
    their names."""
    who = lambda i, h: F.struct(F.coalesce(F.col(i).cast("long"), F.lit(NO_ID)).alias("id"), h.alias("h"))
    keep = near_groups(docs, **how).where("kept").select(who("doc_id", F.col("text_hash")).alias("_keep")).distinct()
    return one_of_each(docs, who(how.get("id_col", "doc_id"), F.xxhash64(F.col(how.get("text_col", "text")))), keep)
