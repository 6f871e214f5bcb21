"""Near-duplicate embeddings by randomly rotated binary codes with correction factors."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, join_split
from flowmill.llm.components import components

#: Share of the pairs at the threshold itself that no table brings together; closer pairs are missed far less often.
MISS = 0.0005
#: Width of the confidence bound, in its unit 1 / sqrt(bits - 1). At 5, one pair in some millions is rejected wrongly.
WIDTH = 5.0
#: Vectors that are compared at once, twice over.
GROUP = 512
#: Vectors of a table that are dealt out together, their keys having no more than GROUP each.
BIN = 2048


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


@lru_cache(16)
def rotation(dims: int, turns: int, seed: int) -> np.ndarray:
    """turns random rotations of dims dimensions, one under the other."""
    rng = np.random.default_rng([seed, dims])
    out = []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def shape_of(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors. Random vectors share a key about n / 2**bits < 16 times; a bit
    of two vectors at the threshold's angle agrees with probability 1 - angle / pi."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


class Codes:
    """Codes of unit vectors (rows of u): signs of the rotated vectors, padded with zeros to 64 dimensions at least.
    With o a vector and o' its code as a unit vector, factor = <o', o>; <o', q> / factor estimates <o, q> without bias
    for every q, and errs by width * sqrt((1 - factor**2) / factor**2 / (bits - 1)) at most, but for rare cases."""

    def __init__(self, u: np.ndarray, bits: int, tables: int, seed: int):
        dims = max(64, u.shape[1])
        turns = -(-bits * tables // dims)
        self.rotated = np.pad(u, ((0, 0), (0, dims - u.shape[1]))) @ rotation(dims, turns, seed).T / math.sqrt(turns)
        self.signs = self.rotated > 0
        total = dims * turns
        self.factor = np.abs(self.rotated).sum(1) / math.sqrt(total)
        weights = 1 << np.arange(bits, dtype=np.int64)
        self.keys = self.signs[:, : bits * tables].reshape(len(u), tables, bits) @ weights


def _pack(codes: Codes) -> list[bytes]:
    return [b.tobytes() for b in np.packbits(codes.signs, axis=1)]


def _equal_keys(key: np.ndarray):
    """Positions of all pairs with equal keys, a step of the sorted order at a time."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    for step in range(1, len(key)):
        at = np.flatnonzero(ranked[step:] == ranked[:-step])
        if not len(at):
            return
        yield order[at], order[at + step]


def _crossed(a: np.ndarray, b: np.ndarray):
    for p in a:
        yield np.full(len(b), p), b


def _in_lots(pairs, most: int = 8192):
    """The pairs in lots of about most."""
    held: list = []
    for pair in pairs:
        held.append(pair)
        if sum(len(p) for p, _ in held) >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _linked(pairs, pdf: pd.DataFrame, table: int, bits: int, tables: int, threshold: float, seed: int):
    """Those of the pairs that share no earlier table's key and reach the threshold."""
    dims = int(pdf.dims.iloc[0])
    unit = _unit(np.stack([np.frombuffer(b, "<f8" if len(b) == 8 * dims else "<f4") for b in pdf.raw]))
    signs = np.unpackbits(np.frombuffer(b"".join(pdf.code), np.uint8).reshape(len(pdf), -1), axis=1)
    keys = signs[:, : bits * tables].reshape(len(pdf), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    rotated = Codes(unit, bits, tables, seed).rotated
    total, f = signs.shape[1], pdf.factor.to_numpy()
    bound = WIDTH * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (total - 1))
    codes = (2.0 * signs - 1) / math.sqrt(total)
    for p, q in _in_lots(pairs):
        new = ~(keys[p, :table] == keys[q, :table]).any(1)
        p, q = p[new], q[new]
        open_ = np.einsum("ij,ij->i", codes[p], rotated[q]) / f[p] + bound[p] >= threshold
        p, q = p[open_], q[open_]
        yes = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
        yield p[yes], q[yes]


def farthest(total: int, threshold: float) -> int:
    """Bits of total in which codes of a pair that reaches the threshold differ at most: each differs with probability
    angle / pi, and WIDTH standard deviations are allowed."""
    p = math.acos(threshold) / math.pi
    return math.ceil(total * p + WIDTH * math.sqrt(total * p * (1 - p)))


def _open_rows(pairs, pdf: pd.DataFrame, table: int, bits: int, tables: int, threshold: float) -> np.ndarray:
    """Which rows have a pair that shares no earlier table's key and that the codes alone do not reject."""
    packed = np.frombuffer(b"".join(pdf.code), np.uint8).reshape(len(pdf), -1)
    keys = np.unpackbits(packed, axis=1)[:, : bits * tables].reshape(len(pdf), tables, bits)[:, :table] @ (1 << np.arange(bits, dtype=np.int64))
    most, has = farthest(8 * packed.shape[1], threshold), np.zeros(len(pdf), bool)
    for p, q in _in_lots(pairs):
        near = np.bitwise_count(packed[p] ^ packed[q]).sum(1, dtype=np.int64) <= most
        p, q = p[near], q[near]
        new = ~(keys[p] == keys[q]).any(1)
        has[p[new]] = has[q[new]] = True
    return has


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for each of n positions."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Other columns are not read.

    Equal vectors become one node that stands for all its ids, so groups of copies are never paired. Each node's code
    gives it a key in each table; nodes that share a key are compared in blocks, at first by their codes alone, which is
    all that travels once for each table. Nodes with pairs whose codes are near enough are then met again with their
    vectors: the estimate's upper bound rejects, and what it cannot reject is computed exactly in double precision. A key with more nodes than a block holds is dealt
    over pairs of blocks. A group passes on counts and one edge for each vector, never its pairs. A pair at the
    threshold is missed with probability MISS; no pair below it is linked.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows without an
    id. Rows that repeat an id count once, with the smallest vector. Vectors of unlike length do not link."""
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad & (F.size(x) > 0), x).alias("v"))
    rows = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    nodes = cut(rows.groupBy("v", F.when(F.col("v").isNull(), F.col("vec_id")).alias("_own")).agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).select("node", "m", "v"), "nodes")
    usable = nodes.where("v is not null")
    n = usable.count()
    bits, tables = shape_of(n, threshold)

    def code(frames):
        for pdf in frames:
            for n, at in pdf.groupby(pdf.v.map(len)).indices.items():
                part = pdf.iloc[at]
                v = np.stack(part.v.to_numpy())
                codes = Codes(_unit(v), bits, tables, seed)
                narrow = (v == v.astype("<f4")).all(1)
                raw = [x.astype("<f4" if few else "<f8").tobytes() for x, few in zip(v, narrow)]
                yield pd.DataFrame({"node": part.node.to_numpy(), "m": part.m.to_numpy(), "dims": n, "raw": raw, "code": _pack(codes), "factor": codes.factor, "keys": list(codes.keys)})

    schema = "node long, m long, dims int, raw binary, code binary, factor double, keys array<long>"
    coded = cut(usable.mapInPandas(code, schema), "codes")
    keyed = coded.select("node", "dims", "code", F.posexplode("keys").alias("t", "key"))
    sizes = coded.select("dims", F.posexplode("keys").alias("t", "key")).groupBy("dims", "t", "key").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > GROUP).select(F.col("dims").alias("_d"), F.col("t").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    keyed = keyed.join(cut(big, "big"), (F.col("dims") == F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_k")), "left").drop("_d", "_t", "_k")
    bins = max(1, math.ceil(n / BIN))
    own = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).alias("second"), F.col("key").alias("bin")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"), (-1 - F.pmod(F.xxhash64("key"), F.lit(bins))).alias("bin")))
    dealt = keyed.withColumn("at", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))
    dealt = dealt.select("dims", "t", "at.bin", "at.i", "at.j", "at.second", "key", "node", "code")
    group = ["dims", "t", "bin", "i", "j"]

    def pairs_of(key, pdf):
        if key[3] < key[4]:
            return _crossed(np.flatnonzero(~pdf.second), np.flatnonzero(pdf.second))
        return _equal_keys(pdf.key.to_numpy())

    def sift(key, pdf):
        pdf = pdf.reset_index(drop=True)
        return pdf.loc[_open_rows(pairs_of(key, pdf), pdf, int(key[1]), bits, tables, threshold), [*group, "second", "key", "node"]]

    left = dealt.groupBy(*group).applyInPandas(sift, dealt.select(*group, "second", "key", "node").schema)
    left = cut(left, "open").join(coded.select("node", "m", "raw", "code", "factor"), "node")

    def compare(key, pdf):
        pdf = pdf.reset_index(drop=True)
        lots = list(_linked(pairs_of(key, pdf), pdf, int(key[1]), bits, tables, threshold, seed))
        p, q = (np.concatenate([x[k] for x in lots] or [np.zeros(0, np.int64)]) for k in (0, 1))
        node, m, n = pdf.node.to_numpy(), pdf.m.to_numpy(), np.zeros(len(pdf), np.int64)
        np.add.at(n, p, m[q])
        np.add.at(n, q, m[p])
        order = np.argsort(node)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        root = node[order[_roots(len(pdf), rank[p], rank[q])]][rank]
        has = n > 0
        return pd.DataFrame({"node": node[has], "n": n[has], "root": root[has]})

    found = cut(left.groupBy(*group).applyInPandas(compare, "node long, n long, root long"), "links")
    roots = components(found.select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    # each node's component, then its ids: the node of an id is the smallest id of its vector
    known = nodes.join(counts.withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left").join(roots.withColumnRenamed("node", "_r"), F.col("node") == F.col("_r"), "left")
    known = known.select("node", "m", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    same = known.where("m > 1").select("v", "m", "n_links", "component_id")
    total = nodes.agg(F.sum("m")).first()[0] or 0
    single = known.where("m = 1").select(F.col("node").alias("vec_id"), "n_links", "component_id")
    copies = join_split(rows.where("v is not null"), same, "v", "m", total).select("vec_id", "n_links", "component_id")
    missing = vectors.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = single.union(copies).union(missing)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
