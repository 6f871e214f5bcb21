"""Exact top-k inner products by vector-approximation files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import cut

#: Cells of each dimension, so a cell's number is one byte.
CELLS = 256
#: Vectors of a block.
BLOCK = 2048
#: So many rows that a block's cells leave open are passed on for each query and result; where there are more, the block's
#: exact vectors are fetched instead, and k rows are passed on.
OPEN = 8


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the rows of x, with each dimension's lowest value and cell width."""
    low = x.min(0)
    step = np.maximum(np.ceil((x.max(0) - low + 1) / CELLS), 1)
    return ((x - low) // step).astype(np.uint8), low, step


def block_bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, k: int):
    """Of a block's rows those that its cells can't exclude from a query's k best: positions of query and row, and the bound
    above the score. A row is excluded if k others of the block are certain to score more. Products are in single
    precision, and the bound holds what that may err by."""
    half = (step - 1) / 2
    wide = queries * step.astype(float)
    middle = (wide.astype(np.float32) @ cells.astype(np.float32).T).astype(float) + (queries @ (low + half))[:, None]
    err = (queries.shape[1] + 4) * 2.0**-23 * (np.abs(wide) @ cells.max(0).astype(float)) + 1e-9 * (1 + np.abs(queries) @ np.abs(low + half))
    slack = np.abs(queries) @ half + err
    least = np.full(len(queries), -np.inf)
    if cells.shape[0] > k:
        least = np.partition(middle, len(cells) - k, axis=1)[:, len(cells) - k] - 2 * slack
    q, row = np.nonzero(middle >= least[:, None])
    return q, row, middle[q, row] + slack[q]


def read_in_order(query: np.ndarray, rows: np.ndarray, upper: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int):
    """The k best of rows and their scores, ties to the smaller id: exact vectors are read in the order of the bounds until
    the kth score found exceeds every bound that is left."""
    order = np.argsort(-upper, kind="stable")
    found, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(order) and not (len(scores) >= k and upper[order[at]] < scores[k - 1]):
        part = rows[order[at : at + 64]]
        found, scores = np.concatenate([found, part]), np.concatenate([scores, exact[part].astype(np.int64) @ query])
        best = np.lexsort((ids[found], -scores))[:k]
        found, scores, at = found[best], scores[best], at + 64
    return found, scores


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x as a double. Vectors that are null or empty or hold null or
    non-finite components are left out, as are rows without an id. An id's repeats count once, with the smallest."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, x).alias("x")).where("vec_id is not null and size(x) > 0")
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query picks, the k other rows with the highest integer inner
    product of floor(scale * x), all if there are fewer; ties to the smaller id. Exact. Vectors of other lengths are not
    candidates. Components must stay below 2**24 in size, else the query fails: scores would not be exact.

    Equal vectors are one candidate with its k + 1 smallest ids, which are all that can matter. Candidates are packed into
    blocks with one byte for each component, and queries into blocks of their own; each pair of blocks is one row of
    work, which gives bounds of those rows that may be among a query's k best. Exact vectors are then read in the order
    of the bounds: those of the 2k highest ones first, then those whose bound still reaches the kth score; of the others
    none can. Where a block's cells leave too many rows open for that, its exact vectors are fetched for the queries
    concerned. is_query is SQL about vec_id, so that a query block holds nothing else."""
    rows = whole_numbers(vectors, scale, id_col, vector_col)
    large = F.exists("v", lambda c: F.abs(c) > float(1 << 24))
    rows = rows.withColumn("v", F.when(large, F.raise_error(F.lit("components of 2**24 and more are not supported"))).otherwise(F.col("v")))
    rows = cut(rows.withColumn("dims", F.size("v")), "vectors")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    nodes = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v", F.size("v").alias("dims")), "nodes")
    bins = max(1, -(-nodes.count() // BLOCK))

    def packed(df: DataFrame, who: str, cells: bool, bins: int) -> DataFrame:
        def pack(key, pdf):
            x = np.stack(pdf.v.to_numpy()).astype(np.int32)
            parts = [y.tobytes() for y in quantise(x)] if cells else []
            return pd.DataFrame([[key[0], pdf[who].to_numpy(np.int64).tobytes(), parts, x.tobytes()]], columns=["dims", "who", "parts", "exact"])

        return df.groupBy("dims", F.pmod(F.xxhash64(who), F.lit(bins)).alias("bin")).applyInPandas(pack, "dims int, who binary, parts array<binary>, exact binary")

    candidates = cut(packed(nodes, "node", True, bins).withColumn("cand", F.monotonically_increasing_id()), "candidates")
    queries = cut(packed(rows.where(is_query), "vec_id", False, max(1, bins // 8)).withColumn("asker", F.monotonically_increasing_id()), "queries")
    asked = queries.select("asker", F.col("who").alias("qid"), F.col("exact").alias("q"))
    # the grid of blocks: each block of candidates meets each block of queries, and every meeting is dealt out by itself
    grid = candidates.select("dims", "cand").join(queries.select("dims", "asker"), "dims").select("cand", "asker")
    work = candidates.select("cand", "dims", "who", "parts").join(grid, "cand").join(asked.join(grid, "asker"), ["cand", "asker"])

    def read(r):
        one = lambda b, kind: np.frombuffer(b, kind)
        x = one(r.q, np.int32).reshape(-1, r.dims).astype(float)
        return one(r.qid, np.int64), x, one(r.who, np.int64), (one(r.parts[0], np.uint8).reshape(-1, r.dims), one(r.parts[1], np.int32), one(r.parts[2], np.float64))

    def search(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                qid, x, ids, cells = read(r)
                q, row, upper = block_bounds(x, *cells, k + 1)
                many = np.bincount(q, minlength=len(qid)) > OPEN * (k + 1)
                fine = ~many[q]
                yield pd.DataFrame({"query_id": qid[q[fine]], "node": ids[row[fine]], "upper": upper[fine], "cand": r.cand, "asker": r.asker})
                yield pd.DataFrame({"query_id": qid[many], "node": None, "upper": 0.0, "cand": r.cand, "asker": r.asker})

    bounds = cut(work.mapInPandas(search, "query_id long, node long, upper double, cand long, asker long"), "bounds")
    crowded = bounds.where("node is null").groupBy("cand", "asker").agg(F.collect_list("query_id").alias("only"))  # a block's queries at most
    crowded = crowded.join(candidates.select("cand", "dims", "who", "parts", "exact"), "cand").join(asked, "asker")

    def search_exact(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                qid, x, ids, cells = read(r)
                exact = np.frombuffer(r.exact, np.int32).reshape(-1, r.dims)
                for at in np.flatnonzero(np.isin(qid, r.only)):
                    _, row, upper = block_bounds(x[at : at + 1], *cells, k + 1)
                    found, score = read_in_order(x[at].astype(np.int64), row, upper, ids, exact, k + 1)
                    yield pd.DataFrame({"query_id": qid[at], "node": ids[found], "score": score})

    def exact(pairs: DataFrame) -> DataFrame:
        """pairs (query_id, node) with their scores."""
        c = nodes.select(F.col("node").alias("_c"), F.col("v").alias("_cv"))
        q = rows.where(is_query).select(F.col("vec_id").alias("_q"), F.col("v").alias("_qv"))
        both = pairs.join(c, F.col("node") == F.col("_c")).join(q, F.col("query_id") == F.col("_q"))
        product = F.zip_with("_cv", "_qv", lambda a, b: a.cast("long") * b.cast("long"))
        return both.select("query_id", "node", F.aggregate(product, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))

    def best(df: DataFrame, n: int, *order) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)

    free, place = bounds.where("node is not null").select("query_id", "node", "upper"), F.struct("upper", -F.col("node"))
    first = cut(best(free, 2 * (k + 1), F.desc("upper"), "node").drop("rank"), "first")
    known = cut(exact(first).union(crowded.mapInPandas(search_exact, "query_id long, node long, score long")), "read")
    kth = best(known, k + 1, F.desc("score"), "node").groupBy("query_id").agg(F.min("score").alias("_kth"), F.count("*").alias("_n"))
    last = first.groupBy("query_id").agg(F.min(place).alias("_last"))
    rest = free.join(kth.where(F.col("_n") > k).join(last, "query_id"), "query_id").where((place < F.col("_last")) & (F.col("upper") >= F.col("_kth")))
    top = best(known.union(exact(rest)), k + 1, F.desc("score"), "node").join(nodes.select("node", "ids"), "node")
    every = top.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    return best(every, k, F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")
