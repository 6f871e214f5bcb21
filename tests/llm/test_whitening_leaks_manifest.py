"""Whitening, decontamination and the Merkle manifest against plain versions, on small tables with nulls, repeats and ties."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, merkle, queries, whitening

DATA = "/root/testdata/sf0.001"


# whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, component int, whitened string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0, 0, "x") for i, v in rows], VECTORS)


def plain_whitening(rows, scale=64, offset=1_000_000, most=32):
    kept = [(i, [math.floor(scale * c) + offset for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    n, s = len(kept), x.sum(0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    c = np.array([[float(n * a - b) / n for a, b in zip(v, s)] for v in x])
    _, sv, vt = np.linalg.svd(c, full_matrices=True)
    e = np.concatenate([sv * sv / n, np.zeros(max(0, x.shape[1] - len(sv)))])
    return kept, deviation, c, e[:most], vt.T[:, :most]


def held(spark, rows, tol=1e-6):
    kept, deviation, c, e, axes = plain_whitening(rows)
    got = {}
    for r in whitening.whiten(vectors_of(spark, rows)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert sorted((i, k + 1) for i, _ in kept for k in range(len(e))) == sorted(k for k, v in got.items() for _ in v)
    live = e > 1e-9 * e[0] if e[0] > 0 else np.zeros(len(e), bool)
    for k in range(len(e)):
        mine = np.array([got[i, k + 1][0].whitened for i, _ in kept])
        assert all(abs(r.explained - (e[k] / e.sum() if e.sum() and len(e) == len(rows[0][1]) else r.explained)) < 1e-9 for i, _ in kept for r in got[i, k + 1])
        if live[k]:
            want = c @ axes[:, k] / math.sqrt(e[k])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < tol
        elif e[0] == 0:
            assert not mine.any()
    one = next(iter(got.values()))[0]
    assert all(int(got[i, 1][0].deviation) == d and got[i, 1][0].n == len(kept) for (i, _), d in zip(kept, deviation)) and one.identity_error < 1e-4


def test_whitening_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 1, 0.5, 0.25]).tolist()) for i in range(300)]
    held(spark, rows + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5)] + [rows[0]])


def test_whitening_of_ill_conditioned_deficient_and_equal_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((80, 3)) * [1e4, 30, 0.5] + 5000
    held(spark, [(i, [*v, v[0], 7.0]) for i, v in enumerate(base.tolist())], 1e-4)  # a copied and a constant dimension
    held(spark, [(i, v) for i, v in enumerate((rng.standard_normal((4, 9)) * np.arange(1, 10)).tolist())])  # fewer rows than dimensions
    held(spark, [(i, [0.5, -2.0]) for i in range(5)])  # nothing varies
    held(spark, [(7, [1.0, 2.0, 3.0])])


def test_whitening_of_nothing_and_of_several_lengths(spark):
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(vectors_of(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="or more"):
        whitening.whiten(vectors_of(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])]))


def test_triangular_solve_and_the_shift():
    rng = np.random.default_rng(5)
    r = np.triu(rng.standard_normal((5, 5))) + 5 * np.eye(5)
    q = rng.standard_normal((20, 5))
    assert np.allclose(whitening.forward(q @ r, r), q)
    flat = np.outer(np.ones(4), np.ones(4))
    assert whitening.cholesky(flat, 10, False) is None
    s = whitening.cholesky(flat, 10, True)
    assert np.abs(s.T @ s - flat).max() < 1e-10


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(texts, items, window=10, coverage=1.0):
    wins = {}
    for i, t in items:
        w = words(t)
        k = max(1, min(window, math.ceil(coverage * len(w))))
        for a in range(len(w) - k + 1) if w and i is not None else ():
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, who = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    who |= wins[tuple(w[a : a + k])]
                    hit |= set(range(a, a + k))
        out.append((len(w), len(hit), sorted(who)))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "alpha beta"), (3, "beta"), (4, None), (5, "  ,.;"), (None, "gamma delta"), (6, "one two three four five six seven eight nine ten eleven twelve"), (2, "rho sigma"), (10, "Straße 東京 naïve ok " * 4), (7, "a a a a a a a a a a a a")]
TEXTS = [None, "", "  ", "ALPHA, beta!", "alpha; Beta alpha beta rho sigma", "zero one two three four five six seven eight nine ten eleven twelve thirteen", "two three four five six seven eight nine ten eleven", "three four five six seven eight nine ten eleven", "a " * 25, "a " * 9, "straße 東京 naïve ok straße 東京 naïve ok straße 東京 naïve", "STRASSE gamma delta", "x " * 5000 + "alpha beta", "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"]
DOCS = "doc_id long, text string, items string, spans int, n_hit int, n_words int, _text string, _number int, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 0, 0, 0, "y", 0, len(t or "")) for i, t in enumerate(texts)], DOCS)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")


@pytest.mark.parametrize("size", [250_000, 20])
def test_contamination_equals_all_windows(spark, size):
    docs, items = docs_of(spark, [*TEXTS, TEXTS[4]]), items_of(spark, ITEMS)
    for coverage in (1.0, 0.4):
        got = decontaminate.find_contamination(docs, items, ["doc_id", "text"], words=size, coverage=coverage).collect()
        want = dict(zip(TEXTS, plain_hits(TEXTS, ITEMS, coverage=coverage)))
        assert len(got) == len(TEXTS) + 1
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == want[r.text] and sum(s.end - s.start for s in r.spans) == r.n_hit


def test_long_items_are_cut_and_long_texts_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(6)]
    items = [(i, [vocabulary[k] for k in rng.integers(0, 6, n)]) for i, n in enumerate([3, 4, 30, 60])]
    index = decontaminate.index_of((str(i), min(4, len(w)), [x.encode() for x in w]) for i, w in items)
    texts = [" ".join(vocabulary[k] if k < 6 else "zz" for k in rng.integers(0, 7, 200)) for _ in range(30)]
    for t, want in zip(texts, plain_hits(texts, [(i, " ".join(w)) for i, w in items], window=4)):
        n, hit, who, _ = decontaminate.scan(t.encode(), index)
        assert (n, hit, sorted(who)) == want


def test_pieces_keep_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 5)
    text = " ".join(f"w{k}" for k in range(23))
    got = decontaminate.pieces(items_of(spark, [(1, text)]), "item_id", "text", 4, 1.0).collect()
    every = {tuple(w[a : a + 4]) for r in got for w in [bytes(r.words).decode().split()] for a in range(len(w) - 3)}
    assert every == {tuple(f"w{k}" for k in range(a, a + 4)) for a in range(20)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=14), min_size=1, max_size=5), st.text("abcd ", max_size=40))
def test_the_automaton_on_any_words(items, text):
    index = decontaminate.index_of((str(i), max(1, min(3, len(words(t)))), [w.encode() for w in words(t)]) for i, t in enumerate(items))
    n, hit, who, _ = decontaminate.scan(text.encode(), index)
    assert (n, hit, sorted(who)) == plain_hits([text], list(enumerate(items)), window=3)[0]


def test_spans_are_removed_and_other_rows_stay(spark):
    docs, items = docs_of(spark, TEXTS), items_of(spark, ITEMS)
    got = {r.text: r for r in decontaminate.remove_contamination(docs, items).collect()}
    assert decontaminate.remove_contamination(docs, items).columns == docs.columns
    clean = [t for t, (_, hit, _) in zip(TEXTS, plain_hits(TEXTS, ITEMS)) if not hit]
    assert set(clean) <= set(got)
    assert "x " * 5000 in got and got["x " * 5000].n_chars == 10000
    assert not any(t in got for t in ("ALPHA, beta!", "a " * 25))
    assert decontaminate.without("Zero (one two), three!".encode(), [(1, 3)]) == "Zero (), three!".encode()


def test_contamination_without_items_or_texts(spark):
    docs = docs_of(spark, TEXTS)
    got = decontaminate.find_contamination(docs, items_of(spark, [(1, None)]), ["doc_id"])
    assert got.count() == len(TEXTS) and got.where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), items_of(spark, ITEMS), ["doc_id"]).count() == 0


# manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_way(levels, at, fanout, changed):
    beside = []
    for level in levels[:-1]:
        begin = at // fanout * fanout
        left, right = level[begin:at], level[at + 1 : begin + fanout]
        changed = digest("".join([*left, changed, *right]))
        beside += [*left, *right]
        at //= fanout
    return beside, changed


def plain_manifest(rows, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for r in rows:
        leaf = digest("".join(map(enc, r)))
        bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        found = digest("".join(map(enc, [*r[:3], r[3] + 1, r[4]]))) if bad else leaf
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, found, r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: plain_tree([x[2] for x in sorted(trees[t], key=lambda x: x[:3])], fanout) for t in order}
    top = plain_tree([made[t][-1][0] for t in order], fanout)
    out = []
    for k, t in enumerate(order):
        for at, x in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            low, folded = plain_way(made[t], at, fanout, x[3])
            high, folded = plain_way(top, k, fanout, folded)
            out.append((x[4][0], x[2], made[t][-1][0], top[-1][0], digest("".join(low + high)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


TABLE = "doc_id long, source string, lang string, n_chars long, text string, leaf int, idx int, size int, tree string, _tie int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, "x", 0) for r in rows], TABLE)


def manifest(docs, fanout, hop):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    df = merkle.verify(docs, changed={"n_chars": F.col("n_chars") + F.when(bad, 1).otherwise(0)}, fanout=fanout, hop=hop)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, digest(r.siblings.hex()), r.folded_root, r.verified) for r in df.collect()], key=repr)


MIXED = [(k, "s", ["a", "b", None, "é", "b"][k % 5], k % 4 or None, f"text {k} ü") for k in range(43)]
MIXED += [(None, None, None, None, None), (5, "s", None, 3, ""), (5, "s", None, 3, ""), (5, "s", "a", 3, "x" * 100_000), (14, "s", "solo", None, "a"), (-1, "s", "b", 2, "a")]


@pytest.mark.parametrize("fanout,hop", [(2, 4), (2, 1), (3, 2)])
def test_manifest_equals_a_plain_one(spark, monkeypatch, fanout, hop):
    monkeypatch.setattr(merkle, "SPREAD", 8)
    assert manifest(table_of(spark, MIXED), fanout, hop) == plain_manifest(MIXED, fanout)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    assert manifest(table_of(spark, MIXED[:n]), 2, 4) == plain_manifest(MIXED[:n], 2)


def test_a_row_limit_does_not_end_the_climb(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        assert len(manifest(table_of(spark, MIXED), 2, 4)) == len(MIXED)
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "10"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit") if before is None else spark.conf.set("spark.sql.cteRecursionRowLimit", before)


# queries


@pytest.mark.parametrize("name", ["op12_benchmark_decontamination", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    ran = duck.execute(queries.SQL[name])
    assert df.columns == [c[0] for c in ran.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, ran.fetchall()))


def test_whitening_query_over_its_table(spark):
    df = queries.QUERIES["op11_embedding_whitening"](spark, DATA)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    held(spark, [(r.vec_id, r.e) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()])
