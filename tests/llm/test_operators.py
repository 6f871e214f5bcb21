"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties and repeats."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowmill.llm import compaction, embed_dedup, mixing, packing, pii, separator_scan, shingle_dedup, simhash, token_store, topk, toxicity
from flowmill.llm.common import shared_path
from flowmill.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copies long, fp string, node int, a int, length int"
TEXTS = ["", None, "one", "one two", "A b c d e", "a  b\n c ", "x " * 3000, "The cat's 12 hats,\n\nand  dogs ", "naïve Σίσυφος 東京 ok", "tab\tand\x0bmore", " lead", "trail "]


def library(path):
    return Tokenizer.from_file(path)


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s1", "s2", None])[i % len(sources or [1, 2, 3])], len(t or ""), 1, "x", 0, 0, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def links_to_roots(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("path,keeps", [(BYTES, True), (WORDS, False)])
def test_cached_ids_equal_the_library(path, keeps):
    texts = [t or "" for t in TEXTS] + ["<|endoftext|> a", "a <|endoftext|>\n b"]
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in Encoder(path, keeps).encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'ts 12.\n\t é 　́ΣİA"), max_size=30))
def test_cached_ids_equal_the_library_on_any_text(text):
    for path, keeps in ((BYTES, True), (WORDS, False)):
        assert np.frombuffer(_encoder(path, keeps).encode([text])[0], "<u4").tolist() == _library(path).encode(text, add_special_tokens=False).ids


_made = {}


def _encoder(path, keeps):
    return _made.setdefault(("e", path), None) or _made.__setitem__(("e", path), Encoder(path, keeps)) or _made["e", path]


def _library(path):
    return _made.setdefault(("l", path), None) or _made.__setitem__(("l", path), library(path)) or _made["l", path]


def test_mixing(spark):
    texts = TEXTS + ["w " * (n % 17) for n in range(300)]
    docs = docs_of(spark, texts, ["a", "B", None, "é", "a", "a", "a"])
    rows = {r.row.doc_id: r for r in mixing.plan_mix(docs).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {i: r.size for i, r in rows.items()} == size
    sums = defaultdict(int)
    for i, r in rows.items():
        sums[r.row.source] += size[i]
    weight = dict(zip(sorted(sums, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    stopped = set()
    while True:
        rest, w = sum(sums.values()) - sum(3 * sums[s] for s in stopped), sum(weight[s] for s in sums if s not in stopped)
        more = {s for s in sums if weight[s] * rest / w > 3 * sums[s]} - stopped
        if not more:
            break
        stopped |= more
    for r in rows.values():
        s = r.row.source
        want = 3.0 * sums[s] if s in stopped else weight[s] * rest / w
        assert math.isclose(r.target, want) and r.source_size == sums[s]
        rate = want / sums[s] if sums[s] else 0
        assert r.copies in (math.floor(rate), math.ceil(rate)) and r.copies <= 3
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_keeps_columns_comes_near_targets_and_repeats_itself(spark):
    odd = "doc_id long, text string, source string, size long, row string, copies long, _size long, _source string, _target double, _copies long, _copy int, key string, `a.b` int"
    rows = [(i, "w " * (1 + i % 23), f"s{i % 4}", -i, f"r{i}", i + 7, 1, "q", 2.5, i, 3, "k", i % 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, odd)
    plan = mixing.plan_mix(docs)
    for r in plan.groupBy("row.source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken / r.target - 1) < 0.06
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    got = sorted(map(tuple, mixed.collect()))
    copies = {r.row.doc_id: r.copies for r in plan.collect()}
    assert got == sorted(r for r in rows for _ in range(copies[r[0]])) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "GROUP", 64)
    rng = np.random.default_rng(5)
    x = list(rng.standard_normal((400, 24)))
    hot = rng.standard_normal(24)
    x += [hot + 0.03 * rng.standard_normal(24) for _ in range(300)]  # one key in most tables, over several blocks
    for a in range(60):  # at all distances about the threshold
        y = rng.standard_normal(24)
        y -= y @ x[a] / (x[a] @ x[a]) * x[a]
        c = rng.uniform(0.93, 0.999)
        x.append((c * x[a] / np.linalg.norm(x[a]) + math.sqrt(1 - c * c) * y / np.linalg.norm(y)) * rng.uniform(0.1, 9))
    x += [x[0], x[0], x[1]]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, 2.0]]
    rows = [(i, [None if c is None else float(c) for c in v] if v is not None else None, 1) for i, v in enumerate([*x, *odd])]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows + [rows[3], (None, [1.0], 1)], "vec_id long, embedding array<double>, m int")).collect()
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows) + 1 and len(by_id) == len(rows)
    found = sum(by_id[i].n_links for i in range(len(x)))
    assert all(by_id[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.995 * near.sum()
    if found == near.sum():
        roots = links_to_roots(range(len(x)), zip(*np.nonzero(near)))
        assert {i: by_id[i].component_id for i in range(len(x))} == roots
    for i in range(len(x), len(rows)):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((300, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = embed_dedup.Codes(u, 12, 24, 3)
    total = c.signs.shape[1]
    estimate = (2.0 * c.signs - 1) / math.sqrt(total) @ c.rotated.T / c.factor[:, None]
    error = (estimate - u @ u.T)[~np.eye(300, dtype=bool)]
    bound = embed_dedup.WIDTH * np.sqrt((1 - c.factor**2) / c.factor**2 / (total - 1))
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < bound.max()


@pytest.mark.parametrize("open_rows", [0, 8])
def test_top_k(spark, monkeypatch, open_rows):
    """Without open rows every meeting of blocks fetches exact vectors."""
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "OPEN", open_rows)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 16)).round(2)
    x[300:400] = x[300]  # ties
    x[400:500] = x[300] + 0.01 * rng.standard_normal((100, 16))  # nearly equal ones
    odd = [None, [], [float("inf")] * 16, [None] * 16, [1.0] * 3]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(700 + i, v, 1) for i, v in enumerate(odd)] + [(5, [float(c) for c in x[5]], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dims int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, "vec_id % 50 = 0", 5).collect()}
    v = np.floor(256 * x).astype(np.int64)
    want = {}
    for q in range(0, 700, 50):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        want |= {(q, k + 1): (int(i), int(s[i])) for k, i in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_compaction(spark):
    docs = docs_of(spark, TEXTS * 4)
    store = compaction.ShardStore(spark, shared_path(spark, "t"), fanout=3)
    assert store.append(docs.limit(0)) == 0
    for _ in range(2):
        store.append(docs)
    assert store.version() == 2 == store.compact()
    before = store.manifest().count()
    with pytest.raises(FileExistsError):
        store.commit(store.manifest(), 2)
    store.append(docs, by="lang")
    assert store.compact() == 4 and (before, store.manifest().count()) == (2, 1)
    assert store.read(2).count() == 2 * len(TEXTS) * 4
    rows = store.read().groupBy("doc_id", "text").count().collect()
    assert len(rows) == 4 * len(TEXTS) and all(r["count"] == 3 for r in rows)
    assert [r.rows for r in store.manifest().collect()] == [12 * len(TEXTS)]
    store.vacuum(0)
    assert store.read().count() == 12 * len(TEXTS)


def test_compaction_commits_each_version_once(spark):
    """Two writers make the same version at the same time: one gets FileExistsError, and readers see the other's."""
    from concurrent.futures import ThreadPoolExecutor

    docs = docs_of(spark, TEXTS)
    store = compaction.ShardStore(spark, shared_path(spark, "t"), fanout=3)
    store.append(docs)
    listed = store.manifest(1).collect()
    rows = [[(f"{w}", 0, 1, 1, 1, listed[0].schema)] for w in range(6)]

    def write(k):
        try:
            store.commit(spark.createDataFrame(rows[k], compaction.MANIFEST), 2)
            return k
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [k for k in pool.map(write, range(6)) if k is not None]
    assert len(won) == 1 and [r.run for r in store.manifest(2).collect()] == [str(won[0])]
    # appends at the same time all arrive
    other = compaction.ShardStore(spark, shared_path(spark, "t"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda _: other.append(docs), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and other.read().count() == 4 * len(TEXTS)
    before = other.read(1).count()
    other.vacuum()  # nothing is old enough to go
    assert other.read(1).count() == before == len(TEXTS)


def test_compaction_of_odd_columns_and_values(spark):
    store = compaction.ShardStore(spark, shared_path(spark, "t"), fanout=2)
    rows = [(1, "a b", "x"), (2, "a:b", "y"), (3, None, "z"), (4, "null", "w"), (5, "a/b=c", None), (6, "", "v"), (6, "", "v")]
    first = spark.createDataFrame(rows, "run long, kind string, __run string")
    assert store.append(first, by="kind") == 1 and store.manifest().count() == 6
    assert store.append(spark.createDataFrame([(7, "u", 1.5)], "run long, `__run` string, `new one` double")) == 2
    want = sorted([(r, x, None) for r, _, x in rows] + [(7, "u", 1.5)], key=repr)
    for _ in range(2):
        got = store.read()
        assert sorted([(r["run"], r["__run"], r["new one"]) for r in got.collect()], key=repr) == want
        store.compact()
    assert store.manifest().count() == 1
    with pytest.raises(ValueError, match="column run"):
        store.append(spark.createDataFrame([("x",)], "run string"))
    assert sorted(map(repr, (tuple(r) for r in store.read(1).select("run", "__run").collect()))) == sorted(repr((r, x)) for r, _, x in rows)


def check_packed(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_packing(spark):
    texts = TEXTS + ["word " * 2047, "word " * 2046, "y " * 9000]
    docs = docs_of(spark, texts)
    rows = packing.pack_documents(docs.union(docs.where("doc_id = 4")), BYTES, with_ids=True).collect()
    ids = [e.ids + [0] for e in library(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    seen = set()
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert own == r.ids and zlib.crc32(own) == r.ids_crc32
        seen.add((r.doc_id, r.piece))
        assert len(ids[r.doc_id]) > 2048 or r.piece == 0
        assert r.piece == 0 or r.length == 2048
    assert seen == {(i, k) for i, x in enumerate(ids) for k in range(-(-len(x) // 2048))}
    assert sum(r.length for r in rows) == sum(map(len, ids)) + len(ids[4])
    check_packed(rows, 2048)
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0


def test_packing_keeps_columns_and_refuses_lengths(spark):
    rows = [(i, 1 + i % 7, None if i % 2 else 2**60 + 1, "x", 5, i) for i in range(50)]
    pieces = spark.createDataFrame(rows, "id int, length int, _nth long, _part string, offset int, _at long").repartition(3)
    got = packing.pack(pieces, 10).collect()
    assert {(r.id, r.length, r["_nth"], r["_part"], r["_at"]) for r in got} == {(*x[:4], x[5]) for x in rows}
    check_packed(got, 10)
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="lengths must"):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), 10).collect()


def test_sums_are_indexed():
    rng = np.random.default_rng(8)
    lengths = sorted(set(rng.integers(1, 60, 25).tolist()))
    free = np.zeros(101, np.int64)
    free[lengths] = rng.integers(0, 3, len(lengths))
    index, have = packing.SumIndex(lengths, 100), [n for n in lengths if free[n]]
    for total in range(101):
        assert index.pairs(free, total) == sorted(((a, b) for a in have for b in have if a >= b and a + b == total), reverse=True)
        assert list(index.triples(free, total)) == sorted(((a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == total), reverse=True)
        assert index.singles(free, total) == [(n,) for n in have if n == total]


def test_plans_use_every_piece_once_and_leave_little():
    rng = np.random.default_rng(3)
    for most in (2048, 700, 60):
        lengths = rng.integers(1, most + 1, 20000)
        counts = dict(zip(*map(lambda x: x.tolist(), np.unique(lengths, return_counts=True))))
        used, bins = defaultdict(int), 0
        for pattern, many in packing.plan_bins(counts):
            assert sum(pattern) <= 2048
            bins += many
            for n in pattern:
                used[n] += many
        least = max(math.ceil(lengths.sum() / 2048), (lengths > 1024).sum())
        assert used == counts and bins <= least * 1.02 + 1, (bins, least)
    assert packing.plan_bins({}) == []


def test_toxicity():
    rng = np.random.default_rng(4)
    clean = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    bad = ["stupid", "idiot", "moronic", "worthless"]
    texts, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, rng.integers(5, 200)))
        if i % 4 == 0:
            words.insert(rng.integers(len(words)), str(rng.choice(bad)) + ",")
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:400], labels[:400])
    score = model.scores(texts[400:])
    assert ((score >= 0.7) == (np.array(labels[400:]) == 1)).mean() > 0.97
    long = " ".join(rng.choice(clean, 20000))
    assert model.scores([long])[0] < 0.7 < model.scores([long + " Idiot!"])[0]
    assert (model.scores(["you stupiid", "such an idiott", "STUPID"]) >= 0.7).all()  # never seen
    assert np.isfinite(model.scores(["", None, " ", "\n"])).all() and len(model.scores([])) == 0
    assert toxicity.train(["a"], [1]).scores(["x"])[0] == 0.5


def plain_score(model, text):
    """The softmax over the words, each the mean weight of its n-grams, of the windows of three words whose means are
    highest, each without a word of those before."""
    found = []
    words = [f" {w} " for w in re.findall(r"[^\W_]+", (text or "").lower())]
    for i in range(max(1, len(words) - toxicity.WINDOW + 1)):
        weights = []
        for w in words[i : i + toxicity.WINDOW]:
            grams = []
            for n in toxicity.GRAMS:
                for k in range(len(w) - n + 1):
                    h = 0
                    for c in w[k : k + n]:
                        h = (h * 0x01000193 + ord(c)) % 2**32
                    grams.append(float(model.weights[((h ^ (n - 1)) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS)]))
            weights.append(sum(grams) / len(grams))
        if weights:
            found.append((-sum(weights) / len(weights), i, weights))
    taken = []
    for _, i, weights in sorted(found):
        if len(taken) < toxicity.TOP and all(abs(i - j) >= toxicity.WINDOW for j, _ in taken):
            taken.append((i, weights))
    every = [x for _, weights in taken for x in weights]
    return 1 / (1 + math.exp(-(sum(every) / max(len(every), 1) + model.bias)))


def test_toxicity_scores_equal_a_plain_version():
    rng = np.random.default_rng(7)
    model = toxicity.Model(rng.standard_normal(1 << toxicity.BITS).astype(np.float32), -0.5)
    texts = [t for t in TEXTS if "Σ" not in (t or "")] + [" ".join("".join(rng.choice(list("abcé1,."), rng.integers(1, 9))) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50)]
    for got in (model.scores(texts), np.concatenate([model.scores([t]) for t in texts])):
        assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)
    first = np.array([0, 2, 2, 7])
    lo, hi, at = toxicity.windows(first, 3)
    assert list(zip(lo.tolist(), hi.tolist())) == [(0, 2), (2, 5), (3, 6), (4, 7)] and at.tolist() == [0, 1, 1]


def test_codes_of_linked_vectors_differ_in_few_bits():
    """Pairs at the threshold itself, which differ most: none in 20,000 is rejected by its codes, unlike nearly all random ones."""
    rng = np.random.default_rng(21)
    a, b = (embed_dedup._unit(rng.standard_normal((20000, 16))) for _ in range(2))
    b = embed_dedup._unit(b - (a * b).sum(1)[:, None] * a)
    near = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    x, y, z = (np.packbits(embed_dedup.Codes(u, 11, 27, 3).signs, axis=1) for u in (a, near, b))
    most = embed_dedup.farthest(8 * x.shape[1], 0.95)
    assert (np.bitwise_count(x ^ y).sum(1, dtype=int) <= most).all()
    assert (np.bitwise_count(x ^ z).sum(1, dtype=int) <= most).mean() < 0.001


def test_most_toxic_windows_share_no_word():
    value, begin, end = np.array([5.0, 5.0, 4.0, 1.0, 7.0]), np.array([0, 1, 2, 3, 6]), np.array([3, 4, 5, 6, 8])
    best, owner = toxicity.most_toxic(value, begin, end, np.array([0, 4]), 3)
    assert list(zip(owner.tolist(), best.tolist())) == [(0, 0), (1, 4), (0, 3)]


def test_a_short_insult_among_long_words():
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("abcdefgh"), 10)) for _ in range(300)]
    texts = [" ".join([*rng.choice(clean, 20), *(["scum", str(rng.choice(clean)), str(rng.choice(clean)), "scum"] if i % 3 == 0 else [])]) for i in range(300)]
    score = toxicity.train(texts[:200], [int(i % 3 == 0) for i in range(200)]).scores(texts[200:])
    assert ((score >= 0.7) == np.array([i % 3 == 0 for i in range(200, 300)])).all()


def test_toxicity_is_learnt_from_more_than_one_word():
    """Labels that depend on two words side by side, each of which is harmless alone."""
    rng = np.random.default_rng(9)
    clean = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 12))
        at = int(rng.integers(10))
        words[at : at + 2] = ["zap", "zog"] if i % 2 else ["zap", clean[0]] if i % 4 else [clean[1], "zog"]
        texts.append(" ".join(words))
        labels.append(i % 2)
    score = toxicity.train(texts[:300], labels[:300]).scores(texts[300:])
    y = np.array(labels[300:])
    assert score[y == 1].min() > score[y == 0].max()


def test_toxicity_on_tables(spark):
    texts = ["you idiot " + str(i) if i % 2 else "fine day " + str(i) for i in range(60)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if "idiot" not in (t or "")}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.-+ ()012359é,"), max_size=40))
def test_base_spans_equal_the_patterns(text):
    want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    want += [(m.start(), 1, m.end()) for m in PLAIN_IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            want.append((m.start(), 2, m.end()))
    want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert pii.base_spans(text) == sorted(want)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1 " * 100_000, "1." * 150_000):
        pii.base_spans(text)


def test_random_field():
    crf = pii.train()
    lines = pii.labelled()
    found = crf.decode([w for w, _ in lines])
    assert np.mean([a == b for (_, y), z in zip(lines, found) for a, b in zip(y, z)]) > 0.98
    text = "please mail bob at shop dot net or phone (646) 555-0133 before 12:45 on 2023-10-02, page 14 of 300"
    (base, more), = pii.find_all([text], crf)
    assert base == [] and {text[s:e] for s, _, e in more} >= {"(646) 555-0133"}
    assert not any(text[s:e].startswith(("12:45", "page", "300", "14")) for s, _, e in more)
    words = ["".join(w) for w in zip("abcdefgh", "xyzuvwst")] * 50
    assert pii.find_all([" ".join(words), None, ""], crf) == [([], [])] * 3
    # Viterbi against all labelings of a short sequence
    seq = ["tel", "(646)", "555-0133"]
    r = [crf.rows(w) for w in seq]
    e = [r[k][0] + (r[k - 1][1] if k else 0) + (r[k + 1][2] if k < 2 else 0) for k in range(3)]
    n = len(pii.LABELS)
    best = max(((crf.first[a] + e[0][a] + crf.move[a, b] + e[1][b] + crf.move[b, c] + e[2][c], (a, b, c)) for a in range(n) for b in range(n) for c in range(n)))
    assert tuple(crf.decode([seq])[0].tolist()) == best[1]


def test_personal_data_on_tables(spark):
    docs = docs_of(spark, [*TEXTS, "é bob@x.org, 10.0.0.1 and +1 (547) 555-0128", "card 4111 1111 1111 1111"])
    rows = {r.doc_id: r for r in pii.find_personal(docs).collect()}
    r = rows[len(TEXTS)]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 1, "email:2:11,ip:13:21,phone:26:43")
    clean = {r.doc_id: r for r in pii.mask_personal(docs).collect()}
    assert clean[len(TEXTS)].text == "é [EMAIL], [IP] and [PHONE]" and clean[len(TEXTS) + 1].text == "card [CARD]"
    assert clean[len(TEXTS)].n_chars == 27 and clean[1].text is None and clean[4].text == TEXTS[4]
    assert pii.mask_personal(docs).columns == docs.columns and pii.find_personal(docs.limit(0)).count() == 0


def test_token_store(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 200)
    texts = TEXTS + [f"text {i} of many " * (i % 9) for i in range(200)]
    where = shared_path(spark, "t")
    token_store.write_store(docs_of(spark, texts).repartition(3), where, WORDS, 2)
    ids = [e.ids + [2] for e in library(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    start = np.cumsum([0] + list(map(len, ids)))
    rows = token_store.read_store(spark, where).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id] and r.start == start[r.doc_id] and r.n_tokens == len(ids[r.doc_id])
    few = token_store.read_store(spark, where, [7, 150, 9999]).collect()
    assert {(r.doc_id, r.start) for r in few} == {(7, start[7]), (150, start[150])}
    empty = shared_path(spark, "t")
    token_store.write_store(docs_of(spark, texts).limit(0), empty, WORDS, 2)
    assert token_store.read_store(spark, empty).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps"], 80)) for _ in range(30)]
    texts = TEXTS + base + [b + " end" for b in base] + base[:5] + [b.replace("alpha", "Alpha", 1) for b in base]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    prints = {i: plain_simhash(t) for i, t in enumerate(texts)}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    pairs = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = links_to_roots(prints, pairs)
    assert {i: r.component_id for i, r in got.items()} == roots
    kept = simhash.drop_near_copies(docs.union(docs.where("doc_id = 4")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in roots if roots[i] == i)
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.drop_near_copies(nulls).count() == len(set(roots.values()))


@pytest.mark.parametrize("distance,segments", [(3, 2), (3, 4), (4, 2), (5, 3), (1, 2)])
def test_hamming_links_lose_and_repeat_nothing(spark, distance, segments):
    rng = np.random.default_rng(distance)
    seeds = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 12)]
    prints = {s ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(15)}
    got = [(r.a, r.b) for r in simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, segments).collect()]
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_keys_are_compared_in_blocks(spark, monkeypatch):
    """Fingerprints that all share half of their bits, near and far from each other, beside others."""
    monkeypatch.setattr(simhash, "HOT", 8)
    rng = np.random.default_rng(4)
    high, low = int(rng.integers(1, 1 << 31)) << 32, int(rng.integers(1, 1 << 32))
    prints = {high | low ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 9), replace=False)) for _ in range(120)}
    prints |= {(high ^ 1 << 40) | low ^ 1 << k for k in range(12)} | {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)}
    pairs = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = [(r.a, r.b) for r in simhash.group_links(df).collect()]
    assert all((a, b) in set(pairs) or (b, a) in set(pairs) or links_to_roots(prints, pairs)[a] == links_to_roots(prints, pairs)[b] for a, b in got)
    assert links_to_roots(prints, got) == links_to_roots(prints, pairs)


@pytest.mark.parametrize("distance,segments,block", [(3, 2, 8), (5, 3, 16), (5, 3, 512)])
def test_a_group_does_not_give_all_its_pairs(spark, monkeypatch, distance, segments, block):
    """240 near fingerprints give links within the distance, fewer than pairs and HOT for each at most; what hangs on one of
    them, or makes a group of its own under the same key, is linked as by all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_PRINTS", block)
    rng = np.random.default_rng(7)
    core = int(rng.integers(1, 1 << 62))
    near = {core}
    while len(near) < 240:
        near.add(core ^ sum(1 << int(b) for b in rng.choice(10, 2, replace=False)) ^ (1 << int(rng.integers(10, 63))))
    tail = {core ^ 0b11111 << 15 ^ 0b111 << 20, core ^ 0b11111 << 15 ^ 0b111 << 20 ^ 0b11 << 30}
    second = {core ^ 0x7F << 24 ^ 1 << int(k) ^ 1 << int(j) for k, j in rng.integers(40, 60, (20, 2))}
    prints = near | tail | second | {int(x) for x in rng.integers(1, 1 << 62, 30)}
    pairs = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.group_links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, segments).collect()}
    assert got <= pairs and links_to_roots(prints, got) == links_to_roots(prints, pairs)
    assert len(got) < min(len(pairs), simhash.HOT * len(prints))


def test_columns_of_any_name_stay(spark):
    texts = ["a b c d e f", "a b c d e f", "q r s t u v", None, ""]
    docs = spark.createDataFrame([(i, t, i * 2, "h", 1.5, "k") for i, t in enumerate(texts)], "doc_id long, text string, _hash2 long, _who string, _keep double, _id string")
    for drop in (simhash.drop_near_copies, shingle_dedup.drop_near_copies):
        kept = drop(docs)
        assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(i, texts[i], i * 2, "h", 1.5, "k") for i in (0, 2, 3)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan(spark, monkeypatch, block):
    monkeypatch.setattr(separator_scan, "FILE_DOCS", 5)
    texts = TEXTS + ["a b c " * i for i in range(40)]
    docs = docs_of(spark, texts).repartition(3).cache()
    where = shared_path(spark, "t")
    separator_scan.write_flat(docs, where, WORDS)
    got = {r.doc_id: r for r in separator_scan.count_tokens(spark, where, block).collect()}
    n = {i: len(library_ids) + 1 for i, library_ids in enumerate(e.ids for e in library(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert {i: r.n_tokens for i, r in got.items()} == n
    at = 0
    for r in sorted(got.values(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = iter([False, True])  # a source that gives its rows in another order the second time
    shown = docs.orderBy("doc_id").coalesce(1)

    class Turned:
        def select(self, *columns):
            return (shown.orderBy(F.desc("doc_id")).coalesce(1) if next(order) else shown).select(*columns)

    with pytest.raises(ValueError, match="another order"):
        separator_scan.write_flat(Turned(), shared_path(spark, "t"), WORDS)
    empty = shared_path(spark, "t")
    separator_scan.write_flat(docs.limit(0), empty, WORDS)
    assert separator_scan.count_tokens(spark, empty).count() == 0


def test_random_field_reads_all_words():
    crf = pii.train()
    text = "reach jo dot lee at mail dot org if it fails"
    (base, more), = pii.find_all([text], crf)
    assert base == [] and [text[s:e] for s, _, e in more] == ["jo dot lee at mail dot org"]
    # across the edges of windows
    plain = ["word"] * 137
    words = (plain + text.split()) * 12
    (_, more), = pii.find_all([long := " ".join(words)], crf)
    assert [long[s:e] for s, _, e in more] == ["jo dot lee at mail dot org"] * 12
    for w in ["Abc", "étude", "at", "At.", "(at)", "a.b", "x_y", "²", "a²", "don't!", "Straße", "%%%", "a@b", "a1", "re%%%", "[DOT]", "<p>ab</p>"]:
        assert pii.shapes(pii.alike(w)) == pii.shapes(w)
