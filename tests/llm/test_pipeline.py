"""The pipeline against its stages' plain versions, on documents that hold each case."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowmill.llm import pii, shingle_dedup
from flowmill.llm.common import shared_path
from tests.llm.test_operators import check_packed, links_to_roots, plain_simhash


@pytest.fixture(scope="module")
def sf_dir(spark):
    where = shared_path(spark, "sf")
    body = ["".join(chr(97 + (i * 7 + j * j) % 26) for j in range(6)) + f" w{i} is here with k{i % 5} and so on {i * 31}" for i in range(60)]
    rows = [(i, b + (" you idiot" if i % 6 == 0 else ""), "en", f"s{i % 3}") for i, b in enumerate(body)]
    rows += [(100 + i, body[i], "en", "s1") for i in range(1, 20)]  # copies
    rows += [(200, "mail bob@x.org now or never again friend", "en", "s2"), (201, None, None, None), (202, "", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(48)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else None
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(path := shared_path(spark, name))
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if "idiot" not in (r.text or "")}
        if name == "near_dedup":
            prints = {i: plain_simhash(r.text) for i, r in before.items()}
            roots = links_to_roots(prints, [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3])
            assert sorted(r.doc_id for r in rows) == sorted(set(roots.values()))
        if name == "personal_data":
            found = pii.find_all([r.text for r in rows], pii.train())
            assert len(rows) == len(before) and not any(base for base, _ in found)
            assert {r.text for r in rows if r.doc_id == 200} == {"mail [EMAIL] now or never again friend"}
        if name == "mixing":
            assert {r.doc_id for r in rows} <= set(before) and len(rows) > 0
            seen["mixed"] = len(rows)
        if name == "packing":
            assert sum(r.piece == 0 for r in rows) == seen["mixed"]
            check_packed(rows, 2048)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"


@pytest.mark.parametrize("small,members,some", [(24, 256, 1 << 20), (0, 3, 1 << 20), (2, 256, 150)])
def test_near_copies_by_five_word_similarity(spark, monkeypatch, small, members, some):
    """Sets of one, two and six changed words in 120: near at 0.8 though many simhash bits apart; a chain is one group."""
    for name, value in (("SMALL", small), ("BLOCK_MEMBERS", members), ("BLOCK_SHINGLES", some)):
        monkeypatch.setattr(shingle_dedup, name, value)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(40, 160))
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            for k in rng.sample(range(len(words)), rng.choice([1, 2, 6])):
                words[k] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["a b", "a b c", "A  B", "", None, texts[0].upper()]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))}
    sets = [grams(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any((plain_simhash(texts[i]) ^ plain_simhash(texts[j])).bit_count() > 3 for i, j in near)
    roots = links_to_roots(range(len(texts)), near)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.union(docs.where("doc_id = 4")), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots.values())) and all(r.text == texts[r.doc_id] for r in kept)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
    nulls = spark.createDataFrame([(None, "x y z"), (None, None), (7, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, nulls, "").collect()} == {(None, None), (7, "x y z")}


def test_near_copies_are_named_by_simhash_first(spark):
    """Pairs of fingerprints within the distance are named and linked without any bucket; equal fingerprints too."""
    words = [f"w{i * i % 997}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:-1], "other"]), " ".join(words[:20]), "a b c d e f"]
    k = shingle_dedup._sketches(texts)
    rows = list(zip(k["fp"].astype(int).tolist(), k["size"].tolist(), k["print"].tolist()))
    nodes = spark.createDataFrame(rows, "fp long, size int, print long")
    want = {(min(a, b), max(a, b)) for a, _, p in rows[:3] for b, _, q in rows[:3] if a != b and (p ^ q).bit_count() <= shingle_dedup.DISTANCE}
    found = shingle_dedup.simhash_pairs(nodes)
    assert len(want) >= 2 and {(r.a, r.b) for r in found.collect()} == want
    sets = spark.createDataFrame([(r[0], shingle_dedup.shingles(t).view(np.int64).tolist()) for r, t in zip(rows, texts)], "fp long, s array<long>")
    none = spark.createDataFrame([], "key long, fp long, size int, lead struct<fp: long, size: int>")
    assert {(r.a, r.b) for r in shingle_dedup.near_links(sets, none, found).collect()} == want


def test_similar_sets():
    rng = np.random.default_rng(2)
    base = rng.choice(10_000, 300, replace=False)
    found = [np.unique(np.concatenate([base[: int(k)], rng.integers(10_000, 11_000, int(x))])) for k, x in zip(rng.integers(200, 300, 40), rng.integers(0, 30, 40))]
    want = [[len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for b in found] for a in found]
    for width in (7, 4096):
        assert shingle_dedup.similar(found, width).tolist() == want
