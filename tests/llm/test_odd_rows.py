"""Repeated rows, rows without an id and ids that do not fit, where each row is a document of its own."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowmill.llm import packing, pii, separator_scan, token_store
from flowmill.llm.common import shared_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(None, "one two"), (None, "one two"), (None, None), (3, "three"), (3, "three"), (3, "other words here"), (1, ""), (2, "a@b.cd"), (2, "a@b.cd"), (None, "last one")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "f", 0) for r in ROWS], "doc_id long, text string, part string, nth int").repartition(2).cache()


def lengths(path):
    ids = Tokenizer.from_file(path).encode_batch([t or "" for _, t in ROWS], add_special_tokens=False)
    return Counter((d, len(e.ids) + 1) for (d, _), e in zip(ROWS, ids))


def test_separator_scan(spark, docs):
    where = shared_path(spark, "t")
    separator_scan.write_flat(docs, where, WORDS)
    got = separator_scan.count_tokens(spark, where).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == lengths(WORDS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_ids_beyond_16_bits_are_an_error(monkeypatch):
    from flowmill.llm import tokens

    class Large:
        def encode(self, texts):
            return [np.array([5, int(t)], "<u4").tobytes() for t in texts]

    monkeypatch.setattr(separator_scan, "encoder", lambda path, keeps: Large())
    assert separator_scan.flat_ids(["65534", "0"], WORDS) == [np.array([6, 65535], "<u2").tobytes(), np.array([6, 1], "<u2").tobytes()]
    with pytest.raises(ValueError, match="16-bit"):
        separator_scan.flat_ids(["1", "65535"], WORDS)
    assert tokens.encoder is not separator_scan.encoder


def test_token_store(spark, docs):
    where = shared_path(spark, "t")
    token_store.write_store(docs, where, WORDS, 2)
    got = token_store.read_store(spark, where).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == lengths(WORDS)
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == [sum(x.n_tokens for x in placed[:i]) for i in range(len(placed))]
    assert [r.doc_id for r in placed] == [None] * 4 + [1, 2, 2, 3, 3, 3]


def test_packing(docs):
    got = packing.pack_documents(docs, BYTES).collect()
    assert Counter((r.doc_id, r.length) for r in got) == lengths(BYTES)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and len({r.sequence_id for r in got}) == 1


def test_personal_data(docs):
    got = pii.find_personal(docs).collect()
    assert Counter((r.doc_id, r.n_email) for r in got) == Counter((d, int(t == "a@b.cd")) for d, t in ROWS)
