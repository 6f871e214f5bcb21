"""Toxicity by averaged subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import smallest_hashes
from flowmill.llm.tokens import in_blocks, texts_of, trim

#: Labelled texts the model is fitted on: so many of each label at most, none longer than so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 2500, 5000
BITS, DIMS, EPOCHS, WHOLE, RATE = 17, 8, 45, 5, 0.3
#: Words of a window; a text of fewer words is one window. A text is scored by so many of its windows.
WINDOW, TOP = 3, 2
#: Lengths of the character n-grams of a word with a mark at either end.
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Code points from here on count as letters.
FAR = 0x3000


@lru_cache(1)
def _is_word() -> np.ndarray:
    return np.array([chr(i).isalnum() or i == FAR for i in range(FAR + 1)])


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Begin and length of each word of the text (runs of letters and digits, lower case), the code points, and for
    each length of n-gram the bucket at each position and whether the n-gram there lies within a marked word."""
    points = np.frombuffer(f" {text.lower()}     ".encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_word()[np.minimum(points, FAR)]
    points = np.where(inside, points, np.uint32(32))
    edge = np.diff(inside.astype(np.int8))
    begin = np.flatnonzero(edge == 1) + 1
    length = np.flatnonzero(edge == -1) + 1 - begin
    n, mult = len(points) - 5, np.uint32(0x01000193)
    h, valid, buckets, valids = points[:n] * mult + points[1 : n + 1], inside[1 : n + 1], [], []
    for k in range(2, max(GRAMS)):
        h = h * mult + points[k : n + k]
        if k + 1 in GRAMS:
            buckets.append(((h ^ np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            valids.append(valid)
        valid = valid & inside[k : n + k]
    return begin, length, points, buckets, valids


def n_grams(length: np.ndarray) -> np.ndarray:
    return sum(np.maximum(length + 3 - g, 0) for g in GRAMS)


def windows(first: np.ndarray, words: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first: where each text's words begin in one row of words, and where the last text's end. Begin and end of every
    window (words neighbours within a text; a shorter text is one window) and where each text's windows begin."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - words, 0) + 1, 0)
    start = np.cumsum(many) - many
    begin = np.arange(many.sum()) - np.repeat(start, many) + np.repeat(first[:-1], many)
    return begin, np.minimum(begin + words, np.repeat(first[1:], many)), start


def most_toxic(value: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that each text is scored by, and of their texts: those of the largest value that share no word, top at
    most, of equal ones the first. at: where each text's windows begin; each has one at least."""
    value, text = value.copy(), np.repeat(np.arange(len(at)), np.diff(np.append(at, len(value))))
    found, owner = [], []
    for _ in range(top):
        peak = np.maximum.reduceat(value, at)
        hit = np.flatnonzero((value == peak[text]) & (value > -np.inf))
        owners, first = np.unique(text[hit], return_index=True)
        best = hit[first]
        found.append(best)
        owner.append(owners)
        lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lo[owners], hi[owners] = begin[best], end[best]
        value[(begin < hi[text]) & (end > lo[text])] = -np.inf
    return np.concatenate(found), np.concatenate(owner)


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x)])


@dataclass
class Model:
    """The weight of each bucket in the difference of the two softmax inputs, and of the biases: all that scores need."""

    weights: np.ndarray
    bias: float

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begins of the words and the mean weight of each one's n-grams."""
        begin, length, points, buckets, valids = words_of(text)
        at = np.zeros(len(points))
        for b, v in zip(buckets, valids):
            at[1 : len(b) + 1] += np.where(v, self.weights[b], 0)
        return begin, np.add.reduceat(at, begin) / n_grams(length) if len(begin) else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the softmax over the mean of the words in each text's most toxic windows, a word being the mean
        of its n-grams; without words that of the bias alone."""
        texts = [(t or "").lower() for t in texts]
        begin, value = self.words(" ".join(texts))
        start = np.cumsum([1] + [len(t) + 1 for t in texts])
        first = np.searchsorted(begin, start)
        lo, hi, at = windows(first)
        z = np.zeros(len(texts))
        has = first[1:] > first[:-1]
        if has.any():
            value, size = _before(value), hi - lo
            value = value[hi] - value[lo]
            best, owner = most_toxic(value / size, lo, hi, at[has])
            z[has] = np.bincount(owner, value[best]) / np.bincount(owner, size[best])
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -500, 500)))


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in one row, as numbers of distinct words, and where each text's begin; the buckets of all distinct
    words' n-grams in one row, where each word's begin, and how many it has."""
    known: dict[str, int] = {}
    found = []
    for text in texts:
        low = text.lower()
        begin, length, *_ = words_of(low)
        found.append(np.fromiter((known.setdefault(low[b - 1 : b - 1 + n], len(known)) for b, n in zip(begin.tolist(), length.tolist())), np.int32, len(begin)))
    first = np.cumsum([0] + [len(f) for f in found])
    begin, length, _, buckets, valids = words_of(" ".join(known))
    size = n_grams(length)
    owner_of = np.zeros(int(begin[-1] + length[-1]) + 6 if len(begin) else 6, np.int32)
    owner_of[begin] = 1
    owner_of = np.cumsum(owner_of, dtype=np.int32) - 1
    at = [np.flatnonzero(v) for v in valids]
    grams = np.concatenate([b[i].astype(np.int32) for b, i in zip(buckets, at)])
    order = np.argsort(np.concatenate([owner_of[i + 1] for i in at]), kind="stable")
    return np.concatenate([*found, np.zeros(0, np.int32)]), first, grams[order], np.cumsum(size) - size, size


def _by_dimension(values) -> np.ndarray:
    """The columns that values gives for each dimension: one at a time, so that memory holds no more than one of them for all
    n-grams."""
    return np.stack([values(k) for k in range(DIMS)], 1)


def train(texts: list[str], labels: Iterable[int], seed: int = 3) -> Model:
    """Embeddings of subwords and a linear softmax over their mean, fitted together by Adagrad. A word is the mean of its
    n-grams, so that a short word weighs as much as its long neighbours. In the first epochs the mean is over the words of
    a whole text; then over those of the windows that the model itself finds most toxic, so that a few words in 20,000 weigh
    as much as in ten. A chance likeness that stands once in a clean text is held against its second window. Texts without words are left out. Without both labels the model says
    0.5 to everything."""
    y = np.asarray(list(labels), np.int64)
    stream, first, grams, start, size = _bags(texts)
    has = np.diff(first) > 0
    if len(set(y[has].tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    y, first = y[has], np.append(first[:-1][has], first[-1])
    lo, hi, at = windows(first)
    cost = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS))
    w, bias = np.zeros((DIMS, 2)), np.zeros(2)
    held = [np.full(x.shape, 1e-6) for x in (e, w, bias)]
    pairs, times = np.unique(np.repeat(np.arange(len(y)), np.diff(first)) * len(size) + stream[first[0] :], return_counts=True)
    for epoch in range(EPOCHS):
        if epoch < WHOLE:
            doc, word, of = pairs // len(size), pairs % len(size), times
            share = 1 / np.diff(first)
        else:
            value = _before((np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[grams], start) / size)[stream])
            value = (value[hi] - value[lo]) / (hi - lo)
            best, owner = most_toxic(value, lo, hi, at)
            begin, end = lo[best], hi[best]
            many = end - begin
            doc, of = np.repeat(owner, many), 1
            share = 1 / np.bincount(owner, many)
            word = stream[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)]
        if epoch < WHOLE:
            n, own, gram = size, start, grams
        else:
            used, word = np.unique(word, return_inverse=True)
            n = size[used]
            own = np.cumsum(n) - n
            gram = grams[np.arange(n.sum()) - np.repeat(own - start[used], n)]
        bag = _by_dimension(lambda k: np.add.reduceat(e[gram, k], own) / n)
        mean = _by_dimension(lambda k: np.bincount(doc, bag[word, k] * of, len(y))) * share[:, None]
        z = mean @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - np.eye(2)[y]) * cost[:, None]
        back = d @ w.T * share[:, None]
        by_word = _by_dimension(lambda k: np.bincount(word, back[doc, k] * of, len(n)) / n)
        of_gram = np.repeat(np.arange(len(n), dtype=np.int32), n)
        de = _by_dimension(lambda k: np.bincount(gram, by_word[of_gram, k], len(e)))
        for x, grad, sums in zip((e, w, bias), (de, mean.T @ d, d.sum(0)), held):
            sums += grad * grad
            x -= RATE * grad / np.sqrt(sums)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of docs (doc_id, text) with labels (doc_id, toxic): of each label those with the
    smallest hash of their id. Rows whose id, text or label is null, or whose text is too long, are not used. An id with
    several labels counts as toxic if one of them says so."""
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS)
    marked = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    both = short.join(marked, "doc_id")
    rows = []
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        rows += smallest_hashes(both.where(F.col("toxic") == toxic), most, "doc_id", "text").select("text", "toxic").collect()
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    trim()
    return model


def toxicity_score(spark, model: Model, text) -> F.Column:
    """The score of a column of texts: that of each text's most toxic windows; of null and empty texts, the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [shared.value.scores(texts_of(part.text)) for part in in_blocks([texts.to_frame("text")], 64)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (any columns, with text) with score and predicted: 1 if score >= threshold. Columns of docs with these names
    are replaced."""
    scored = docs.withColumn("score", toxicity_score(docs.sparkSession, model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score reaches the threshold; all columns stay."""
    return docs.where(toxicity_score(docs.sparkSession, model, F.col("text")) < threshold)
