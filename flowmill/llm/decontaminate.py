"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from flowmill.llm.common import cut, fresh

#: Words that make a window, unless the share of its item that counts (COVERAGE) is fewer.
WINDOW, COVERAGE = 10, 1.0
#: Words of the items in one automaton, which every Python worker holds; some 100 MB. More items make more automata, and as
#: many passes over the documents.
WORDS = 250_000
#: Longer items are cut into pieces of so many words, which overlap by a window less one, so no window is lost.
PIECE = 20_000
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
#: Lower case for A to Z, a space for every byte that is no part of a word; bytes of other letters stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
FOUND = (
    StructType().add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))
    .add("spans", ArrayType(StructType().add("start", "long").add("end", "long")))
)


def words_of(text: bytes):
    """Lists of a text's normalised words (UTF-8), a stretch of the text at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and _PLAIN[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_PLAIN).split()
        at = end


class Automaton:
    """The generalised suffix automaton of sequences of word numbers: its states are the classes of their runs that end at
    the same places, each reached by one step for one more word. windows(state) has, by number of words, the items with
    a window of that many words in the state's class."""

    def __init__(self):
        self.step, self.link, self.size = [{}], [-1], [0]
        self.windows: dict[int, dict[int, set]] = {}

    def _copy(self, of: int, size: int) -> int:
        self.step.append(dict(self.step[of]))
        self.link.append(self.link[of])
        self.size.append(size)
        return len(self.size) - 1

    def _divide(self, p: int, word: int) -> int:
        """The state that word leads to from p, taken apart if it stands for longer runs too."""
        q = self.step[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        c = self._copy(q, self.size[p] + 1)
        self.link[q] = c
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.step[last]:
                last = self._divide(last, word)
                continue
            self.step.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            new, p = len(self.size) - 1, last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._divide(p, word)
            last = new

    def mark(self, sequence: list[int], window: int, item) -> None:
        """Notes every window of the sequence, which was added, at its state."""
        v, length = 0, 0
        for word in sequence:
            v, length = self.step[v][word], length + 1
            while self.size[self.link[v]] >= window:
                v = self.link[v]
            length = min(length, self.size[v])
            if length >= window:
                self.windows.setdefault(v, {}).setdefault(window, set()).add(item)

    def close(self) -> None:
        """near: of each state the first on its way of links, itself included, that has windows; -1 if none."""
        self.near = [-1] * len(self.size)
        for v in sorted(range(len(self.size)), key=self.size.__getitem__):
            self.near[v] = v if v in self.windows else self.near[self.link[v]] if v else -1


class Index(NamedTuple):
    """vocabulary: numbers of the items' words; shortest: words of the shortest window."""

    vocabulary: dict[bytes, int]
    automaton: Automaton
    shortest: int


def index_of(items) -> Index:
    """The index of items: (item, words of a window, normalised words)."""
    vocabulary: dict[bytes, int] = {}
    kept = [(item, window, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for item, window, words in items if words]
    a = Automaton()
    for _, _, s in kept:
        a.add(s)
    for item, window, s in kept:
        a.mark(s, window, item)
    a.close()
    return Index(vocabulary, a, min((w for _, w, _ in kept), default=1))


def scan(text: bytes, index: Index) -> tuple[int, int, set, list[list[int]]]:
    """Number of words of a text, how many of them a window hits, the items it holds windows of, and the stretches of hit
    words (first, behind the last). The words stream through the automaton, which keeps the longest run of items that
    ends at each; words that no item has, and stretches between them that are shorter than any window, are passed over."""
    vocabulary, a, shortest = index
    step, link, size, near, windows = a.step, a.link, a.size, a.near, a.windows
    at, v, length, items, spans = 0, 0, 0, set(), []
    for words in words_of(text):
        known = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known >= 0, [0]]).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if begin:
                v = length = 0
            if end - begin + length < shortest and end < len(words):
                continue
            for k, word in enumerate(known[begin:end].tolist(), at + begin + 1):
                while v and word not in step[v]:
                    v = link[v]
                    length = size[v]
                v = step[v].get(word, 0)
                length = length + 1 if v else 0
                u, longest = near[v], 0
                while u > 0:
                    for n, who in windows[u].items():
                        if n <= length:
                            items |= who
                            longest = max(longest, n)
                    u = near[link[u]]
                if longest:
                    first = k - longest
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first:
                        spans[-1][1] = k
                    else:
                        spans.append([first, k])
        if len(words) and known[-1] < 0:
            v = length = 0
        at += len(words)
    return at, sum(e - b for b, e in spans), items, spans


def window_of(n: int, window: int, coverage: float) -> int:
    return max(1, min(window, math.ceil(coverage * n)))


def pieces(items: DataFrame, id_col: str, text_col: str, window: int, coverage: float) -> DataFrame:
    """The items' words: item (its id as text), window, words (UTF-8, between spaces), n; long items in pieces. Items without
    words and those without an id are left out."""

    def run(batches):
        for b in batches:
            out = []
            for who, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w for part in words_of(text or b"") for w in part]
                size = window_of(len(words), window, coverage)
                for at in range(0, max(len(words) - size + 1, 1) if words else 0, PIECE):
                    own = words[at : at + PIECE + size - 1]
                    out.append((who, size, b" ".join(own), len(own)))
            names = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(names, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["item", "window", "words", "n"])

    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary")).where("i is not null")
    return rows.mapInArrow(run, "item string, window long, words binary, n long")


def _scanned(rows: DataFrame, index, rest: list[str]) -> DataFrame:
    """rows (text first, as binary, then rest) with FOUND in place of the text; index: a broadcast one."""

    def run(batches):
        for b in batches:
            got = [scan(t or b"", index.value) for t in b.column(0).to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())), pa.array([[{"start": x, "end": y} for x, y in g[3]] for g in got], span)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *new], [*rest, "n_words", "n_hit", "items", "spans"])

    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in rest), *FOUND.fields])
    return rows.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, words: int = WORDS) -> DataFrame:
    """A row for each of docs: the columns in keep, n_words, n_hit, items (ids as text, each once, sorted) and spans (hit words,
    numbered from 0: first, behind the last).

    A word is hit if it lies in a run of words that an item has too, of window words or of the share coverage of the item's
    words, whichever is fewer. Words are runs of digits, a to z and characters beyond ASCII, after A to Z are lower-cased.
    Null and empty texts have no words; repeated rows are rows of their own; items that share an id are one; items
    without an id or words hit nothing. Texts are read in stretches, whatever their length.

    The items are parted by hash into automata of about as many words as the argument words says, so what is broadcast is
    bounded; with more than one, documents get a number and are scanned by each, and what was hit is put together again."""
    spark = docs.sparkSession
    parts = cut(pieces(items, item_col, item_text, window, coverage), "items")
    total = parts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // words))
    of = F.pmod(F.xxhash64("item", "words"), F.lit(shards))

    def index(k: int):
        own = parts.where(of == k).select("item", "window", "words").orderBy("item", "words").collect()
        return spark.sparkContext.broadcast(index_of((r.item, r.window, bytes(r.words).split()) for r in own))

    (mine,) = fresh(docs.columns, "_text")
    if shards == 1:
        rows = docs.select(F.col(text_col).cast("binary").alias(mine), *keep)
        return _scanned(rows, index(0), keep).select(*keep, "n_words", "n_hit", "items", "spans")
    (number,) = fresh(docs.columns, "_number")
    rows = cut(docs.select(F.col(text_col).cast("binary").alias(mine), *keep).withColumn(number, F.monotonically_increasing_id()), "numbered")
    first = cut(_scanned(rows, index(0), [*keep, number]), "scanned")
    hits = first.where("n_hit > 0").select(number, "items", "spans")
    for k in range(1, shards):
        hits = hits.unionByName(cut(_scanned(rows.select(mine, number), index(k), [number]).where("n_hit > 0").select(number, "items", "spans"), "scanned"))
    g = hits.groupBy(F.col(number).alias("_n")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    last = lambda a: F.element_at(a, -1)
    span = "array<struct<start:long,end:long>>"
    grown = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
    joined = F.aggregate("s", F.array().cast(span), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), grown(a, x)).otherwise(F.concat(a, F.array(x))).cast(span))
    g = g.withColumn("s", joined)
    out = first.drop("items", "spans", "n_hit").join(g, F.col(number) == F.col("_n"), "left").withColumn("spans", F.coalesce("s", F.array().cast(span)))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(*keep, "n_words", hit.alias("n_hit"), F.coalesce("i", F.array().cast("array<string>")).alias("items"), "spans")


def without(text: bytes, spans) -> bytes:
    """text without the words of the spans and what stands between them; what follows a span's last word stays."""
    plain, out, at, k, n = text.translate(_PLAIN), [], 0, 0, 0
    for begin, end in spans:
        edge = []
        for wanted in (begin, end - 1):
            while n <= wanted:  # the place of word number wanted
                while plain[k] == 32:
                    k += 1
                start = k
                k = plain.find(b" ", k)
                k, n = len(plain) if k < 0 else k, n + 1
            edge.append(start)
        out.append(text[at : edge[0]])
        at = k
    return b"".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, items: DataFrame, most: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """docs without what find_contamination hits: spans are taken out of texts, and rows of whose words a share above most is
    hit go altogether. n_chars, where docs has it, follows; other columns and rows stay as they are."""
    (mine,) = fresh(docs.columns, "_row")
    found = find_contamination(docs.withColumn(mine, F.struct("*")), items, [mine], text_col, **how)
    left = found.where(F.col("n_hit") <= most * F.col("n_words")).select(f"{mine}.*", F.struct("n_hit", "spans").alias(mine))

    @F.pandas_udf("binary")
    def trim(text, where):
        return pd.Series([None if t is None else t if not len(s) else without(bytes(t), [(x["start"], x["end"]) for x in s]) for t, s in zip(text, where)], dtype=object)

    some = F.col(mine)["n_hit"] > 0
    left = left.withColumn(text_col, F.when(some, trim(F.col(text_col).cast("binary"), F.col(mine)["spans"]).cast("string")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(some, F.char_length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)
