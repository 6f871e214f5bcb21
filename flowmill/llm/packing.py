"""Best-fit packing by exact complements."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from flowmill.llm.common import cut, fresh
from flowmill.llm.tokens import encoder, in_blocks, texts_of

SIZE = 2048


class SumIndex:
    """Which lengths add up to a sum. Pairs are indexed by their sum once, largest first; a triple is a length with the
    indexed pairs of what it leaves, so its index is that of pairs."""

    def __init__(self, lengths: list[int], most: int):
        self.lengths = np.array(sorted(lengths, reverse=True), np.int64)
        i, j = np.triu_indices(len(self.lengths))
        a, b = self.lengths[i], self.lengths[j]
        fits = a + b <= most
        a, b = a[fits], b[fits]
        order = np.lexsort((-a, a + b))
        self.a, self.b = a[order], b[order]
        self.at = np.searchsorted(self.a + self.b, np.arange(most + 2))

    def singles(self, free: np.ndarray, total: int):
        return [(total,)] if total > 0 and free[total] > 0 else []

    def pairs(self, free: np.ndarray, total: int, largest: int | None = None) -> list[tuple[int, int]]:
        """Pairs of this sum, none above largest, of lengths that are free."""
        if total < 2:
            return []
        a, b = (x[self.at[total] : self.at[total + 1]] for x in (self.a, self.b))
        ok = (free[a] > 0) & (free[b] > 0)
        if largest is not None:
            ok &= a <= largest
        return list(zip(a[ok].tolist(), b[ok].tolist()))

    def triples(self, free: np.ndarray, total: int):
        for a in self.lengths[(self.lengths <= total - 2) & (3 * self.lengths >= total)].tolist():
            if free[a] > 0:
                for pair in self.pairs(free, total - a, a):
                    yield a, *pair


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with how many sequences follow it, that use up counts (pieces per length, all of
    1..size). For lengths from the longest, the gap is looked up in the index of single lengths; then, for those that
    are left, of sums of two, then of three. A combination that fills it exactly is consumed as often as all its lengths last.
    What is left goes, longest first, to the open sequences with the smallest gap that holds it.

    It works on counts, of which there are size at most, however many pieces there are; each step uses up a length or a
    gap, so the patterns are few as well."""
    free = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        free[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(int(free[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                free[n] -= times * k
            plan.append((lengths, times))

    consume((size,))
    index = SumIndex([n for n, c in counts.items() if c and n < size], size)
    for find in (index.singles, index.pairs, index.triples):
        for n in range(size - 1, 0, -1):
            for rest in find(free, size - n) if free[n] else ():
                if not free[n]:
                    break
                consume((n, *rest))
    opened: dict[int, list[list]] = defaultdict(list)  # by gap: lengths, number of sequences
    gaps: list[int] = []
    for n in range(size, 0, -1):
        left = int(free[n])
        while left and (k := bisect.bisect_left(gaps, n)) < len(gaps):
            gap = gaps[k]
            lengths, many = opened[gap].pop()
            if not opened[gap]:
                gaps.pop(k)
            used = min(left, many)
            if many > used:
                _open(opened, gaps, gap, lengths, many - used)
            _open(opened, gaps, gap - n, (*lengths, n), used)
            left -= used
        each = size // n
        for lengths, many in (((n,) * each, left // each), ((n,) * (left % each), int(left % each > 0))):
            if many:
                _open(opened, gaps, size - n * len(lengths), lengths, many)
    return plan + [(lengths, many) for group in opened.values() for lengths, many in group]


def _open(opened: dict, gaps: list[int], gap: int, lengths: tuple[int, ...], many: int) -> None:
    if not opened[gap]:
        bisect.insort(gaps, gap)
    opened[gap].append([lengths, many])


class _Nth:
    """Numbers the pieces of each length, a frame after the other."""

    def __init__(self, size: int):
        self.seen = np.zeros(size + 1, np.int64)

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        size = len(self.seen) - 1
        if len(lengths) and not (1 <= lengths.min() and lengths.max() <= size):
            raise ValueError(f"lengths must be 1 to {size}")
        order = np.argsort(lengths, kind="stable")
        ranked = lengths[order]
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.searchsorted(ranked, ranked) + self.seen[ranked]
        self.seen += np.bincount(lengths, minlength=size + 1)
        return nth


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, with_ids: bool = False, numbered: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32 bits): each text's ids
    and end_id, cut into pieces of size if longer, with what remains first. A null text counts as empty: it is end_id
    alone. Rows that repeat a doc_id are documents of their own. Columns other than doc_id and text are not read.
    numbered adds _part and _nth, as pack() needs them."""

    def run(frames):
        nth, own = _Nth(size), TaskContext.get().partitionId()
        for pdf in in_blocks(frames):
            rows = []
            for doc, ids in zip(pdf.doc_id, encoder(path, True).encode(texts_of(pdf.text))):
                ids += int(end_id).to_bytes(4, "little")
                n = len(ids) // 4
                at = [0, *range((n - 1) % size + 1, n, size), n]
                for k, (lo, hi) in enumerate(zip(at, at[1:])):
                    part = ids[4 * lo : 4 * hi]
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            out = out.astype({"doc_id": "Int64"})
            yield out.assign(_part=own, _nth=nth(out.length.to_numpy(np.int64))) if numbered else out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + (", _part int, _nth long" if numbered else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (length: 1 to size) with sequence_id and offset: no sequence exceeds size, offsets leave no gaps. All other
    columns stay as they are; those named sequence_id or offset are replaced. An empty table gives an empty one; a length
    that is null or out of range is an error."""
    pieces = pieces.drop("sequence_id", "offset")
    part, nth = fresh(pieces.columns, "_part", "_nth")
    at = pieces.columns.index("length")

    def number(batches):
        count, own = _Nth(size), TaskContext.get().partitionId()
        for b in batches:
            length = b.column(at)
            if length.null_count:
                raise ValueError("lengths must not be null")
            of = count(length.to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(of), own, np.int32)), pa.array(of)], names=[*b.schema.names, part, nth])

    schema = StructType([*pieces.schema.fields, StructField(part, IntegerType()), StructField(nth, LongType())])
    return _placed(cut(pieces.mapInArrow(number, schema), "pieces"), part, nth, size)


def _placed(rows: DataFrame, part: str, nth: str, size: int) -> DataFrame:
    """Pieces are counted by length, the plan is made from the counts, and the nth piece of a length takes the nth place
    the plan has for it. n is its number in its partition (nth, part) plus the counts of the partitions before, so no
    length is gathered in one task."""
    columns = [c for c in rows.columns if c not in (part, nth)]
    p, l, before, at = fresh(rows.columns, "_p", "_l", "_before", "_at")
    by_part = rows.groupBy(F.col(part).alias(p), F.col("length").alias(l)).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(l).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select(p, l, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, first, base = defaultdict(list), Counter(), 0
    for lengths, many in plan_bins(counts, size):
        begin = 0
        for n in lengths:
            slots[n].append((first[n], base, begin))
            first[n] += many
            begin += n
        base += many
    slots = {n: np.array(x, np.int64).T for n, x in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        for n, where in length.groupby(length).indices.items():
            starts, bases, offsets = slots[n]
            r = rank.to_numpy()[where]
            k = np.searchsorted(starts, r, "right") - 1
            out[:, where] = bases[k] + r - starts[k], offsets[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    ranked = rows.join(by_part, (F.col(part) == F.col(p)) & (F.col("length") == F.col(l)))
    return ranked.withColumn(at, place("length", F.col(before) + F.col(nth))).select(*columns, f"{at}.sequence_id", f"{at}.offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """token_pieces packed into sequences of size, as by pack(). Pieces are numbered as they are made, in one Python step."""
    return _placed(cut(token_pieces(docs, path, end_id, size, with_ids, numbered=True), "pieces"), "_part", "_nth", size)
