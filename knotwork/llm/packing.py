"""4. Best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the whole instance, however many documents there are, is a
count for each length. That histogram, at most ``capacity`` rows, is all that the driver sees. ``plan`` solves it:

1. Dominance: take the longest open length L with rest r = capacity - L. If nothing fits in the rest, {L} is fixed;
   if the longest length k that fits fills the rest, or no two items fit there together, {L, k} dominates every
   other set with L and is fixed; so does {L, a, b} that fills the rest while no three items fit there, a is the
   longest that fits, and no two items longer than b fit together. Fixing shrinks the instance and is repeated, in
   multiples of equal items.
2. The remainder is packed by best fit decreasing, again in multiples: open bins are kept by their free space.

The plan is a table of runs, a few for each length: bounded by the capacity, not by the documents. Each piece finds
its run by its rank among the pieces of its length. Ranks are local counts, taken while encoding, plus a running sum
over tasks; the pieces are cut from their lineage first, so that both passes see the same ranks.

Null texts are empty: one piece, the end id alone. Repeated rows are packed each. Longer documents than the capacity
are cut into full pieces, the first of which may be shorter. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .util import cut, spread, table

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
PIECE = "piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece, with the encoding task's number and the piece's rank there among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, task = encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = memoryview(ids(text) + end)
                n, at, i = len(raw) // 4, 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    doc.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    nth.append(seen[size])
                    seen[size] += 1
                    at, i, size = at + size, i + 1, capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth, pa.int64())], names=[id_col, *(x.split()[0] for x in PIECE.split(", "))])

    picked = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, {PIECE}")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that provably dominate, with how many of each, and what is left of the instance."""
    left, fixed = {k: n for k, n in counts.items() if n}, []
    sizes = sorted(left)

    def take(*items: int) -> None:
        need = {x: items.count(x) for x in items}
        n = min(left[x] // c for x, c in need.items())
        if n:
            fixed.append((items, n))
        for x, c in need.items():
            left[x] -= n * c
            if not left[x]:
                del left[x]
                sizes.remove(x)

    def enough(*items: int) -> bool:
        return all(left.get(x, 0) >= items.count(x) for x in items)

    at = len(sizes) - 1
    while at >= 0:
        if at >= len(sizes):
            at = len(sizes) - 1
            continue
        big = sizes[at]
        rest = capacity - big
        if rest < sizes[0]:
            take(big)
        elif enough(big, k := sizes[bisect_left(sizes, rest + 1) - 1]) and (k == rest or k == sizes[0] and left[k] == 1 + (big == k) or rest < least(sizes, left, 2, big)):
            take(big, k)
        elif rest < least(sizes, left, 3, big) and (pair := filling(sizes, left, rest, big)):
            take(big, *pair)
        else:
            at -= 1
            continue
        at = min(at, len(sizes) - 1)
    return fixed, left


def least(sizes: list[int], left: dict[int, int], n: int, without: int) -> float:
    """Sum of the n smallest items besides one of the given size."""
    total = 0
    for x in sizes:
        take = min(n, left[x] - (x == without))
        total += take * x
        n -= take
        if not n:
            return total
    return float("inf")


def filling(sizes: list[int], left: dict[int, int], rest: int, without: int) -> tuple[int, int] | None:
    """The longest item that fits in the rest and one that fills it, if they cover whatever one or two items fit: a
    single one is no longer than the first, and of two the shorter is no longer than the second."""
    spare = lambda x: left.get(x, 0) - (x == without)
    a = next((x for x in reversed(sizes[: bisect_left(sizes, rest + 1)]) if spare(x)), rest)
    b = rest - a
    if not 0 < b <= a or spare(b) < 1 + (a == b) or least(sizes[bisect_left(sizes, b + 1) :], left, 2, without) <= rest:
        return None
    return a, b


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing in multiples: kinds of bins as runs (length, how many), and how many bins of each kind."""
    free: list[int] = []  # free spaces of open kinds, sorted
    bins: dict[int, list[tuple[tuple, int]]] = {}

    def put(kind: tuple, space: int, n: int) -> None:
        if space not in bins:
            bins[space] = []
            insort(free, space)
        bins[space].append((kind, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(free, size)
            if k == len(free):
                each, space, kind, m = capacity // size, capacity, (), -(-n // (capacity // size))
            else:
                space = free[k]
                kind, m = bins[space].pop()
                each = space // size
                if not bins[space]:
                    del bins[space]
                    free.pop(k)
            full = min(m, n // each)
            if full:
                put((*kind, (size, each)), space - each * size, full)
                n -= full * each
            if m > full and n:
                some = min(n, each)
                put((*kind, (size, some)), space - some * size, 1)
                n -= some
                full += 1
            if m > full and kind:
                put(kind, space, m - full)
    return [x for kinds in bins.values() for x in kinds]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """For each length its runs (first rank, items a bin, first bin, offset), by first rank; and the bins in all."""
    fixed, rest = reduce_dominated(counts, capacity)
    kinds = [(tuple((x, 1) for x in items), n) for items, n in fixed] + best_fit(rest, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for kind, n in kinds:
        offset = 0
        for size, each in kind:
            runs.setdefault(size, []).append((used.get(size, 0), each, bins, offset))
            used[size] = used.get(size, 0) + n * each
            offset += size * each
        bins += n
    return {k: np.array(v, np.int64) for k, v in runs.items()}, bins


def pack(cut_pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces() that are cut from their lineage."""
    groups = cut_pieces.groupBy("task", "length").agg(F.max("nth").alias("last"))
    before = Window.partitionBy("length").orderBy("task")
    groups = cut(groups.select("task", "length", (F.col("last") + 1).alias("n"), (F.sum(F.col("last") + 1).over(before) - F.col("last") - 1).alias("base")))
    counts = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                first, each, bins, off = runs[int(length[at[0]])].T
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                seq[at] = bins[k] + inside // each[k]
                offset[at] = off[k] + inside % each[k] * length[at]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = cut_pieces.join(groups.select("task", "length", "base"), ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    kind = cut_pieces.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(pieces(docs, id_col, text_col, vocabulary, end_id, capacity)), id_col, capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
