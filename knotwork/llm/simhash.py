"""9. SimHash near-dedup by bit-sliced comparison.

Fingerprints: one pass over the texts; a bit is set if it is set in over half of the hashes of all four-word
shingles, repeats included. From here on only distinct fingerprints move, with the smallest id that bears each, so a
group of exact copies of any size is one row. Rows learn their component by the fingerprint, and fingerprints by their
component's name; keys with a large part of all rows meet these by broadcast (util.looked_up).

Candidates: fingerprints that differ in at most ``radius`` bits agree in one whole choice of blocks, if 64 bits are
cut into ``radius`` + 1 blocks or more (``key_plan``: more and longer keys for more fingerprints; nothing is lost).
Fingerprints that share a key stand side by side in a long sequence, whose 64 bit planes are stored vertically, 64
fingerprints a word. A plane XOR the same plane moved by ``lag`` places gives one bit of the distances of all pairs
at that lag; carry-save counters add up the planes by bitwise operations, and words in which every pair has passed
the radius, or is of different keys, are given up after every eight planes. Keys with many fingerprints fall into
slices whose pairs are compared in tasks of their own (util.dealt_groups).

A task gives back a spanning forest of the links in each sequence, never all pairs; components.py joins them.

Null and empty texts, and those without words, have the fingerprint zero and are linked like any other. Repeated rows
each get a row. Null ids get a component too and never name one, unless no row of the component has an id. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tokens import forget
from .util import dealt_groups, looked_up, numbered, partitions, spread, stored, table
from .words import raw_texts

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Distinct fingerprints that are compared in one sequence of a hot key at most, twice over; and the size of a key's
#: group that the plan of blocks aims at.
SLICE, GROUP = 4096, 4096
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Words of a plane, over all lags worked on at a time.
WORK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, and only ASCII blanks part
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:n - 1] + 1])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[shingle - 1 :][at : at + CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """id, the columns ``keep`` and ``fp``: the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in raw_texts(batch.column(batch.num_columns - 1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*names, "fp"])

    names = [id_col, *keep]
    picked = spread(df.select(*(F.col(x) for x in names), F.col(text_col).cast("string").alias("_text")))
    return picked.mapInArrow(run, ", ".join(f"`{x}` {picked.schema[x].dataType.simpleString()}" for x in names) + ", fp long")


def key_plan(n: int, radius: int = RADIUS, group: int = GROUP) -> list[int]:
    """Masks of the key bits: for every choice of as many of ``blocks`` blocks as ``radius`` differences leave whole.
    The fewest blocks whose keys would part n evenly spread fingerprints into groups of about ``group``."""
    for blocks in range(radius + 1, radius + 5):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:])]
        keys = [sum(c) for c in combinations(masks, blocks - radius)]
        if n <= group << min(k.bit_count() for k in keys):
            break
    return keys


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Planes:
    """The bit planes of a sequence of fingerprints, 64 of them a word."""

    def __init__(self, fps: np.ndarray):
        self.n, self.words = len(fps), -(-len(fps) // 64)
        padded = np.zeros(self.words * 64, "<u8")
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
        self.planes = np.pad(planes, ((0, 0), (0, 1)))  # a word behind the last

    def links(self, at: np.ndarray, lag: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (i, i + lag) within the radius, of the lanes ``wanted`` of the words ``at``, each word with
        a lag of its own. Radius below 8: three counter planes and one that keeps the overflow."""
        left, word, bit = wanted, at + lag // 64, (lag % 64).astype(np.uint64)
        c0, c1, c2, over = (np.zeros(len(at), np.uint64) for _ in range(4))
        for p in range(0, 64, 8):
            rest = np.uint64(63) - bit
            for plane in self.planes[p : p + 8]:
                # the word whose lane i is the place lag after lane i
                moved = plane[word] >> bit | (plane[word + 1] << rest) << np.uint64(1)
                x = plane[at] ^ moved
                c0, x = c0 ^ x, c0 & x
                c1, x = c1 ^ x, c1 & x
                c2, x = c2 ^ x, c2 & x
                over |= x
            left = left & ~(over | beyond(c0, c1, c2, radius))
            alive = np.flatnonzero(left)
            if len(alive) < len(at):
                at, lag, left, word, bit, c0, c1, c2, over = (x[alive] for x in (at, lag, left, word, bit, c0, c1, c2, over))
                if not len(at):
                    break
        row, lane = np.nonzero(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = at[row] * 64 + lane
        return i, i + lag[row]


def beyond(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is over the radius."""
    out = np.zeros_like(c0)
    for value in range(radius + 1, 8):
        out |= (c0 if value & 1 else ~c0) & (c1 if value & 2 else ~c1) & (c2 if value & 4 else ~c2)
    return out


def forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and those, at other places of the same group, that they hang from: a spanning forest of all links
    within groups. ``group`` numbers the runs of equal keys of the sequence."""
    n = len(fps)
    root = np.arange(n)
    planes = Planes(fps)
    rest = np.zeros(planes.words * 64, np.int64)  # how many of its group stand behind each
    rest[:n] = np.searchsorted(group, group, "right") - 1 - root
    rest = rest.reshape(-1, 64)
    most, lag = rest.max(1, initial=0), 1
    while len(words := np.flatnonzero(most >= lag)):
        lags = np.arange(lag, min(lag + max(1, WORK // len(words)), int(most.max()) + 1))
        wanted = np.packbits(rest[words][None] >= lags[:, None, None], axis=2, bitorder="little").view("<u8").reshape(-1)
        some = np.flatnonzero(wanted)
        i, j = planes.links(np.tile(words, len(lags))[some], np.repeat(lags, len(words))[some], wanted[some], radius)
        while len(open_ := np.flatnonzero(root[i] != root[j])):
            i, j = i[open_], j[open_]
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # each root hooks to the first it is linked with
            while not np.array_equal(jumped := root[root], root):
                root = jumped
        lag = int(lags[-1]) + 1
    hangs = np.flatnonzero(root != np.arange(n))
    return fps[hangs], fps[root[hangs]]


def spanning_links(distinct: DataFrame, radius: int = RADIUS, plan: list[int] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that span every group of near ones."""
    plan = plan or key_plan(distinct.count(), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for k, m in enumerate(plan))))
    rows = distinct.select("fp", keys.alias("x")).select("fp", "x.k", "x.key")
    rows = dealt_groups(rows, ["k", "key"], F.col("fp"), SLICE).drop("slice")
    order = ["k", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def compare(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*parts)]
            new = np.zeros(len(columns[0]), bool)
            for c in columns[1:]:
                new[1:] |= c[1:] != c[:-1]
            a, b = forest(columns[0].view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for start in range(0, len(batch), 16 * SLICE):
                got = [np.asarray(c) for c in batch.slice(start, 16 * SLICE).columns]
                held.append(got)
                last = [c[-1] for c in got[1:]]
                ends = np.flatnonzero(np.any([c != x for c, x in zip(got[1:], last)], axis=0))
                if len(ends):  # all but the last group are whole
                    cut = int(ends[-1]) + 1
                    held[-1] = [c[:cut] for c in got]
                    yield compare(held)
                    held = [[c[cut:] for c in got]]
        if held:
            yield compare(held)

    dealt = rows.select("fp", *order).repartition(partitions(distinct.sparkSession), *order).sortWithinPartitions(*order, "fp")
    return dealt.mapInArrow(run, "a long, b long")


def classes(found: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, n, root, component_id) of every distinct fingerprint in ``found`` (id, fp): ``n`` rows bear it, ``root``
    names the component, ``component_id`` is its smallest id."""
    distinct = stored(found.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "fingerprints")
    linked = components(spanning_links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(linked, "fp"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "least")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return alone.unionByName(looked_up(rooted.select("fp", "n", "root"), least, ["root"], "size"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = stored(fingerprints(df, id_col, text_col), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    known = stored(classes(found, id_col, radius).select("fp", "n", "component_id"), "classes")
    return looked_up(found, known, ["fp"], "n").select(id_col, hexed.alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id; of several rows with that id, the one whose columns
    hash lowest; of equal rows, one."""
    own = numbered(docs)
    key = own.columns[docs.columns.index("doc_id")]
    text = own.columns[docs.columns.index("text")]
    marked = own.withColumn("_h", F.xxhash64(*own.columns))
    found = stored(fingerprints(marked, key, text, ("_h",)), "fingerprints")
    first = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("id"), F.col("_h").alias("h"))
    best = found.groupBy("fp").agg(F.min(first).alias("x"))  # copies meet as one row of each task
    keep = best.join(classes(found, key), "fp").groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.id").alias("_id"), F.col("x.h").alias("_hash"))
    kept = marked.join(keep, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates([key, "_h"]).select(own.columns).toDF(*docs.columns)
