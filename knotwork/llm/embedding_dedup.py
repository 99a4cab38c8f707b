"""8. Embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c or more are at a squared distance of at most 2 - 2c. A rotation (two rounds of random signs
and a Hadamard transform, so every row comes out the same wherever it is computed) spreads the differences evenly;
the rotated vector is split into blocks, and each block has its share of the squared distance, in proportion to its
dimensions. By the pigeonhole principle two near vectors are within the budget of at least one block.

Each block is a range join: the block's first coordinate falls into slabs as wide as the budget's root, a vector is at
home in its slab and a guest of the next, and slabs that hold many vectors fall into slices (util.dealt_groups). In a
task, homes and guests are sorted by that coordinate, compared in windows by their block's distances, and what is
within the budget is verified exactly: cosine in double precision, from the vectors as they came. A pair that several
blocks find counts in the first of them, so the union needs no shuffle of pairs. A task gives back each vector's
number of links and a spanning forest, never the pairs; components.py joins the forests.

Equal vectors of a label are one row from the start, with their number, so a group of copies of any size costs no
more than one vector; its rows learn their class by broadcast if they are many (util.looked_up). A vector travels
whole to each of its slabs, as it is verified there: fetching it for the candidates alone would move pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing and are kept. Vectors of different dimensions don't link. Repeated rows are copies of each other. Null ids get
rows too and never name a component, unless none of its rows has an id; such a row isn't kept.

At 64 dimensions and 0.93 a block's budget is wide against the vectors' spread, so slabs part little of a label, and
the work within a label still grows with the square of its distinct vectors, at about a nanosecond a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .util import dealt_groups, looked_up, partitions, stored, table

THRESHOLD = 0.93
#: Dimensions of a block, vectors of a slab's slice, rows and candidates that are compared at a time, and what the
#: budgets allow for rounding.
BLOCK, SLICE, WINDOW, CANDIDATES, SLACK = 16, 8192, 512, 1 << 16, 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotate(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Orthogonal, by additions of whole columns only: a row's result doesn't depend on the others."""
    n, dim = x.shape
    size = 1 << max(0, dim - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :dim] = x
    rng = np.random.default_rng(seed)
    for _ in range(2):
        out = out * rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = out.reshape(n, size // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        out = out / np.sqrt(size)
    return out


def blocks_of(dim: int, block: int = BLOCK) -> list[slice]:
    size = 1 << max(0, dim - 1).bit_length()
    return [slice(a, min(a + block, size)) for a in range(0, size, block)]


def budgets(dim: int, threshold: float, block: int = BLOCK) -> np.ndarray:
    """Squared distance that each block may have; they sum to that of the threshold."""
    found = blocks_of(dim, block)
    sizes = np.array([b.stop - b.start for b in found], float)
    return (2 - 2 * threshold) * sizes / sizes.sum()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dim)


class Side:
    def __init__(self, node: np.ndarray, weight: np.ndarray, raw: np.ndarray, block: int):
        self.rotated = rotate(unit(raw))
        self.part = blocks_of(raw.shape[1])[block]
        order = np.argsort(self.rotated[:, self.part.start], kind="stable")
        self.node, self.weight, self.raw, self.rotated = node[order], weight[order], raw[order], self.rotated[order]
        self.near = self.rotated[:, self.part]
        self.first, self.square = self.near[:, 0], (self.near**2).sum(1)
        scaled = self.raw / np.abs(self.raw).max(1, keepdims=True)
        self.scaled, self.norm = scaled, np.sqrt((scaled * scaled).sum(1))


def linked(x: Side, y: Side, block: int, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers in x and y of all links that this block is the first to find; ``own``: x is y, each pair once."""
    dim = x.raw.shape[1]
    allowed, parts = budgets(dim, threshold), blocks_of(dim)
    reach = np.sqrt(allowed[block]) + SLACK
    for a in range(0, len(x.node), WINDOW):
        rows = slice(a, min(a + WINDOW, len(x.node)))
        low = np.searchsorted(y.first, x.first[rows.start] - reach, "left")
        high = np.searchsorted(y.first, x.first[rows.stop - 1] + reach, "right")
        for c in range(max(low, a) if own else low, high, 8 * WINDOW):
            columns = slice(c, min(c + 8 * WINDOW, high))
            distance = x.square[rows, None] + y.square[None, columns] - 2 * x.near[rows] @ y.near[columns].T
            i, j = np.nonzero(distance <= allowed[block] + SLACK)
            i, j = i + rows.start, j + columns.start
            if own:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CANDIDATES):
                p, q = i[k : k + CANDIDATES], j[k : k + CANDIDATES]
                apart = (x.rotated[p] - y.rotated[q]) ** 2
                within = np.stack([apart[:, s].sum(1) <= b + 1e-9 for s, b in zip(parts, allowed)], axis=1)
                mine = within[:, block] & (within.argmax(1) == block)
                p, q = p[mine], q[mine]
                cosine = (x.scaled[p] * y.scaled[q]).sum(1) / (x.norm[p] * y.norm[q])
                yield p[cosine >= threshold], q[cosine >= threshold]


def compare(node: np.ndarray, weight: np.ndarray, raw: np.ndarray, guest: np.ndarray, part: np.ndarray, block: int, threshold: float, lo: int, hi: int) -> tuple[list, list, list]:
    """Of one sub-group: (node, None, its links to others' copies) and (node, node it hangs from, None)."""
    sides = {(g, s): Side(node[m], weight[m], raw[m], block) for g in (False, True) for s in {lo, hi} if (m := (guest == g) & (part == s)).any()}
    meet = [((False, lo), (False, hi)), ((True, lo), (False, hi))] + ([((True, hi), (False, lo))] if lo != hi else [])
    places = {}
    for s in sides.values():
        for n in s.node.tolist():
            places.setdefault(n, len(places))
    nodes = np.fromiter(places, np.int64, len(places))
    root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for p, q in meet:
        if p not in sides or q not in sides:
            continue
        x, y = sides[p], sides[q]
        at_x = np.fromiter((places[n] for n in x.node.tolist()), np.int64)
        at_y = np.fromiter((places[n] for n in y.node.tolist()), np.int64)
        for i, j in linked(x, y, block, threshold, p == q):
            a, b = at_x[i], at_y[j]
            links += np.bincount(a, y.weight[j], len(nodes)).astype(np.int64) + np.bincount(b, x.weight[i], len(nodes)).astype(np.int64)
            while len(open_ := np.flatnonzero(root[a] != root[b])):
                a, b = a[open_], b[open_]
                u, v = root[a], root[b]
                np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
                while not np.array_equal(jumped := root[root], root):
                    root = jumped
    some, hangs = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(nodes)))
    return [*nodes[some], *nodes[hangs]], [*[None] * len(some), *nodes[root[hangs]]], [*links[some], *[None] * len(hangs)]


def spanning_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links) from nodes (node, label, embedding, n): a spanning link a-b, or a's number of links."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                dims = np.asarray(part.column("dim"))
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    turned, allowed = rotate(unit(matrix(part.column("embedding").take(pa.array(rows)), dim))), budgets(dim, threshold)
                    slabs = np.stack([np.floor(turned[:, s.start] / (np.sqrt(b) + 2 * SLACK)) for s, b in zip(blocks_of(dim), allowed)], axis=1).astype(np.int64)
                    n = slabs.shape[1]
                    block, guest = np.tile(np.repeat(np.arange(n, dtype=np.int32), 2), len(rows)), np.tile(np.array([False, True]), n * len(rows))
                    out = part.take(pa.array(np.repeat(rows, 2 * n)))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block), pa.array(np.repeat(slabs.ravel(), 2) + guest), pa.array(guest)], names=[*names, "block", "slab", "guest"])

    names = ["node", "label", "n", "dim", "embedding"]
    picked = nodes.withColumn("dim", F.size("embedding")).select(names)
    dealt = picked.mapInArrow(deal, f"node long, label {kinds['label']}, n long, dim int, embedding {kinds['embedding']}, block int, slab long, guest boolean")
    keys = ["label", "dim", "block", "slab"]
    order = [*keys, "lo", "hi"]
    groups = dealt_groups(dealt, keys, F.col("node"), SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            node, weight, guest, part = (np.asarray(rows.column(x).to_numpy(zero_copy_only=False)) for x in ("node", "n", "guest", "slice"))
            dim, block, lo, hi = (rows.column(x)[0].as_py() for x in ("dim", "block", "lo", "hi"))
            a, b, links = compare(node, weight, matrix(rows.column("embedding"), dim), guest, part, block, threshold, lo, hi)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

        last = None
        for batch in batches:
            keyed = list(zip(*(batch.column(x).to_pylist() for x in order)))
            start = 0
            for i, key in enumerate(keyed):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield close()
                    held.clear()
                    start, last = i, key
            held.append(batch.slice(start))
        if held:
            yield close()

    arranged = groups.repartition(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return arranged.mapInArrow(run, "a long, b long, links long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    if isinstance(rows.schema["embedding"].dataType.elementType, (T.IntegralType, T.DecimalType)):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = rows.where("sound").groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = stored(spanning_links(nodes, threshold), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = stored(nodes.select("node", "least").join(components(found.where("b is not null").select("a", "b")), "node"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("named"), F.count("*").alias("size")), "least")
    named = looked_up(rooted.select("node", "root"), least, ["root"], "size").select("node", "named")
    known = nodes.join(links, "node", "left").join(named, "node", "left")
    known = known.select("label", "embedding", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("named", "least").alias("component_id"))
    linked = looked_up(rows.where("sound").select("id", "label", "embedding"), stored(known, "known"), ["label", "embedding"], "n")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
s AS MATERIALIZED (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
k AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, k.b FROM reach r JOIN k ON k.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM k WHERE a = v.vec_id)::BIGINT AS n_links, c.least AS component_id, v.vec_id = c.least AS kept FROM v JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
