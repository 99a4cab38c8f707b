"""7. Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are the sources' token shares to the power of an exponent from 0 (uniform) to 1 (as they are), normalised.
The exponent is found by bisection: the smallest whose most repeated source stays within ``max_repeats`` epochs, or
the largest whose weights still have ``target_entropy`` (nats). All the midpoints that the next halvings may ask for
are evaluated in one aggregate over the table of sources, so the driver sees a few rows a round, however many sources
there are, and a job serves five halvings.

A source's budget is its weight's share of the tokens asked for; by default so many that the least repeated source
is used exactly once, so nothing is lost. The budget gives whole epochs, and one more that breaks off: its documents
stand in a permutation by a keyed hash, cut into blocks; sums by block, a running sum over the blocks, and one inside
the single block in which the budget runs out give the last hash that is still in. Texts never move: each document
compares its own hash with its source's.

Null and empty texts have no tokens. A null source is a source. Sources without tokens are used once, as they are.
Equal rows have equal hashes and are in or out together. An empty table stays empty. Columns that aren't named are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .util import numbered, spread, stored, table

VOCABULARY, MAX_REPEATS, SEED = "byte_bpe_50k.json", 1.5, 7
#: Halvings that one aggregate serves, rounds, documents of a block of the permutation, about, and most blocks of one.
HALVINGS, ROUNDS, BLOCK, BLOCKS = 5, 6, 4096, 1 << 18


def token_counts(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary).ids
        for batch in batches:
            n = [len(ids(t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    picked = spread(df.select(*keep, F.col(text_col).cast("string").alias("_text")))
    return picked.mapInArrow(run, ", ".join(f"`{x}` {picked.schema[x].dataType.simpleString()}" for x in keep) + ", n_tokens long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def measures(sources: DataFrame, exponents: list[float], budget: int | None) -> list[tuple[float, float]]:
    """For each exponent, (epochs of the most repeated source, entropy of the weights)."""
    total = float(sources.agg(F.sum("tokens")).first()[0])
    tried = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(exponents))))
    shares = sources.select((F.col("tokens") / F.lit(total)).alias("p"), tried.alias("x")).select("x.i", F.pow("p", F.col("x.e")).alias("raw"), F.pow("p", F.col("x.e") - 1).alias("ratio"))
    rows = shares.groupBy("i").agg(F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("h"), F.max("ratio").alias("most"), F.min("ratio").alias("least"))
    found = sorted(rows.collect())  # a row for each exponent
    return [(r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / total, math.log(r["z"]) - r["h"] / r["z"]) for r in found]


def exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> float:
    """By bisection. A larger exponent repeats less and has less entropy: the least that keeps the limit of repeats, or
    the greatest that keeps the entropy. If even 1 breaks the limit, or even 0 misses the entropy: that end."""
    by_entropy, steps = target_entropy is not None, 1 << HALVINGS

    def small_enough(found: tuple[float, float]) -> bool:
        """Whether the exponent sought isn't below this one."""
        return found[1] >= target_entropy - 1e-12 if by_entropy else found[0] > max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    for number in range(ROUNDS):
        midpoints = [low + (high - low) * i / steps for i in range(steps + 1)]
        found = measures(sources, midpoints, budget)
        if number == 0 and not small_enough(found[0]):
            return low
        if number == 0 and small_enough(found[-1]):
            return high
        a, b = 0, steps
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if small_enough(found[middle]) else (a, middle)
        low, high = midpoints[a], midpoints[b]
    return low if by_entropy else high


def plan(counted: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """From (key, n_tokens, h): for each source its weight, budget, whole epochs and the last hash of the partial one."""
    sources = stored(counted.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    full = sources.where("tokens > 0")
    if full.isEmpty():
        return sources.select("key", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("epochs"), F.lit(None).cast("long").alias("last"))
    e = exponent(full, max_repeats, target_entropy, budget)
    total = float(full.agg(F.sum("tokens")).first()[0])
    raw = F.pow(F.col("tokens") / F.lit(total), F.lit(e))
    z, least = full.agg(F.sum(raw), F.max(F.col("tokens") / raw)).first()
    asked = float(least) * z if budget is None else float(budget)
    weight = F.when(F.col("tokens") > 0, raw / F.lit(z)).otherwise(0.0)
    sources = sources.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * asked).cast("long"))
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1))
    sources = sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0))
    sources = stored(sources.withColumn("blocks", F.least(F.ceil(F.col("docs") / BLOCK), F.lit(BLOCKS))), "weights")
    ranked = counted.join(sources.where("rest > 0").select("key", "epochs", "rest", "blocks"), "key").withColumn("u", place("epochs", "h", seed))
    ranked = ranked.withColumn("block", F.floor(F.col("u") / F.lit(float(1 << 62)) * F.col("blocks"))).select("key", "block", "u", "n_tokens", "rest")
    before = Window.partitionBy("key").orderBy("block")
    sums = ranked.groupBy("key", "block").agg(F.sum("n_tokens").alias("n"))
    edge = sums.withColumn("before", F.sum("n").over(before) - F.col("n"))
    edge = edge.join(sources.select("key", "rest"), "key").where("before < rest").groupBy("key").agg(F.max(F.struct("block", "before")).alias("x")).select("key", "x.block", "x.before")
    inside = ranked.join(edge, ["key", "block"]).groupBy("key", "u", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy("key").orderBy("u")) - F.col("n")
    last = inside.withColumn("start", start).where("start < rest").groupBy("key").agg(F.max("u").alias("last"))
    return stored(sources.join(last, "key", "left").select("key", "weight", "budget", "epochs", "last"), "mixture")


def place(epoch: str, h: str, seed: int) -> Column:
    """A document's place in an epoch's permutation, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(epoch).cast("long"), F.col(h)), 2)


def with_copies(docs: DataFrame, mixture: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each use of each document, with ``epoch`` from 0, and ``weight`` and ``budget`` of its source."""
    rows = docs.join(mixture, "key")
    more = (F.col("last").isNotNull() & (place("epochs", "h", seed) <= F.col("last"))).cast("int")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), (F.col("epochs") + more).cast("int")))).where("epoch > 0").withColumn("epoch", F.col("epoch") - 1)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """id, source, n_tokens, weight, budget, epoch and place: a row for each use; sorted by source, epoch and place
    they are the permutations."""
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), source_key(F.col(source_col)).alias("key"), F.xxhash64(id_col, text_col, source_col).alias("h"))
    counted = stored(token_counts(own, ["id", "source", "key", "h"], "text", vocabulary), "tokens")
    used = with_copies(counted, plan(counted.select("key", "n_tokens", "h"), max_repeats, target_entropy, budget, seed), seed)
    return used.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", "budget", "epoch", place("epoch", "h", seed).alias("place"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture uses it: at least once."""
    own = numbered(docs)
    at = {c: own.columns[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    marked = own.withColumn("key", source_key(F.col(at["source"]))).withColumn("h", F.xxhash64(at["doc_id"], at["text"], at["source"]))
    counted = stored(token_counts(marked, ["key", "h"], at["text"]), "tokens")
    return with_copies(marked, plan(counted)).select(own.columns).toDF(*docs.columns)
