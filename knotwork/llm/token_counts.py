"""1. Token counts: the exact token count at every prefix of every text.

``prefix_counts`` adds to each row the text's prefix store: one signed 16-bit number a code point, the change of
the exact token count, deflated. ``count_at`` and ``cut_at`` answer truncation and budget questions from the store
alone, without the tokenizer. The counts come from a dynamic programme over the prefixes of each word (tokens.py).

Null and empty texts have no prefixes and count 0. Repeated rows are counted each. Columns of the input that bear
the name of a new column are replaced.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import prefixes
from .util import spread, table

VOCABULARY = "byte_bpe_50k.json"
OUT = "n_bytes long, n_tokens long, prefix_store binary, cuts array<long>"


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = ()) -> DataFrame:
    """id, n_bytes, n_tokens, prefix_store and, for each budget, the longest prefix (code points) whose exact
    token count is within it. No shuffle: one pass over the texts, bounded memory a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas = prefixes(vocabulary).deltas
        for batch in batches:
            n_bytes, n_tokens, stores, cuts = [], [], [], []
            for text in batch.column(1).to_pylist():
                d = deltas(text)
                steps = array("h", d)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                n_tokens.append(sum(steps))
                stores.append(zlib.compress(d, 1))
                cuts.append([longest_within(steps, b) for b in budgets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(stores, pa.binary()), pa.array(cuts, pa.list_(pa.int64()))], names=[id_col, "n_bytes", "n_tokens", "prefix_store", "cuts"])

    picked = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, {OUT}")


def longest_within(steps: array, budget: int) -> int:
    """Code points of the longest prefix whose exact count is at most the budget. Counts may fall, so all are seen."""
    if len(steps) <= budget // 4 or (total := sum(steps)) <= budget:
        return len(steps)
    at, n = len(steps), total
    while n > budget:
        at -= 1
        n -= steps[at]
    return at


def count_at(store: bytes, prefix: int) -> int:
    """Exact token count of the prefix of so many code points."""
    return sum(array("h", zlib.decompress(store))[:prefix])


def counts(store: bytes) -> list[int]:
    """Exact token count of every non-empty prefix."""
    return list(accumulate(array("h", zlib.decompress(store))))


def cut_at(store: bytes, budget: int) -> int:
    return longest_within(array("h", zlib.decompress(store)), budget)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_counts(table(spark, sf_dir, "documents"), budgets=(512,))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("cuts")[0].alias("cut_512"))
