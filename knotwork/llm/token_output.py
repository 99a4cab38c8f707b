"""10. Token-ID / binary output: ORC files in ascending id order.

``write_token_ids`` range-partitions the texts by id, encodes each partition in order and writes its ids with
Spark's ORC writer: integer run-length encoding, row indexes, Bloom filters on the document id. Every row also
bears its shard, its place there and its number of ids, nearly free under run-length encoding. Readers split files by stripe, and
a filter on the document id prunes files and stripes by their statistics and Bloom filters.

``read_token_ids`` reads the files back and gives each document its place in the whole token stream: sums by shard,
a running sum over the few shard rows, and one inside each shard. A shard is one range partition, so a window over
a shard is as large as one task's work, and so is the table of shards as the number of tasks.

Null and empty texts are documents of the end id alone. Null ids come first. Rows with equal ids stand together,
in the order of their texts' hashes; repeated rows are all written. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .util import new_path, table

VOCABULARY = "word_bpe_49k.json"
#: Documents between two entries of the row index, and bytes of a stripe.
ROW_INDEX, STRIPE = 2000, 16 << 20


def write_token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 1) -> None:
    """Writes (shard, place, id, n_tokens, ids array<int>) in ascending order of the id, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, place = encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes(), 0
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                raw = [ids(t) + end for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n)), part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["shard", "place", id_col, "n_tokens", "ids"])
                place += n

    picked = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    picked = picked.withColumn("tie", F.xxhash64("text"))
    dealt = picked.repartitionByRange(id_col, "tie").sortWithinPartitions(id_col, "tie").drop("tie")
    kind = picked.schema[id_col].dataType.simpleString()
    rows = dealt.mapInArrow(run, f"shard int, place long, `{id_col}` {kind}, n_tokens int, ids array<int>")
    rows.write.mode("overwrite").option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", ROW_INDEX).option("orc.stripe.size", STRIPE).option("orc.create.index", "true").option("compression", "zstd").orc(path)


def read_token_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, values = np.asarray(lists.offsets), memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "place", id_col, "n_tokens", "ids_crc32"])

    files = spark.read.orc(path).select("shard", "place", id_col, "ids")
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.mapInArrow(run, f"shard int, place long, `{id_col}` {kind}, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("shard").orderBy("place")
    rows = rows.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    # reads two columns of integers, and no ids
    sums = spark.read.orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(bases, "shard").select(id_col, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return read_token_ids(spark, path)
