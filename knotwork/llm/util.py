"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, spread, stored

__all__ = ["cut", "dealt_groups", "looked_up", "new_path", "numbered", "partitions", "shared_dir", "spread", "stored", "table"]

#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: no lineage, and no executor's loss costs them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under names of their own, so that no column can clash with an operator's."""
    return df.toDF(*(f"_k{i}" for i in range(len(df.columns))))


def dealt_groups(rows: DataFrame, keys: list[str], by: Column, limit: int) -> DataFrame:
    """Rows of groups that are compared pair by pair, with ``slice``, ``lo`` and ``hi``, so that no task needs a whole
    hot group: a group of over ``limit`` rows falls into slices by the hash of ``by``, and each row goes to the
    sub-groups (lo, hi) of its slice with every other. Any two rows of a group meet in a sub-group."""
    sizes = rows.groupBy(keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    big = stored(sizes.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_m")), "groups")
    out = rows.join(big, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    out = out.withColumn("slice", F.pmod(F.xxhash64(by), F.col("_m")).cast("int"))
    out = out.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return out.withColumns({"lo": F.least("slice", "_t"), "hi": F.greatest("slice", "_t")}).drop("_t", "_m")


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows joined with ``known``, a stored table of one row for each key, whose column ``count`` says how many rows bear
    it and is left out. Rows of hot keys meet it by broadcast, as there are fewer than HOT_KEYS of them however large the
    tables are, so none of their tasks is longer than others; the rest meet it by Spark's own choice."""
    total = known.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_KEYS > F.lit(total)
    hot = known.where(is_hot)
    near = rows.join(F.broadcast(hot.drop(count)), keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return near.unionByName(rest.join(known.where(~is_hot).drop(count), keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
