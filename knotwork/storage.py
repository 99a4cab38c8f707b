"""Folders that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this driver has written to the shared folder and not yet deleted, in order.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, a temporary
    one if all of Spark runs on this machine, else an error, as executors elsewhere couldn't read it."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def stored(df: DataFrame, kind: str = "rows") -> DataFrame:
    """The same rows, written to the shared folder and read back: no lineage, no cost when an executor is lost, and
    true sizes for the planner."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes what this driver wrote to the shared folder from place ``since`` of WRITTEN up to ``until``; by default
    all of it, for when its results are no longer read."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in WRITTEN[since:until]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del WRITTEN[since:until]


#: Most partitions that a table is dealt out to.
MOST_PIECES = 1 << 14


def pieces(df: DataFrame, each: int) -> int:
    """How many partitions hold the rows at ``each`` bytes of the files that they come from; at least as many as the
    session's shuffles have. Dealt out to so many, what a task holds doesn't grow with the table."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a leaf that isn't of files has no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // each), MOST_PIECES))


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores. A small table comes in one file or few, and
    the Python work on it would leave most cores idle; a large one is left as it is, and so is what a shuffle made."""
    plan, cores = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
