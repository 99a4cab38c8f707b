"""Label occurrences of documents that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.labels import label_occurrences
from ..storage import new_path, stored


def stream_occurrences(spark: SparkSession, path: str, schema: T.StructType, labels: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """Reads what is there as a stream, appends each batch's (doc_id, label, n) to a table in the shared folder and
    gives the table. The sink is idempotent: a batch that runs again replaces its own folder."""
    out, known = new_path(spark, "stream"), stored(labels.select("label").distinct(), "labels")

    def sink(batch: DataFrame, number: int) -> None:
        label_occurrences(batch, known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    # a table is a folder of files or a single file; a stream's source is a pattern of files
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(f"{path.rsplit('/', 1)[0]}/{path.rsplit('/', 1)[1]}*")
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
