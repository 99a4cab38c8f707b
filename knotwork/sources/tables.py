"""Tables on disk: explicit schemas, first-wins and last-wins writes, exports and the ledger of phases."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of the engine.
SCHEMAS = {
    "phase": "id INT, description STRING, start_ts LONG, end_ts LONG, state STRING",
    "log": "log_level STRING, ts LONG, message STRING",
    "configuration": "id STRING, data STRING",
    "namespace": "id INT, casing STRING, name STRING",
    "page": "id LONG, namespace_id INT, page_type INT, last_edited LONG, markup_size INT, title STRING, redirect_target STRING",
    "markup": "page_id LONG, wikitext STRING, snippet STRUCT<first_paragraph: STRING, first_sentence: STRING>, text STRING, links ARRAY<STRUCT<target: STRING, anchor_text: STRING, left: INT, right: INT>>, list_items INT",
    "last_transclusion_count": "name STRING, n LONG",
    "title_to_page": "title STRING, page_id LONG",
    "link": "source LONG, destination LONG, anchor_text STRING",
    "dead_link": "source LONG, destination STRING, anchor_text STRING",
    "label": "label STRING, id LONG, occurrence_count LONG, occurrence_doc_count LONG, link_count LONG, link_doc_count LONG",
    "sense": "label STRING, destination LONG, n LONG",
    "link_source_count": "page_id LONG, n LONG",
    "link_destination_count": "page_id LONG, n LONG",
    "link_sample": "group_name STRING, id LONG",
    "sample": "group_name STRING, id LONG",
    "sense_training_context_page": "source LONG, page_id LONG, weight DOUBLE",
    "link_training_context": "source LONG, group_name STRING, quality DOUBLE, pages LONG",
    "link_training_context_page": "source LONG, page_id LONG, weight DOUBLE",
    "link_training_example": "source LONG, page_id LONG, normalized_occurrences DOUBLE, max_confidence DOUBLE, avg_confidence DOUBLE, relatedness_to_context DOUBLE, relatedness_to_others DOUBLE, avg_link_probability DOUBLE, max_link_probability DOUBLE, first_occurrence DOUBLE, last_occurrence DOUBLE, spread DOUBLE, is_valid_link BOOLEAN",
    "sense_training_example": "source LONG, label STRING, link_destination LONG, page_id LONG, commonness DOUBLE, in_vector DOUBLE, out_vector DOUBLE, in_distance DOUBLE, out_distance DOUBLE, quality DOUBLE, is_correct BOOLEAN",
}


class Tables:
    """A folder of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(self.at(name))

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at(name)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def write(self, name: str, rows: DataFrame, compression: str = "zstd") -> DataFrame:
        """Replaces the table; columns as its schema has them."""
        if name in SCHEMAS:
            schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
            rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        rows.write.mode("overwrite").option("compression", compression).parquet(self.at(name))
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.at(name))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the first along ``order``: rows that come later with a key that is taken are ignored."""
    return one_each(rows, key, F.min_by, order)


def one_each(rows: DataFrame, key: list[str], best, order: str) -> DataFrame:
    """By an aggregate, which is begun before rows move, so that a key's rows needn't meet; null orders come first."""
    picked = rows.groupBy(*key).agg(best(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_row"))
    return picked.select("_row.*")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the last along ``order``: later rows replace earlier ones."""
    return one_each(rows, key, F.max_by, order)


def max_id(*tables: DataFrame, key: str = "page_id") -> int:
    return max((t.agg(F.coalesce(F.max(key), F.lit(0))).first()[0] for t in tables), default=0)


def in_range(rows: DataFrame, start: int, end: int, key: str = "page_id") -> DataFrame:
    return rows.where((F.col(key) >= start) & (F.col(key) < end))


#: The headers of exported training groups, by the columns that they name.
SENSE_HEADER = {"link_destination": "linkDestination", "commonness": "commonness", "in_vector": "inLinkVectorMeasure", "out_vector": "outLinkVectorMeasure", "in_distance": "inLinkGoogleMeasure", "out_distance": "outLinkGoogleMeasure", "quality": "contextQuality", "is_correct": "isCorrectSense"}
LINK_HEADER = {
    "normalized_occurrences": "normalizedOccurrences", "max_confidence": "maxDisambigConfidence", "avg_confidence": "avgDisambigConfidence", "relatedness_to_context": "relatednessToContext", "relatedness_to_others": "relatednessToOtherTopics",
    "avg_link_probability": "avgLinkProbability", "max_link_probability": "maxLinkProbability", "first_occurrence": "firstOccurrence", "last_occurrence": "lastOccurrence", "spread": "spread", "is_valid_link": "isValidLink",
}


def export_csv(rows: DataFrame, path: str, code: str, group: str, header: dict[str, str] | None = None) -> str:
    """One training group as a folder of CSV files with a header, named wiki_<code>_<group>; ``header``: the columns
    to write and their names there."""
    out = f"{path.rstrip('/')}/wiki_{code}_{group}"
    rows = rows.select(*(F.col(c).alias(n) for c, n in header.items())) if header else rows
    rows.write.mode("overwrite").option("header", True).csv(out)
    return out


def name_of_export(path: str) -> str:
    """wiki_<code>_<group> of an exported group, without its folder and suffix: models are named by it."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]


def without_occurrences(labels: DataFrame) -> DataFrame:
    """Labels as they are before their occurrences are counted (again)."""
    zero = F.lit(0).cast("long")
    return labels.withColumn("occurrence_count", zero).withColumn("occurrence_doc_count", zero)


def shrunk(markup: DataFrame) -> DataFrame:
    """Markup rows of which only the snippets are left."""
    return markup.select("page_id", F.lit(None).cast("string").alias("wikitext"), "snippet", F.lit("").alias("text"), F.array().cast(markup.schema["links"].dataType).alias("links"), F.lit(0).alias("list_items"))


class Ledger:
    """Which phases have begun and ended; each state is a row, and the latest counts."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def put(self, phase: int, state: str, description: str) -> None:
        now = int(time.time() * 1000)
        row = [(phase, description, now, now if state == "COMPLETED" else None, state)]
        self.tables.append("phase", self.tables.spark.createDataFrame(row, SCHEMAS["phase"]).coalesce(1))

    def state(self, phase: int) -> str | None:
        if not self.tables.has("phase"):
            return None
        rows = self.tables.read("phase").where(F.col("id") == phase).orderBy(F.desc("start_ts"), F.desc_nulls_last("end_ts")).limit(1).collect()
        return rows[0]["state"] if rows else None


class Log:
    def __init__(self, tables: Tables):
        self.tables = tables

    def write(self, level: str, message: str) -> None:
        self.tables.append("log", self.tables.spark.createDataFrame([(level, int(time.time() * 1000), message)], SCHEMAS["log"]).coalesce(1))

    def since(self, ts: int) -> DataFrame:
        return self.tables.read("log").where(F.col("ts") >= ts).orderBy("ts")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
