"""Contexts: the pages that stand for what a document is about."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CANDIDATE_CAP, CONTEXT_SIZE
from ..functions import measures as me
from .relatedness import both_ways, compare, pairs_within


def date_labels(spark: SparkSession) -> DataFrame:
    """(label): "January 1" and so on, for the 366 days of a leap year."""
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d")
    return days.select(F.date_format("d", "MMMM d").alias("label"))


def date_pages(page: DataFrame, dates: DataFrame) -> DataFrame:
    """(page_id) of the pages whose title is a date: at most as many as there are dates and redirects to them."""
    return page.join(F.broadcast(dates.withColumnRenamed("label", "title")), "title", "left_semi").select(F.col("id").alias("page_id"))  # 366 rows


def dates_of(spark: SparkSession, code: str) -> DataFrame:
    """The date labels of a language."""
    return french_date_labels(spark) if code == "fr" else date_labels(spark)


#: Months in French.
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def french_date_labels(spark: SparkSession) -> DataFrame:
    days = [date(2024, 1, 1) + timedelta(i) for i in range(366)]
    return spark.createDataFrame([(f"{d.day} {FRENCH_MONTHS[d.month - 1]}",) for d in days], "label string")


def candidates(doc_labels: DataFrame, labels: DataFrame, senses: DataFrame, degrees: DataFrame, dates: DataFrame, least: float, broad: bool = False, cap: int = CANDIDATE_CAP, date_pages: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """(doc_id, page_id, weight): a document's likeliest pages. doc_labels(doc_id, label), labels(label,
    link_probability), senses(label, destination, commonness), degrees(page_id, n)."""
    own = doc_labels.select(by, "label").distinct().join(F.broadcast(dates), "label", "left_anti")  # 366 rows
    found = own.join(labels.select("label", "link_probability"), "label").join(senses.where(F.col("commonness") > least), "label").withColumnRenamed("destination", "page_id")
    if date_pages is not None:
        found = found.join(date_pages, "page_id", "left_anti")
    if broad:
        weight = me.broad_weight(F.col("commonness"), F.coalesce("_degree", F.lit(0)))
        found = found.join(degrees.select("page_id", F.col("n").alias("_degree")), "page_id", "left")
    else:
        weight = me.link_favouring_weight(F.col("link_probability"), F.col("commonness"))
        found = found.where("link_probability is not null")
    best = found.groupBy(by, "page_id").agg(F.max(weight).alias("weight"))
    return capped(best, cap, by)


def capped(rows: DataFrame, n: int, by: str = "doc_id") -> DataFrame:
    """Each document's n rows of the highest weight; of weights equal to nine digits those of smaller page ids, so that
    the order in which sums were added decides nothing."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("weight", 9)), "page_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def reranked(rows: DataFrame, compared: DataFrame, size: int = CONTEXT_SIZE, by: str = "doc_id") -> DataFrame:
    """(doc_id, page_id, weight): candidates weighed again by their mean relatedness to each other, the best of them."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    others = rows.select(by, F.col("page_id").alias("b"))
    met = rows.select(by, F.col("page_id").alias("a")).join(others, by).join(compared.select("a", "b", "mean"), ["a", "b"])
    sums = met.groupBy(by, F.col("a").alias("page_id")).agg(F.sum("mean").alias("_sum"))
    new = F.col("weight") + 4 * (F.coalesce("_sum", F.lit(0.0)) / F.col("_n")) / 5
    joined = rows.join(n, by).join(sums, [by, "page_id"], "left").select(by, "page_id", new.alias("weight"))
    return capped(joined, size, by)


def contexts(doc_labels: DataFrame, labels: DataFrame, senses: DataFrame, degrees: DataFrame, dates: DataFrame, weighted: DataFrame, sizes: DataFrame, n_articles: int, least: float, broad: bool = False, by: str = "doc_id", date_pages: DataFrame | None = None) -> DataFrame:
    """The whole way from labels to a context of each document."""
    first = candidates(doc_labels, labels, senses, degrees, dates, least, broad, date_pages=date_pages, by=by)
    return reranked(first, both_ways(compare(pairs_within(first, by), weighted, sizes, n_articles)), by=by)


def quality(context: DataFrame, by: str = "doc_id") -> DataFrame:
    return context.groupBy(by).agg(F.sum("weight").alias("quality"), F.count("*").alias("pages"))
