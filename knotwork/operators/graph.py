"""Degrees, adjacency, label senses and categories of a link graph: link(source, destination, anchor_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARTICLE, CATEGORY, MAX_CATEGORIES
from ..functions.measures import category_score
from ..storage import pieces


#: Bytes of edges, as Spark expects them, that one task tells apart.
EDGES = 1 << 22


def edges_of(link: DataFrame) -> DataFrame:
    """Distinct (source, destination), each once: dealt out by both, so that a hub is no one task's, to as many tasks as
    the edges' size asks for. What a task holds doesn't grow with the table."""
    edge = link.select("source", "destination")
    return edge.repartition(pieces(edge, EDGES), "source", "destination").distinct()


def in_degree(link: DataFrame) -> DataFrame:
    """(page_id, n): distinct pages that link to each."""
    return edges_of(link).groupBy(F.col("destination").alias("page_id")).agg(F.count("source").alias("n"))


def out_degree(link: DataFrame) -> DataFrame:
    return edges_of(link).groupBy(F.col("source").alias("page_id")).agg(F.count("destination").alias("n"))


def n_pages(link: DataFrame, by: str, name: str = "n") -> DataFrame:
    """One row: how many pages stand on that side of a link."""
    return link.select(by).distinct().agg(F.count("*").alias(name))


def adjacency(link: DataFrame, by: str = "destination") -> DataFrame:
    """(page_id, links): sorted neighbours with repeats. One row holds one page's list."""
    other = "source" if by == "destination" else "destination"
    return link.groupBy(F.col(by).alias("page_id")).agg(F.sort_array(F.collect_list(other)).alias("links"))


def multiplicities(link: DataFrame) -> DataFrame:
    """(dir, page_id, link, cnt, most): how often each neighbour is linked, and the page's largest such count."""
    arms = F.explode(F.array(F.struct(F.lit("in").alias("dir"), F.col("destination").alias("page_id"), F.col("source").alias("link")), F.struct(F.lit("out").alias("dir"), F.col("source").alias("page_id"), F.col("destination").alias("link"))))
    counted = link.select(arms.alias("x")).select("x.*").groupBy("dir", "page_id", "link").agg(F.count("*").alias("cnt"))
    # a join, not a window: a hub's neighbours need not meet in one task
    return counted.join(counted.groupBy("dir", "page_id").agg(F.max("cnt").alias("most")), ["dir", "page_id"])


def top_linked(link: DataFrame, n: int) -> DataFrame:
    return in_degree(link).orderBy(F.desc("n"), "page_id").limit(n)


def anchor_stats(link: DataFrame, anchor_pages: DataFrame, anchor: Column) -> DataFrame:
    """(label, link_count, link_doc_count) over links to the given pages (id)."""
    own = link.join(anchor_pages.select(F.col("id").alias("destination")), "destination", "left_semi")
    own = own.select(anchor.alias("label"), "source").where("label <> ''")
    return own.groupBy("label").agg(F.count("*").alias("link_count"), F.count_distinct("source").alias("link_doc_count"))


def sense_counts(link: DataFrame, anchor: Column) -> DataFrame:
    """(label, destination, n)."""
    return link.select(anchor.alias("label"), "destination").where("label <> ''").groupBy("label", "destination").agg(F.count("*").alias("n"))


def commonness(senses: DataFrame, least: float = 0.0) -> DataFrame:
    """Senses whose share of their label's links is over ``least``, with their share among those that are left."""
    total = senses.groupBy("label").agg(F.sum("n").alias("_total"))
    kept = senses.join(total, "label").where(F.col("n") / F.col("_total") > least).drop("_total")
    left = kept.groupBy("label").agg(F.sum("n").alias("_left"))
    return kept.join(left, "label").withColumn("commonness", F.col("n") / F.col("_left")).drop("_left")


def commonest(senses: DataFrame) -> DataFrame:
    """(label, destination, commonness, n_senses) of the commonest sense; of equal ones the smallest page."""
    best = F.max(F.struct("n", (-F.col("destination")).alias("m"), "destination"))
    out = senses.groupBy("label").agg(best.alias("b"), F.sum("n").alias("total"), F.count("*").alias("n_senses"))
    return out.select("label", F.col("b.destination").alias("destination"), (F.col("b.n") / F.col("total")).alias("commonness"), "n_senses")


def ambiguous(senses: DataFrame, least: float) -> DataFrame:
    """Labels with two pruned senses or more of which the commonest doesn't take nearly all."""
    return commonest(commonness(senses, least)).where((F.col("n_senses") >= 2) & (F.col("commonness") <= 1 - least))


def related_categories(ids: DataFrame, page: DataFrame, link: DataFrame, limit: int = MAX_CATEGORIES) -> DataFrame:
    """(category_id, title, score, frequency) of the categories that the articles among ``ids`` (id) link to most."""
    inputs = ids.select("id").distinct().join(page.where(F.col("page_type") == ARTICLE).select("id"), "id", "left_semi")
    total = inputs.agg(F.count("*").alias("n_inputs"))
    found = link.join(inputs.withColumnRenamed("id", "source"), "source", "left_semi").groupBy(F.col("destination").alias("id")).agg(F.count("*").alias("frequency"))
    scored = found.join(page.where(F.col("page_type") == CATEGORY).select("id", "title"), "id").join(F.broadcast(total))  # one row
    scored = scored.withColumn("score", category_score(F.col("frequency"), F.col("n_inputs")))
    return scored.orderBy(F.desc("score"), "id").limit(limit).select(F.col("id").alias("category_id"), "title", "score", "frequency")
