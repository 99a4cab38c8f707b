"""Titles, redirects and the resolution of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARTICLE, CATEGORY, DISAMBIGUATION, MAX_REDIRECTS, NAMESPACES, REDIRECT, TEMPLATE, UNHANDLED, UNPARSEABLE
from ..functions import text as tx
from ..storage import stored


def page_type(namespace: Column, redirect: Column, last: Column, names: tuple[str, ...]) -> Column:
    """The type of a page from its namespace, redirect target and last transclusion."""
    main = F.when(F.coalesce(tx.is_disambiguation(last, names), F.lit(False)), DISAMBIGUATION).otherwise(ARTICLE)
    return (
        F.when(redirect.isNotNull(), REDIRECT)
        .when(namespace == NAMESPACES["CATEGORY"], CATEGORY)
        .when(namespace == NAMESPACES["TEMPLATE"], TEMPLATE)
        .when(namespace == NAMESPACES["MAIN"], main)
        .otherwise(UNHANDLED)
    )


def resolve_redirects(page: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From page(id, page_type, title, redirect_target): (title, page_id, hops) of every redirect that leads to an
    ordinary page within the limit, and the redirects (id, title, redirect_target) that don't. An ordinary page wins
    over a redirect of its title; of several redirects of a title the smallest id counts."""
    plain = page.where(~F.col("page_type").isin(REDIRECT, UNPARSEABLE)).groupBy("title").agg(F.min("id").alias("page_id"))
    redirects = page.where(F.col("page_type") == REDIRECT).select("id", "title", "redirect_target")
    step = redirects.groupBy("title").agg(F.min_by("redirect_target", "id").alias("at"))
    ends = plain.withColumnRenamed("title", "at")
    now = stored(step.join(ends, "at", "left").select("title", "at", "page_id", F.lit(1).alias("hops")), "redirects")
    for _ in range((MAX_REDIRECTS - 1).bit_length()):  # each round doubles the reach
        more = now.select(F.col("title").alias("at"), F.col("at").alias("next"), F.col("page_id").alias("end"), F.col("hops").alias("more"))
        rest = now.where("page_id is null").join(more, "at").select("title", F.col("next").alias("at"), F.col("end").alias("page_id"), (F.col("hops") + F.col("more")).alias("hops"))
        now = stored(now.where("page_id is not null").unionByName(rest), "redirects")
    found = now.where((F.col("page_id").isNotNull()) & (F.col("hops") < MAX_REDIRECTS)).select("title", "page_id", "hops")
    found = found.join(plain.select("title"), "title", "left_anti")
    return found, redirects.join(found.select("title"), "title", "left_anti").join(plain.select("title"), "title", "left_anti")


def title_map(page: DataFrame) -> DataFrame:
    """(title, page_id) of all ordinary pages and resolvable redirects."""
    plain = page.where(~F.col("page_type").isin(REDIRECT, UNPARSEABLE)).groupBy("title").agg(F.min("id").alias("page_id"))
    return plain.unionByName(resolve_redirects(page)[0].select("title", "page_id")).distinct()


def located(raw: DataFrame, titles: DataFrame, prefix: str = ":en:", category: str = "Category") -> DataFrame:
    """raw(source, target, anchor_text) with destination: null if the title is unknown or the page itself."""
    keys = titles.groupBy(F.lower("title").alias("key")).agg(F.min("page_id").alias("page_id"))
    joined = raw.withColumn("key", tx.key_from_target(F.col("target"), prefix, category)).join(keys, "key", "left")
    destination = F.when(F.col("page_id") != F.col("source"), F.col("page_id"))
    return joined.select("source", "target", tx.anchor_or_original(F.col("anchor_text"), prefix).alias("anchor_text"), destination.alias("destination"))


def resolved_links(found: DataFrame) -> DataFrame:
    return found.where("destination is not null").select("source", "destination", "anchor_text")


def dead_links(found: DataFrame) -> DataFrame:
    return found.where("destination is null").select("source", F.col("target").alias("destination"), "anchor_text")


def above_average(counts: DataFrame) -> DataFrame:
    """Rows whose n is above the mean of all (one row, broadcast)."""
    return counts.join(F.broadcast(counts.agg(F.avg("n").alias("mean_n")))).where("n > mean_n").drop("mean_n")
