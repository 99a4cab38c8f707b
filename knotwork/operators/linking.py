"""Senses of labels in context, topics of documents, and the links that they deserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_SENSE_SERVE, OTHER_TOPICS
from ..functions import measures as me
from ..functions.text import count_matches
from .context import capped
from .relatedness import MEASURES, both_ways, compare, to_context

SENSE_FEATURES = ("commonness", "in_vector", "out_vector", "in_distance", "out_distance", "context_quality")
LINK_FEATURES = ("normalized_occurrences", "max_confidence", "avg_confidence", "relatedness_to_context", "relatedness_to_others", "avg_link_probability", "max_link_probability", "first_occurrence", "last_occurrence", "spread")


def without_noise(labels: DataFrame, senses: DataFrame, least: float = MIN_SENSE_SERVE) -> DataFrame:
    """Labels with a pruned sense whose commonest is over ``least``."""
    good = senses.groupBy("label").agg(F.max("commonness").alias("c")).where(F.col("c") > least)
    return labels.join(good.select("label"), "label", "left_semi")


def softmax(score: Column, window) -> Column:
    shifted = F.exp(score - F.max(score).over(window))
    return shifted / F.sum(shifted).over(window)


def linear_score(features: dict[str, float]) -> Column:
    """A fixed linear score, for use without a trained model."""
    return sum((F.col(k) * v for k, v in features.items()), F.lit(0.0))


#: Weights of the score that stands in where no trained ranker is given.
SENSE_WEIGHTS = {"commonness": 4.0, "in_vector": 1.0, "out_vector": 1.0, "in_distance": 1.0, "out_distance": 1.0}


def sense_candidates(labels: DataFrame, senses: DataFrame, context: DataFrame, compared: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, label, page_id, features): every sense of every distinct label of a document."""
    own = labels.select(by, "label").distinct().join(senses.select("label", F.col("destination").alias("page_id"), "commonness"), "label")
    related = to_context(own.select(by, "page_id").distinct(), context, compared, by)
    qualities = context.groupBy(by).agg(F.sum("weight").alias("context_quality"))
    return own.join(related, [by, "page_id"], "left").join(qualities, by, "left").fillna(0.0, [*MEASURES, "relatedness", "context_quality"])


def faulty_groups(candidates: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, label, problem) of groups that can't be ranked: with a page twice, or without any page."""
    sized = candidates.groupBy(by, "label").agg(F.count("page_id").alias("n"), F.count_distinct("page_id").alias("k"))
    return sized.where("n = 0 or n > k").select(by, "label", F.when(F.col("n") == 0, "empty").otherwise("duplicate").alias("problem"))


def best_senses(candidates: DataFrame, score: Column, by: str = "doc_id") -> DataFrame:
    """(doc_id, label, page_id, confidence): the sense of the highest score, with its share in the softmax; a label's
    only sense has 1. Of equal ones the smallest page."""
    group = Window.partitionBy(by, "label")
    scored = candidates.withColumn("_score", score).withColumn("confidence", softmax(F.col("_score"), group))
    order = group.orderBy(F.desc(F.round("_score", 9)), "page_id")
    return scored.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(by, "label", "page_id", "confidence")


def resolve(spans: DataFrame, best: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, label, page_id, confidence): one label a position, of the highest confidence."""
    joined = spans.join(best, [by, "label"])
    order = Window.partitionBy(by, "start", "end").orderBy(F.desc(F.round("confidence", 9)), "label")
    return joined.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def topics(resolved: DataFrame, labels: DataFrame, docs: DataFrame, related: DataFrame, least: float = MIN_SENSE_SERVE, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Resolved labels rolled up by page: the features of each topic of a document but its relatedness to others."""
    probable = resolved.join(labels.where(F.col("link_probability") > least).select("label", "link_probability"), "label")
    # the text meets each distinct label once, not each span
    surfaces = probable.groupBy(by, "page_id", "label").agg(F.count("*").alias("spans"), F.max("confidence").alias("most"), F.sum("confidence").alias("sum"), F.min("start").alias("first"), F.max("start").alias("last"), F.first("link_probability").alias("p"))
    read = docs.select(by, F.col(text).alias("_text"))
    counted = surfaces.join(read, by).withColumn("matches", count_matches(F.col("_text"), F.col("label"))).withColumn("chars", F.length("_text")).drop("_text")
    rolled = counted.groupBy(by, "page_id").agg(
        F.log(F.sum(F.col("matches") * F.col("spans")) + 1).alias("normalized_occurrences"),
        F.max("most").alias("max_confidence"),
        (F.sum("sum") / F.sum("spans")).alias("avg_confidence"),
        F.avg("p").alias("avg_link_probability"),
        F.max("p").alias("max_link_probability"),
        (F.min("first") / F.max("chars")).alias("first_occurrence"),
        (F.max("last") / F.max("chars")).alias("last_occurrence"),
        F.array_sort(F.collect_list("label")).alias("surface_forms"),
    )
    rolled = rolled.withColumn("spread", F.col("last_occurrence") - F.col("first_occurrence"))
    named = related.select(by, "page_id", F.col("relatedness").alias("relatedness_to_context"))
    return rolled.join(named, [by, "page_id"], "left").fillna(0.0, ["relatedness_to_context"])


def other_topics(found: DataFrame, top: int = OTHER_TOPICS, by: str = "doc_id") -> DataFrame:
    """(doc_id, page_id, weight): the document's heaviest topics."""
    return capped(found.select(by, "page_id", me.topic_weight(F.col("avg_link_probability"), F.col("normalized_occurrences")).alias("weight")), top, by)


def with_others(found: DataFrame, weighted: DataFrame, sizes: DataFrame, n_articles: int, by: str = "doc_id") -> DataFrame:
    """Adds relatedness_to_others: to the document's heaviest topics."""
    heavy = other_topics(found, by=by)
    pairs = found.select(by, F.col("page_id").alias("x")).join(heavy.select(by, F.col("page_id").alias("y")), by).where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    related = to_context(found.select(by, "page_id"), heavy, both_ways(compare(pairs, weighted, sizes, n_articles)), by)
    return found.join(related.select(by, "page_id", F.col("relatedness").alias("relatedness_to_others")), [by, "page_id"])


#: Weights of the score that stands in where no trained link classifier is given.
LINK_WEIGHTS = {"avg_link_probability": 3.0, "relatedness_to_context": 2.0, "relatedness_to_others": 2.0, "avg_confidence": 1.0, "normalized_occurrences": 0.5}


def predicted(found: DataFrame, model=None) -> DataFrame:
    """Adds prediction, the probability that the topic deserves a link."""
    if model is None:
        return found.withColumn("prediction", me.sigmoid(linear_score(LINK_WEIGHTS) - 3.0))
    from pyspark.ml.functions import vector_to_array

    return model.transform(found).withColumn("prediction", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")
