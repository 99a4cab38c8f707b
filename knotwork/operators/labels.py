"""Labels: their occurrence in texts, their use as links, and their detection in documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_NGRAM_TOKENS, MIN_LINK_PROBABILITY
from ..functions.measures import link_probability
from ..functions.ngrams import candidates, counted_ngrams, filter_bits, placed_ngrams
from ..functions.text import capitalize_first, tokens, uncapitalize_first
from .ordering import numbered

#: Bits of a filter for each label, and most bits of one: 32 MB, however many labels there are.
BITS_EACH, MOST_BITS = 32, 1 << 28


def vocabulary(labels: DataFrame) -> tuple[int, object]:
    """(tokens of the longest label, filters of the labels and of their caseless forms, broadcast). The filters are made
    on the workers and have at most MOST_BITS each; what they let through meets the labels in a join."""
    row = labels.agg(F.max(F.size(tokens(F.col("label")))).alias("longest"), F.count("*").alias("n")).first()
    size = min(MOST_BITS, 1 << (BITS_EACH * max(row["n"], 32) - 1).bit_length())
    words = np.zeros((2, size >> 5), "<u4")
    set_ = filter_bits(labels, size).toArrow()  # at most a row for each word of the filters
    words[np.asarray(set_["kind"]), np.asarray(set_["word"])] = np.asarray(set_["bits"])
    return min(row["longest"] or 0, MAX_NGRAM_TOKENS), labels.sparkSession.sparkContext.broadcast(tuple(w.tobytes() for w in words))


def label_occurrences(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, n): how often each label stands in a document, as a run of tokens in a line."""
    longest, known = vocabulary(labels)
    found = counted_ngrams(docs, longest, known, id_col, text_col).withColumnRenamed("content", "label")
    return found.join(labels.select("label").distinct(), "label", "left_semi")


def label_places(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, label): where labels stand as runs of tokens in a line, as written and, if that is a label too,
    with the first letter's case turned."""
    only = labels.select("label").distinct()
    longest, known = vocabulary(only)
    found = placed_ngrams(docs, longest, known, id_col, text_col).withColumnRenamed("content", "label").join(only, "label", "left_semi")
    forms = F.array_distinct(F.array("label", capitalize_first(F.col("label")), uncapitalize_first(F.col("label"))))
    return found.select(id_col, "start", "end", F.explode(forms).alias("label")).join(only, "label", "left_semi").select(id_col, "start", "end", "label")


def occurrence_stats(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("label").agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("occurrence_doc_count"))


def label_table(links: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(label, link_count, link_doc_count, occurrence_count, occurrence_doc_count, link_probability)."""
    zero = {"occurrence_count": 0, "occurrence_doc_count": 0}
    joined = links.join(occurrences, "label", "left").fillna(zero)
    return joined.withColumn("link_probability", link_probability(F.col("link_count"), F.col("occurrence_count")))


def usable(labels: DataFrame, min_in_links: int, least: float = MIN_LINK_PROBABILITY) -> DataFrame:
    return labels.where((F.col("link_doc_count") >= min_in_links) & (F.col("link_probability") >= least))


def with_ids(labels: DataFrame) -> DataFrame:
    """Labels numbered from 1 in their order."""
    return numbered(labels, ["label"], "id")


def unshadowed(spans: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Spans (start, end, first) that end behind all spans of their keys that start before them, or are longer from
    the same start; of equal ones that at a sentence start, then the least tie."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("first"), tie).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(order)
    return spans.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def detect(docs: DataFrame, usable_labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, label, kind): the usable labels of each document, its natural, downcased and recased ones each
    without those that a longer one covers. Recased forms count only where the form as written isn't usable."""
    labels = usable_labels.select("label").distinct()
    longest, known = vocabulary(labels)
    found = candidates(docs, longest, known, id_col, text_col).withColumnRenamed("content", "label")
    found = found.join(labels, "label", "left_semi")
    # a flag and not a union of two parts, for which the texts would be read twice
    written = labels.select(F.col("label").alias("natural"), F.lit(True).alias("_written"))
    both = found.join(written, "natural", "left").where("kind <> 'recased' or _written is null").dropDuplicates([id_col, "start", "end", "label", "kind"]).withColumn("first", F.col("kind") == "downcased")
    return unshadowed(both, [id_col, "kind"], "label").select(id_col, "start", "end", "label", "kind")
