"""The surface of the engine: labelled documents, categories, excerpts and pages, for many inputs at a time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ENGLISH, LINK_CUTOFF, MIN_SENSE_SERVE, Language
from .functions.measures import topic_weight
from .operators import context as cx
from .operators import graph as gr
from .operators import linking as lk
from .operators import relatedness as rl
from .operators.labels import detect
from .storage import stored


class Graph(NamedTuple):
    """What a mined wiki knows: labels with their probabilities, those that are usable, pruned senses, links, pages."""

    labels: DataFrame
    usable: DataFrame
    senses: DataFrame
    link: DataFrame
    page: DataFrame
    weighted: DataFrame
    sizes: DataFrame
    n_articles: int
    language: Language = ENGLISH

    @staticmethod
    def of_wiki(wiki) -> Graph:
        return Graph(wiki.labels, wiki.usable, wiki.senses, wiki.link, wiki.page, *wiki.vectors, wiki.n_articles)

    def contexts(self, doc_labels: DataFrame, least: float, broad: bool = False, by: str = "doc_id") -> DataFrame:
        """Contexts of documents from their labels; neither dates nor pages of dates count."""
        dates = cx.dates_of(doc_labels.sparkSession, self.language.code)
        known = (self.labels, self.senses, gr.in_degree(self.link), dates, self.weighted, self.sizes, self.n_articles, least)
        return cx.contexts(doc_labels, *known, broad=broad, by=by, date_pages=cx.date_pages(self.page, dates))

    def against(self, pages: DataFrame, context: DataFrame, by: str = "doc_id") -> DataFrame:
        """Measures, both ways, of pages and the pages of their contexts."""
        pairs = pages.select(by, F.col("page_id").alias("x")).join(context.select(by, F.col("page_id").alias("y")), by).where("x <> y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return stored(rl.both_ways(rl.compare(pairs, self.weighted, self.sizes, self.n_articles)), "compared")


def related_categories(ids: DataFrame, graph: Graph) -> DataFrame:
    return gr.related_categories(ids, graph.page, graph.link)


def document_parts(docs: DataFrame, graph: Graph, least: float = MIN_SENSE_SERVE, ranker=None, classifier=None, context: DataFrame | None = None) -> dict[str, DataFrame]:
    """labels, context, broad_context, resolved and links of every document (doc_id, text); ``context``: of documents
    that have one from elsewhere, as pages have from their links."""
    spans = stored(detect(docs, graph.usable), "spans")
    names = spans.select("doc_id", "label").distinct()
    context = stored(graph.contexts(names, least), "context") if context is None else context
    broad = graph.contexts(names, least, broad=True)
    return {"labels": spans, "context": context, "broad_context": broad, **linked_parts(docs, spans, context, graph, least, ranker, classifier)}


def linked_parts(docs: DataFrame, spans: DataFrame, context: DataFrame, graph: Graph, least: float = MIN_SENSE_SERVE, ranker=None, classifier=None) -> dict[str, DataFrame]:
    """resolved and links from the labels' places (doc_id, start, end, label) in the documents, and their contexts."""
    good = lk.without_noise(spans, graph.senses, least)
    pages = spans.select("doc_id", "label").distinct().join(graph.senses, "label").select("doc_id", F.col("destination").alias("page_id")).distinct()
    compared = graph.against(pages, context)
    candidates = lk.sense_candidates(good, graph.senses, context, compared)
    if ranker is None:
        best = lk.best_senses(candidates, lk.linear_score(lk.SENSE_WEIGHTS))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = ranker.transform(candidates).withColumn("raw", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")
        best = lk.best_senses(scored, F.col("raw"))
    resolved = stored(lk.resolve(good, best), "resolved")
    related = rl.to_context(resolved.select("doc_id", "page_id").distinct(), context, compared)
    found = stored(lk.topics(resolved, graph.labels, docs, related, least), "topics")
    links = lk.predicted(lk.with_others(found, graph.weighted, graph.sizes, graph.n_articles), classifier)
    links = links.withColumn("weight", topic_weight(F.col("avg_link_probability"), F.col("normalized_occurrences")))
    return {"resolved": resolved, "links": links}


def label_documents(docs: DataFrame, graph: Graph, **settings) -> DataFrame:
    """(doc_id, page_id, weight, prediction, features, surface_forms): the topics of every document."""
    return document_parts(docs, graph, **settings)["links"]


def simple(links: DataFrame, page: DataFrame) -> DataFrame:
    """Links with the page as (id, title) alone, the likeliest first."""
    named = links.join(page.select(F.col("id").alias("page_id"), "title"), "page_id")
    return named.select("doc_id", F.struct(F.col("page_id").alias("id"), "title").alias("page"), "weight", "prediction", "surface_forms").orderBy("doc_id", F.desc("prediction"))


def enriched(context: DataFrame, page: DataFrame) -> DataFrame:
    return context.join(page.withColumnRenamed("id", "page_id"), "page_id")


def likely_links(links: DataFrame, cutoff: float = LINK_CUTOFF) -> DataFrame:
    return links.where(F.col("prediction") > cutoff)


def context_categories(parts: dict[str, DataFrame], graph: Graph) -> DataFrame:
    """Categories of the pages of both contexts together."""
    ids = parts["context"].select(F.col("page_id").alias("id")).unionByName(parts["broad_context"].select(F.col("page_id").alias("id"))).distinct()
    return related_categories(ids, graph)


def excerpts(ids: DataFrame, markup: DataFrame) -> DataFrame:
    """(page_id, first_paragraph): the first paragraph, else the first sentence; pages without either are left out."""
    text = F.coalesce("snippet.first_paragraph", "snippet.first_sentence")
    return markup.join(ids.select(F.col("id").alias("page_id")), "page_id", "left_semi").select("page_id", text.alias("first_paragraph")).where("first_paragraph is not null")


def page_by_id(page: DataFrame, *ids: int) -> DataFrame:
    return page.where(F.col("id").isin(*ids))


def page_by_title(page: DataFrame, *titles: str) -> DataFrame:
    return page.where(F.col("title").isin(*titles))


def links_from(link: DataFrame, *ids: int) -> DataFrame:
    return link.where(F.col("source").isin(*ids))


def links_to(link: DataFrame, *ids: int) -> DataFrame:
    return link.where(F.col("destination").isin(*ids))


def senses_of(sense: DataFrame, *labels: str) -> DataFrame:
    return sense.where(F.col("label").isin(*labels))


def known_labels(labels: DataFrame) -> DataFrame:
    """Labels that occur in a text."""
    return labels.where("occurrence_count > 0")


def with_namespace(page: DataFrame, namespace: DataFrame) -> DataFrame:
    """Pages with their namespace's casing and name: a few dozen rows, which Spark broadcasts by their size."""
    return page.join(namespace.select(F.col("id").alias("namespace_id"), "casing", F.col("name").alias("namespace")), "namespace_id")


def markup_of(markup: DataFrame, page: DataFrame, *types: int) -> DataFrame:
    """The markup of the pages of some types."""
    ids = page.where(F.col("page_type").isin(*types)).select(F.col("id").alias("page_id"))
    return markup.join(ids, "page_id", "left_semi")
