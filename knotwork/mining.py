"""From a dump to the tables of the engine, in seven phases that can stop and resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Graph, document_parts, markup_of
from .config import ARTICLE, DANGLING_REDIRECT, DISAMBIGUATION, ENGLISH, MIN_SENSE_TRAIN, REDIRECT, Language
from .functions import text as tx
from .functions.wikitext import parsed
from .operators import context as cx
from .operators import graph as gr
from .operators import labels as lb
from .operators import relatedness as rl
from .operators import titles as tt
from .operators import training as tr
from .sources.dump import read_pages, site_info, unparseable, unseen_namespaces
from .sources.tables import LINK_HEADER, SENSE_HEADER, Ledger, Tables, export_csv, first_wins


class Mine:
    def __init__(self, spark: SparkSession, dump: str, path: str, language: Language = ENGLISH):
        self.spark, self.dump, self.language = spark, dump, language
        self.tables = Tables(spark, path)
        self.ledger = Ledger(self.tables)

    @staticmethod
    def opened(spark: SparkSession, path: str) -> Mine:
        """A wiki that was mined before, with the language that it was mined with."""
        tables = Tables(spark, path)
        rows = tables.read("configuration").where("id = 'language'").collect() if tables.has("configuration") else []
        if not rows:
            raise ValueError(f"no configuration is stored in {tables.path}")
        return Mine(spark, "", path, Language.restored(rows[0]["data"]))

    def pages(self) -> None:
        """1. Pages, markup and transclusion counts of the dump."""
        t = self.tables
        config = self.spark.createDataFrame([("language", self.language.stored())], "id string, data string")
        t.write("configuration", config.coalesce(1))
        header = site_info(self.spark, self.dump)
        rows = first_wins(read_pages(self.spark, self.dump, self.language), ["id"], "last_edited")
        found = parsed(rows.select("id", "wikitext"))
        markup = t.write("markup", found.withColumnRenamed("id", "page_id"))
        t.write("page", unparseable(rows, markup.withColumnRenamed("page_id", "id")))
        t.write("namespace", header.unionByName(unseen_namespaces(t.read("page"), header)))
        last = rows.select(tx.last_transclusion(F.col("wikitext")).alias("name")).where("name is not null")
        t.write("last_transclusion_count", last.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name"))

    def titles(self) -> None:
        """2. Titles with their redirects resolved; redirects that lead nowhere get their type."""
        page = self.tables.read("page")
        self.tables.write("title_to_page", tt.title_map(page))
        lost = tt.resolve_redirects(page)[1].select("id").withColumn("_lost", F.lit(True))
        kind = F.when(F.col("_lost") & (F.col("page_type") == REDIRECT), DANGLING_REDIRECT).otherwise(F.col("page_type"))
        self.tables.write("typed_page", page.join(lost, "id", "left").withColumn("page_type", kind).drop("_lost"))

    def links(self) -> None:
        """3. Links between pages, and those that lead nowhere."""
        names = self.tables.read("namespace").where("id = 14").select("name").collect()
        raw = self.tables.read("markup").select(F.col("page_id").alias("source"), F.explode("links").alias("x")).select("source", "x.target", "x.anchor_text")
        found = tt.located(raw, self.tables.read("title_to_page"), self.language.wiki_prefix, names[0]["name"] if names else self.language.category_name)
        self.tables.write("link", tt.resolved_links(found))
        self.tables.write("dead_link", tt.dead_links(found))

    @property
    def page(self) -> DataFrame:
        return self.tables.read("typed_page")

    def labels(self) -> None:
        """4. Labels by their use as links."""
        anchors = self.page.where(F.col("page_type").isin(ARTICLE, DISAMBIGUATION)).select("id")
        self.tables.write("anchor", gr.anchor_stats(self.tables.read("link"), anchors, tx.clean_anchor(F.col("anchor_text"), self.language.wiki_prefix)))

    def occurrences(self) -> None:
        """5. Labels by their occurrence in the text of articles and disambiguation pages."""
        texts = markup_of(self.tables.read("markup"), self.page, ARTICLE, DISAMBIGUATION)
        anchors = self.tables.read("anchor")
        stats = lb.occurrence_stats(lb.label_occurrences(texts, anchors, "page_id"))
        self.tables.write("label", lb.with_ids(lb.label_table(anchors, stats)))

    def senses(self) -> None:
        """6. Senses of labels and degrees of pages."""
        link = self.tables.read("link")
        anchor = tx.clean_anchor(F.col("anchor_text"), self.language.wiki_prefix)
        self.tables.write("sense", gr.sense_counts(link, anchor).join(self.tables.read("label").select("label"), "label", "left_semi"))
        self.tables.write("link_source_count", gr.in_degree(link))
        self.tables.write("link_destination_count", gr.out_degree(link))

    def graph(self, least: float) -> Graph:
        t, link, page = self.tables, self.tables.read("link"), self.page
        labels = t.read("label").withColumn("link_probability", F.when(F.col("occurrence_count") > 0, F.least(F.col("link_count") / F.col("occurrence_count"), F.lit(1.0))))
        n = page.where(F.col("page_type") == ARTICLE).count()
        return Graph(labels, lb.usable(labels, self.language.profile.min_in_links), gr.commonness(t.read("sense"), least), link, page, *rl.vectors(link, n), n, self.language)

    def sampled(self, groups: tuple[tuple[str, int], ...], graph: Graph, but: DataFrame | None = None) -> DataFrame:
        """(group_name, id) of eligible articles, without those of ``but`` (id)."""
        texts = self.tables.read("markup").select(F.col("page_id").alias("id"), "text", "wikitext", "list_items")
        ids = tr.eligible(self.page, graph.link, texts, self.language.profile)
        return tr.disjoint_samples(ids if but is None else ids.join(but, "id", "left_anti"), groups)

    def own_contexts(self, links: DataFrame, graph: Graph) -> DataFrame:
        """(source, page_id, weight): contexts of pages from the usable labels among their own links' texts."""
        own = links.select("source", F.col("anchor_text").alias("label")).distinct().join(graph.usable.select("label"), "label", "left_semi")
        return graph.contexts(own, MIN_SENSE_TRAIN, by="source")

    def export(self, rows: DataFrame, samples: DataFrame, header: dict[str, str]) -> None:
        for name in [r[0] for r in samples.select("group_name").distinct().collect()]:  # the profile's groups
            ids = samples.where(F.col("group_name") == name).select(F.col("id").alias("source"))
            export_csv(rows.join(ids, "source", "left_semi"), f"{self.tables.path}/csv", self.language.code, name, header)

    def used_pages(self) -> DataFrame:
        """(id): the articles of all groups of word-sense examples."""
        return self.tables.read("sample").select("id").distinct()

    def training(self) -> None:
        """7. Word-sense examples of sampled articles."""
        g, t = self.graph(MIN_SENSE_TRAIN), self.tables
        samples = t.write("sample", self.sampled(self.language.profile.disambiguator_groups, g))
        links = g.link.join(samples.select(F.col("id").alias("source")), "source", "left_semi")
        context = t.write("sense_training_context_page", self.own_contexts(links, g))
        pages = links.select("source", F.col("anchor_text").alias("label")).distinct().join(g.senses, "label").select("source", F.col("destination").alias("page_id")).distinct()
        related = rl.to_context(pages, context, g.against(pages, context, "source"), "source")
        out = t.write("sense_training_example", tr.sense_examples(links, g.senses, related, cx.quality(context, "source"), MIN_SENSE_TRAIN))
        self.export(out, samples, SENSE_HEADER)

    def link_training(self, ranker=None) -> DataFrame:
        """Link examples of sampled articles, none of which gave word-sense examples: the ten features of every topic
        that is an article, and whether the page links to it. Senses are ranked by a trained model, if one is given.
        Runs behind the phases and may be repeated."""
        self.check()
        g, t = self.graph(MIN_SENSE_TRAIN), self.tables
        samples = t.write("link_sample", self.sampled(self.language.profile.linking_groups, g, self.used_pages()))
        ids = samples.select(F.col("id").alias("page_id"))
        docs = t.read("markup").join(ids, "page_id", "left_semi").select(F.col("page_id").alias("doc_id"), F.col("wikitext").alias("text"))
        links = g.link.join(samples.select(F.col("id").alias("source")), "source", "left_semi")
        context = t.write("link_training_context_page", self.own_contexts(links, g))
        sums = samples.withColumnRenamed("id", "source").join(cx.quality(context, "source"), "source", "left").fillna(0)
        t.write("link_training_context", sums)
        parts = document_parts(docs, g, MIN_SENSE_TRAIN, ranker, context=context.withColumnRenamed("source", "doc_id"))
        out = t.write("link_training_example", tr.link_examples(parts["links"].withColumnRenamed("doc_id", "source"), links, self.page))
        self.export(out, samples, LINK_HEADER)
        return out

    def check(self, last: int = 7) -> None:
        """An error unless the phases up to ``last`` are completed."""
        if lost := [n for n in range(1, last + 1) if self.ledger.state(n) != "COMPLETED"]:
            raise ValueError(f"phases {lost} of {self.tables.path} aren't completed")

    @property
    def phases(self) -> list[Callable[[], None]]:
        return [self.pages, self.titles, self.links, self.labels, self.occurrences, self.senses, self.training]

    def run(self, last: int = 7) -> list[int]:
        """Runs the phases that aren't completed, in order; gives their numbers. A phase that broke off runs again."""
        ran = []
        for number, phase in enumerate(self.phases[:last], 1):
            if self.ledger.state(number) == "COMPLETED":
                continue
            self.ledger.put(number, "CREATED", phase.__doc__ or "")
            phase()
            self.ledger.put(number, "COMPLETED", phase.__doc__ or "")
            ran.append(number)
        return ran

