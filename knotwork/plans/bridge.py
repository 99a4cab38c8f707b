"""The driver's tables seen as a link graph, as web pages with titles and links, and as documents.

Each view exists twice: as a DataFrame here, and as SQL in CTES for the twin of each query.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PAGE_TYPES
from ..functions import text as tx
from ..operators import context as cx
from ..operators import graph as gr
from ..operators import labels as lb
from ..operators import relatedness as rl
from ..operators import titles as tt
from ..storage import stored

#: What each kind of entity adds to its key to make a page id.
ORDER, CUSTOMER, PART, SUPPLIER, NATION, REGION = (k * 1_000_000_000 for k in range(1, 7))
ANCHOR = '<a href="/([^"]*)">([^<]*)</a>'
MIN_IN_LINKS, LEAST_SENSE = 3, 0.02
ANCHOR_PAGES = (PAGE_TYPES["ARTICLE"], PAGE_TYPES["DISAMBIGUATION"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Star:
    """Customers, orders, parts, suppliers, nations and regions as pages that link along their keys."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.of = lambda name: table(spark, sf_dir, name)

    @property
    def page(self) -> DataFrame:
        row = lambda name, base, key, kind, title: self.of(name).select((F.lit(base) + F.col(key)).alias("id"), F.lit(kind).alias("page_type"), title.alias("title"))
        return union([
            row("orders", ORDER, "o_orderkey", 1, F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))),
            row("customer", CUSTOMER, "c_custkey", 1, F.col("c_name")), row("part", PART, "p_partkey", 1, F.col("p_name")),
            row("supplier", SUPPLIER, "s_suppkey", 1, F.col("s_name")), row("nation", NATION, "n_nationkey", 2, F.col("n_name")), row("region", REGION, "r_regionkey", 2, F.col("r_name")),
        ])

    @property
    def link(self) -> DataFrame:
        row = lambda df, a, source, b, destination, anchor: df.select((F.lit(a) + F.col(source)).alias("source"), (F.lit(b) + F.col(destination)).alias("destination"), F.col(anchor).alias("anchor_text"))
        line, part, supplier = self.of("lineitem"), self.of("part"), self.of("supplier")
        nation, customer = self.of("nation"), self.of("customer")
        return union([
            row(self.of("orders"), CUSTOMER, "o_custkey", ORDER, "o_orderkey", "o_orderpriority"),
            row(line.join(part, line["l_partkey"] == part["p_partkey"]), ORDER, "l_orderkey", PART, "l_partkey", "p_name"),
            row(line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]), PART, "l_partkey", SUPPLIER, "l_suppkey", "s_name"),
            row(supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]), SUPPLIER, "s_suppkey", NATION, "s_nationkey", "n_name"),
            row(customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]), CUSTOMER, "c_custkey", NATION, "c_nationkey", "n_name"),
            row(nation.join(self.of("region"), F.col("n_regionkey") == F.col("r_regionkey")), NATION, "n_nationkey", REGION, "n_regionkey", "r_name"),
        ])

    @property
    def edge(self) -> DataFrame:
        """link without its texts: (source, destination), and no joins."""
        row = lambda name, a, source, b, destination: self.of(name).select((F.lit(a) + F.col(source)).alias("source"), (F.lit(b) + F.col(destination)).alias("destination"))
        return union([
            row("orders", CUSTOMER, "o_custkey", ORDER, "o_orderkey"), row("lineitem", ORDER, "l_orderkey", PART, "l_partkey"), row("lineitem", PART, "l_partkey", SUPPLIER, "l_suppkey"),
            row("supplier", SUPPLIER, "s_suppkey", NATION, "s_nationkey"), row("customer", CUSTOMER, "c_custkey", NATION, "c_nationkey"), row("nation", NATION, "n_nationkey", REGION, "n_regionkey"),
        ])

    @property
    def redirecting(self) -> DataFrame:
        """Customers as pages; every third redirects to that of a third of its key, every thousandth to nowhere."""
        c = self.of("customer").select(F.col("c_custkey").alias("k"), "c_name")
        to = F.when(F.col("k") % 1000 == 999, F.lit("Nobody")).when((F.col("k") % 3 == 0) & (F.col("k") > 0), F.concat(F.lit("Customer#"), F.lpad((F.col("k") / 3).cast("long").cast("string"), 9, "0")))
        return c.select(F.col("k").alias("id"), F.when(to.isNotNull(), 3).otherwise(1).alias("page_type"), F.col("c_name").alias("title"), to.alias("redirect_target"))


class Wiki:
    """Web pages as articles: the targets of all their links, in order, are the titles of pages 0, 1, 2 and so on; the
    words of the anchors are labels, and documents are the texts in which labels occur."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.pages, self.documents = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str, make) -> DataFrame:
        if name not in self.made:
            self.made[name] = stored(make(), name)
        return self.made[name]

    @property
    def raw_links(self) -> DataFrame:
        found = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("anchor_text"))
        return self.once("raw_links", lambda: self.pages.select(F.col("page_id").alias("source"), F.explode(found).alias("x")).select("source", "x.target", F.trim(tx.letters_digits(F.col("x.anchor_text"))).alias("anchor_text")))

    @property
    def page(self) -> DataFrame:
        def make() -> DataFrame:
            titles = lb.with_ids(self.raw_links.select(F.col("target").alias("label")).distinct()).select((F.col("id") - 1).alias("id"), F.col("label").alias("title"))
            kind = F.when(F.col("id") % 10 == 9, 2).when(F.col("id") % 10 == 8, 4).otherwise(1)
            ids = self.pages.select(F.col("page_id").alias("id")).distinct()
            return ids.join(titles, "id", "left").select("id", kind.alias("page_type"), F.coalesce("title", F.concat(F.lit("Page "), F.col("id").cast("string"))).alias("title"))

        return self.once("page", make)

    @property
    def located(self) -> DataFrame:
        titles = self.page.select("title", F.col("id").alias("page_id"))
        return self.once("located", lambda: tt.located(self.raw_links, titles))

    @property
    def link(self) -> DataFrame:
        return tt.resolved_links(self.located)

    @property
    def anchor_pages(self) -> DataFrame:
        return self.page.where(F.col("page_type").isin(*ANCHOR_PAGES)).select("id")

    @property
    def anchors(self) -> DataFrame:
        return gr.anchor_stats(self.link, self.anchor_pages, tx.clean_anchor(F.col("anchor_text")))

    @property
    def occurrences(self) -> DataFrame:
        return self.once("occurrences", lambda: lb.label_occurrences(self.documents, self.anchors))

    @property
    def labels(self) -> DataFrame:
        return self.once("labels", lambda: lb.label_table(self.anchors, lb.occurrence_stats(self.occurrences)))

    @property
    def usable(self) -> DataFrame:
        return lb.usable(self.labels, MIN_IN_LINKS)

    @property
    def raw_senses(self) -> DataFrame:
        return gr.sense_counts(self.link, tx.clean_anchor(F.col("anchor_text"))).join(self.labels.select("label"), "label", "left_semi")

    @property
    def senses(self) -> DataFrame:
        return self.once("senses", lambda: gr.commonness(self.raw_senses, LEAST_SENSE))

    @property
    def n_articles(self) -> int:
        return self.page.where("page_type = 1").count()

    @property
    def vectors(self) -> tuple[DataFrame, DataFrame]:
        weighted, sizes = rl.vectors(self.link, self.n_articles)
        return self.once("weighted", lambda: weighted), self.once("sizes", lambda: sizes)

    @property
    def doc_labels(self) -> DataFrame:
        """(doc_id, label): the usable labels that occur in each document."""
        return self.occurrences.join(self.usable.select("label"), "label", "left_semi").select("doc_id", "label")

    @property
    def spans(self) -> DataFrame:
        """(doc_id, start, end, label): where usable labels stand."""
        return self.once("spans", lambda: lb.label_places(self.documents, self.usable))

    @property
    def linked(self) -> dict[str, DataFrame]:
        """resolved and links of the documents, from the places of their labels and their contexts."""
        from ..api import Graph, linked_parts

        if "links" not in self.made:
            parts = linked_parts(self.documents, self.spans, self.context, Graph.of_wiki(self), LEAST_SENSE)
            self.made["resolved"] = parts["resolved"]
            self.once("links", lambda: parts["links"])
        return self.made

    def candidates(self, broad: bool = False) -> DataFrame:
        return self.once(f"candidates{broad}", lambda: cx.candidates(self.doc_labels, self.labels, self.senses, gr.in_degree(self.link), cx.date_labels(self.spark), LEAST_SENSE, broad))

    @property
    def compared(self) -> DataFrame:
        """Measures of all pairs of pages that are candidates of one document, both ways."""
        weighted, sizes = self.vectors
        return self.once("compared", lambda: rl.both_ways(rl.compare(rl.pairs_within(self.candidates()), weighted, sizes, self.n_articles)))

    @property
    def context(self) -> DataFrame:
        return self.once("context", lambda: cx.reranked(self.candidates(), self.compared))


def clean_sql(x: str) -> str:
    plain = f"trim(replace(split_part({x}, '#', 1), '_', ' '))"
    return f"trim(CASE WHEN starts_with({plain}, ':en:') THEN substr({plain}, 5) ELSE {plain} END)"


def key_sql(x: str) -> str:
    plain = f"lower(trim(replace(split_part({x}, '#', 1), '_', ' ')))"
    return f"replace(CASE WHEN starts_with({plain}, ':en:') THEN trim(substr({plain}, 5)) WHEN starts_with({plain}, ':category:') THEN substr({plain}, 2) ELSE {plain} END, 'category: ', 'category:')"


PIECE_SQL = r"[\p{L}\p{M}]+|\p{N}+|[ \t\n\r\f]+|[^ \t\n\r\f]"
CTES = {
    "page": "SELECT 1000000000 + o_orderkey AS id, 1 AS page_type, 'Order#' || o_orderkey AS title FROM orders UNION ALL SELECT 2000000000 + c_custkey, 1, c_name FROM customer UNION ALL SELECT 3000000000 + p_partkey, 1, p_name FROM part UNION ALL SELECT 4000000000 + s_suppkey, 1, s_name FROM supplier UNION ALL SELECT 5000000000 + n_nationkey, 2, n_name FROM nation UNION ALL SELECT 6000000000 + r_regionkey, 2, r_name FROM region",
    "link": "SELECT 2000000000 + o_custkey AS source, 1000000000 + o_orderkey AS destination, o_orderpriority AS anchor_text FROM orders UNION ALL SELECT 1000000000 + l_orderkey, 3000000000 + l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 3000000000 + l_partkey, 4000000000 + l_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 4000000000 + s_suppkey, 5000000000 + s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 2000000000 + c_custkey, 5000000000 + c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 5000000000 + n_nationkey, 6000000000 + n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "redirecting": "SELECT id, CASE WHEN redirect_target IS NULL THEN 1 ELSE 3 END AS page_type, title, redirect_target FROM (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 1000 = 999 THEN 'Nobody' WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 'Customer#' || lpad((c_custkey // 3)::VARCHAR, 9, '0') END AS redirect_target FROM customer)",
    "resolved_redirect": "SELECT title, page_id, hops FROM (SELECT w.title, p.id AS page_id, w.hops FROM walk w JOIN redirecting p ON p.title = w.goes AND p.page_type = 1 WHERE w.hops < 16)",
    "sense": "SELECT anchor_text AS label, destination, count(*)::BIGINT AS n FROM link GROUP BY ALL",
    "pruned3": "SELECT label, destination, n, n / sum(n) OVER (PARTITION BY label) AS commonness FROM (SELECT *, n / sum(n) OVER (PARTITION BY label) AS prior FROM sense) WHERE prior > 0.03",
    "html_link": f"SELECT page_id AS source, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS target, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS raw_anchor FROM pages",
    "raw_link": r"SELECT source, target, trim(regexp_replace(raw_anchor, '[^\p{L}\p{Nd}]', ' ', 'g')) AS anchor_text FROM html_link",
    "wtitle": "SELECT target AS title, row_number() OVER (ORDER BY target) - 1 AS id FROM (SELECT DISTINCT target FROM raw_link)",
    "wpage": "SELECT p.page_id AS id, CASE WHEN p.page_id % 10 = 9 THEN 2 WHEN p.page_id % 10 = 8 THEN 4 ELSE 1 END AS page_type, coalesce(t.title, 'Page ' || p.page_id) AS title FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN wtitle t ON t.id = p.page_id",
    "wkey": "SELECT lower(title) AS key, min(id) AS page_id FROM wpage GROUP BY 1",
    "wlocated": f"SELECT source, target, coalesce(nullif({clean_sql('anchor_text')}, ''), anchor_text) AS anchor_text, CASE WHEN page_id <> source THEN page_id END AS destination FROM raw_link LEFT JOIN wkey ON key = {key_sql('target')}",
    "wlink": "SELECT source, destination, anchor_text FROM wlocated WHERE destination IS NOT NULL",
    "wanchor": f"SELECT label, count(*)::BIGINT AS link_count, count(DISTINCT source)::BIGINT AS link_doc_count FROM (SELECT {clean_sql('anchor_text')} AS label, source FROM wlink WHERE destination IN (SELECT id FROM wpage WHERE page_type IN (1, 4))) WHERE label <> '' GROUP BY 1",
    "line": "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS li FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)",
    "piece": f"SELECT doc_id, li, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, li, regexp_extract_all(line, '{PIECE_SQL}') AS p FROM line)",
    "token": r"SELECT doc_id, li, i, piece, j, j <> i + 1 AS gap, after FROM (SELECT doc_id, li, i, piece, lead(i) OVER w AS j, lead(piece) OVER w AS after FROM piece WHERE NOT regexp_matches(piece, '^[ \t\n\r\f]+$') WINDOW w AS (PARTITION BY doc_id, li ORDER BY i))",
    "gap": "SELECT t.doc_id, t.li, t.i, t.piece || coalesce(s.piece, '') || t.after AS content FROM token t LEFT JOIN piece s ON t.gap AND s.doc_id = t.doc_id AND s.li = t.li AND s.i = t.i + 1 WHERE t.after IS NOT NULL",
    "ngram": "SELECT doc_id, piece AS content FROM token UNION ALL SELECT doc_id, content FROM gap",
    "occurrence": "SELECT doc_id, label, count(*)::BIGINT AS n FROM ngram JOIN wanchor ON content = label GROUP BY ALL",
    "wlabel": "SELECT label, link_count, link_doc_count, coalesce(occurrence_count, 0)::BIGINT AS occurrence_count, coalesce(occurrence_doc_count, 0)::BIGINT AS occurrence_doc_count, CASE WHEN occurrence_count > 0 THEN least(link_count / occurrence_count, 1.0) END AS link_probability FROM wanchor LEFT JOIN (SELECT label, sum(n)::BIGINT AS occurrence_count, count(*)::BIGINT AS occurrence_doc_count FROM occurrence GROUP BY 1) USING (label)",
    "usable": "SELECT * FROM wlabel WHERE link_doc_count >= 3 AND link_probability >= 0.0025",
    "wsense": f"SELECT label, destination, n, n / sum(n) OVER (PARTITION BY label) AS commonness FROM (SELECT *, n / sum(n) OVER (PARTITION BY label) AS prior FROM (SELECT {clean_sql('anchor_text')} AS label, destination, count(*) AS n FROM wlink GROUP BY ALL) WHERE label IN (SELECT label FROM wlabel)) WHERE prior > 0.02",
    "articles": "SELECT count(*) AS n_articles FROM wpage WHERE page_type = 1",
    "lowest": "SELECT 1 - ln(greatest(least(n_articles - 1, 100000), 1)) / ln(n_articles) AS lowest, n_articles FROM articles",
    "arm": "SELECT dir, page_id, link, count(*) AS cnt, max(count(*)) OVER (PARTITION BY dir, page_id) AS most FROM (SELECT 'in' AS dir, destination AS page_id, source AS link FROM wlink UNION ALL SELECT 'out', source, destination FROM wlink) GROUP BY dir, page_id, link",
    "degree": "SELECT 'in' AS dir, destination AS link, count(DISTINCT source) AS degree FROM wlink GROUP BY 2 UNION ALL SELECT 'out', source, count(DISTINCT destination) FROM wlink GROUP BY 2",
    "weighted": "SELECT dir, page_id, link, (0.5 + 0.5 * cnt / most) * ln(n_articles / degree) AS w FROM arm JOIN degree USING (dir, link) CROSS JOIN articles",
    "size": "SELECT dir, page_id, count(*) AS size FROM arm GROUP BY ALL",
    "doc_label": "SELECT DISTINCT doc_id, label FROM occurrence WHERE label IN (SELECT label FROM usable)",
    "in_degree": "SELECT destination AS page_id, count(DISTINCT source) AS n FROM wlink GROUP BY 1",
    "candidate": "SELECT doc_id, page_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, page_id) AS place FROM (SELECT doc_id, destination AS page_id, max((link_probability + commonness) / 2) AS weight FROM doc_label JOIN wlabel USING (label) JOIN wsense USING (label) GROUP BY ALL)) WHERE place <= 125",
    "broad_candidate": "SELECT doc_id, page_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, page_id) AS place FROM (SELECT doc_id, destination AS page_id, max(commonness * ln(coalesce(d.n, 0) + 1)) AS weight FROM doc_label JOIN wlabel USING (label) JOIN wsense USING (label) LEFT JOIN in_degree d ON d.page_id = destination GROUP BY ALL)) WHERE place <= 125",
    "pair": "SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM candidate x JOIN candidate y ON x.doc_id = y.doc_id AND x.page_id < y.page_id",
}


def compared_sql(pairs: str) -> str:
    """(a, b, in_vector, out_vector, in_distance, out_distance, mean) of the pairs of a CTE."""
    side = lambda d, s: f"coalesce((SELECT size FROM size WHERE dir = '{d}' AND page_id = {s}), 0)"
    flat = f"SELECT a, b, x.dir, count(*) AS common, sum(x.w * y.w) AS dot, sum(x.w * x.w) AS sa, sum(y.w * y.w) AS sb FROM {pairs} JOIN weighted x ON x.page_id = a JOIN weighted y ON y.page_id = b AND y.dir = x.dir AND y.link = x.link GROUP BY ALL"
    vector = lambda d: f"coalesce(CASE WHEN {d}.sa > 0 AND {d}.sb > 0 THEN {d}.dot / sqrt({d}.sa * {d}.sb) ELSE 0 END, 0)::DOUBLE"

    def distance(d: str) -> str:
        return f"((greatest(0, 1 - CASE WHEN coalesce({d}.common, 0) = 0 OR ln(n_articles) - ln(least({d}_a, {d}_b)) <= 0 THEN 1 ELSE (ln(greatest({d}_a, {d}_b)) - ln({d}.common)) / (ln(n_articles) - ln(least({d}_a, {d}_b))) END) - lowest) / (1 - lowest))::DOUBLE"

    sizes = ", ".join(f"greatest({side(d, s)}, 0) AS {d}_{s}" for d in ("in", "out") for s in ("a", "b"))
    inner = f"SELECT s.a, s.b, {vector('i')} AS in_vector, {vector('o')} AS out_vector, {distance('in').replace('in.', 'i.')} AS in_distance, {distance('out').replace('out.', 'o.')} AS out_distance FROM (SELECT a, b, {sizes} FROM {pairs}) s LEFT JOIN (SELECT * FROM ({flat}) WHERE dir = 'in') i ON i.a = s.a AND i.b = s.b LEFT JOIN (SELECT * FROM ({flat}) WHERE dir = 'out') o ON o.a = s.a AND o.b = s.b CROSS JOIN lowest"
    return f"SELECT *, (in_vector + out_vector + in_distance + out_distance) / 4 AS mean FROM ({inner})"


CTES["half"] = compared_sql("pair")
CTES["compared"] = "SELECT a, b, in_vector, out_vector, in_distance, out_distance, mean FROM half UNION ALL SELECT b, a, in_vector, out_vector, in_distance, out_distance, mean FROM half"
CTES["context"] = (
    "SELECT doc_id, page_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, page_id) AS place FROM ("
    "SELECT c.doc_id, c.page_id, c.weight + 4 * (coalesce(s.total, 0) / k.n) / 5 AS weight FROM candidate c JOIN (SELECT doc_id, count(*) AS n FROM candidate GROUP BY 1) k ON k.doc_id = c.doc_id "
    "LEFT JOIN (SELECT x.doc_id, x.page_id, sum(mean) AS total FROM candidate x JOIN candidate y ON x.doc_id = y.doc_id JOIN compared ON a = x.page_id AND b = y.page_id GROUP BY ALL) s ON s.doc_id = c.doc_id AND s.page_id = c.page_id)) WHERE place <= 25"
)
CTES["sense_related"] = (
    "SELECT o.doc_id, o.page_id, sum(coalesce(in_vector, 0)) / count(*) AS in_vector, sum(coalesce(out_vector, 0)) / count(*) AS out_vector, sum(coalesce(in_distance, 0)) / count(*) AS in_distance, sum(coalesce(out_distance, 0)) / count(*) AS out_distance, sum(coalesce(mean * x.weight, 0)) / count(*) AS relatedness, sum(x.weight) AS quality "
    "FROM (SELECT DISTINCT doc_id, destination AS page_id FROM doc_label JOIN wsense USING (label)) o JOIN context x ON x.doc_id = o.doc_id LEFT JOIN compared ON a = o.page_id AND b = x.page_id GROUP BY ALL"
)
CTES["scored_sense"] = (
    "SELECT doc_id, label, page_id, commonness, 4.0 * commonness + coalesce(in_vector, 0) + coalesce(out_vector, 0) + coalesce(in_distance, 0) + coalesce(out_distance, 0) AS score FROM (SELECT doc_id, label, destination AS page_id, commonness FROM doc_label JOIN wsense USING (label)) "
    "LEFT JOIN (SELECT doc_id, page_id, CASE WHEN quality > 0 THEN in_vector ELSE 0 END AS in_vector, CASE WHEN quality > 0 THEN out_vector ELSE 0 END AS out_vector, CASE WHEN quality > 0 THEN in_distance ELSE 0 END AS in_distance, CASE WHEN quality > 0 THEN out_distance ELSE 0 END AS out_distance FROM sense_related) USING (doc_id, page_id)"
)
CTES["soft_sense"] = "SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id, label)) / sum(exp(score - m)) OVER (PARTITION BY doc_id, label) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, label) AS m FROM scored_sense)"
CTES["best_sense"] = "SELECT doc_id, label, page_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY round(score, 9) DESC, page_id) AS place FROM soft_sense) WHERE place = 1"


# labels by place: resolved, rolled up to topics, and the topics' measures against contexts and each other
CTES |= {
    "line_at": "SELECT doc_id, li, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM line",
    "piece_at": "SELECT doc_id, li, i, base + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, li ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM piece JOIN line_at USING (doc_id, li)",
    "written": 'SELECT doc_id, begins::INT AS start, (begins + length(content))::INT AS "end", content AS label FROM (SELECT doc_id, li, i, piece AS content FROM token UNION ALL SELECT t.doc_id, t.li, t.i, t.piece || coalesce(s.piece, \'\') || t.after FROM token t LEFT JOIN piece s ON t.gap AND s.doc_id = t.doc_id AND s.li = t.li AND s.i = t.i + 1 WHERE t.after IS NOT NULL) JOIN piece_at USING (doc_id, li, i) WHERE content IN (SELECT label FROM usable)',
    "span": 'SELECT doc_id, start, "end", label FROM (SELECT DISTINCT doc_id, start, "end", unnest([label, upper(left(label, 1)) || substr(label, 2), lower(left(label, 1)) || substr(label, 2)]) AS label FROM written) WHERE label IN (SELECT label FROM usable)',
    "heard": "SELECT doc_id, start, \"end\", label FROM span WHERE label IN (SELECT label FROM wsense GROUP BY label HAVING max(commonness) > 0.02)",
    "heard_label": "SELECT DISTINCT doc_id, label FROM heard",
    "span_page": "SELECT DISTINCT doc_id, destination AS page_id FROM span JOIN wsense USING (label)",
    "against_pair": "SELECT DISTINCT least(o.page_id, x.page_id) AS a, greatest(o.page_id, x.page_id) AS b FROM span_page o JOIN context x ON x.doc_id = o.doc_id AND x.page_id <> o.page_id",
    "against_half": compared_sql("against_pair"),
    "against": "SELECT a, b, in_vector, out_vector, in_distance, out_distance, mean FROM against_half UNION ALL SELECT b, a, in_vector, out_vector, in_distance, out_distance, mean FROM against_half",
}
for _name, _body in [(n, CTES[n]) for n in ("sense_related", "scored_sense", "soft_sense", "best_sense")]:
    for _old, _new in (("compared", "against"), ("doc_label", "heard_label"), ("FROM sense_related", "FROM heard_related"), ("scored_sense", "heard_scored"), ("soft_sense", "heard_soft")):
        _body = _body.replace(_old, _new)
    CTES[{"sense_related": "heard_related", "scored_sense": "heard_scored", "soft_sense": "heard_soft", "best_sense": "heard_best"}[_name]] = _body
CTES |= {
    "resolved": 'SELECT doc_id, start, "end", label, page_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY round(confidence, 9) DESC, label) AS place FROM heard JOIN heard_best USING (doc_id, label)) WHERE place = 1',
    "surface": "SELECT doc_id, page_id, label, count(*) AS spans, max(confidence) AS most, sum(confidence) AS total, min(start) AS first, max(start) AS last, min(link_probability) AS p FROM resolved JOIN wlabel USING (label) WHERE link_probability > 0.02 GROUP BY ALL",
    "topic": "SELECT doc_id, page_id, ln(sum(((length(text) - length(replace(text, label, ''))) // length(label)) * spans) + 1) AS normalized_occurrences, max(most) AS max_confidence, sum(total) / sum(spans) AS avg_confidence, avg(p) AS avg_link_probability, max(p) AS max_link_probability, min(first) / max(length(text)) AS first_occurrence, max(last) / max(length(text)) AS last_occurrence, max(last) / max(length(text)) - min(first) / max(length(text)) AS spread, string_agg(label, '|' ORDER BY label) AS forms FROM surface JOIN documents USING (doc_id) GROUP BY ALL",
    "other": "SELECT doc_id, page_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, page_id) AS place FROM (SELECT doc_id, page_id, avg_link_probability * normalized_occurrences AS w FROM topic)) WHERE place <= 25",
    "topic_pair": "SELECT DISTINCT least(t.page_id, o.page_id) AS a, greatest(t.page_id, o.page_id) AS b FROM topic t JOIN other o ON o.doc_id = t.doc_id AND o.page_id <> t.page_id",
    "topic_half": compared_sql("topic_pair"),
    "topic_compared": "SELECT a, b, mean FROM topic_half UNION ALL SELECT b, a, mean FROM topic_half",
    "to_others": "SELECT t.doc_id, t.page_id, CASE WHEN sum(o.w) > 0 THEN sum(coalesce(mean * o.w, 0)) / count(*) ELSE 0 END AS relatedness_to_others FROM topic t JOIN other o ON o.doc_id = t.doc_id LEFT JOIN topic_compared ON a = t.page_id AND b = o.page_id GROUP BY ALL",
    "to_context": "SELECT doc_id, page_id, CASE WHEN quality > 0 THEN relatedness ELSE 0 END AS relatedness_to_context FROM heard_related",
    "feature": "SELECT *, 1 / (1 + exp(-(3 * avg_link_probability + 2 * relatedness_to_context + 2 * relatedness_to_others + avg_confidence + 0.5 * normalized_occurrences - 3))) AS prediction FROM (SELECT t.*, coalesce(relatedness_to_context, 0) AS relatedness_to_context, relatedness_to_others FROM topic t JOIN to_others USING (doc_id, page_id) LEFT JOIN to_context USING (doc_id, page_id))",
}

#: Views of n-grams of up to ten tokens.
CTES |= {
    "run": "SELECT doc_id, p, list_filter(range(1, len(p) + 1), lambda k: NOT regexp_matches(p[k], '^[ \\t\\n\\r\\f]+$')) AS t FROM (SELECT doc_id, regexp_extract_all(line, '" + PIECE_SQL + "') AS p FROM line)",
    "ngram10": "SELECT doc_id, array_to_string(p[t[a]:t[b]], '') AS content FROM (SELECT doc_id, p, t, a, unnest(range(a, least(a + 10, len(t) + 1))) AS b FROM (SELECT doc_id, p, t, unnest(range(1, len(t) + 1)) AS a FROM run))",
}


WALK = "walk(title, goes, hops) AS (SELECT title, redirect_target, 1 FROM redirecting WHERE page_type = 3 UNION ALL SELECT w.title, r.redirect_target, w.hops + 1 FROM walk w JOIN redirecting r ON r.title = w.goes AND r.page_type = 3 WHERE w.hops < 16)"


def with_ctes(sql: str) -> str:
    """The statement with the views that it and they name in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in wanted and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                need(body)
                if name not in wanted:
                    wanted.append(name)
        if "FROM walk" in text and "walk" not in wanted:
            need(CTES["resolved_redirect"].replace("FROM walk", "FROM redirecting"))
            wanted.append("walk")

    need(sql)
    parts = [WALK if w == "walk" else f"{w} AS MATERIALIZED ({CTES[w]})" for w in wanted]
    return f"WITH {'RECURSIVE ' if 'walk' in wanted else ''}{', '.join(parts)} {sql}" if parts else sql
