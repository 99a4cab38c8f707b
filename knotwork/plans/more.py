"""Queries for the smaller operators: look-ups, upserts, updates, projections, set operations, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DANGLING_REDIRECT
from ..functions import measures as me
from ..functions import text as tx
from ..operators import context as cx
from ..operators import graph as gr
from ..operators import linking as lk
from ..operators import titles as tt
from ..operators import training as tr
from ..sources import tables as st
from ..storage import new_path
from .bridge import Star, Wiki, table
from .queries import list_items, query, r


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def upsert_first_wins(spark, sf_dir):
    return st.first_wins(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    return st.last_wins(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT greatest((SELECT max(page_id) FROM pages), (SELECT max(doc_id) FROM documents))::BIGINT AS max_id")
def max_page_id(spark, sf_dir):
    found = st.max_id(table(spark, sf_dir, "pages").select("page_id"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")))
    return spark.createDataFrame([(found,)], "max_id long")


@query("SELECT p.page_id, w.page_type, length(p.html)::BIGINT AS n_chars FROM pages p JOIN wpage w ON w.id = p.page_id WHERE p.page_id >= 10 AND p.page_id < 60")
def markup_slice(spark, sf_dir):
    """A range of page ids, with the pages' types: the range is the query."""
    wiki = Wiki(spark, sf_dir)
    found = st.in_range(wiki.pages, 10, 60).join(wiki.page.withColumnRenamed("id", "page_id"), "page_id")
    return found.select("page_id", "page_type", F.length("html").cast("long").alias("n_chars"))


@query("SELECT source, destination, anchor_text FROM wlink WHERE destination IN (3, 5, 8)")
def links_by_destination(spark, sf_dir):
    return Wiki(spark, sf_dir).link.where(F.col("destination").isin(3, 5, 8))


@query("SELECT source, destination, anchor_text FROM wlink WHERE source IN (3, 5, 8)")
def links_by_source(spark, sf_dir):
    return Wiki(spark, sf_dir).link.where(F.col("source").isin(3, 5, 8))


@query("SELECT source, destination, anchor_text FROM wlink WHERE destination IN (SELECT id FROM wpage WHERE page_type IN (1, 4))")
def anchor_links(spark, sf_dir):
    wiki = Wiki(spark, sf_dir)
    return wiki.link.join(wiki.anchor_pages.withColumnRenamed("id", "destination"), "destination", "left_semi")


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_records(spark, sf_dir):
    """Records to JSON and back."""
    read = lambda c: F.from_json(c, "k INT")
    return table(spark, sf_dir, "events").select("event_id", read(F.to_json(read("props")))["k"].alias("k"))


@query("SELECT id, title, CASE WHEN page_type = 3 AND title NOT IN (SELECT title FROM resolved_redirect) THEN 6 ELSE page_type END AS page_type FROM redirecting")
def retyped_pages(spark, sf_dir):
    page = Star(spark, sf_dir).redirecting
    lost = tt.resolve_redirects(page)[1].select("id").withColumn("lost", F.lit(True))
    return page.join(lost, "id", "left").select("id", "title", F.when(F.col("lost"), DANGLING_REDIRECT).otherwise(F.col("page_type")).alias("page_type"))


@query("SELECT doc_id, label FROM doc_label WHERE label IN (SELECT label FROM wsense GROUP BY label HAVING max(commonness) > 0.02)")
def noisy_labels_removed(spark, sf_dir):
    wiki = Wiki(spark, sf_dir)
    return lk.without_noise(wiki.doc_labels, wiki.senses).select("doc_id", "label").distinct()


@query(r"SELECT doc_id, len(string_split_regex(regexp_replace(text, '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]+'))::BIGINT AS n FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n"))


@query("SELECT doc_id, ((length(text) - length(replace(text, source, ''))) // length(source))::BIGINT AS of_source, ((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT AS of_th FROM documents")
def match_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_matches(t, F.col("source")).alias("of_source"), tx.count_matches(t, F.lit("th")).alias("of_th"))


@query("SELECT page_id, md5(nullif(trim(replace(replace(html, chr(160), ' '), '&nbsp;', ' ')), '')) AS text_md5 FROM pages")
def markup_normalised(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.markup_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT p_partkey AS id, upper(left(p_name, 1)) || substr(p_name, 2) AS up, lower(left(upper(p_name), 1)) || substr(upper(p_name), 2) AS down FROM part")
def first_letter_case(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.capitalize_first(name).alias("up"), tx.uncapitalize_first(F.upper(name)).alias("down"))


@query(r"SELECT doc_id, CASE WHEN long > 0 THEN round(items / long, 6) ELSE 1 END AS ratio FROM (SELECT doc_id, len(list_filter(l, lambda x: length(trim(replace(replace(x, ':', ' '), ';', ' '))) > 5)) AS long, len(list_filter(l, lambda x: regexp_matches(x, '^[*#:;]'))) AS items FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def list_ratios(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(list_items(docs), "doc_id").select("doc_id", r(tr.list_ratio(F.col("text"), F.col("list_items"))).alias("ratio"))


@query("SELECT id, 'both' AS kind FROM (SELECT page_id AS id FROM pages INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT id, 'unlabelled' FROM (SELECT page_id AS id FROM pages EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT id, 'any' FROM (SELECT page_id AS id FROM pages UNION SELECT doc_id FROM labels)")
def page_sets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    of = lambda rows, kind: rows.withColumn("kind", F.lit(kind))
    return of(pages.intersect(marked), "both").unionByName(of(pages.exceptAll(marked).distinct(), "unlabelled")).unionByName(of(pages.union(marked).distinct(), "any"))


@query("SELECT c.doc_id, c.page_id, round(c.weight, 6) AS weight, p.title, p.page_type FROM context c JOIN wpage p ON p.id = c.page_id")
def context_pages(spark, sf_dir):
    from ..api import enriched

    wiki = Wiki(spark, sf_dir)
    return enriched(wiki.context, wiki.page).select("doc_id", "page_id", r("weight").alias("weight"), "title", "page_type")


@query("SELECT p.id AS category_id, p.title, round(count(*) / k.n * ln(count(*) + 1), 6) AS score, count(*)::BIGINT AS frequency FROM wlink JOIN wpage p ON p.id = destination AND p.page_type = 2 CROSS JOIN (SELECT count(*) AS n FROM (SELECT DISTINCT page_id FROM context) JOIN wpage ON id = page_id AND page_type = 1) k WHERE source IN (SELECT page_id FROM context JOIN wpage ON id = page_id AND page_type = 1) GROUP BY p.id, p.title, k.n ORDER BY count(*) DESC, p.id LIMIT 20")
def context_categories(spark, sf_dir):
    """The top 20 categories of all context pages."""
    wiki = Wiki(spark, sf_dir)
    ids = wiki.context.select(F.col("page_id").alias("id"))
    return gr.related_categories(ids, wiki.page, wiki.link).withColumn("score", r("score"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def csv_export(spark, sf_dir):
    """A training group written as CSV with a header, and read back."""
    rows = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "quality", "toxic")
    path = st.export_csv(rows, new_path(spark, "csv"), "en", "good")
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("SELECT * FROM (VALUES (-1, 'FIRST_LETTER', 'Special'), (0, 'FIRST_LETTER', ''), (6, 'FIRST_LETTER', 'File'), (10, 'FIRST_LETTER', 'Template'), (14, 'CASE_SENSITIVE', 'Category')) t(id, casing, name)")
def site_header(spark, sf_dir):
    """Writes the header of a dump to the shared folder and reads its namespaces."""
    from ..sources.dump import site_info

    names = [(-1, "Special"), (0, ""), (6, "File"), (10, "Template"), (14, "Category")]
    inner = "".join(f'<namespace key="{k}" case="{"case-sensitive" if k == 14 else "first-letter"}">{n}</namespace>' for k, n in names)
    path = new_path(spark, "header") + ".xml"
    header = f"<mediawiki><siteinfo><sitename>W</sitename><case>first-letter</case><namespaces>{inner}</namespaces></siteinfo></mediawiki>"
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(path)
    return site_info(spark, path)


@query("SELECT e.vec_id, round(list_dot_product(e.x, f.x) / sqrt(list_dot_product(e.x, e.x) * list_dot_product(f.x, f.x)), 6) AS cosine FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings) e JOIN (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS x FROM embeddings GROUP BY label) f USING (label)")
def vector_cosine(spark, sf_dir):
    """Cosine of each vector with the first of its label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    first = rows.groupBy("label").agg(F.min_by("x", "vec_id").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return rows.join(first, "label").select("vec_id", r(me.cosine(dot("x", "y"), dot("x", "x"), dot("y", "y"))).alias("cosine"))


@query("SELECT label, destination AS page_id, round(commonness, 6) AS commonness, d.n::BIGINT AS n_in, round(commonness * ln(d.n + 1), 6) AS broad, round((link_probability + commonness) / 2, 6) AS favouring FROM wsense JOIN wlabel USING (label) JOIN in_degree d ON d.page_id = destination WHERE link_probability IS NOT NULL")
def candidate_weights(spark, sf_dir):
    wiki = Wiki(spark, sf_dir)
    rows = wiki.senses.join(wiki.labels.where("link_probability is not null").select("label", "link_probability"), "label")
    rows = rows.join(gr.in_degree(wiki.link).select(F.col("page_id").alias("destination"), F.col("n").alias("n_in")), "destination")
    broad, favouring = me.broad_weight(F.col("commonness"), F.col("n_in")), me.link_favouring_weight(F.col("link_probability"), F.col("commonness"))
    return rows.select("label", F.col("destination").alias("page_id"), r("commonness").alias("commonness"), "n_in", r(broad).alias("broad"), r(favouring).alias("favouring"))


@query("SELECT doc_id, page_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, page_id) AS k FROM candidate) WHERE k <= 5")
def top_candidates(spark, sf_dir):
    """The five heaviest candidates of each document."""
    return cx.capped(Wiki(spark, sf_dir).candidates(), 5).withColumn("weight", r("weight"))


@query("SELECT dir, page_id, link, cnt::BIGINT AS cnt, most::BIGINT AS most FROM arm")
def link_multiplicity(spark, sf_dir):
    return gr.multiplicities(Wiki(spark, sf_dir).link)


@query("SELECT event_id, least(user_id, event_id) AS a, greatest(user_id, event_id) AS b FROM events")
def symmetric_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least("user_id", "event_id").alias("a"), F.greatest("user_id", "event_id").alias("b"))


@query("SELECT doc_id, md5(clean) AS clean_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(\\n\\s*){3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents)")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text")).cast("binary")).alias("clean_md5"))
