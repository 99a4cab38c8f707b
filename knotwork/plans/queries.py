"""Every query over the driver's tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ENGLISH, TrainingProfile
from ..functions import measures as me
from ..functions import text as tx
from ..operators import context as cx
from ..operators import evaluation as ev
from ..operators import graph as gr
from ..operators import labels as lb
from ..operators import linking as lk
from ..operators import relatedness as rl
from ..operators import titles as tt
from ..operators import training as tr
from .bridge import Star, Wiki, clean_sql, key_sql, table, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_ctes(sql)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


# graph


@query("SELECT destination AS page_id, count(DISTINCT source)::BIGINT AS n FROM link GROUP BY 1")
def in_degree(spark, sf_dir):
    return gr.in_degree(Star(spark, sf_dir).edge)


@query("SELECT source AS page_id, count(DISTINCT destination)::BIGINT AS n FROM link GROUP BY 1")
def out_degree(spark, sf_dir):
    return gr.out_degree(Star(spark, sf_dir).edge)


@query("SELECT destination AS page_id, count(*)::BIGINT AS n, min(source)::BIGINT AS first_link, max(source)::BIGINT AS last_link FROM link GROUP BY 1")
def adjacency_size(spark, sf_dir):
    lists = gr.adjacency(Star(spark, sf_dir).edge)
    return lists.select("page_id", F.size("links").cast("long").alias("n"), F.col("links")[0].alias("first_link"), F.element_at("links", -1).alias("last_link"))


@query("SELECT destination AS page_id, count(DISTINCT source)::BIGINT AS n FROM link GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_linked_pages(spark, sf_dir):
    return gr.top_linked(Star(spark, sf_dir).edge, 100)


@query(f"SELECT {clean_sql('anchor_text')} AS label, count(*)::BIGINT AS link_count, count(DISTINCT source)::BIGINT AS link_doc_count FROM link WHERE destination IN (SELECT id FROM page WHERE page_type IN (1, 4)) GROUP BY 1")
def link_anchor_stats(spark, sf_dir):
    star = Star(spark, sf_dir)
    return gr.anchor_stats(star.link, star.page.where("page_type in (1, 4)"), tx.clean_anchor(F.col("anchor_text")))


@query("SELECT label, destination, n FROM sense")
def sense_counts(spark, sf_dir):
    return gr.sense_counts(Star(spark, sf_dir).link, F.col("anchor_text"))


@query("SELECT label, destination, n, round(n / sum(n) OVER (PARTITION BY label), 9) AS commonness FROM sense")
def sense_commonness(spark, sf_dir):
    return gr.commonness(sense_counts(spark, sf_dir)).withColumn("commonness", r("commonness", 9))


@query("SELECT label, destination, n, round(commonness, 9) AS commonness FROM pruned3")
def sense_pruned(spark, sf_dir):
    return gr.commonness(sense_counts(spark, sf_dir), 0.03).withColumn("commonness", r("commonness", 9))


@query("SELECT label, destination, round(commonness, 9) AS commonness, n_senses::BIGINT AS n_senses FROM (SELECT label, destination, n / sum(n) OVER (PARTITION BY label) AS commonness, count(*) OVER (PARTITION BY label) AS n_senses, row_number() OVER (PARTITION BY label ORDER BY n DESC, destination) AS k FROM sense) WHERE k = 1")
def commonest_sense(spark, sf_dir):
    return gr.commonest(sense_counts(spark, sf_dir)).withColumn("commonness", r("commonness", 9))


@query("SELECT label, destination, round(commonness, 9) AS commonness, n_senses::BIGINT AS n_senses FROM (SELECT label, destination, n / sum(n) OVER (PARTITION BY label) AS commonness, count(*) OVER (PARTITION BY label) AS n_senses, row_number() OVER (PARTITION BY label ORDER BY n DESC, destination) AS k FROM pruned3) WHERE k = 1 AND n_senses >= 2 AND commonness <= 0.97")
def ambiguous_labels(spark, sf_dir):
    return gr.ambiguous(sense_counts(spark, sf_dir), 0.03).withColumn("commonness", r("commonness", 9))


# strings

STRINGS = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN ':en: ' || p_name WHEN 1 THEN p_name || '#' || p_type WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN ':Category: ' || p_name WHEN 4 THEN ':fr:' || p_name WHEN 5 THEN ' ' || upper(p_name) || ' ' ELSE 'Category: ' || p_name END AS s FROM part"


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_name"), F.col("p_partkey") % 7
    s = F.when(k == 0, F.concat(F.lit(":en: "), n)).when(k == 1, F.concat(n, F.lit("#"), "p_type")).when(k == 2, F.replace(n, F.lit(" "), F.lit("_"))).when(k == 3, F.concat(F.lit(":Category: "), n))
    s = s.when(k == 4, F.concat(F.lit(":fr:"), n)).when(k == 5, F.concat(F.lit(" "), F.upper(n), F.lit(" "))).otherwise(F.concat(F.lit("Category: "), n))
    return p.select(F.col("p_partkey").alias("id"), s.alias("s"))


@query(f"SELECT id, {clean_sql('s')} AS anchor FROM ({STRINGS})")
def clean_anchor(spark, sf_dir):
    return strings(spark, sf_dir).select("id", tx.clean_anchor(F.col("s")).alias("anchor"))


@query(f"SELECT id, {key_sql('s')} AS key FROM ({STRINGS})")
def key_from_target(spark, sf_dir):
    return strings(spark, sf_dir).select("id", tx.key_from_target(F.col("s")).alias("key"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{Nd}]', ' ', 'g')) AS plain_md5, length(regexp_replace(text, '[^\p{L}\p{Nd}]', ' ', 'g'))::BIGINT AS n FROM documents")
def letters_digits(spark, sf_dir):
    plain = tx.letters_digits(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("plain_md5"), F.length(plain).cast("long").alias("n"))


WIKITEXT = "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '{{' || lang || '|x}} ' || source || ' {{' || CASE doc_id % 5 WHEN 0 THEN 'Disambiguation' WHEN 1 THEN 'geodis|' || source WHEN 2 THEN 'Airport disambiguation' WHEN 3 THEN 'hndis' ELSE source END || '}}' END AS wikitext, doc_id % 4 AS ns, CASE WHEN doc_id % 11 = 0 THEN source END AS redirect FROM documents"


def wikitexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    last = F.when(k == 0, "Disambiguation").when(k == 1, F.concat(F.lit("geodis|"), "source")).when(k == 2, "Airport disambiguation").when(k == 3, "hndis").otherwise(F.col("source"))
    whole = F.concat(F.lit("{{"), "lang", F.lit("|x}} "), "source", F.lit(" {{"), last, F.lit("}}"))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, whole).alias("wikitext"), (F.col("doc_id") % 4).alias("ns"), F.when(F.col("doc_id") % 11 == 0, F.col("source")).alias("redirect"))


@query(rf"SELECT id, i, t FROM (SELECT id, unnest(x) AS t, generate_subscripts(x, 1)::BIGINT AS i FROM (SELECT id, regexp_extract_all(wikitext, '\{{([^{{}}]+)\}}', 1) AS x FROM ({WIKITEXT})))")
def transclusions(spark, sf_dir):
    found = wikitexts(spark, sf_dir).select("id", F.posexplode(tx.transclusions(F.col("wikitext"))).alias("i", "t"))
    return found.select("id", (F.col("i") + 1).cast("long").alias("i"), "t")


LAST = rf"SELECT id, ns, redirect, list_last(regexp_extract_all(wikitext, '\{{([^{{}}]+)\}}', 1)) AS last FROM ({WIKITEXT})"


@query(f"SELECT last AS name, count(*)::BIGINT AS n FROM ({LAST}) WHERE last IS NOT NULL GROUP BY 1")
def last_transclusion_counts(spark, sf_dir):
    return wikitexts(spark, sf_dir).select(tx.last_transclusion(F.col("wikitext")).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT name, n FROM (SELECT *, avg(n) OVER () AS m FROM (SELECT last AS name, count(*)::BIGINT AS n FROM ({LAST}) WHERE last IS NOT NULL GROUP BY 1)) WHERE n > m")
def above_average_transclusions(spark, sf_dir):
    return tt.above_average(last_transclusion_counts(spark, sf_dir))


NS = "CASE ns WHEN 0 THEN 0 WHEN 1 THEN 14 WHEN 2 THEN 10 ELSE 6 END"


@query(f"SELECT id, CASE WHEN redirect IS NOT NULL THEN 3 WHEN {NS} = 14 THEN 2 WHEN {NS} = 10 THEN 5 WHEN {NS} = 0 THEN CASE WHEN lower(split_part(last, '|', 1)) IN ('dab', 'disambiguation', 'disambig', 'geodis', 'schooldis', 'call sign disambiguation', 'airport disambiguation', 'genus disambiguation', 'school disambiguation') THEN 4 ELSE 1 END ELSE 8 END AS page_type FROM ({LAST})")
def page_type_inference(spark, sf_dir):
    ns = F.when(F.col("ns") == 0, 0).when(F.col("ns") == 1, 14).when(F.col("ns") == 2, 10).otherwise(6)
    return wikitexts(spark, sf_dir).select("id", tt.page_type(ns, F.col("redirect"), tx.last_transclusion(F.col("wikitext")), ENGLISH.disambiguation_prefixes).alias("page_type"))


# titles and links


@query("SELECT title, page_id, hops::BIGINT AS hops FROM resolved_redirect")
def redirect_resolve(spark, sf_dir):
    return tt.resolve_redirects(Star(spark, sf_dir).redirecting)[0].withColumn("hops", F.col("hops").cast("long"))


@query("SELECT id, title, redirect_target FROM redirecting WHERE page_type = 3 AND title NOT IN (SELECT title FROM resolved_redirect)")
def dangling_redirects(spark, sf_dir):
    return tt.resolve_redirects(Star(spark, sf_dir).redirecting)[1]


@query("SELECT title, id AS page_id FROM redirecting WHERE page_type = 1 UNION SELECT title, page_id FROM resolved_redirect")
def title_map(spark, sf_dir):
    return tt.title_map(Star(spark, sf_dir).redirecting)


@query("SELECT source, destination, anchor_text FROM wlink")
def resolved_links(spark, sf_dir):
    return Wiki(spark, sf_dir).link


@query("SELECT source, target AS destination, anchor_text FROM wlocated WHERE destination IS NULL")
def dead_links(spark, sf_dir):
    return tt.dead_links(Wiki(spark, sf_dir).located)


@query("SELECT id, title, page_type FROM wpage WHERE id IN (0, 3, 8, 9, 17)")
def page_by_id(spark, sf_dir):
    """A point lookup of five ids."""
    return Wiki(spark, sf_dir).page.where(F.col("id").isin(0, 3, 8, 9, 17)).select("id", "title", "page_type")


@query("SELECT id, title, page_type FROM wpage WHERE title IN ('the', 'and', 'Page 5')")
def page_by_title(spark, sf_dir):
    return Wiki(spark, sf_dir).page.where(F.col("title").isin("the", "and", "Page 5")).select("id", "title", "page_type")


@query("SELECT CASE page_type WHEN 1 THEN 'ARTICLE' WHEN 2 THEN 'CATEGORY' ELSE 'DISAMBIGUATION' END AS kind, count(*)::BIGINT AS n, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id FROM wpage GROUP BY 1")
def pages_by_type(spark, sf_dir):
    return Wiki(spark, sf_dir).page.groupBy(tx.page_type_name(F.col("page_type")).alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT page_id, strlen(html)::BIGINT AS n_bytes FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def resume_scan(spark, sf_dir):
    """Pages that no earlier run has stored; the labelled ids stand for those that it has."""
    from ..sources.dump import remaining

    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    left = remaining(table(spark, sf_dir, "pages").withColumnRenamed("page_id", "id"), done)
    return left.select(F.col("id").alias("page_id"), F.octet_length("html").cast("long").alias("n_bytes"))


# tokens, n-grams, labels


@query(r"SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(x, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^ \t\n\r\f]') AS x FROM documents)")
def tokens(spark, sf_dir):
    found = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens_md5"))


@query("SELECT doc_id, label, n FROM occurrence")
def ngrams_vocab(spark, sf_dir):
    return Wiki(spark, sf_dir).occurrences


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([x FOR x IN [upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2), upper(left(p_name, 1)) || substr(p_name, 2)] IF x <> CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END])), '|') AS variants FROM part")
def case_variants(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(tx.case_variants(name)), "|").alias("variants"))


@query("SELECT label, sum(n)::BIGINT AS occurrence_count, count(*)::BIGINT AS occurrence_doc_count FROM occurrence GROUP BY 1")
def label_occurrence_stats(spark, sf_dir):
    return lb.occurrence_stats(Wiki(spark, sf_dir).occurrences)


@query("SELECT label, link_count, link_doc_count, occurrence_count, occurrence_doc_count, round(link_probability, 9) AS link_probability FROM wlabel")
def link_probability(spark, sf_dir):
    return Wiki(spark, sf_dir).labels.withColumn("link_probability", r("link_probability", 9))


@query("SELECT label, row_number() OVER (ORDER BY label) AS id FROM wlabel")
def label_ids(spark, sf_dir):
    return lb.with_ids(Wiki(spark, sf_dir).labels.select("label")).select("label", "id")


@query("SELECT label, link_doc_count FROM usable")
def usable_labels(spark, sf_dir):
    return Wiki(spark, sf_dir).usable.select("label", "link_doc_count")


SPANS = "SELECT l_orderkey AS doc_id, (l_partkey % 40)::INT AS s, (l_partkey % 40 + 1 + l_suppkey % 9)::INT AS e, l_linenumber % 2 = 0 AS f, l_linenumber AS tie FROM lineitem"


@query(f"SELECT doc_id, s AS start, e AS \"end\", tie FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, f DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({SPANS})) WHERE m IS NULL OR e > m")
def shadow_filter(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), (F.col("l_linenumber") % 2 == 0).alias("first"), F.col("l_linenumber").alias("tie"))
    return lb.unshadowed(spans, ["doc_id"], "tie").drop("first")


@query("SELECT strftime(d, '%B ') || day(d) AS label FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS d)")
def date_labels(spark, sf_dir):
    return cx.date_labels(spark)


# contexts, senses, topics


@query("SELECT doc_id, page_id, round(weight, 6) AS weight FROM candidate")
def context_link_weight(spark, sf_dir):
    return Wiki(spark, sf_dir).candidates().withColumn("weight", r("weight"))


@query("SELECT doc_id, page_id, round(weight, 6) AS weight FROM broad_candidate")
def context_broad_weight(spark, sf_dir):
    return Wiki(spark, sf_dir).candidates(True).withColumn("weight", r("weight"))


@query("SELECT doc_id, page_id, round(weight, 6) AS weight FROM context")
def context_rerank(spark, sf_dir):
    return Wiki(spark, sf_dir).context.withColumn("weight", r("weight"))


@query("SELECT doc_id, round(sum(weight), 6) AS quality, count(*)::BIGINT AS pages FROM context GROUP BY 1")
def context_quality(spark, sf_dir):
    return cx.quality(Wiki(spark, sf_dir).context).withColumn("quality", r("quality"))


def sense_features(wiki: Wiki) -> DataFrame:
    return lk.sense_candidates(wiki.doc_labels, wiki.senses, wiki.context, wiki.compared)


@query("SELECT doc_id, page_id, round(CASE WHEN quality > 0 THEN relatedness ELSE 0 END, 6) AS relatedness FROM sense_related")
def relatedness_to_context(spark, sf_dir):
    wiki = Wiki(spark, sf_dir)
    pages = wiki.doc_labels.join(wiki.senses, "label").select("doc_id", F.col("destination").alias("page_id")).distinct()
    found = rl.to_context(pages, wiki.context, wiki.compared)
    return found.select("doc_id", "page_id", r("relatedness").alias("relatedness"))


@query("SELECT doc_id, label, page_id, round(confidence, 6) AS confidence FROM soft_sense")
def softmax_group(spark, sf_dir):
    scored = sense_features(Wiki(spark, sf_dir)).withColumn("score", lk.linear_score(lk.SENSE_WEIGHTS))
    return scored.select("doc_id", "label", "page_id", r(lk.softmax(F.col("score"), Window.partitionBy("doc_id", "label"))).alias("confidence"))


@query("SELECT doc_id, label, page_id, round(confidence, 6) AS confidence FROM best_sense")
def resolve_best_sense(spark, sf_dir):
    best = lk.best_senses(sense_features(Wiki(spark, sf_dir)), lk.linear_score(lk.SENSE_WEIGHTS))
    return best.withColumn("confidence", r("confidence"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS score FROM events")
def sigmoid_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r(me.sigmoid((F.col("value") - 50) / 10), 9).alias("score"))


# training sets and metrics

PROFILE = TrainingProfile(min_out_links=2, min_in_links=2, max_list_proportion=0.9, min_word_count=20, max_word_count=4000)


def list_items(documents: DataFrame) -> DataFrame:
    """(doc_id, list_items) of documents read as markup."""
    from ..functions.wikitext import parsed

    return parsed(documents.select(F.col("doc_id").alias("id"), F.col("text").alias("wikitext"))).select(F.col("id").alias("doc_id"), "list_items")


@query(r"SELECT id FROM wpage JOIN documents ON doc_id = id WHERE page_type = 1 AND (SELECT count(*) FROM wlink WHERE source = id) >= 2 AND (SELECT count(*) FROM wlink WHERE destination = id) >= 2 AND len(string_split_regex(regexp_replace(text, '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]+')) BETWEEN 20 AND 4000 AND (SELECT CASE WHEN count(*) FILTER (length(trim(replace(replace(x, ':', ' '), ';', ' '))) > 5) > 0 THEN count(*) FILTER (regexp_matches(x, '^[*#:;]')) / count(*) FILTER (length(trim(replace(replace(x, ':', ' '), ';', ' '))) > 5) ELSE 1 END FROM (SELECT unnest(string_split(text, chr(10))) AS x)) <= 0.9")
def article_selection(spark, sf_dir):
    wiki = Wiki(spark, sf_dir)
    texts = wiki.documents.join(list_items(wiki.documents), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("text").alias("wikitext"), "list_items")
    return tr.eligible(wiki.page, wiki.link, texts, PROFILE)


@query("SELECT CASE WHEN place <= 20 THEN 'train' WHEN place <= 30 THEN 'validate' ELSE 'test' END AS group_name, id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || '-1'), id) AS place FROM wpage WHERE page_type = 1) WHERE place <= 40")
def disjoint_samples(spark, sf_dir):
    """Sampling is the operator: groups of 20, 10 and 10 articles."""
    ids = Wiki(spark, sf_dir).page.where("page_type = 1").select("id")
    return tr.disjoint_samples(ids, (("train", 20), ("validate", 10), ("test", 10)))


@query("SELECT user_id, event_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS group_id FROM (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS c FROM events)")
def group_ids_islands(spark, sf_dir):
    return tr.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_id", "event_type", ["user_id"])


RANKED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error')::INT DESC, event_id) AS i FROM events"


@query(f"SELECT count(*)::BIGINT AS n_groups, round(avg(top), 6) AS accuracy, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg FROM (SELECT user_id, max(CASE WHEN p = 1 THEN (event_type = 'error')::INT ELSE 0 END) AS top, sum((event_type = 'error')::INT / log2(p + 1)) AS dcg, sum((event_type = 'error')::INT / log2(i + 1)) AS idcg FROM ({RANKED}) GROUP BY 1)")
def ranking_accuracy_ndcg(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("truth", F.col("event_type") == "error")
    return ev.ranking_metrics(rows, ["user_id"], "value", "truth", "event_id").select("n_groups", r("accuracy").alias("accuracy"), r("ndcg").alias("ndcg"))


BINARY = "SELECT (value / 100)::DOUBLE AS s, event_type = 'error' AS t FROM events"


@query(f"SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(wins / (p * q), 6) AS auc FROM (SELECT count(*) FILTER (s >= 0.5 AND t) AS tp, count(*) FILTER (s >= 0.5 AND NOT t) AS fp, count(*) FILTER (s < 0.5 AND t) AS fn, count(*) FILTER (s < 0.5 AND NOT t) AS tn FROM ({BINARY})), (SELECT sum(pos * (below + neg / 2)) AS wins, sum(pos) AS p, sum(neg) AS q FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM (SELECT s, count(*) FILTER (t) AS pos, count(*) FILTER (NOT t) AS neg FROM ({BINARY}) GROUP BY 1)))")
def binary_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("s"), (F.col("event_type") == "error").alias("t"))
    return ev.binary_metrics(rows, "s", "t").select("tp", "fp", "fn", "tn", *(r(c).alias(c) for c in ("precision", "recall", "f1", "auc")))


@query("SELECT count(*) FILTER (value > 80)::BIGINT AS high, count(*) FILTER (value BETWEEN 20 AND 80)::BIGINT AS middle, count(*) FILTER (value < 20)::BIGINT AS low FROM events")
def confidence_histogram(spark, sf_dir):
    return ev.confidence_histogram(table(spark, sf_dir, "events").select((F.col("value") / 100).alias("s")), "s")


@query("SELECT quality, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM labels GROUP BY 1")
def target_distribution(spark, sf_dir):
    return ev.target_distribution(table(spark, sf_dir, "labels"), "quality").withColumn("percent", r("percent"))


@query("SELECT count(*) FILTER (text IS NULL)::BIGINT AS text, count(*) FILTER (lang IS NULL)::BIGINT AS lang, count(*) FILTER (source IS NULL)::BIGINT AS source FROM documents")
def missing_values(spark, sf_dir):
    return ev.missing_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("SELECT count(*)::BIGINT AS n_groups, min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest, round(avg(n), 6) AS mean_size, count(*) FILTER (t = 0)::BIGINT AS without_truth FROM (SELECT user_id, count(*) AS n, max((event_type = 'error')::INT) AS t FROM events GROUP BY 1)")
def group_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("event_type") == "error")
    return ev.group_statistics(rows, "user_id", "t").withColumn("mean_size", r("mean_size"))


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '-1'), doc_id) - 1) % 5)::BIGINT AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return tr.stratified_folds(rows, "quality", F.struct(tr.sample_order(F.col("doc_id")), "doc_id"))


@query("SELECT DISTINCT source, (('0x' || substr(md5(source), 1, 8))::BIGINT % 5)::BIGINT AS fold FROM documents")
def group_folds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", tr.fold_of(F.col("source")).alias("fold")).distinct()


# text, models, sources: no SQL twin; tests hold them against golden cases or plain Python


@query()
def wikitext_parse(spark, sf_dir):
    from ..functions.wikitext import parsed

    d = table(spark, sf_dir, "documents")
    markup = F.concat(F.lit("'''"), "source", F.lit("''' {{info|"), "lang", F.lit("}} see [["), "lang", F.lit("|"), "source", F.lit("]]s.\n* [[File:x.png|thumb|"), "source", F.lit("]]\n"), "text")
    out = parsed(d.select(F.col("doc_id").alias("id"), markup.alias("wikitext")))
    return out.select("id", F.coalesce("snippet.first_paragraph", "snippet.first_sentence").alias("excerpt"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("links").alias("n_links"))


@query()
def label_documents(spark, sf_dir):
    from ..api import Graph, label_documents as run

    wiki = Wiki(spark, sf_dir)
    found = run(wiki.documents, Graph.of_wiki(wiki))
    return found.select("doc_id", "page_id", r("prediction").alias("prediction"), r("weight").alias("weight"))


@query("SELECT page_id AS id, 'Title ' || page_id AS title, 1 AS page_type, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, epoch_ms(TIMESTAMP '2024-01-01' + to_days((page_id % 300)::INT))::BIGINT AS last_edited FROM (SELECT page_id, nullif(trim(replace(replace(html, chr(160), ' '), '&nbsp;', ' ')), '') AS text FROM pages)")
def xml_dump_scan(spark, sf_dir):
    """Writes the pages, with their whole html as text, as an XML dump to the shared folder and scans it."""
    from ..sources.dump import read_pages, written_dump

    pages = table(spark, sf_dir, "pages")
    stamp = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").alias("id"), F.lit(0).alias("ns"), F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("redirect"), stamp.alias("timestamp"), F.col("html").alias("text"))
    found = read_pages(spark, written_dump(rows), ENGLISH)
    return found.select("id", "title", "page_type", F.length("wikitext").cast("long").alias("n_chars"), F.md5(F.col("wikitext").cast("binary")).alias("text_md5"), "last_edited")


@query()
def streaming_labels(spark, sf_dir):
    """The documents as a stream of files; each batch's label occurrences are appended, and counted at the end."""
    from ..streaming.labels import stream_occurrences

    wiki = Wiki(spark, sf_dir)
    return lb.occurrence_stats(stream_occurrences(spark, f"{sf_dir}/documents.parquet", wiki.documents.schema, wiki.anchors))


SQL["streaming_labels"] = SQL["label_occurrence_stats"]
