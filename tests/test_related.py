"""Queries of relatedness, n-grams, topics and excerpts against plain Python, and over all rows."""

import functools
import hashlib
import math

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from knotwork.operators import relatedness as rl
from knotwork.functions import wikitext as wt
from knotwork.plans import bridge, registry, related
from test_operators import brute_compare


@pytest.fixture(scope="module")
def wide_dir(spark, tmp_path_factory):
    """A table of 120 pages; page k links to the titles of the two after it, so that there are many of an id over 80."""
    path = str(tmp_path_factory.mktemp("wide"))
    name = lambda k: f"p{k % 120:03d}"
    html = lambda k: "".join(f'<a href="/{name(k + i)}">word {name(k + i)}</a>' for i in (1, 2))
    spark.createDataFrame([(k, f"https://x.org/{k}", html(k)) for k in range(120)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, "word p001 and word p002")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def wide_wiki(spark, wide_dir):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(related, "Wiki", functools.cache(bridge.Wiki))
        yield


@pytest.mark.parametrize("name", ["common_links", "lf_iaf_cosine", "page_comparison", "link_distance", "link_weights"])
def test_pages_beyond_80_are_kept(spark, wide_dir, wide_wiki, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{wide_dir}/{t}.parquet/*.parquet'")
    own = registry.queries()[name](spark, wide_dir)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    plain = lambda rows: sorted(tuple(round(float(x), 5) if isinstance(x, float) else x for x in row) for row in rows)
    found = plain(own.select(*names).collect())
    assert found == plain(got.fetchall())
    ids = {row[names.index("page_id" if "page_id" in names else "b")] for row in found}
    assert {81, 100, 119} <= ids
    if name in ("common_links", "link_distance"):
        pairs = {(row[names.index("a")], row[names.index("b")]) for row in found}
        assert pairs == {(min(k, (k + 1) % 120), max(k, (k + 1) % 120)) for k in range(120)}


def test_all_customers_count(spark, sf_dir):
    found = {r["title"]: r["frequency"] for r in entry.entry(spark).collect()}
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = {r["n_name"]: r["count"] for r in customers.groupBy("n_name").count().collect()}
    assert len(found) == min(20, len(counts)) and all(counts[k] == v for k, v in found.items())


def runs(text, longest):
    """Every run of up to ``longest`` tokens of each line, by plain Python."""
    for line in text.split("\n"):
        at = [m.span() for m in regex.finditer(r"[\p{L}\p{M}]+|\p{N}+|[^ \t\n\r\f]", line)]
        for i in range(len(at)):
            for j in range(i, min(i + longest, len(at))):
                yield line[at[i][0] : at[j][1]]


def case(content):
    words = [t for t in regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[^ \t\n\r\f]", content) if regex.search(r"\p{L}", t)]
    for name, pattern in (("UPPER", r"\p{Lu}+"), ("LOWER", r"\p{Ll}+"), ("UPPER_FIRST", r"\p{Lu}+|\p{Lu}\p{Ll}*")):
        if words and all(regex.fullmatch(pattern, t) for t in words):
            return name
    return "MIXED"


def test_ngrams_of_ten_tokens(spark, tmp_path):
    texts = {1: "One two THREE four five six seven eight nine ten eleven, twelve.", 2: "a a a a a a a a a a a a\nNEW YORK", 3: "", 4: "Über 12 Ça va"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: list(runs(t, 10)) for k, t in texts.items()}
    lines = {r["doc_id"]: (r["n"], r["n_distinct"], r["last"]) for r in registry.queries()["ngrams_line"](spark, str(tmp_path)).collect()}
    assert lines == {k: (len(v), len(set(v)), max(v, key=lambda x: x.encode())) for k, v in want.items() if v}
    assert "One two THREE four five six seven eight nine ten" in want[1]
    cases = {}
    for x in {x for v in want.values() for x in v}:
        digest = hashlib.md5(x.encode()).hexdigest()
        n, total = cases.get((case(x), digest[:2]), (0, 0))
        cases[case(x), digest[:2]] = n + 1, total + int(digest[2:10], 16)
    assert {(r["case_context"], r["bucket"]): (r["n"], r["checksum"]) for r in registry.queries()["case_context"](spark, str(tmp_path)).collect()} == cases


def test_excerpts_are_first_paragraphs(spark, tmp_path):
    texts = {1: "Head\nOne sentence. And more of it.\nNext.", 2: "Only one", 3: "", 4: None, 5: "''Slanted'' is [[x|this]]. It is (ok)."}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["page_id"]: r["first_paragraph"] for r in registry.queries()["excerpts"](spark, str(tmp_path)).collect()}
    assert found == {1: "One sentence. And more of it.", 2: "Only one", 5: "Slanted is this. It is (ok)."}
    assert all(found[k] == (wt.parse(texts[k])["snippet"]["first_paragraph"] or wt.parse(texts[k])["snippet"]["first_sentence"]) for k in found)


def test_links_and_senses_with_relatedness(spark, tmp_path, monkeypatch):
    """Pages link to the three after them; 59 link "mercury" to page 1, and one to page 2: a sense of 1 in 60."""
    monkeypatch.setattr(related, "Wiki", functools.cache(bridge.Wiki))
    a = lambda k, text: f'<a href="/p{k % 120:03d}">{text}</a>'
    html = lambda k: "".join(a(k + i, f"topic{(k + i) % 120:03d}") for i in (1, 2, 3)) + (a(1, "mercury") if k < 60 else a(2, "mercury") if k == 61 else "")
    spark.createDataFrame([(k, "u", html(k)) for k in range(120)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = {1: "mercury and topic005 topic006 topic007 topic020\nmercury", 2: "topic030 topic031"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wiki = related.Wiki(spark, str(tmp_path))
    links, n = [(r["source"], r["destination"]) for r in wiki.link.collect()], wiki.n_articles
    compare = functools.cache(lambda a, b: brute_compare(links, a, b, n))
    context = {}
    for r in wiki.context.collect():
        context.setdefault(r["doc_id"], {})[r["page_id"]] = r["weight"]
    topics = {(r["doc_id"], r["page_id"]): r for r in registry.queries()["topic_features"](spark, str(tmp_path)).collect()}
    best = {(r["doc_id"], r["label"]): r["page_id"] for r in registry.queries()["resolved_places"](spark, str(tmp_path)).collect()}
    assert {d for d, _ in topics} <= {1, 2} and len(topics) > 2
    heavy = {d: {p: r["avg_link_probability"] * r["normalized_occurrences"] for (e, p), r in topics.items() if e == d} for d, _ in topics}
    mean = lambda p, others: sum(w * sum(compare(p, q)) / 4 for q, w in others.items() if q != p) / len(others)
    for (d, p), t in topics.items():
        to_context, to_others = mean(p, context[d]), mean(p, heavy[d])
        score = 3 * t["avg_link_probability"] + 2 * to_context + 2 * to_others + t["avg_confidence"] + t["normalized_occurrences"] / 2 - 3
        assert (t["relatedness_to_context"], t["relatedness_to_others"], t["prediction"]) == pytest.approx((to_context, to_others, 1 / (1 + math.exp(-score))), abs=3e-6)
        labels = [x for (e, x), q in best.items() if (e, q) == (d, p)]
        at = [m.start() for x in labels for m in regex.finditer(x, docs[d])]
        # each place counts all the matches of its label
        assert t["normalized_occurrences"] == pytest.approx(math.log(sum(docs[d].count(x) ** 2 for x in labels) + 1), abs=1e-6)
        assert (t["first_occurrence"], t["last_occurrence"]) == pytest.approx((min(at) / len(docs[d]), max(at) / len(docs[d])), abs=1e-6)
    assert any(t["relatedness_to_context"] > 0.01 and t["relatedness_to_others"] > 0.01 for t in topics.values())
    examples = registry.queries()["wsd_examples"](spark, str(tmp_path)).where("source in (3, 61)").collect()
    by_source = {}
    for r in wiki.made["training_context"].collect():
        by_source.setdefault(r["source"], {})[r["page_id"]] = r["weight"]
    assert {(r["source"], r["page_id"], r["commonness"], r["is_correct"]) for r in examples} == {(s, p, round(c / 60, 6), p == d) for s, d in ((3, 1), (61, 2)) for p, c in ((1, 59), (2, 1))}
    for r in examples:
        others = by_source[r["source"]]
        want = [sum(compare(r["page_id"], q)[i] for q in others if q != r["page_id"]) / len(others) for i in range(4)]
        assert [r[m] for m in rl.MEASURES] + [r["quality"]] == pytest.approx([*want, sum(others.values())], abs=2e-6)


def test_pairs_of_like_pages_meet_once(spark, monkeypatch):
    """300 pages with the same links and 3 others: every pair is listed, but the links of like pages are joined once."""
    from knotwork.operators import relatedness as rl

    links = {k: {1: 0.5, 2: 0.25} for k in range(300)} | {300: {2: 1.0}, 301: {1: 0.5, 3: 2.0}, 302: {4: 1.0}}
    rows = [("out", k, link, w) for k, x in links.items() for link, w in x.items()] + [("in", 5, 300, 1.0), ("in", 6, 300, 3.0)]
    weighted = spark.createDataFrame(rows, "dir string, page_id long, link long, w double")
    joined, sums = [], rl.link_sums
    monkeypatch.setattr(rl, "link_sums", lambda met: joined.append(met.count()) or sums(met))
    found = {(r["dir"], r["a"], r["b"]): (r["common"], r["dot"], r["square_a"], r["square_b"]) for r in rl.all_common_links(weighted).collect()}
    by = {}
    for d, k, link, w in rows:
        by.setdefault((d, k), {})[link] = w
    want = {}
    for (d, a), x in by.items():
        for (e, b), y in by.items():
            if d == e and a < b and (both := x.keys() & y.keys()):
                want[d, a, b] = len(both), sum(x[i] * y[i] for i in both), sum(x[i] ** 2 for i in both), sum(y[i] ** 2 for i in both)
    assert found == want and len(want) > 44_000
    assert joined[0] < 50
    sizes = weighted.groupBy("dir", "page_id").agg(F.count("*").alias("size"))
    measured = {(r["a"], r["b"]): r for r in rl.compare(None, weighted, sizes, 400).collect()}
    assert measured.keys() == {(a, b) for _, a, b in want} and joined[1] < 50
    asked = spark.createDataFrame([(0, 1), (0, 300), (5, 6), (0, 301)], "a long, b long")
    for r in rl.compare(asked, weighted, sizes, 400).collect():
        assert all(abs(r[m] - measured[r["a"], r["b"]][m]) < 1e-12 for m in (*rl.MEASURES, "mean"))
