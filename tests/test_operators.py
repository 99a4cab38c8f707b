"""Operators, sources, the mining phases and the queries' twins."""

import functools
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from knotwork import api, mining, storage
from knotwork.config import LANGUAGES, Language, TrainingProfile
from knotwork.operators import context as cx
from knotwork.operators import evaluation as ev
from knotwork.operators import graph as gr
from knotwork.operators import labels as lb
from knotwork.operators import linking as lk
from knotwork.operators import relatedness as rl
from knotwork.operators import titles as tt
from knotwork.operators import training as tr
from knotwork.plans import bridge, more, queries, registry, related
from knotwork.sources import dump, tables
from knotwork.storage import new_path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_wiki():
    """The queries share what they derive from the pages; each still runs its own operators."""
    with pytest.MonkeyPatch.context() as patch:
        shared = functools.cache(bridge.Wiki)
        patch.setattr(queries, "Wiki", shared)
        patch.setattr(more, "Wiki", shared)
        patch.setattr(related, "Wiki", shared)
        yield


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    own = registry.queries()[name](spark, sf_dir)
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(own.columns) == sorted(names)
    assert rows_of(own.columns, own.collect()) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    # the smallest tables make too small a graph for topics and for labels of several senses
    larger = name in ("label_documents", "wsd_examples")
    out = registry.queries()[name](spark, "/root/testdata/sf0.01" if larger else sf_dir)
    assert out.columns and out.count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_redirect_chains(spark):
    page = [(1, 1, "End", None)] + [(10 + i, 3, f"R{i}", f"R{i - 1}" if i else "End") for i in range(20)] + [(50, 3, "Loop", "Pool"), (51, 3, "Pool", "Loop"), (52, 3, "Lost", "Nowhere"), (53, 3, "End", "Lost"), (54, 3, "Twice", "End"), (55, 3, "Twice", "Lost")]
    frame = spark.createDataFrame(page, "id long, page_type int, title string, redirect_target string")
    found, lost = tt.resolve_redirects(frame)
    assert {r["title"]: r["hops"] for r in found.collect()} == {f"R{i}": i + 1 for i in range(15)} | {"Twice": 1}
    assert {r["title"] for r in lost.collect()} == {f"R{i}" for i in range(15, 20)} | {"Loop", "Pool", "Lost"}
    assert tt.title_map(frame).count() == 17


def test_shadow_filter(spark):
    spans = [(2, 9), (4, 7), (9, 12), (11, 20), (11, 14), (20, 21)]
    frame = spark.createDataFrame([(1, a, b, False, i) for i, (a, b) in enumerate(spans)], "d int, start int, end int, first boolean, tie int")
    kept = lb.unshadowed(frame, ["d"], "tie")
    assert sorted((r["start"], r["end"]) for r in kept.collect()) == [(2, 9), (9, 12), (11, 20), (20, 21)]
    assert lb.unshadowed(kept, ["d"], "tie").count() == 4


def test_detection(spark):
    docs = spark.createDataFrame([(1, "Mercury is hot. We love iceland and NEW YORK-city; apple pie."), (2, ""), (3, None)], "doc_id long, text string")
    usable = spark.createDataFrame([("Mercury",), ("mercury",), ("Iceland",), ("New York",), ("apple",), ("Apple",), ("apple pie",), ("York",)], "label string")
    found = sorted((r["label"], r["kind"]) for r in lb.detect(docs, usable).collect())
    assert found == [("Iceland", "recased"), ("Mercury", "natural"), ("New York", "recased"), ("apple pie", "natural"), ("mercury", "downcased")]


def test_label_ids(spark):
    labels = spark.createDataFrame([(x,) for x in ("b", "a", "ä", "Z", "zz")], "label string")
    assert {r["label"]: r["id"] for r in lb.with_ids(labels).collect()} == {"Z": 1, "a": 2, "b": 3, "zz": 4, "ä": 5}


def brute_compare(links, a, b, n):
    into, out = {}, {}
    for s, d in links:
        into.setdefault(d, []).append(s)
        out.setdefault(s, []).append(d)
    result = []
    for arms in (into, out):
        x, y = arms.get(a, []), arms.get(b, [])
        common = [k for k in set(x) & set(y) if arms.get(k)]
        weight = lambda v, k: (0.5 + 0.5 * v.count(k) / max(map(v.count, v))) * math.log(n / len(set(arms[k])))
        wa, wb = [weight(x, k) for k in common], [weight(y, k) for k in common]
        norm = math.sqrt(sum(w * w for w in wa) * sum(w * w for w in wb))
        cosine = sum(p * q for p, q in zip(wa, wb)) / norm if norm else 0.0
        big, small = max(len(set(x)), len(set(y))), min(len(set(x)), len(set(y)))
        plain = 0.0 if not common else max(0, 1 - (math.log(big) - math.log(len(common))) / (math.log(n) - math.log(small)))
        low = 1 - math.log(n - 1) / math.log(n)
        result.append((cosine, (plain - low) / (1 - low)))
    return [result[0][0], result[1][0], result[0][1], result[1][1]]


def test_comparison(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(90)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in links], "source long, destination long, anchor_text string")
    pairs = spark.createDataFrame([(a, b) for a in range(15) for b in range(a + 1, 15)], "a long, b long")
    for r in rl.compare(pairs, *rl.vectors(frame, 40), 40).collect():
        want = brute_compare(links, r["a"], r["b"], 40)
        assert [r[m] for m in rl.MEASURES] == pytest.approx(want) and r["mean"] == pytest.approx(sum(want) / 4)


def test_softmax_and_best(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(1, "a", 1, 0.5), (1, "a", 2, 2.0), (1, "b", 3, -900.0), (2, "a", 1, 1.0), (2, "a", 9, 1.0)], "doc_id long, label string, page_id long, s double")
    shares = rows.withColumn("c", lk.softmax(F.col("s"), Window.partitionBy("doc_id", "label"))).groupBy("doc_id", "label").agg(F.sum("c").alias("t"))
    assert all(abs(r["t"] - 1) < 1e-12 for r in shares.collect())
    best = {(r["doc_id"], r["label"]): (r["page_id"], round(r["confidence"], 6)) for r in lk.best_senses(rows, F.col("s")).collect()}
    assert best == {(1, "a"): (2, 0.817574), (1, "b"): (3, 1.0), (2, "a"): (1, 0.5)}


def test_list_ratio(spark):
    from knotwork.functions.wikitext import parsed

    texts = ["* one item\n* two item\nplain line here\n:;", "", "short", "* one item\nplain line here\nanother line\nand more text", "{|\n| * no item in a cell\n|}\n<!--\n* gone in a comment\n-->\nplain line here"]
    rows = parsed(spark.createDataFrame(list(enumerate(texts)), "id long, wikitext string"))
    found = {r["id"]: r["x"] for r in rows.select("id", tr.list_ratio(F.col("wikitext"), F.col("list_items")).alias("x")).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.25, 4: 0.0}


def test_samples_are_disjoint(spark):
    out = tr.disjoint_samples(spark.range(100), (("a", 10), ("b", 5))).collect()
    assert len({r["id"] for r in out}) == 15 and sum(r["group_name"] == "a" for r in out) == 10


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, True, 1), (1, 0.1, False, 2), (2, 0.8, False, 3), (2, 0.3, True, 4), (3, 0.5, False, 5)], "g int, s double, t boolean, id int")
    m = ev.ranking_metrics(rows, ["g"], "s", "t", "id").first()
    assert m["n_groups"] == 3 and m["accuracy"] == pytest.approx(1 / 3) and m["ndcg"] == pytest.approx((1 + 1 / math.log2(3)) / 3)
    b = ev.binary_metrics(rows, "s", "t").first()
    assert (b["tp"], b["fp"], b["fn"], b["tn"]) == (1, 2, 1, 1) and b["auc"] == pytest.approx(4 / 6)
    assert ev.validate(rows, ("s",), "t", least=3) == [] and ev.validate(rows, ("none",), "t") == ["missing column none"]
    assert ev.validate(rows, ("s",), "t")[0] == "only 5 rows"


def test_models(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, x, rng.random(), float(x > 0.5)) for i, x in enumerate(rng.random() for _ in range(200))], "id int, x double, y double, t double")
    model = ev.boosted_trees(("x", "y"), "t", rounds=3, depth=2).fit(rows)
    path = f"{tmp_path}/model"
    tables.save_model(model, path)
    again = tables.load_model(path)
    assert [r["probability"] for r in again.transform(rows).collect()] == [r["probability"] for r in model.transform(rows).collect()]
    assert ev.importances(again, ("x", "y"))[0][0] == "x"
    folded = tr.stratified_folds(rows, "t", F.col("id"), 2)
    assert ev.cross_validated(folded, ("x", "y"), "t", "fold", 2, rounds=3, depth=2).count() == 200


def test_writes(spark):
    t = tables.Tables(spark, new_path(spark, "tables"))
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id int, v string, seq int")
    assert {(r["id"], r["v"]) for r in tables.first_wins(rows, ["id"], "seq").collect()} == {(1, "a"), (2, "c")}
    assert {(r["id"], r["v"]) for r in tables.last_wins(rows, ["id"], "seq").collect()} == {(1, "b"), (2, "c")}
    out = t.write("namespace", spark.createDataFrame([(0, "FIRST_LETTER", "")], "id long, casing string, name string"))
    assert out.schema["id"].dataType.simpleString() == "int" and t.has("namespace") and not t.has("page")
    ledger = tables.Ledger(t)
    assert ledger.state(1) is None
    ledger.put(1, "CREATED", "x")
    assert ledger.state(1) == "CREATED"
    ledger.put(1, "COMPLETED", "x")
    assert ledger.state(1) == "COMPLETED"
    log = tables.Log(t)
    log.write("INFO", "begun")
    assert log.since(0).first()["message"] == "begun"
    assert tables.max_id(rows.withColumnRenamed("id", "page_id")) == 2 and tables.max_id(rows.limit(0).withColumnRenamed("id", "page_id")) == 0
    assert tables.in_range(rows.withColumnRenamed("id", "page_id"), 2, 3).count() == 1
    path = tables.export_csv(rows, t.path, "en", "train")
    assert path.endswith("wiki_en_train") and spark.read.option("header", True).csv(path).columns == ["id", "v", "seq"]


SITE = '<siteinfo><sitename>W</sitename><dbname>w</dbname><base>b</base><case>first-letter</case><namespaces><namespace key="-1" case="first-letter">Special</namespace><namespace key="0" case="first-letter" /><namespace key="6" case="first-letter">File</namespace><namespace key="10" case="first-letter">Template</namespace><namespace key="14" case="case-sensitive">Category</namespace></namespaces></siteinfo>'


def dump_file(path, pages):
    body = "".join(
        f'<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{f"<redirect title={chr(34)}{to}{chr(34)} />" if to else ""}<revision><id>9</id><timestamp>2016-05-18T00:32:19Z</timestamp><text xml:space="preserve">{text}</text></revision></page>\n'
        for i, ns, t, to, text in pages
    )
    path.write_text(f"<mediawiki>\n{SITE}\n{body}</mediawiki>\n")
    return str(path)


def test_dump(spark, tmp_path):
    import bz2

    import zstandard

    path = dump_file(tmp_path / "d.xml", [(1, 0, "A", None, "x&nbsp;&amp;nbsp;y é"), (2, 0, "B", "A", "#R"), (3, 14, "Category:C", None, ""), (4, 0, "D", None, "{{Disambig|x}}"), (5, 10, "T", None, " "), (6, 4, "P", None, "z")])
    raw = open(path, "rb").read().replace(b"x&nbsp;", b"x ")
    (tmp_path / "d.xml").write_bytes(raw)
    (tmp_path / "e.xml.bz2").write_bytes(bz2.compress(raw))
    (tmp_path / "f.xml.zst").write_bytes(zstandard.compress(raw))
    for name in ("d.xml", "e.xml.bz2", "f.xml.zst"):
        rows = {r["id"]: r for r in dump.read_pages(spark, str(tmp_path / name)).collect()}
        assert {i: r["page_type"] for i, r in rows.items()} == {1: 1, 2: 3, 3: 2, 4: 4, 5: 5, 6: 8}
        assert rows[1]["wikitext"] == "x  y é" and rows[1]["markup_size"] == 7 and rows[1]["last_edited"] == 1463531539000
        assert rows[2]["redirect_target"] == "A" and rows[3]["markup_size"] is None and rows[5]["wikitext"] is None
        assert {r["id"]: r["casing"] for r in dump.site_info(spark, str(tmp_path / name)).collect()}[14] == "CASE_SENSITIVE"
    with pytest.raises(ValueError):
        dump.readable(spark, "dump.gz")
    (tmp_path / "bad.xml").write_bytes(raw.replace(b'key="14"', b'key="15"'))
    with pytest.raises(ValueError):
        dump.site_info(spark, str(tmp_path / "bad.xml"))
    done = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert dump.remaining(spark.range(1, 5), done).count() == 2


@pytest.fixture(scope="module")
def mine(spark, tmp_path_factory):
    """A small wiki: planets, gods and metals that share the label Mercury."""
    rng = random.Random(4)
    pages = [(1, 0, "Mercury (planet)", None), (2, 0, "Mercury (element)", None), (3, 0, "Orbit", None), (4, 0, "Metal", None), (5, 14, "Category:Planets", None), (6, 14, "Category:Elements", None)]
    text = {i: "" for i, *_ in pages}
    filler = " ".join(["plain words stand here to make it long enough."] * 4)
    body = lambda links: f"A page. It tells of {' and '.join(links)}. {filler}"
    text[1] = body(["[[Orbit]]", "[[Metal]]", "[[Category:Planets]]"])
    text[2] = body(["[[Metal]]", "[[Orbit]]", "[[Category:Elements]]"])
    text[3], text[4] = body(["[[Mercury (planet)|Mercury]]", "[[Metal]]"]), body(["[[Mercury (element)|Mercury]]", "[[Orbit]]"])
    for i in range(10, 40):
        sky = i % 2 == 0
        pages.append((i, 0, f"Page {i}", None))
        links = [f"[[Mercury ({'planet' if sky else 'element'})|Mercury]]", "[[Orbit]]" if sky else "[[Metal]]", f"[[page {rng.randint(10, 39)}]]", f"[[Category:{'Planets' if sky else 'Elements'}]]", "[[Nowhere]]", "[[quick silver]]"]
        text[i] = body(links)
    pages.append((60, 0, "Quick silver", "Mercury (element)"))
    path = dump_file(tmp_path_factory.mktemp("dump") / "wiki.xml", [(i, ns, t, to, text.get(i, "#REDIRECT")) for i, ns, t, to in pages])
    profile = TrainingProfile(1, 2, 0.9, 5, 4000, (("train", 6), ("test", 3)), (("links", 3), ("more-links", 2)))
    return mining.Mine(spark, path, new_path(spark, "wiki"), Language("en", "English", ("disambig",), profile))


def test_phases(spark, mine):
    assert mine.run() == [1, 2, 3, 4, 5, 6, 7]
    assert mine.run() == []  # all are completed
    t = mine.tables
    assert t.read("dead_link").select("destination").distinct().first()[0] == "Nowhere"
    assert {r["destination"] for r in t.read("link").where("anchor_text = 'quick silver'").collect()} == {2}
    senses = {r["destination"]: r["n"] for r in t.read("sense").where("label = 'Mercury'").collect()}
    assert senses == {1: 16, 2: 16}
    label = t.read("label").where("label = 'Mercury'").first()
    assert label["link_count"] == 32 and label["link_doc_count"] == 32 and label["occurrence_doc_count"] == 32
    degrees = {r["page_id"]: r["n"] for r in t.read("link_source_count").collect()}
    assert degrees[1] == 16 and degrees[2] == 31
    examples = t.read("sense_training_example")
    assert examples.count() > 0 and examples.where("is_correct").count() * 2 == examples.count()
    assert spark.read.option("header", True).csv(f"{t.path}/csv/wiki_en_train").count() > 0
    assert t.read("markup").where("snippet.first_sentence is null").count() == 2  # the empty categories
    assert spark.read.option("header", True).csv(f"{t.path}/csv/wiki_en_train").columns == list(tables.SENSE_HEADER.values())
    again = mining.Mine.opened(spark, t.path)
    assert again.language == mine.language and again.run() == [] and Language.restored(LANGUAGES["fr"].stored()) == LANGUAGES["fr"]
    assert t.read("namespace").count() == 5
    counts = [r["n"] for r in t.read("last_transclusion_count").collect()]
    assert counts == sorted(counts, reverse=True)
    assert api.with_namespace(mine.page, t.read("namespace")).where("namespace = 'Category'").count() == 2
    small = tables.shrunk(t.read("markup")).where("page_id = 1").first()
    assert small["text"] == "" and small["links"] == [] and small["snippet"]["first_sentence"] == "A page."


def test_documents_are_labelled(spark, mine):
    mine.run()
    graph = mine.graph(0.02)
    docs = spark.createDataFrame([(1, "The orbit of Mercury is near. An Orbit and page 12, page 14, page 16."), (2, "Mercury is a Metal. Some Metal melts; Mercury and page 13, page 15 too."), (3, ""), (4, None)], "doc_id long, text string")
    parts = api.document_parts(docs, graph)
    sense = {r["doc_id"]: r["page_id"] for r in parts["resolved"].where("label = 'Mercury'").collect()}
    assert sense == {1: 1, 2: 2}
    links = parts["links"].collect()
    assert {r["doc_id"] for r in links} == {1, 2} and all(0 < r["prediction"] < 1 for r in links)
    assert all(r["surface_forms"] and r["last_occurrence"] - r["first_occurrence"] == pytest.approx(r["spread"]) for r in links)
    named = api.simple(api.likely_links(parts["links"], 0.0), graph.page).collect()
    assert {r["page"]["title"] for r in named if r["doc_id"] == 1} >= {"Mercury (planet)", "Orbit"}
    assert api.enriched(parts["context"], graph.page).count() == parts["context"].count()
    ids = spark.createDataFrame([(10,), (12,), (1,), (5,)], "id long")
    found = api.related_categories(ids, graph).collect()
    assert [(r["title"], r["frequency"]) for r in found] == [("Category:Planets", 3)] and found[0]["score"] == pytest.approx(math.log(4))
    assert api.context_categories(parts, graph).count() == 2
    assert api.excerpts(ids, mine.tables.read("markup")).count() == 3
    assert api.page_by_id(graph.page, 3).first()["title"] == "Orbit" and api.page_by_title(graph.page, "Nothing").count() == 0


def test_link_training(spark, mine):
    mine.run()
    out = mine.link_training().collect()
    t = mine.tables
    samples = {r["id"]: r["group_name"] for r in t.read("link_sample").collect()}
    used = {r["id"] for r in mine.used_pages().collect()}
    assert len(samples) == 5 and not used & set(samples) and {r["source"] for r in out} <= set(samples)
    links = {(r["source"], r["destination"]) for r in t.read("link").collect()}
    kinds = {r["id"]: r["page_type"] for r in mine.page.collect()}
    assert out and all(r["is_valid_link"] == ((r["source"], r["page_id"]) in links) and kinds[r["page_id"]] == 1 for r in out)
    for r in out:
        assert all(r[c] is not None for c in lk.LINK_FEATURES) and r["spread"] == pytest.approx(r["last_occurrence"] - r["first_occurrence"])
        assert 0 <= r["first_occurrence"] <= r["last_occurrence"] < 1
    rows = spark.read.option("header", True).csv(f"{t.path}/csv/wiki_en_links")
    assert rows.columns == list(tables.LINK_HEADER.values()) and rows.count() == sum(samples[r["source"]] == "links" for r in out)
    pages = {(r["source"], r["page_id"]) for r in t.read("link_training_context_page").collect()}
    sums = {r["source"]: (r["group_name"], r["pages"]) for r in t.read("link_training_context").collect()}
    assert sums == {i: (g, sum(s == i for s, _ in pages)) for i, g in samples.items()}
    assert tables.name_of_export("a/b/wiki_en_links/") == "wiki_en_links" and tables.name_of_export("x/wiki_fr_test.csv") == "wiki_fr_test"


def test_phases_must_be_complete(spark, tmp_path):
    with pytest.raises(ValueError, match="aren't completed"):
        mining.Mine(spark, "none.xml", str(tmp_path)).link_training()
    with pytest.raises(ValueError, match="no configuration"):
        mining.Mine.opened(spark, str(tmp_path))


def test_pages_of_dates_are_no_context(spark):
    page = spark.createDataFrame([(1, "May 5"), (2, "Mars"), (3, "5 mai"), (4, "1 août")], "id long, title string")
    of = lambda code: {r["page_id"] for r in cx.date_pages(page, cx.dates_of(spark, code)).collect()}
    assert of("en") == of("en_simple") == {1} and of("fr") == {3, 4}
    labels = spark.createDataFrame([("day", 0.5), ("red", 0.5), ("May 5", 0.5)], "label string, link_probability double")
    senses = spark.createDataFrame([("day", 1, 0.9), ("red", 2, 0.9), ("May 5", 2, 0.9)], "label string, destination long, commonness double")
    own = spark.createDataFrame([(7, "day"), (7, "red"), (8, "May 5")], "doc_id long, label string")
    none = spark.createDataFrame([], "page_id long, n long")
    dates = cx.dates_of(spark, "en")
    found = cx.candidates(own, labels, senses, none, dates, 0.02, date_pages=cx.date_pages(page, dates)).collect()
    assert [(r["doc_id"], r["page_id"]) for r in found] == [(7, 2)]


def test_hubs_are_not_expanded(spark):
    """A pair's page with fewer links is the one expanded, on either side and in either direction."""
    rng = random.Random(8)
    links = [(s, 1) for s in range(10, 60)] + [(s, 2) for s in range(10, 14)] + [(s, 90) for s in range(50, 55)] + [(1, d) for d in range(20, 25)] + [(2, d) for d in range(20, 40)] + [(rng.randint(1, 9), rng.randint(60, 80)) for _ in range(40)]
    frame = spark.createDataFrame([(s, d, "x") for s, d in links], "source long, destination long, anchor_text string")
    weighted, sizes = rl.vectors(frame, 100)
    pairs = [(1, 2), (1, 90), (2, 90), (3, 4), (5, 9), (1, 99)]
    out = rl.compare(spark.createDataFrame(pairs, "a long, b long"), weighted, sizes, 100).collect()
    assert len(out) == len(pairs)
    for r in out:
        assert [r[m] for m in rl.MEASURES] == pytest.approx(brute_compare(links, r["a"], r["b"], 100)), (r["a"], r["b"])


def test_filters_lose_no_label(spark):
    from knotwork.functions import ngrams as ng

    names = [f"Label {i}" for i in range(3000)] + ["Straße", "İzmir", "日本"]
    frame = spark.createDataFrame([(x,) for x in names], "label string").repartition(3)
    longest, known = lb.vocabulary(frame)
    plain, caseless = map(ng.Filter, known.value)
    assert longest == 2 and all(x in plain and ng.caseless(x) in caseless for x in names)
    assert sum(f"other {i}" in plain for i in range(3000)) < 100 and len(known.value[0]) * 8 <= 2 * 64 * len(names)
    assert lb.vocabulary(frame.limit(0))[0] == 0


def test_faulty_groups(spark):
    rows = [(1, "a", 5), (1, "a", 6), (1, "b", 5), (1, "b", 5), (2, "c", None)]
    found = lk.faulty_groups(spark.createDataFrame(rows, "doc_id long, label string, page_id long")).collect()
    assert {(r["label"], r["problem"]) for r in found} == {("b", "duplicate"), ("c", "empty")}


def test_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)
    before = len(storage.WRITTEN)
    a, b = storage.stored(spark.range(3)), storage.stored(spark.range(4))
    files = a.inputFiles()
    storage.discard(spark, before, -1)
    assert len(storage.WRITTEN) == before + 1 and b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(files[0])
    storage.discard(spark, before)
    assert len(storage.WRITTEN) == before


def test_streams_equal_batches(spark, tmp_path):
    from knotwork.streaming.labels import stream_occurrences

    docs = spark.createDataFrame([(i, f"red cat {i} and blue dog") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs.parquet")
    labels = spark.createDataFrame([("red cat",), ("dog",), ("bird",)], "label string")
    out = stream_occurrences(spark, f"{tmp_path}/docs.parquet", docs.schema, labels, files_per_batch=1)
    key = lambda rows: sorted((r["doc_id"], r["label"], r["n"]) for r in rows.collect())
    assert key(out) == key(lb.label_occurrences(docs, labels)) and out.count() == 40


def test_graph_sums(spark, sf_dir):
    from knotwork.plans.bridge import Star

    link = Star(spark, sf_dir).link
    pairs = link.select("source", "destination").distinct().count()
    assert gr.in_degree(link).agg(F.sum("n")).first()[0] == pairs == gr.out_degree(link).agg(F.sum("n")).first()[0]
    arms = gr.multiplicities(link)
    assert arms.where("cnt > most").count() == 0 and json.dumps(sorted(arms.columns))


def test_commands(spark, mine, tmp_path, capsys, monkeypatch):
    from knotwork.__main__ import main

    mine.run()
    main("shrink", mine.tables.path)
    main("link-training", mine.tables.path)
    assert int(capsys.readouterr().out.split()[-1]) == mine.tables.read("link_training_example").count() > 0
    assert mine.tables.read("small_markup").where("wikitext is null and text = ''").count() == mine.tables.read("markup").count()
    frame = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, y double")
    tables.save_model(ev.boosted_trees(("x",), "y", rounds=1, depth=1).fit(frame), f"{tmp_path}/model")
    main("load-model", f"{tmp_path}/model", str(tmp_path), "rank")
    assert tables.load_model(f"{tmp_path}/models/rank").transform(frame).count() == 20
    with pytest.raises(SystemExit):
        main("help")


def test_metrics_without_predicted_or_true_rows(spark):
    """What has no denominator is null, as in SQL, and no error."""
    low = spark.createDataFrame([(0.1, 1.0), (0.2, 0.0), (0.3, 0.0)], "s double, t double")
    none = ev.binary_metrics(low, "s", "t").first()
    assert (none["tp"], none["fp"], none["fn"], none["tn"], none["precision"], none["recall"], none["f1"], none["auc"]) == (0, 0, 1, 2, None, 0.0, 0.0, 0.0)
    one = ev.binary_metrics(low.where("t = 0"), "s", "t").first()
    assert (one["tn"], one["precision"], one["recall"], one["f1"], one["auc"]) == (2, None, None, None, None)
    rows = spark.createDataFrame([(float(i % 7), 0.0, i % 5) for i in range(40)], "x double, t double, fold int")
    assert ev.binary_metrics(ev.cross_validated(rows, ("x",), "t", "fold", rounds=2), "score", "t").first()["tn"] == 40


def test_detection_reads_each_text_once(spark):
    """Natural and recased forms come from one pass over the texts."""
    docs = spark.createDataFrame([(1, "THE cat sat. Cat and HAT"), (2, "the cat")], "doc_id long, text string")
    found = lb.detect(docs, spark.createDataFrame([("cat",), ("Cat",), ("hat",), ("Hat",)], "label string"))
    rows = {tuple(r) for r in found.collect()}
    assert (1, 4, 7, "cat", "natural") in rows and (1, 21, 24, "Hat", "recased") in rows
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_kept_forms_are_those_made_anew():
    from knotwork.functions import ngrams as ng

    texts, known = ["THE cat sat. Cat and HAT", "the cat.\nCat 2", "CAT. cat", ""], {"cat", "Cat", "Hat", "the cat"}
    near = set(map(ng.caseless, known))
    calls = []
    forms = ng.Once(lambda key: calls.append(key) or ng.known_forms(*key, known, near), most=5)
    for text in texts:
        assert ng.label_candidates(text, 2, forms=forms) == ng.label_candidates(text, 2, known)
    assert len(forms) <= 5 and len(calls) > 5


def test_degrees_are_dealt_out_by_the_edges_size(spark, tmp_path, monkeypatch):
    """Parts of a fixed size, however many edges there are; a null neighbour isn't counted, its page stays."""
    monkeypatch.setattr(gr, "EDGES", 64, raising=False)
    link = spark.createDataFrame([(i % 50, i % 7) for i in range(400)] + [(None, 3), (9, None), (None, 77)], "source long, destination long")
    link.write.parquet(f"{tmp_path}/link")
    link = spark.read.parquet(f"{tmp_path}/link")
    into, out = gr.in_degree(link), gr.out_degree(link)
    assert {r["page_id"]: r["n"] for r in into.collect()} == {k: 50 for k in range(7)} | {None: 1, 77: 0}
    assert {r["page_id"]: r["n"] for r in out.collect()} == {k: 7 for k in range(50)} | {None: 2}
    for found in (into, out):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and 4 < gr.pieces(link, 64) < 1000
    assert gr.pieces(spark.createDataFrame([(1, 2)], "source long, destination long"), 64) == 4
