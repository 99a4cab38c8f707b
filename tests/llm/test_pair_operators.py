"""Chats, URLs, embeddings and the pipeline against plain, slow versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import chat_format, components, embedding_dedup, queries, url_filters


def test_template_round_trip():
    rng = random.Random(1)
    parts = ["<|", "|>", "end", "<|end|>", "\\", "\n", "a", "<|user|>", "é", "[INST]", "</s>"]
    for _ in range(300):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        assert chat_format.read_back("".join(chat_format.render_turn(*t) for t in turns)) == turns


def brute_fold(events):
    """(message, kind, role, text) in their order to the roles and texts of the messages that are left."""
    found = {}
    for place, (message, kind, role, text) in enumerate(events):
        m = found.setdefault(message, {"place": place, "here": True, "role": "", "text": ""})
        if kind == "delete":
            m.update(here=False, role="", text="")
            continue
        m["text"] = (text or "") if kind in ("message", "edit", "regenerate") else m["text"] + (text or "")
        m.update(here=True, role=role or m["role"])
    return [(m["role"], m["text"]) for m in sorted(found.values(), key=lambda m: m["place"]) if m["here"]]


LOG = "conv_id long, seq long, message_id string, kind string, role string, text string"


def fold_of(spark, log):
    """By conversation, what final_messages and the plain fold leave, in order."""
    frame = spark.createDataFrame(log, LOG).withColumn("tie", F.xxhash64("text"))
    key = lambda x: (x is not None, x)
    events, got = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (key(r["seq"]), key(r["kind"]), key(r["role"]), r["tie"])):
        events.setdefault(r["conv_id"], []).append((r["message_id"], r["kind"], r["role"], r["text"]))
    for r in sorted(chat_format.final_messages(frame.withColumn("task", F.lit("clash"))).collect(), key=lambda r: key(r["seq"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return {c: got.get(c, []) for c in events}, {c: brute_fold(e) for c, e in events.items()}


def test_fold_of_edits(spark):
    log = [
        (1, 0, "a", "message", "user", "hi"), (1, 1, "b", "message", "assistant", "he"), (1, 2, "b", "delta", None, "llo"), (1, 3, "a", "edit", "user", "hey"), (1, 4, "b", "regenerate", "assistant", None),
        (1, 5, "b", "delta", None, "good "), (1, 6, "b", "delta", None, "day"), (1, 7, "c", "message", "user", "gone"), (1, 8, "c", "delete", None, None), (2, 0, "x", "message", "user", "old"), (2, 1, "x", "delete", None, None), (2, 2, "x", "edit", None, "new"),
    ]
    got, want = fold_of(spark, log)
    assert got == want == {1: [("user", "hey"), ("assistant", "good day")], 2: [("", "new")]}
    single = [(3, 0, None, "message", "user", "solo"), (3, 1, None, "message", None, None), (3, 2, None, "delete", None, None)]
    assert [(r["role"], r["text"]) for r in chat_format.final_messages(spark.createDataFrame(single, LOG)).orderBy("seq").collect()] == [("user", "solo"), ("", "")]
    assert chat_format.final_messages(spark.createDataFrame([], LOG)).count() == 0


def test_fold_of_random_logs(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", 200)
    rng, log = random.Random(7), []
    for c in range(500):
        for i in range(rng.randint(1, 12)):
            log.append((c or None, i if rng.random() < 0.9 else None, rng.choice("ab"), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", None]), rng.choice([None, "user", "assistant", ""]), rng.choice([None, "", "x", "yy", "z"])))
    log += [(900, i, "hot", "delta" if i % 2000 else "regenerate", "user" if i == 10 else None, f"{i} ") for i in range(3000)]  # over half of all rows
    got, want = fold_of(spark, log)
    for c in got:
        assert sorted(got[c]) == sorted(want[c]), c
        if len({r[1] for r in log if r[0] == c}) == sum(r[0] == c for r in log):  # messages of one place have no order by it
            assert got[c] == want[c], c


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", 50)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "x" * rng.randint(0, 40), "<|end|>\\"])) for c in range(30) for t in range(rng.randint(1, 12))]
    rows += [(99, t, "assistant", f"turn {t}") for t in range(200)]  # a third of all rows
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(chat_format.final_messages(chat_format.as_events(frame)))).collect()}
    assert set(out) == {r[0] for r in rows}
    for c, r in out.items():
        turns = [(role or "", text or "") for k, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == sum(len(chat_format.render_turn(*t)) for t in turns)
    assert chat_format.digests(chat_format.formatted(chat_format.final_messages(chat_format.as_events(frame.limit(0))))).count() == 0


def test_rows_pass_the_fold(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "DELTA", 3)
    rows = [(1, 0, "user", "a long text"), (1, 0, "user", "a long text"), (1, 0, "user", None), (1, 1, None, "b"), (None, 0, "user", "c"), (2, None, "assistant", "streamed é😀 text"), (2, 5, "assistant", ""), (2, 6, "assistant", "abc"), (3, 1, "tool", "x")]
    log = chat_format.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")))
    assert log.where("message_id is null").count() == 0 and log.select("conv_id", "message_id").distinct().count() == len(rows)
    assert {r["kind"] for r in log.collect()} == {"message", "edit", "delta", "regenerate"} and log.count() > 2 * len(rows)
    found = [(r["conv_id"], r["seq"]["turn"], r["role"], r["text"]) for r in chat_format.final_messages(log).collect()]
    assert sorted(found, key=repr) == sorted(((c, t, role or "", text or "") for c, t, role, text in rows), key=repr)


def test_null_conversations_and_long_turns(spark):
    rows = [(None, t, "assistant", "x" * 300_000 + str(t)) for t in range(8)] + [(1, 0, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(chat_format.final_messages(chat_format.as_events(frame)))).collect()}
    assert set(out) == {None, 1} and out[None]["n_turns"] == 8 and out[None]["loss_sha256"] == sha("".join(r[3] for r in rows[:8]))


def test_probe_is_kept_apart(spark, sf_dir):
    row = chat_format.op3_chat_format(spark, sf_dir).where("conv_id = -7").first()
    assert row["turns_sha256"] == sha(f"user\n{chat_format.PROBE}\nassistant\n{chat_format.PROBE}\n") and row["loss_sha256"] == sha(chat_format.PROBE)


def brute_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "example.com", "www.example.com", "Sub.WWW.example.COM", "notexample.com", "x.net", "net", "", "a..net", "exa-mple.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/1", "/fr/?q=/en/", "/fr/#x", "?a=/b", "#/es/", "//en/", "/en/://x"]
    urls = ["https://" + "a." * 300 + "example.com/en/" + "x" * 5000, "https://x.net/es/" + "y" * 100_000] + [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "http:/x", "://", "a://b://c/es/"]
    frame = spark.createDataFrame([(i if i % 9 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_filters.judge(frame, url_filters.rule_table(spark)).collect()
    want = sorted([(i if i % 9 else None, *brute_judge(u)) for i, u in enumerate(urls)], key=repr)
    assert sorted((tuple(r) for r in out), key=repr) == want
    assert url_filters.judge(frame.limit(0), url_filters.rule_table(spark)).count() == 0


def test_rules_that_tie(spark):
    rules = spark.createDataFrame([("b.com", "/x", "allow"), ("com", "/x", "block"), ("b.com", "/x", "block"), ("a.b.com", "", "allow"), (None, "/", "block"), ("com", "/", None)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.b.com/x"), (2, "http://c.com/x/y"), (3, "http://a.b.com/"), (4, "http://c.org/x"), (None, None)], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(urls, rules).collect()}
    # of equal length the longer host, of equal rules block
    assert out == {1: ("a.b.com", "allow"), 2: ("com/x", "block"), 3: ("a.b.com", "allow"), 4: (None, "allow"), None: (None, "allow")}


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    from knotwork.llm import util

    monkeypatch.setattr(util, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, 0 if i < 60 else i % 7) for i in range(100)], "id long, k long")
    known = util.stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    out = util.looked_up(rows, known, ["k"], "n")
    assert sorted(out.columns) == ["id", "k", "least"]
    want = rows.join(known.drop("n"), "k").select("id", "k", "least").collect()
    assert sorted(tuple(r) for r in out.select("id", "k", "least").collect()) == sorted(tuple(r) for r in want)


def brute_links(rows):
    sound = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    return sound, [(i, j) for i in range(len(sound)) for j in range(i) if sound[i][2] == sound[j][2] and len(sound[i][1]) == len(sound[j][1]) and cos(np.array(sound[i][1]), np.array(sound[j][1])) >= 0.93]


@pytest.mark.parametrize("limit", [8192, 16])
def test_embeddings(spark, monkeypatch, limit):
    monkeypatch.setattr(embedding_dedup, "SLICE", limit)  # hot slabs fall into slices
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for c in range(25):
            centre = rng.normal(size=64)
            rows += [(centre + rng.normal(size=64) * rng.uniform(0, 0.5), label) for _ in range(rng.integers(1, 9))]
    centre = rng.normal(size=64)
    rows += [(centre + 0.1 * rng.normal(size=64), 1) for _ in range(60)] + [(rows[0][0], 0)] * 40 + [(rng.normal(size=10), 2) for _ in range(3)] + [(np.ones(10), 2), (np.ones(10) * 3, 2)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 64, 1), (n + 3, [float("nan")] * 64, 1), (n + 4, [None, 1.0], 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * 64, 0), (None, rows[0][1], 0)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as node"))
    found = {r["vec_id"]: r for r in out.collect()}
    assert len(found) == len(rows)
    sound, links = brute_links(rows)
    degree, parent = [0] * len(sound), list(range(len(sound)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    named = {}
    for k, r in enumerate(sound):
        if r[0] is not None:
            named[find(k)] = min(named.get(find(k), r[0]), r[0])
    for k, r in enumerate(sound):
        assert (found[r[0]]["n_links"], found[r[0]]["component_id"]) == (degree[k], named[find(k)]), r[0]
        assert found[r[0]]["kept"] == (r[0] == named[find(k)])
    for k in range(n, n + 7):
        assert tuple(found[k]) == (k, 0, k, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_rotation_keeps_distances():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 16, 64, 100):
        x = rng.normal(size=(20, dim))
        y = embedding_dedup.rotate(x)
        assert np.allclose(((x[:, None] - x[None]) ** 2).sum(2), ((y[:, None] - y[None]) ** 2).sum(2))
        assert np.array_equal(y[3:4], embedding_dedup.rotate(x[3:4]))  # rows don't depend on each other
        assert abs(embedding_dedup.budgets(dim, 0.93).sum() - 0.14) < 1e-12


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in out} == {x: find(x) for x in linked} and len(out) == len(linked)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_cover_the_ten(spark, sf_dir):
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_against_its_parts(spark, sf_dir):
    import corpus_pipeline
    from knotwork.llm import mixing, packing, quality_classifier, quality_rules, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    good = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    likely = {r["doc_id"] for r in quality_classifier.op2_quality_classifier(spark, sf_dir).where("predicted = 1").collect()} & good
    groups = {}
    for r in simhash.near_duplicates(docs.where(docs.doc_id.isin(list(likely)))).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    kept = set(groups)
    assert kept == {min(g) for g in groups.values()}
    used = {}
    for r in mixing.mix(docs.where(docs.doc_id.isin(list(kept)))).collect():
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + 1
    assert set(used) == kept
    first = {}
    for r in out:
        first[r["doc_id"]] = first.get(r["doc_id"], 0) + (r["piece"] == 0)
    assert first == used
    assert packing.CAPACITY == 1024 and len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_plain_code(spark, tmp_path):
    """All stages on a small table with nulls, copies, repeated rows and columns with clashing names."""
    import corpus_pipeline
    import test_text_operators as plain
    from knotwork.llm import mixing, quality_classifier

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(60, 200))) + ".\n" + " ".join(word() for _ in range(30)) for _ in range(40)]
    bad = ["\n".join("#### BUY!!! ||| " + " ".join(word().upper() + "$$" for _ in range(20)) for _ in range(6)) for _ in range(20)]
    texts = good + bad + good[:6] + [t + " end" for t in good[:3]] + [None, "", "few words", "same words again " * 60]
    rows = [(i, t, f"s{0 if i % 4 else i % 3}" if i % 11 else None, "x", i) for i, t in enumerate(texts)] + [(3, texts[3], "s0", "x", 3)] * 2 + [(None, good[9] + " more of it", "s1", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, h string, n_tokens long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def fine(text):
        n, _, _, _, repeated, covered, longest = plain.brute_rules(text)
        return not (n < 50 or 100 * repeated > 50 * n) and covered <= 0.3 * n and longest <= 200

    kept = [r for r in rows if fine(r[1])]
    model = quality_classifier.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r, s in zip(kept, plain.plain_scores(model, [r[1] for r in kept])) if s >= 0.3]
    prints = [plain.brute_fingerprint(r[1]) for r in kept]
    root = plain.roots(range(len(kept)), [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(root[i], []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    assert len(kept) > 20 and any(len(g) > 1 for g in groups.values()) and len(kept) < len(rows) - 20
    lib = plain.library("byte_bpe_50k.json")
    size = {r[0]: len(lib.encode(r[1], add_special_tokens=False).ids) for r in kept}
    hashed = spark.createDataFrame([r[:3] for r in kept], "doc_id long, text string, source string").select("doc_id", "source", F.xxhash64("doc_id", "text", "source").alias("h"))
    hashed = hashed.withColumns({f"e{e}": F.lit(e) for e in range(1, 4)})
    placed = hashed.select("doc_id", "source", *(mixing.place(f"e{e}", "h", mixing.SEED).alias(f"p{e}") for e in range(1, 4))).collect()
    sources = {}
    for r in placed:
        sources[r["source"]] = sources.get(r["source"], 0) + size[r["doc_id"]]
    most, least = max(sources.values()), min(sources.values())
    e = max(0.0, 1 - math.log(mixing.MAX_REPEATS) / math.log(most / least))
    used = plain.plain_mixture([(r["doc_id"], r["source"], size[r["doc_id"]], {k: r[f"p{k}"] for k in range(1, 4)}) for r in placed], e)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found, bins = {}, {}
    for r in out:
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {i: sorted(n * plain_pieces(size[i] + 1)) for i, n in used.items()}
    assert {i: sorted(p) for i, p in found.items()} == want
    for spans in bins.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 1024
    assert len(bins) <= -(-sum(n for s in bins.values() for _, n in s) // 1024) + 1


def plain_pieces(n, capacity=1024):
    sizes = [n % capacity or min(n, capacity)]
    while sum(sizes) < n:
        sizes.append(capacity)
    return [(k, sum(sizes[:k]), x) for k, x in enumerate(sizes)]


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    own = queries.queries()[name](spark, sf_dir)
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(own.columns)
    rows = lambda found, columns: sorted((tuple(same(r[columns.index(c)]) for c in sorted(names)) for r in found), key=repr)
    assert rows([tuple(r) for r in own.collect()], own.columns) == rows(got.fetchall(), names)
