"""Operators on texts against plain, slow versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import mixing, packing, quality_classifier, quality_rules, simhash, token_counts, token_output, tokens
from knotwork.llm.words import word_ids

TEXTS = [None, "", " ", "one", "a b c d", "the cat sat\nthe cat sat\nthe cat sat", "é ü <|endoftext|> x  y\t\tz\n\n", "word " * 500, "A!! B!! C!!\n| a | b |", "zero width   blank\x85s", "\x1c\x1d words", "日本語 テキスト 😀😀", "don't we'll they're I've 'RE 12345 ...", "Word*** caps!! x$$$ a### b&&& (c) d-e f_ g/h i|j \"k\" l[1] m{} n@o p^~ Q... R?!, SS*** É%%% İx! ǆ;: ß==", "x" * 3000, " İ!! aİ$$$\nb", "one.\nTwo two.\n\nTwo!\n'll\r\nthree\n\u0301a \nb\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i else None, 1, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s0", 1, "clash"), (None, "a b c d", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    own, lib = tokens.encoder(name), library(name)
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "b", "the", "The", "ing", " ", "  ", "\n", "\n", "\r\n", "\u0301", "\t", "é", "ß", "İ", ".", ",", "!!", "'s", "'ll", "7", "42", "***", "!!", "$$$", "_", "-", "|", "日", "😀", " ", "<|endoftext|>", "<|", "|>"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in [t for t in TEXTS if t] + made:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_prefix_counts_equal_the_library():
    own, lib = tokens.prefixes("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    rng = random.Random(2)
    made = ["".join(rng.choice(["a", "th", "The", "ing", " ", "  ", "\n", "\n", "\u0301", "é", "'s", "'ll", "7", "日", ".", "<|endoftext|>"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    for text in [t for t in TEXTS if t and len(t) < 100] + made:
        found = np.cumsum(np.frombuffer(own.deltas(text), "<i2")).tolist()
        assert found == [len(lib.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))], text


def test_token_counts(docs, empty):
    lib = library("byte_bpe_50k.json")
    rows = token_counts.prefix_counts(docs, budgets=(8,)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "a b c d") or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(lib.encode(text, add_special_tokens=False).ids)
        cut = r["cuts"][0]
        n = lambda k: len(lib.encode(text[:k], add_special_tokens=False).ids)  # noqa: B023, E731
        longest = max(k for k in range(len(text) + 1) if n(k) <= 8) if len(text) < 200 else next(k for k in range(120, -1, -1) if n(k) <= 8)
        assert cut == token_counts.cut_at(r["prefix_store"], 8) == longest or n(len(text)) <= 8
        assert token_counts.count_at(r["prefix_store"], cut) == n(cut) <= 8
    assert token_counts.prefix_counts(empty).count() == 0


def brute_repeats(words):
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    return longest


def test_suffix_array_repeats():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 5))]
        ids, at = word_ids([" ".join(t).encode() for t in texts])
        found = quality_rules.longest_repeats(ids, *quality_rules.suffix_array(ids, at), at)
        assert found.tolist() == [x for t in texts for x in brute_repeats(t)]


def test_repeats_of_long_texts(monkeypatch):
    from knotwork.llm import words

    rng = random.Random(31)
    part = [f"w{rng.randint(0, 9999)}" for _ in range(40_000)]
    text = " ".join(part * 3 + ["end"]).encode()
    found = [x.to_pylist()[0] for x in quality_rules.measure([text])[:7]]
    assert found[0] == found[5] + 1 == 120_001 and found[6] == 80_000
    monkeypatch.setattr(words.parts, "__defaults__", (64,))  # a long text's words are read in pieces
    ids, at = word_ids([text[:5000], b"", b" x ", b"y" * 500])
    assert at.tolist() == [0, *np.cumsum([len(t.split()) for t in (text[:5000], b"", b" x ", b"y" * 500)]).tolist()]
    assert ids[: at[1]].tolist() == word_ids([text[:5000]])[0].tolist()


def brute_rules(text, least=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest = brute_repeats(words)
    cover = {j for i, n in enumerate(longest) if n >= least for j in range(i, i + n)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(cover), max([n for n in longest if n >= least], default=0)


def test_quality_rules(docs, empty):
    rows = quality_rules.judge(docs.drop("n_words")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "a b c d"
        assert tuple(r)[1:8] == brute_rules(text), text
        covered = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(covered) == r["covered_words"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_limit_repeats(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    clean = " ".join(word() for _ in range(400))
    part = " ".join(word() for _ in range(100))
    often = " ".join([part, clean, part, part])
    rows = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([(1, clean), (2, often)], "doc_id long, text string")).collect()}
    assert rows[1]["kept"] and not rows[2]["kept"] and not rows[2]["base_failed"] and rows[2]["covered_words"] == 300


def test_stages_keep_all_columns(spark, docs, sf_dir):
    long = docs.unionByName(docs.sparkSession.createDataFrame([(90, " ".join(f"w{i}" for i in range(80)), "en", "s1", 5, "x")], docs.schema))
    out = quality_rules.quality_rules_stage(spark, long, sf_dir)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [90]
    for stage in (quality_classifier.quality_classifier_stage, simhash.simhash_stage, mixing.mixing_stage):
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_bit_sliced_forest():
    rng = np.random.default_rng(5)
    for _ in range(25):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, size=max(1, n // 4), dtype=np.uint64)
        fps = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(n)], np.uint64))
        rng.shuffle(fps)
        group = np.sort(rng.integers(0, rng.integers(1, 20), len(fps)))
        a, b = simhash.forest(fps, group)
        f = [int(x) for x in fps]
        want = roots(f, [(f[i], f[j]) for i in range(len(f)) for j in range(i) if group[i] == group[j] and (f[i] ^ f[j]).bit_count() <= 4])
        assert want == roots(f, zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_key_plans_lose_no_pair(n):
    keys, rng = simhash.key_plan(n), random.Random(n)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
        assert any(a & k == b & k for k in keys)


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 16)  # hot keys fall into slices
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(50)) for _ in range(60)] + [" ".join(base)] * 5 + [None, "", " \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(base))]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [brute_fingerprint(t) for t in texts]
    want = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] == want[120]


def test_simhash_stage_keeps_one(spark, docs, sf_dir):
    out = simhash.simhash_stage(spark, docs, sf_dir).collect()
    prints = {brute_fingerprint(t) for t in TEXTS}
    assert len(out) == len(simhash_groups(list(prints)))


def simhash_groups(prints):
    return set(roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]).values())


def brute_marginals(unary, link):
    """By summing over all labelings of a short chain."""
    from itertools import product

    n, total, good = len(unary), 0.0, np.zeros(len(unary))
    for labels in product((0, 1), repeat=n):
        weight = np.exp(sum(u for u, y in zip(unary, labels) if y) + sum(link[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(7)
    sizes = [1, 4, 2, 6, 3]
    unary, link = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    text = np.repeat(np.arange(len(sizes)), sizes)
    found = quality_classifier.sigmoid(np.add(*quality_classifier.Chains(text).messages(unary, link)))
    want = np.concatenate([brute_marginals(unary[text == i], link) for i in range(len(sizes))])
    assert np.allclose(found, want)


def plain_inputs(own, text):
    """Line features with those of the neighbours, line by line."""
    out = []
    for k, row in enumerate(own):
        side = lambda j: [*own[j], 1.0] if 0 <= j < len(own) and text[j] == text[k] else [0.0] * (len(row) + 1)  # noqa: B023, E731
        out.append([1.0, *row, *side(k - 1), *side(k + 1)])
    return np.array(out)


def test_fit_equals_plain_fit():
    """Adam on the exact gradient, whose expectations are sums over all labelings of each short chain."""
    from itertools import product

    rng = np.random.default_rng(11)
    texts = ["\n".join(" ".join(rng.choice(["word", "UPPER!", "x#|", "42", "more of it"], rng.integers(1, 6))) for _ in range(rng.integers(1, 5))) for _ in range(8)]
    label = np.array([1, 0, 1, 1, 0, 0, 1, 0])
    lines = quality_classifier.line_features([t.encode() for t in texts])
    model = quality_classifier.fit(lines, label, steps=15)
    x = plain_inputs(lines.own.astype(float), lines.text)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0, np.maximum(scale, 1e-3)
    scale[0] = 1
    x = np.clip((x - mean) / scale, -5, 5)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def of(labels, rows):
        """Features of a labeling of one chain."""
        f = np.zeros_like(theta)
        for k, y in zip(rows, labels):
            f[:-4] += x[k] * y
        for a, b in zip(labels, labels[1:]):
            f[len(theta) - 4 + 2 * a + b] += 1
        return f

    for step in range(1, 16):
        gradient = np.zeros_like(theta)
        for i, y in enumerate(label):
            rows = np.flatnonzero(lines.text == i)
            every = [of(c, rows) for c in product((0, 1), repeat=len(rows))]
            weights = np.exp([f @ theta for f in every])
            gradient += of([y] * len(rows), rows) - sum(w * f for w, f in zip(weights, every)) / weights.sum()
        gradient = gradient / len(x) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(model.weights, theta[:-4], atol=1e-5) and np.allclose(model.link.ravel(), theta[-4:], atol=1e-5)
    assert np.allclose(model.scores([t.encode() for t in texts]), plain_scores(model, texts), atol=1e-5)


def test_fit_in_blocks(monkeypatch):
    """Blocks of a few lines give the inputs, the model and the scores of one block."""
    rng = np.random.default_rng(5)
    texts = ["\n".join(" ".join(rng.choice(["word", "UPPER!", "x#|", "42", "more of it"], rng.integers(1, 6))) for _ in range(rng.integers(0, 9))).encode() for _ in range(20)]
    lines, label = quality_classifier.line_features(texts), np.arange(20) % 2
    whole = quality_classifier.fit(lines, label, steps=15)
    scores = whole.scores(texts)
    for size in (1, 3, 7):
        monkeypatch.setattr(quality_classifier, "BLOCK", size)
        found = np.concatenate([x for _, x in quality_classifier.input_blocks(lines)])
        assert np.array_equal(found, quality_classifier.with_neighbours(lines.text, lines.own))
        model = quality_classifier.fit(lines, label, steps=15)
        assert np.allclose(model.weights, whole.weights, atol=1e-9) and np.allclose(model.link, whole.link, atol=1e-9)
        assert np.allclose(model.scores(texts), scores, atol=1e-9)


def peak_bytes(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_fit_holds_its_inputs_once():
    """The driver fits on up to 600,000 lines: it has no room for several matrices of them."""
    n, rng = 200_000, np.random.default_rng(3)
    lines = quality_classifier.Lines(np.repeat(np.arange(n // 200), 200), np.full(n, 40), rng.random((n, quality_classifier.N), dtype=np.float32))
    assert peak_bytes(lambda: quality_classifier.fit(lines, np.arange(n // 200) % 2, steps=2)) < 500 * n


def test_features_of_a_long_text_in_little_memory():
    text = b"\n".join(b" ".join(b"w%07d" % (12 * i + k) for k in range(12)) for i in range(40_000))
    assert peak_bytes(lambda: quality_classifier.line_features([text])) < 24 * len(text)


def plain_scores(model, texts):
    """Each text's score, a line and a step at a time."""
    out = []
    for text in texts:
        lines = quality_classifier.line_features([(text or "").encode()])
        if not len(lines.text):
            out.append(model.share)
            continue
        unary = [float(u) for u in np.clip((plain_inputs(lines.own.astype(float), lines.text) - model.mean) / model.scale, -5, 5) @ model.weights]
        link, n = np.exp(model.link), len(unary)
        forward, backward = [np.array([1.0, np.exp(unary[0])])], [np.ones(2)]
        for u in unary[1:]:
            step = forward[-1] @ link * [1.0, np.exp(u)]
            forward.append(step / step.sum())
        for u in reversed(unary[1:]):
            step = link @ (backward[-1] * [1.0, np.exp(u)])
            backward.append(step / step.sum())
        both = [f * b for f, b in zip(forward, reversed(backward))]
        quality = sum(p[1] / p.sum() * size for p, size in zip(both, lines.length)) / lines.length.sum()
        a, b = model.curve
        out.append(1 / (1 + np.exp(-(a + b * quality))))
    return out


def test_training_keeps_long_documents(spark):
    """A document of many lines trains by a stretch of them, and a labelled id's rows count once."""
    rows = [(i, "\n".join(f"line {k} of good words here" for k in range(700 if i < 4 else 5)) if i % 2 else "#### $$$ ||||\n" * (900 if i < 4 else 3)) for i in range(40)] + [(7, "again and again")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    used = [i for i in range(4) if zlib.crc32(str(i).encode()) % 5]
    model = quality_classifier.train(docs, labels)
    assert len({i % 2 for i in used}) == 2 and model.weights is not None
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs.limit(40), model).collect()}
    assert min(scores[i] for i in (9, 11)) > max(scores[i] for i in (8, 10))
    more = spark.createDataFrame([(7, 1), (7, 1), (6, 0)], "doc_id long, quality int")
    shares = quality_classifier.train(docs, more, rows=2)
    assert shares.share == 0.5 if zlib.crc32(b"7") % 5 and zlib.crc32(b"6") % 5 else shares.share in (0.0, 1.0, 0.5)
    text = b"\n".join(b"l%d" % k for k in range(1000))
    some = quality_classifier.stretch(quality_classifier.line_features([text]), text, 200)
    assert 0 <= some.start <= 800 and some.stop == some.start + 200


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = quality_classifier.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(14)], "doc_id long, quality int")
    model = quality_classifier.train(docs, one)
    assert {r["score"] for r in quality_classifier.score(docs, model).collect()} == {1.0}
    assert quality_classifier.score(empty, model).count() == 0


def test_packing_fills_sequences(docs, empty):
    lib = library("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, capacity=64).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in seen.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(TEXTS):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        own = own[::2] if i == 3 else own
        assert sum(p[2] for p in own) == len(ids) and all(p[2] == 64 for p in own[1:])
        assert [p[3] for p in own] == [zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) for p in own]
    assert packing.pack_documents(empty).count() == 0


def fewest_bins(items, capacity):
    best = len(items)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        tried = set()
        for k, free in enumerate(bins):
            if free >= left[0] and free not in tried:
                tried.add(free)
                go(left[1:], [*bins[:k], free - left[0], *bins[k + 1 :]])
        go(left[1:], [*bins, capacity - left[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_dominance_costs_no_bin():
    rng = random.Random(8)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_dominated(dict(Counter(items)), 20)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest_bins(rest, 20) == fewest_bins(items, 20)
        runs, bins = packing.plan(dict(Counter(items)), 20)
        assert bins <= fewest_bins(items, 20) + 1


def test_dominance_of_three_items():
    items = [20, 18, 17, 16, 14, 12, 11, 9]
    fixed, left = packing.reduce_dominated(dict(Counter(items)), 40)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + fewest_bins(rest, 40) == fewest_bins(items, 40) == 3
    rng = random.Random(9)
    for _ in range(400):
        items = [rng.randint(8, 22) for _ in range(rng.randint(5, 9))]
        fixed, left = packing.reduce_dominated(dict(Counter(items)), 40)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest_bins(rest, 40) == fewest_bins(items, 40)


def test_token_output_round_trip(spark, docs, empty):
    from knotwork.llm.util import new_path

    lib = library("word_bpe_49k.json")
    path = new_path(spark, "ids")
    token_output.write_token_ids(docs, path)
    stored = {r["doc_id"]: r["ids"] for r in spark.read.orc(path).collect()}
    rows = token_output.read_token_ids(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for r in rows:
        text = "a b c d" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        assert stored[r["doc_id"]] == ids and (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    path = new_path(spark, "ids")
    token_output.write_token_ids(empty, path)
    assert token_output.read_token_ids(spark, path).count() == 0


def test_very_long_texts(spark):
    from knotwork.llm.util import new_path

    text = "a long text, of many words and\nlines 42 " * 6000 + "z" * 5000
    rows = spark.createDataFrame([(1, text, "x", 1), (2, None, "y", 2)], "doc_id long, text string, n_tokens string, piece long")
    lib = library("byte_bpe_50k.json")
    n = len(lib.encode(text, add_special_tokens=False).ids)
    r = {r["doc_id"]: r for r in token_counts.prefix_counts(rows, budgets=(512,)).collect()}
    assert r[1]["n_tokens"] == n and r[2]["n_tokens"] == 0 and len(lib.encode(text[: r[1]["cuts"][0]], add_special_tokens=False).ids) <= 512
    pieces = [p for p in packing.pack_documents(rows).collect() if p["doc_id"] == 1]
    assert sum(p["length"] for p in pieces) == n + 1 and all(p["length"] == 1024 for p in pieces if p["piece"])
    path = new_path(spark, "long")
    token_output.write_token_ids(rows, path)
    out = {r["doc_id"]: r["n_tokens"] for r in token_output.read_token_ids(spark, path).collect()}
    assert out == {1: len(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids) + 1, 2: 1}
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def mixed(spark, sizes, **settings):
    rows = [(k * 1000 + i, "word " * n, f"s{k}") for k, (docs, n) in enumerate(sizes) for i in range(docs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix(docs, **settings).collect()


def test_mixing_meets_its_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = mixed(spark, [(300, 20), (60, 20), (20, 20)], max_repeats=3.0)
    used = Counter((r["source"], r["doc_id"]) for r in rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r["source"] == s]
        assert sum(r["n_tokens"] for r in own) - own[0]["budget"] in range(0, 22)
        counts = {n for (k, _), n in used.items() if k == s}
        assert max(counts) - min(counts) <= 1 and min(counts) >= 1
        whole = [r for r in own if r["epoch"] == max(x["epoch"] for x in own)]
        cut = max(r["place"] for r in whole)
        assert all(r["place"] <= cut for r in whole)
    assert max(used.values()) == 3 and {n for (k, _), n in used.items() if k == "s0"} == {1}
    total = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in ("s0", "s1", "s2")}
    assert abs(total["s2"] / 420 - 3) < 0.06 and abs(total["s0"] / 6300 - 1) < 0.01


def test_mixing_by_entropy_and_budget(spark):
    rows = mixed(spark, [(40, 10), (20, 10), (10, 10)], target_entropy=1.05, max_repeats=None, budget=1000)
    weights = {r["source"]: r["weight"] for r in rows}
    assert abs(-sum(w * np.log(w) for w in weights.values()) - 1.05) < 1e-3 and abs(sum(weights.values()) - 1) < 1e-9
    assert abs(sum(r["n_tokens"] for r in rows) - 1000) < 40


def plain_mixture(rows, e):
    """How often each (id, source, tokens, place in the last epoch) is used, source by source: weights are shares to
    the power of e, the least repeated source is used once."""
    totals = Counter()
    for _, s, n, _ in rows:
        totals[s] += n
    share = {s: t / sum(totals.values()) for s, t in totals.items()}
    raw = {s: p**e for s, p in share.items()}
    asked = max(totals[s] / raw[s] for s in totals) * sum(raw.values())
    used = {}
    for s in totals:
        budget = round(asked * raw[s] / sum(raw.values()))
        epochs, rest = divmod(budget, totals[s])
        for i, _, n, place in sorted((r for r in rows if r[1] == s), key=lambda r: r[3][epochs]):
            used[i] = epochs + (rest > 0)
            rest = max(0, rest - n)
    return used


@pytest.mark.parametrize("limit", [1.2, 1.5, 2.0])
def test_mixing_equals_plain_mixture(spark, monkeypatch, limit):
    """Sources of shares 16 : 4 : 1, so the exponent for a limit r is 1 - ln r / ln 16, inside (0, 1)."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    lib = library("byte_bpe_50k.json")
    texts = [(k * 1000 + i, "word " * (1 + (i * 7) % 9), f"s{k}") for k, n in enumerate((36 * 16, 36 * 4, 36)) for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    placed = docs.select("doc_id", F.xxhash64("doc_id", "text", "source").alias("h"), F.lit(1).alias("e1"), F.lit(2).alias("e2"))
    places = {r["doc_id"]: r for r in placed.select("doc_id", *(mixing.place(f"e{e}", "h", mixing.SEED).alias(f"p{e}") for e in (1, 2))).collect()}
    rows = [(i, s, len(lib.encode(t, add_special_tokens=False).ids), {1: places[i]["p1"], 2: places[i]["p2"], 3: 0}) for i, t, s in texts]
    totals = Counter()
    for _, s, n, _ in rows:
        totals[s] += n
    e = 1 - np.log(limit) / np.log(totals["s0"] / totals["s2"])
    got = mixing.mix(docs, max_repeats=limit).collect()
    weights = {r["source"]: r["weight"] for r in got}
    want = {s: (totals[s] / sum(totals.values())) ** e for s in totals}
    assert 0 < e < 1 and all(abs(weights[s] - want[s] / sum(want.values())) < 1e-8 for s in want)
    assert Counter(r["doc_id"] for r in got) == Counter(plain_mixture(rows, e))


def test_mixing_edges(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(TEXTS)), None}
    assert mixing.mix(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["epoch"]) for r in mixing.mix(silent).collect()) == [(1, 0), (2, 0)]
