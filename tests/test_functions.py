"""String functions, n-grams, markup and measures on golden cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from knotwork.config import ENGLISH, LANGUAGES, Language, Settings
from knotwork.functions import measures as me
from knotwork.functions import ngrams as ng
from knotwork.functions import text as tx
from knotwork.functions import wikitext as wt


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("s"))).collect()]


def test_clean_anchor(spark):
    found = apply(spark, tx.clean_anchor, "Medera ", ":en: n-Butanol", "Alchemy#Egypt", "Coordination_chemistry", "#only", "", None)
    assert found == ["Medera", "n-Butanol", "Alchemy", "Coordination chemistry", "", "", None]
    assert apply(spark, tx.anchor_or_original, "#only", "a_b") == ["#only", "a b"]


def test_key_from_target(spark):
    found = apply(spark, tx.key_from_target, "Big Apple", ":fr:Les Cahiers", ":en:Thing", ":Category: People from Here", "Category: Ships", "A_b#c")
    assert found == ["big apple", ":fr:les cahiers", "thing", "category:people from here", "category:ships", "a b"]


def test_letters_digits(spark):
    assert apply(spark, tx.letters_digits, "Café, résumé & naïve", "Item #42: $19.99", "a😀b") == ["Café  résumé   naïve", "Item  42   19 99", "a b"]


def test_transclusions(spark):
    found = apply(spark, tx.transclusions, "{{a}} x {{b|c}} {d} {{e {{f}} }}", "none", None)
    assert found == [["a", "b|c", "d", "f"], [], None]
    assert apply(spark, tx.last_transclusion, "{{a}} {{b|c}}", "none") == ["b|c", None]
    test = lambda c: tx.is_disambiguation(c, ENGLISH.disambiguation_prefixes)
    assert apply(spark, test, "disambiguation|geo", "Disambiguation", "reflist") == [True, True, False]


def test_clean_text(spark):
    mark = "\ue000"
    text = f"A ({mark}; x) b{mark}  c\t d \n\n\n\n e\n \n \n \nf "
    assert apply(spark, tx.clean_text, text) == ["A b c d\n\ne\n\nf"]
    assert wt.clean(text) == "A b c d\n\ne\n\nf"


def test_first_letters(spark):
    assert apply(spark, tx.capitalize_first, "ñoño", "123abc", " x", "😀x", "") == ["Ñoño", "123abc", " x", "😀x", ""]
    assert apply(spark, tx.uncapitalize_first, "Ñoño", "ABC") == ["ñoño", "aBC"]


def test_case_variants(spark):
    found = apply(spark, tx.case_variants, "new york", "ICELAND", "McDonald", "2024", "blue-gray tanager", "New York")
    assert found == [["New York", "New york"], ["Iceland"], [], [], ["Blue-Gray Tanager", "Blue-gray tanager"], []]
    for text, want in zip(("new york", "ICELAND", "McDonald", "2024", "blue-gray tanager"), found):
        assert ng.variants(text, ng.spans(text)) == want


@pytest.mark.parametrize("text, case", [("iceland", "LOWER"), ("ICELAND", "UPPER"), ("New York", "UPPER_FIRST"), ("new York", "MIXED"), ("McDonald", "MIXED"), ("12 - 3", "MIXED"), ("blue-gray", "LOWER"), ("A B", "UPPER"), ("I Am", "UPPER_FIRST")])
def test_case_context(spark, text, case):
    assert ng.case_of([text[a:b] for a, b in ng.spans(text)]) == case
    assert apply(spark, lambda c: tx.case_of(tx.tokens(c)), text) == [case]


def test_counts(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("a.b.a", "a"), ("x", "y")], "t string, p string")
    assert [r[0] for r in rows.select(tx.count_matches(F.col("t"), F.col("p"))).collect()] == [2, 2, 0]
    assert apply(spark, tx.word_count, "a b  c ", " a", "", "one") == [3, 2, 1, 1]


def test_tokens_and_pieces(spark):
    assert [("Palladium-103 can't")[a:b] for a, b in ng.spans("Palladium-103 can't")] == ["Palladium", "-", "103", "can", "'", "t"]
    line = "x  a-1,\tb "
    assert "".join(apply(spark, tx.pieces, line)[0]) == line


def test_sentences():
    text = "Dr. Smith came. He saw J. Doe! Really? yes it is 3.5 wide."
    assert [text[a:b] for a, b in ng.sentences(text)] == ["Dr. Smith came.", "He saw J. Doe!", "Really? yes it is 3.5 wide."]
    assert ng.sentences("  ") == []


def test_ngrams():
    assert list(ng.line_ngrams("a b\nc d e", 2)) == ["a", "a b", "b", "c", "c d", "d", "d e", "e"]
    found = ng.label_candidates("The cat sat. It ran", 2)
    assert (0, 7, "The cat", "The cat", "natural") in found and (0, 7, "the cat", "the cat", "downcased") in found
    assert (4, 7, "Cat", "cat", "recased") in found and (4, 11, "Cat sat", "cat sat", "recased") in found and (4, 11, "Cat Sat", "cat sat", "recased") in found
    assert not any(x[2].startswith("sat. It") for x in found)
    text = "Größe, naïve & 日本 test-case.\nNew line; more"
    assert all(text[a:b] == c for a, b, c, _, k in ng.label_candidates(text, 3) if k == "natural" and c in text)
    known = {"cat", "The cat"}
    assert {x[2] for x in ng.label_candidates("The cat sat. It ran", 2, known)} == known


def test_first_letters_of_both_engines(spark):
    """The column functions and those of the Python workers turn first letters alike."""
    words = ["ßa", "ǆep", "éa", "e\u0301a", "ﬁre", "İx", "ıx", "Ça", "日本", "1a", "a", "", "ΐx"]
    assert apply(spark, tx.capitalize_first, *words) == [ng.capitalize(w) for w in words]
    assert apply(spark, tx.uncapitalize_first, *(w.upper() for w in words)) == [ng.uncapitalize(w.upper()) for w in words]


def test_languages():
    assert set(LANGUAGES) == {"en", "en_simple", "fr"} and len(ENGLISH.disambiguation_prefixes) == 9 and "hndis" not in ENGLISH.disambiguation_prefixes
    assert LANGUAGES["fr"].disambiguation_prefixes == ("homonymie",) and LANGUAGES["en_simple"].profile.min_in_links == 3
    assert ENGLISH.profile.linking_groups == (("linking-train", 5000), ("linking-test", 2000))
    assert Settings(language="fr").chosen is LANGUAGES["fr"]
    with pytest.raises(ValueError, match="no language xx"):
        Settings(language="xx").chosen


def test_markup():
    page = (
        "{{Infobox|name=[[Inside]]}}'''Thing''' (''{{lang|x}}'') is a [[big thing|thing]]s of [[Place]]ville.<ref>[[no]]</ref> It has [[File:a.png|thumb|left|A [[cap]]tion]] parts &amp; more.\n"
        "== Head ==\n* one [[Item]]\n# two\n{| class=x\n! H1 !! H2\n|-\n| style=y | a || b\n|}\n<!-- [[gone]] -->\n[http://x.org Out] [[Category:Things]]\n"
    )
    found = wt.parse(page)
    assert [(x["target"], x["anchor_text"]) for x in found["links"]] == [("Inside", "Inside"), ("big thing", "thing"), ("Place", "Place"), ("cap", "cap"), ("Item", "Item"), ("Category:Things", "Category:Things")]
    assert all(page[x["left"] : x["right"]] == x["target"] for x in found["links"])
    assert "Thing is a things of Placeville. It has A caption parts & more." in found["text"]
    assert "Head" in found["text"] and " : H1" in found["text"].replace("\n", " ") and "| b" in found["text"] and "Out Category:Things" in found["text"]
    assert "gone" not in found["text"] and "ref" not in found["text"] and found["list_items"] == 2
    assert found["snippet"]["first_sentence"] == "Thing  is a thing of Place." and "caption" not in found["snippet"]["first_paragraph"]


def test_broken_markup():
    for text in ("[[a", "a]]", "{{x", "}}", "[[a|b", "[[a {{b]] c}}", "[[]]", "''", "{|", "|}", "<ref>", "[[a]][[b", "{{{{}}}}"):
        assert wt.parse(text) is not None
    assert wt.parse("[[" * 5000) is None
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["[[", "]]", "{{", "}}", "|", "a", " ", "\n", "*", "''", "<b>", "File:x", "=", "{|", "|}"]) for _ in range(rng.randint(0, 30)))
        found = wt.parse(text)
        assert found is not None and all(text[x["left"] : x["right"]] == x["target"] for x in found["links"] if x["target"].isalnum())


def test_parsed_frame(spark):
    rows = wt.parsed(spark.createDataFrame([(1, "One. Two [[x]]."), (2, None), (3, "[[" * 5000)], "id long, wikitext string")).collect()
    assert {r["id"]: r["text"] for r in rows} == {1: "One. Two x.", 2: None, 3: None}


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_measures(spark):
    lit = F.lit
    close = lambda a, b, common, n: value(spark, me.link_similarity(lit(a), lit(b), lit(common), lit(n)))
    assert close(10, 5, 5, 500_000) > 0.93 and 0.86 < close(10, 5, 5, 1000) < 0.87 and 0.82 < close(5, 1, 1, 10_000) < 0.83
    assert 0.78 < close(100, 10, 10, 500_000) < 0.79 and close(5, 5, 0, 100) == 0.0
    assert value(spark, me.cosine(lit(1.0), lit(1.0), lit(1.0))) == 1.0 and value(spark, me.cosine(lit(0.0), lit(0.0), lit(1.0))) == 0.0
    assert value(spark, me.link_probability(lit(3), lit(0))) is None and value(spark, me.link_probability(lit(3), lit(2))) == 1.0
    assert abs(value(spark, me.sigmoid(lit(0.0))) - 0.5) < 1e-12
    low = me.lowest_similarity(1000)
    assert abs(low - (1 - math.log(999) / math.log(1000))) < 1e-12 and value(spark, me.rescaled(lit(0.0), low)) < 0


def test_configuration():
    found = Language.from_json('[{"code": "en_simple", "name": "Simple", "disambiguationPrefixes": ["dab"], "trainingProfile": {"minInLinks": 3, "disambiguatorGroup": [{"name": "train", "size": 5}]}}]')
    assert found["en_simple"].wiki_prefix == ":simple:" and found["en_simple"].profile.min_in_links == 3 and found["en_simple"].profile.disambiguator_groups == (("train", 5),)
    assert Settings.from_environment({"N_WORKERS": "3", "COMPRESS_MARKUP": "false"}).master == "local[3]" and Settings.from_environment({}).compress


def test_both_token_patterns_agree():
    import regex

    every = "".join(map(chr, range(0x250)))
    for text in (every, *(every[i : i + 3] for i in range(0x24D)), "a²b ½x º1ª µ"):
        assert [m.span() for m in ng.LATIN.finditer(text)] == [m.span() for m in regex.finditer(tx.TOKEN, text)] == ng.spans(text)
    assert [("x日本 é̈1")[a:b] for a, b in ng.spans("x日本 é̈1")] == ["x日本", "é̈", "1"]


def test_known_labels_lose_no_form():
    rng = random.Random(9)
    words = ["iceland", "ICELAND", "New", "york", "straße", "İzmir", "ıl", "K", "ǆ", "the", "The"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) + rng.choice([".", ". ", "! X"])
        every = ng.label_candidates(text, 2)
        known = {x[2] for x in every if rng.random() < 0.3}
        assert ng.label_candidates(text, 2, known) == [x for x in every if x[2] in known]


def test_counting_ngrams_holds_a_slice_of_texts(monkeypatch):
    """Many texts in one Arrow batch: what the worker holds follows a slice of them, and so do its batches."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    words, grabbed = [f"w{i}" for i in range(400)], []

    class Frame:
        schema = T.StructType().add("doc_id", T.LongType()).add("_n", T.IntegerType())

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            grabbed.append(f)

    monkeypatch.setattr(ng, "spread", lambda df: df)
    monkeypatch.setattr(ng.F, "lit", lambda x: ng.F)
    monkeypatch.setattr(ng.F, "alias", lambda x: x, raising=False)
    monkeypatch.setattr(ng.F, "col", lambda x: type("C", (), {"cast": lambda self, kind: self})())
    n = 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([" ".join(words[i % 7 :]) for i in range(n)])], names=["doc_id", "text"])
    tokens = [2 * (400 - i % 7) for i in range(n)]  # of two tokens each, of which "w" stands everywhere
    total = sum(10 * t - 45 - (t // 2 - 1) for t in tokens)
    for make, want in ((ng.counted_ngrams, total), (ng.ngram_totals, n), (ng.cased_ngrams, None)):
        make(Frame())
        tracemalloc.start()
        rows = [len(out) for out in grabbed[-1](iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(rows) <= ng.BATCH and peak < 100e6, (make, max(rows), peak)
        assert want in (None, sum(rows))


def test_cases_by_bits_are_those_of_columns(spark):
    from knotwork.functions import text as tx

    texts = ["One two THREE four. NEW YORK 12 !\nx Y", "Über ÇA va ǅ á 日本 3", ""]
    found = {(r["content"], r["case_context"]) for r in ng.cased_ngrams(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = {x for t in texts for x in ng.line_ngrams(t)}
    rows = spark.createDataFrame([(x,) for x in want], "content string").select("content", tx.case_of(tx.tokens(F.col("content"))))
    assert found == {tuple(r) for r in rows.collect()}
