"""Tokens, sentences and n-grams of texts, in Python workers over Arrow batches. Offsets are code points."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_NGRAM_TOKENS
from ..storage import spread
from .text import TOKEN

#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = {"Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "etc", "e.g", "i.e", "Jr", "Sr", "No", "Inc", "Ltd", "Co", "M", "Mme", "Mlle"}
NGRAM = "start int, `end` int, content string, natural string, kind string"
SCHEMA = pa.schema([("start", pa.int32()), ("end", pa.int32()), ("content", pa.string()), ("natural", pa.string()), ("kind", pa.string())])


#: The same tokens for texts below U+0250, where the classes are these; most texts are, and this is twice as fast.
LATIN = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]+|[^ \t\n\r\f]")
BEYOND = re.compile("[^\x00-\u024f]")


@cache
def any_token():
    import regex

    return regex.compile(TOKEN)


def token_pattern(text: str):
    return any_token() if BEYOND.search(text) else LATIN


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in token_pattern(text).finditer(text)]


BREAK = re.compile(r"[.!?]+[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[^\W_a-zß-öø-ÿ])")


def sentences(line: str) -> list[tuple[int, int]]:
    """Spans of sentences: a sentence ends behind . ! ? and closing quotes or brackets, before blanks and an upper-case
    letter, a digit or an opening quote, unless an abbreviation or an initial stands before the period."""
    out, start = [], 0
    for m in BREAK.finditer(line):
        before = line[start : m.start()].rsplit(None, 1)[-1:] or [""]
        if m.group()[0] == "." and (before[0].strip("(\"'") in ABBREVIATIONS or len(before[0]) == 1 and before[0].isupper()):
            continue
        out.append((start, m.start() + len(m.group().rstrip())))
        start = m.end()
    out.append((start, len(line)))
    return [(a + len(line[a:b]) - len(line[a:b].lstrip()), b - len(line[a:b]) + len(line[a:b].rstrip())) for a, b in out if line[a:b].strip()]


def case_of_token(token: str) -> str:
    if all(c.isupper() for c in token):
        return "UPPER"
    if all(c.islower() for c in token):
        return "LOWER"
    if token[:1].isupper() and all(c.islower() for c in token[1:]):
        return "UPPER_FIRST"
    return "MIXED"


def case_of(tokens: list[str]) -> str:
    found = {case_of_token(t) for t in tokens if any(c.isalpha() for c in t)}
    if not found:
        return "MIXED"
    if found == {"UPPER"} or found == {"LOWER"}:
        return found.pop()
    return "UPPER_FIRST" if found <= {"UPPER", "UPPER_FIRST"} else "MIXED"


def capitalize(text: str) -> str:
    return text[:1].upper() + text[1:]


def uncapitalize(text: str) -> str:
    return text[:1].lower() + text[1:]


def variants(content: str, tokens: list[tuple[int, int]]) -> list[str]:
    """Title case by token and sentence case of an n-gram in one case; token spans count from its start."""
    case = case_of([content[a:b] for a, b in tokens])
    if case not in ("LOWER", "UPPER"):
        return []
    base = content.lower() if case == "UPPER" else content
    if len(base) != len(content):
        base = content
    parts, at = [], 0
    for a, b in tokens:
        parts += [base[at:a], capitalize(base[a:b])]
        at = b
    return [x for x in dict.fromkeys(("".join(parts) + base[at:], capitalize(base))) if x != content]


def line_ngrams(text: str, longest: int = MAX_NGRAM_TOKENS) -> Iterator[str]:
    """Every run of up to ``longest`` tokens of a line, as it stands there."""
    if longest == 1:
        yield from token_pattern(text).findall(text)
        return
    for line in text.split("\n"):
        at = spans(line)
        for i, (start, _) in enumerate(at):
            for _, end in at[i : i + longest]:
                yield line[start:end]


def sentence_ngrams(text: str, longest: int = MAX_NGRAM_TOKENS) -> Iterator[tuple[int, int, list[tuple[int, int]], bool]]:
    """(start, end, token spans from the start, whether a sentence starts here) of every n-gram inside a sentence."""
    base = 0
    for line in text.split("\n"):
        for a, b in sentences(line):
            at = [(base + a + s, base + a + e) for s, e in spans(line[a:b])]
            for i, (start, _) in enumerate(at):
                for j in range(i, min(i + longest, len(at))):
                    yield start, at[j][1], [(s - start, e - start) for s, e in at[i : j + 1]], i == 0
        base += len(line) + 1


def caseless(text: str) -> str:
    """Equal for all forms of a text that differ in case."""
    return text.lower().upper().lower()


class Filter:
    """A Bloom filter of texts: says no only to what isn't in it. ``bits``: a power of two of them, little-endian."""

    def __init__(self, bits: bytes):
        from xxhash import xxh64_intdigest

        self.digest, self.bits, self.mask = xxh64_intdigest, bits, 8 * len(bits) - 1

    def places(self, text: str) -> tuple[int, int]:
        """The two bits of a text."""
        h = self.digest(text.encode("utf-8", "surrogatepass"))
        return h & self.mask, h >> 32 & self.mask

    def __contains__(self, text: str) -> bool:
        h = self.digest(text.encode("utf-8", "surrogatepass"))
        a = h & self.mask
        if not self.bits[a >> 3] >> (a & 7) & 1:
            return False
        b = h >> 32 & self.mask
        return bool(self.bits[b >> 3] >> (b & 7) & 1)


def filter_bits(labels: DataFrame, size: int, label_col: str = "label") -> DataFrame:
    """(kind, word, bits): the set bits, 32 a word, of the filters of the labels (kind 0) and of their caseless forms (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Filter(bytes(size >> 3))
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for label in batch.column(0).to_pylist():
                for kind, text in enumerate((label, caseless(label))):
                    for place in empty.places(text):
                        key = kind, place >> 5
                        found[key] = found.get(key, 0) | 1 << (place & 31)
            kinds, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(words, pa.int64()), pa.array(found.values(), pa.int64())], names=["kind", "word", "bits"])

    return labels.select(F.col(label_col).cast("string")).dropna().mapInArrow(run, "kind int, word long, bits long").groupBy("kind", "word").agg(F.bit_or("bits").alias("bits"))


def label_candidates(text: str, longest: int, known=None, forms_known=None, forms=None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, content, natural form, kind) of all n-grams of the text and of its letters and digits alone, with
    their downcased twins at sentence starts and their recased variants; ``known``: only contents in it, if given, and
    ``forms_known`` their caseless forms: what isn't among these has no form that is known. ``forms``: known_forms by
    content and place, kept from text to text."""
    import regex

    if known is not None and forms_known is None:
        forms_known = set(map(caseless, known))
    forms = Once(lambda key: known_forms(*key, known, forms_known)) if forms is None else forms
    out: dict[tuple, None] = {}
    for source in (text, regex.sub(r"[^\p{L}\p{Nd}]", " ", text)):
        base = 0
        for line in source.split("\n"):
            for a, b in sentences(line):
                part, at = line[a:b], spans(line[a:b])
                for i, (start, _) in enumerate(at):
                    for _, end in at[i : i + longest]:
                        for form in forms[part[start:end], i == 0]:
                            out[base + a + start, base + a + end, *form] = None
            base += len(line) + 1
    return list(out)


def known_forms(content: str, first: bool, known=None, forms_known=None) -> list[tuple[str, str, str]]:
    """(form, natural form, kind) of one n-gram that are known; ``first``: a sentence starts with it."""
    if forms_known is not None and caseless(content) not in forms_known:
        return []
    forms = [(content, content, "natural")] + ([(uncapitalize(content), uncapitalize(content), "downcased")] if first else [])
    tokens = spans(content)
    for form, natural, _ in list(forms):
        forms += [(v, natural, "recased") for v in variants(form, tokens)]
    return [x for x in forms if known is None or x[0] in known]


class Once(dict):
    """Values of a function by argument, each made once as long as there aren't too many."""

    def __init__(self, of, most: int = 1 << 17):
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.of(key)
        return value


def found_rows(batches: Iterator[pa.RecordBatch], find, schema: pa.Schema, id_col: str) -> Iterator[pa.RecordBatch]:
    """What ``find`` gives for each text, with the text's id in front, in batches of about BATCH rows."""
    for batch in batches:
        ids, held = [], []

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held), schema)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), *columns], names=[id_col, *schema.names])

        for i, text in enumerate(batch.column(1)):
            found = find(text.as_py() or "")
            for at in range(0, len(found), BATCH):
                held += found[at : at + BATCH]
                ids += [i] * (len(held) - len(ids))
                if len(held) >= BATCH:
                    yield taken()
                    ids, held = [], []
        if held:
            yield taken()


def candidates(docs: DataFrame, longest: int = MAX_NGRAM_TOKENS, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label_candidates of every document; ``known``: a broadcast variable that holds the filters of labels and of
    their caseless forms, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = map(Filter, known.value) if known else (None, None)
        forms = Once(lambda key, filters=tuple(filters): known_forms(*key, *filters))
        yield from found_rows(batches, lambda text: label_candidates(text, longest, forms=forms), SCHEMA, id_col)

    picked = spread(docs.select(id_col, F.col(text_col).cast("string")))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, {NGRAM}")


def placed_ngrams(docs: DataFrame, longest: int = MAX_NGRAM_TOKENS, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, content): where the line n-grams stand that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = Once(Filter(known.value[0]).__contains__ if known else lambda content: True)

        def find(text: str) -> list[tuple[int, int, str]]:
            if longest == 1:
                return [(*m.span(), m[0]) for m in token_pattern(text).finditer(text) if allowed[m[0]]]
            found, base = [], 0
            for line in text.split("\n"):
                at = spans(line)
                for k, (a, _) in enumerate(at):
                    found += [(base + a, base + b, line[a:b]) for _, b in at[k : k + longest] if allowed[line[a:b]]]
                base += len(line) + 1
            return found

        yield from found_rows(batches, find, pa.schema(list(SCHEMA)[:3]), id_col)

    picked = spread(docs.select(id_col, F.col(text_col).cast("string")))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, start int, `end` int, content string")


#: Code points of texts worked on at once, unless one text is longer, and n-grams or their code points in one batch.
SLICE, BATCH = 1 << 20, 1 << 15
#: What a token with letters can be, as bits; a token without is all of it. WORDED: some token has letters.
UPPER, LOWER, FIRST, WORDED = 1, 2, 4, 8
CASES = np.array(["UPPER" if k & UPPER else "LOWER" if k & LOWER else "UPPER_FIRST" if k & FIRST else "MIXED" for k in range(8)] + ["MIXED"])


@cache
def case_patterns():
    import regex

    return regex.compile(r"\p{L}"), [(regex.compile(p), bit) for p, bit in ((r"\p{Lu}+", UPPER), (r"\p{Ll}+", LOWER), (r"\p{Lu}+|\p{Lu}\p{Ll}*", FIRST))]


def case_bits(token: str) -> int:
    letter, patterns = case_patterns()
    if not letter.search(token):
        return UPPER | LOWER | FIRST
    return WORDED | sum(bit for pattern, bit in patterns if pattern.fullmatch(token))


class Runs:
    """The line n-grams of some texts by numbers: a token is one number, and one with the blanks before it another, so
    n-grams of one text are equal where their last tokens and all before them are. No n-gram is a string here."""

    def __init__(self, texts: list[str], apart: bool = True):
        self.joined = "\n".join(texts)
        words: dict[str, int] = {}
        tails: dict[str, int] = {}
        word, tail, start, end, n = array("q"), array("q"), array("q"), array("q"), []
        base = 0
        for text in texts:
            last = None
            for a, b in spans(text):
                word.append(words.setdefault(text[a:b], len(words)))
                tail.append(-1 if last is None or "\n" in text[last:a] else tails.setdefault(text[last:b], len(tails)))
                start.append(base + a)
                end.append(base + b)
                last = b
            n.append(len(word))
            base += len(text) + 1
        self.words, self.n_tails = words, len(tails)
        self.word, self.tail, self.start, self.end = (np.frombuffer(x, np.int64) if x else np.zeros(0, np.int64) for x in (word, tail, start, end))
        self.text = np.repeat(np.arange(len(texts)), np.diff([0, *n])) if texts else np.zeros(0, np.int64)
        self.apart = apart

    def of_length(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: where n-grams of it start, which of these places are the first of their text (of all, if texts
        aren't kept apart), and how often these n-grams stand there. Places are tokens' numbers."""
        at, key = np.arange(len(self.word)), self.word + self.text * (len(self.words) if self.apart else 0)
        for k in range(longest):
            if k:
                some = np.flatnonzero(at + k < len(self.word))
                some = some[self.tail[at[some] + k] >= 0]
                at = at[some]
                key = rank[some] * self.n_tails + self.tail[at + k]
            if not len(at):
                return
            _, first, rank, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            yield at, at[first], count

    def reach(self, longest: int) -> np.ndarray:
        """The last token of each token's longest n-gram."""
        breaks = np.append(np.flatnonzero(self.tail < 0), len(self.tail))
        return np.minimum(np.arange(len(self.tail)) + longest, breaks[np.searchsorted(breaks, np.arange(len(self.tail)), "right")]) - 1

    def contents(self, at: np.ndarray, last: np.ndarray) -> Iterator[tuple[slice, list[str]]]:
        """The n-grams from tokens to tokens as strings, some at a time."""
        a, b = self.start[at], self.end[last]
        sizes = np.cumsum(b - a) // (BATCH * 64) + np.arange(len(a)) // BATCH
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(a)]
        for x, y in zip(edges[:-1], edges[1:]):
            if x < y:
                yield slice(x, y), [self.joined[i:j] for i, j in zip(a[x:y].tolist(), b[x:y].tolist())]


def text_slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Successive texts of about SLICE code points, null as empty, with the number of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i + 1 == len(texts):
            yield start, [t or "" for t in texts[start : i + 1]]
            start, size = i + 1, 0


def over_texts(docs: DataFrame, run, schema: str, id_col: str, text_col: str) -> DataFrame:
    """``run`` over slices of texts: it gets the ids, the texts and yields batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # texts become strings a few at a time
                part = batch.slice(at, 256)
                for i, texts in text_slices(part.column(1).to_pylist()):
                    yield from run(part.column(0).slice(i, len(texts)), texts)

    picked = spread(docs.select(id_col, F.col(text_col).cast("string")))
    return picked.mapInArrow(each, schema.replace("_id", f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}"))


def counted_ngrams(docs: DataFrame, longest: int = MAX_NGRAM_TOKENS, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, n): the line n-grams of each document, counted there, before anything moves; ``known``: as above,
    of which those that the filter lets through are counted. What a worker holds follows one text or SLICE, and batches
    are small, however many n-grams there are."""

    def run(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        runs = Runs(texts)
        for k, (_, first, count) in enumerate(runs.of_length(longest)):
            for at, found in runs.contents(first, first + k):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(runs.text[first[at]])), pa.array(found, pa.string()), pa.array(count[at])], names=[id_col, "content", "n"])

    def run_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = Once(Filter(known.value[0]).__contains__)

        def find(text: str) -> list[tuple[str, int]]:
            if longest == 1:
                return [x for x in Counter(line_ngrams(text, 1)).items() if allowed[x[0]]]
            return list(Counter(x for x in line_ngrams(text, longest) if allowed[x]).items())

        yield from found_rows(batches, find, pa.schema([("content", pa.string()), ("n", pa.int64())]), id_col)

    if known:
        picked = spread(docs.select(id_col, F.col(text_col).cast("string")))
        return picked.mapInArrow(run_known, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, content string, n long")
    return over_texts(docs, run, "_id, content string, n long", id_col, text_col)


def ngram_totals(docs: DataFrame, longest: int = MAX_NGRAM_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, n_distinct, last): how many line n-grams a document has, how many different ones, and the last of them in
    the order of their code points; a row for each text that has any."""

    def run(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        runs = Runs(texts)
        n, different = np.zeros((2, len(texts)), np.int64)
        for at, first, _ in runs.of_length(longest):
            n += np.bincount(runs.text[at], minlength=len(texts))
            different += np.bincount(runs.text[first], minlength=len(texts))
        last: list[str | None] = [None] * len(texts)
        # of n-grams that start at one place the longest is the last
        for at, found in runs.contents(np.arange(len(runs.word)), runs.reach(longest)):
            for i, x in zip(runs.text[at].tolist(), found):
                if last[i] is None or x > last[i]:
                    last[i] = x
        some = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(different), pa.array(last, pa.string())], names=[id_col, "n", "n_distinct", "last"]).filter(some)

    return over_texts(docs, run, "_id, n long, n_distinct long, last string", id_col, text_col)


def cased_ngrams(docs: DataFrame, longest: int = MAX_NGRAM_TOKENS, text_col: str = "text") -> DataFrame:
    """(content, case_context): the different line n-grams of slices of texts, and the case of their words; an n-gram may
    come from many slices."""

    def run(_: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        runs = Runs(texts, apart=False)
        bits = np.fromiter(map(case_bits, runs.words), np.int64, len(runs.words))[runs.word]
        every, some = bits & 7, bits & WORDED
        for k, (at, first, _) in enumerate(runs.of_length(longest)):
            if k:
                every[at], some[at] = every[at] & bits[at + k], some[at] | bits[at + k] & WORDED
            case = np.where(some[first] > 0, CASES[every[first]], "MIXED")
            for part, found in runs.contents(first, first + k):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(case[part].tolist(), pa.string())], names=["content", "case_context"])

    return over_texts(docs.select(F.lit(0).alias("_n"), text_col), run, "content string, case_context string", "_n", text_col)
