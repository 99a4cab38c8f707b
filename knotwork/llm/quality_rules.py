"""5. Quality rules: repetition by suffix array, beside plain counts.

Per text, a suffix array of its words (prefix doubling: suffixes are ordered by 1, 2, 4, ... words; those that are
alone already drop out) and the longest common prefixes of neighbours in it, counted from the position before where
the words in front are equal. Every interval of that array with a
common prefix of at least ``min_repeat`` words is a maximal repeated substring; the deepest interval over a position
has the larger of its two common prefixes. The union of the spans of all of them and the longest are limited:
``kept`` is false if the union covers more than ``max_covered`` of the words or one repeat is longer than
``max_repeat`` words. Many texts are worked on in one array; suffixes of different texts never meet.

One pass over the texts without a shuffle; a task holds a few MB of text, or one longer text, at a time, and a few
numbers for each of its words.

Null and empty texts have no words: all counts are 0 and the base rule fails them (fewer than ``min_words``).
Repeated rows are judged each. Columns of the input that aren't named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import forget
from .util import numbered, spread, table
from .words import SPACE, counts, offsets, raw_texts, slices, word_ids

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_WORDS = 50, 50  # words; per cent of words in repeated 3-word windows
#: Words that a repeat must have to count, the share of words that repeats may cover, and words of the longest.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.3, 200
#: Words of all pairs that are compared at a time.
STEP = 1 << 16
OUT = pa.schema(
    [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, spans array<struct<start: long, end: long>>"


def suffix_array(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of all texts in ``ids``, and its inverse.

    While it grows, a rank is where the group of equal beginnings starts in the array.
    """
    n = len(ids)
    whole = np.int32 if n < 1 << 30 else np.int64
    end = np.repeat(at[1:], np.diff(at)).astype(whole)
    key = np.repeat(np.arange(len(at) - 1), np.diff(at)) * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable").astype(whole)
    found = key[order]
    del key
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if n else np.zeros(0, np.int64)
    del found
    rank = np.empty(n, whole)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    k = 1
    active = order[np.repeat(sizes > 1, sizes)]  # by rank
    while len(active):
        after = active + whole(k)
        inside = after < end[active]
        key = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0).astype(np.int64)
        del after, inside
        own = rank[active]
        key += own.astype(np.int64) * (n + 2)
        by = np.argsort(key, kind="stable")
        active, own, key = active[by], own[by], key[by]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        place = own + np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        order[place] = active
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(new, len(key)))
        rank[active] = np.repeat(place[new], sizes)
        active, k = active[np.repeat(sizes > 1, sizes)], 2 * k
    return order, rank


def common_words(ids: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words are equal from positions i and j on, at most ``room``: all pairs side by side, in longer steps
    the fewer of them go on."""
    found, live = np.zeros(len(i), np.int64), np.flatnonzero(room > 0)
    while len(live):
        step = max(1, min(STEP // len(live), int((room[live] - found[live]).max())))
        along = found[live][:, None] + np.arange(step)
        inside = along < room[live][:, None]
        x, y = np.where(inside, i[live][:, None] + along, 0), np.where(inside, j[live][:, None] + along, 0)
        equal = inside & (ids[x] == ids[y])
        more = np.where(equal.all(1), step, equal.argmin(1))
        found[live] += more
        live = live[(more == step) & (found[live] < room[live])]
    return found


def longest_repeats(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position, the longest beginning that stands somewhere else in its text too: the larger of its common
    prefixes with its two neighbours in the suffix array.

    The prefix with the neighbour before is one less than that of the position before, where the two are preceded by
    the same word of their texts. Elsewhere it is counted; all counts together are of the order of n log n."""
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    start = np.repeat(at[:-1], np.diff(at)).astype(order.dtype)
    here = np.arange(n, dtype=order.dtype)
    paired = before >= start  # the array is by text: a neighbour of another text is one of an earlier text
    reducible = paired & (here > start) & (before > start)
    inner = np.flatnonzero(reducible)
    reducible[inner] = ids[inner - 1] == ids[before[inner] - 1]
    counted = np.flatnonzero(paired & ~reducible)
    common = np.zeros(n, order.dtype)
    end = at[np.searchsorted(at, counted, "right")]
    common[counted] = common_words(ids, counted, before[counted], end - np.maximum(counted, before[counted]))
    since = np.maximum.accumulate(np.where(reducible, 0, here))
    common = np.maximum(common[since] - (here - since), 0)
    after = np.zeros(n, order.dtype)
    after[order[:-1]] = common[order[1:]]
    return np.maximum(common, after)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT, spans: bool = False) -> list:
    """The columns of OUT for these texts."""
    raw, at = np.frombuffer(b"".join(texts), np.uint8), offsets([len(t) for t in texts])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    ids, word_at = word_ids(texts)
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    longest = longest_repeats(ids, *suffix_array(ids, word_at), word_at)
    three = np.flatnonzero(longest >= 3)
    repeat = counts(covered(three, np.full(len(three), 3), len(ids)), word_at)
    long = np.flatnonzero(longest >= min_repeat)
    cover = covered(long, longest[long], len(ids))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, np.searchsorted(word_at, long, "right") - 1, longest[long])
    counted = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)  # first bytes of code points in words
    chars = counts(counted[raw], at)
    found = [np.diff(word_at), chars, counts(symbol[raw], at), np.array(dup_lines, np.int64), repeat, counts(cover, word_at), most]
    merged: list = [None] * len(texts)
    if spans:
        for i, (a, b) in enumerate(zip(word_at[:-1], word_at[1:])):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cover[a:b].astype(np.int8), [0]])))
            merged[i] = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
    return [*(pa.array(x, pa.int64()) for x in found), pa.array(merged, OUT.field("spans").type)]


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep``, and the counts of each text; ``spans``: the union of its repeats, as word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = raw_texts(batch.column(batch.num_columns - 1))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *measure(texts[a:b], min_repeat, spans)], names=[*names, *OUT.names])

    names = [id_col, *keep]
    picked = spread(df.select(*(F.col(x) for x in names), F.col(text_col).cast("string").alias("_text")))
    kinds = ", ".join(f"`{x}` {picked.schema[x].dataType.simpleString()}" for x in names)
    return picked.mapInArrow(run, f"{kinds}, {DDL}")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))


def within_limits(max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT):
    return (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    found = repetition(df, id_col, text_col, spans=spans, keep=keep).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & within_limits(max_covered, max_repeat))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), spans=False).drop("spans")


#: What lies in a repeat of 8 words or more lies in a window of 8 words that stands there twice; the longest repeat is
#: found by growing such windows by a word at a time, while they still stand there twice.
SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
d AS MATERIALIZED (SELECT *, row_number() OVER () AS k FROM t),
p AS MATERIALIZED (SELECT k, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT k, i, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS g FROM p, (VALUES (3), (8)) s(n) WHERE i + n - 1 <= len(w)),
y AS MATERIALIZED (SELECT k, i, n, g FROM (SELECT *, count(*) OVER (PARTITION BY k, n, g) AS c FROM x) WHERE c > 1),
grow(k, i, n, g) AS (SELECT k, i, n, g FROM y WHERE n = 8 UNION ALL SELECT k, i, n, g FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM (SELECT r.k, r.i, r.n + 1 AS n, md5(r.g || p.word) AS g FROM grow r JOIN p ON p.k = r.k AND p.i = r.i + r.n)) WHERE c > 1),
c AS (SELECT k, n, count(*) AS m FROM (SELECT DISTINCT k, n, i + unnest(range(0, n)) AS j FROM y) GROUP BY k, n),
l AS (SELECT k, count(*) - count(DISTINCT line) AS m FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \x09-\x0D]') GROUP BY k),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.m, 0)::BIGINT AS n_dup_lines,
  coalesce(c3.m, 0)::BIGINT AS n_repeat_words, coalesce(c8.m, 0)::BIGINT AS covered_words, coalesce(o.most, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN l ON l.k = d.k LEFT JOIN c c3 ON c3.k = d.k AND c3.n = 3 LEFT JOIN c c8 ON c8.k = d.k AND c8.n = 8 LEFT JOIN (SELECT k, max(n) AS most FROM grow GROUP BY k) o ON o.k = d.k)
SELECT *, NOT base_failed AND covered_words <= 0.3 * n_words AND longest_repeat <= 200 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, as they are."""
    own = numbered(docs)
    found = judge(own, own.columns[0], own.columns[docs.columns.index("text")], spans=False, keep=tuple(own.columns[1:]))
    return found.where("kept").select(own.columns).toDF(*docs.columns)
