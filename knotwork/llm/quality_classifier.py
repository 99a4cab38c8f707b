"""2. Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word has features of its characters, words and repetition, and those of the line before and the
line after. The field labels each line good or bad; forward-backward gives each line's marginal, and their mean,
weighted by the lines' lengths, is the text's quality. A logistic curve, fitted beside the field, turns it into the
probability of label 1. Two labels need one log-odds a message, so many texts run through the recursions at once.

Training: lines bear the label of their document. The sample is bounded: at most ``TRAIN_ROWS`` labelled ids, by their
hash, and of each document, however long, at most ``TRAIN_LINES`` successive lines with a word, from a place that its
text's checksum names. Only the features of these lines come to the driver. Of several rows of one labelled id the one
whose features are least counts. Scoring is one pass over all whole texts without a shuffle.

Null and empty texts have no lines: their score is the share of label 1 in the sample. Without labelled rows of both
labels every score is that share, or 0.5 without any. Repeated rows are scored each; null labels are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import forget
from .util import numbered, spread, table
from .words import SPACE, offsets, raw_texts, slices, word_ids

TRAIN_ROWS, TRAIN_LINES, STEPS = 3000, 200, 200
THRESHOLD = 0.3
#: Lines whose inputs are made, or worked on in double precision, at a time.
BLOCK = 1 << 14
#: Own features of a line, besides those of its neighbours.
FEATURES = ("upper", "symbols", "exclamations", "bars", "digits", "same_as_before", "in_repeats", "seen_line", "words", "word_length", "marked_words")
N = len(FEATURES)


def mask(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


UPPER, LOWER, DIGIT = mask(bytes(range(65, 91))), mask(bytes(range(97, 123))), mask(b"0123456789")
SYMBOL, MARK = mask(b"#*$%&|<>@^~=+_{}[]\\"), mask(b"#*$%&|<>@^~=+_!?")


class Lines(NamedTuple):
    """Lines with a word: whose they are, their lengths in bytes, their own features."""

    text: np.ndarray
    length: np.ndarray
    own: np.ndarray


def line_features(texts: list[bytes]) -> Lines:
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N), np.float32))
    breaks = np.flatnonzero(raw == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.append(breaks, len(raw))
    text = np.searchsorted(offsets([len(t) + 1 for t in texts]), start, "right") - 1
    ids = word_ids(texts)[0]
    edges = np.diff(SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    word_at, word_end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1) - 1
    del edges
    sizes, marked = np.minimum(word_end - word_at + 1, 50).astype(np.int8), MARK[raw[word_end]]
    del word_end
    line = np.searchsorted(start, word_at, "right") - 1
    del word_at
    n_words = np.bincount(line, minlength=len(start))
    of_text = text[line]

    def in_lines(values: np.ndarray) -> np.ndarray:
        return np.bincount(line, values, len(start))

    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (of_text[1:] == of_text[:-1])])[: len(ids)]
    repeats = np.zeros(len(ids), bool)
    if len(ids) > 2:
        with np.errstate(over="ignore"):
            x = ids.view(np.uint64)
            windows = x[:-2] * np.uint64(0x9E3779B97F4A7C15)
            windows += x[1:-1]
            windows *= np.uint64(0xC2B2AE3D27D4EB4F)
            windows += x[2:]
            windows *= np.uint64(0x165667B19E3779F9)
            windows ^= of_text[2:].view(np.uint64) << np.uint64(40)
        inside = np.flatnonzero(of_text[2:] == of_text[:-2])
        windows = windows[inside]
        order = np.argsort(windows, kind="stable")
        windows, inside = windows[order], inside[order]
        del order
        equal = windows[1:] == windows[:-1]
        del windows
        for twice in (inside[1:][equal], inside[:-1][equal]):
            for k in range(3):
                repeats[twice + k] = True
        del inside, equal
    del ids, of_text
    seen, dup, last = set(), np.zeros(len(start)), -1
    for i, (t, a, b) in enumerate(zip(text.tolist(), start.tolist(), end.tolist())):
        content = joined[a:b]
        if t != last:
            seen, last = set(), t
        if content in seen:
            dup[i] = 1
        else:
            seen.add(content)

    del seen
    filled = start[start < len(raw)]  # all but an empty last line

    def share(of: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(start), np.int64)
        sums[: len(filled)] = np.add.reduceat(of[raw], filled, dtype=np.int64)  # none of them holds a line feed
        return sums / np.maximum(n, 1)

    length = end - start
    letters = share(UPPER | LOWER, 1)
    own = np.stack([
        share(UPPER, letters), share(SYMBOL, length), share(mask(b"!"), length), share(mask(b"|"), length), share(DIGIT, length),
        in_lines(same) / np.maximum(n_words, 1), in_lines(repeats) / np.maximum(n_words, 1), dup, np.log1p(n_words) / 5,
        in_lines(sizes) / np.maximum(n_words, 1) / 10, in_lines(marked) / np.maximum(n_words, 1),
    ], axis=1)
    some = n_words > 0
    return Lines(text[some], length[some], own[some].astype(np.float32))


def with_neighbours(text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A bias, own features, those of the lines before and after in the same text, and whether there are any."""
    n = len(own)
    before, after = np.zeros((n, N + 1), np.float32), np.zeros((n, N + 1), np.float32)
    if n > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:, :N], after[:-1, :N] = own[:-1] * same, own[1:] * same
        before[1:, N:], after[:-1, N:] = same, same
    return np.concatenate([np.ones((n, 1), np.float32), own, before, after], axis=1)


def input_blocks(lines: Lines) -> Iterator[tuple[slice, np.ndarray]]:
    """Which lines, and with_neighbours of them, ``BLOCK`` lines at a time."""
    for a in range(0, len(lines.text), BLOCK):
        b, near = a + BLOCK, slice(max(a - 1, 0), a + BLOCK + 1)
        yield slice(a, b), with_neighbours(lines.text[near], lines.own[near])[a - near.start :][:BLOCK]


class Chains:
    """Texts as chains of lines, longest first, so that step t works on the first ``alive[t]`` of them."""

    def __init__(self, text: np.ndarray):
        self.at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        size = np.diff(np.append(self.at, len(text)))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = self.at[order], size[order]
        self.steps = int(self.size[0]) if len(size) else 0
        self.alive = np.searchsorted(-self.size, -np.arange(self.steps), "left")

    def messages(self, unary: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the forward messages with, and the backward ones without, each line's own unary."""
        forward, backward = unary.copy(), np.zeros(len(unary))
        for t in range(1, self.steps):
            i = self.first[: self.alive[t]] + t
            a = forward[i - 1]
            forward[i] += np.logaddexp(a + link[1, 1], link[0, 1]) - np.logaddexp(a + link[1, 0], link[0, 0])
        for t in range(self.steps - 1, 0, -1):
            i = self.first[: self.alive[t]] + t
            b = unary[i] + backward[i]
            backward[i - 1] = np.logaddexp(b + link[1, 1], link[1, 0]) - np.logaddexp(b + link[0, 1], link[0, 0])
        return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -5, 5)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    link: np.ndarray
    curve: tuple[float, float]
    share: float  # of label 1

    def qualities(self, n: int, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of each of n texts; NaN for those without lines."""
        unary = np.zeros(len(lines.text))
        for at, x in input_blocks(lines):
            unary[at] = standard(x, self.mean, self.scale) @ self.weights
        good = sigmoid(np.add(*Chains(lines.text).messages(unary, self.link)))
        with np.errstate(invalid="ignore"):
            return np.bincount(lines.text, good * lines.length, n) / np.bincount(lines.text, lines.length, n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        quality = self.qualities(len(texts), line_features(texts))
        a, b = self.curve
        return np.where(np.isnan(quality), self.share, sigmoid(a + b * np.nan_to_num(quality)))


def fit(lines: Lines, label: np.ndarray, steps: int = STEPS) -> Model:
    """label: 0 or 1 of each text. Gradient steps (Adam) on the field's penalised conditional likelihood. The inputs are
    held once, in single precision; all else that is made of them is made of a block of lines at a time."""
    share = float(label.mean()) if len(label) else 0.5
    if not 0 < share < 1 or not len(lines.text):
        return Model(None, None, None, None, (0, 0), share)
    n = len(lines.text)
    mean = sum(part.sum(0, dtype=float) for _, part in input_blocks(lines)) / n
    scale = np.sqrt(sum(((part - mean) ** 2).sum(0) for _, part in input_blocks(lines)) / n)
    mean[0], scale = 0, np.maximum(scale, 1e-3)
    scale[0] = 1
    x = np.empty((n, len(mean)), np.float32)
    for at, part in input_blocks(lines):
        x[at] = standard(part, mean, scale)
    y = label[lines.text].astype(float)
    chains = Chains(lines.text)
    follows = np.ones(len(y), bool)
    follows[chains.at] = False
    j = np.flatnonzero(follows)
    told = np.array([[np.sum((y[j - 1] == a) & (y[j] == b)) for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, link = theta[:-4], theta[-4:].reshape(2, 2)
        unary = np.concatenate([x[a : a + BLOCK] @ weights for a in range(0, n, BLOCK)])
        forward, backward = chains.messages(unary, link)
        expected = np.zeros(4)
        for a in range(0, len(j), BLOCK):
            k = j[a : a + BLOCK]
            right = unary[k] + backward[k]
            joint = np.stack([np.full(len(k), link[0, 0]), link[0, 1] + right, forward[k - 1] + link[1, 0], forward[k - 1] + link[1, 1] + right])
            joint = np.exp(joint - joint.max(0))
            expected += (joint / joint.sum(0)).sum(1)
        off = y - sigmoid(forward + backward)
        slope = sum(x[a : a + BLOCK].T @ off[a : a + BLOCK] for a in range(0, n, BLOCK))
        gradient = np.concatenate([slope, told.ravel() - expected]) / n - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    del x
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (0, 0), share)
    quality = model.qualities(len(label), lines)
    some = ~np.isnan(quality)
    return model._replace(curve=logistic(quality[some], label[some]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(y = 1) = sigmoid(a + b x), slightly penalised."""
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(30):
        p = sigmoid(design @ beta)
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 0.5 * np.eye(2), design.T @ (y - p) - 0.5 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def stretch(lines: Lines, text: bytes, most: int) -> slice:
    """The lines of one text that train: all, or ``most`` successive ones."""
    more = len(lines.text) - most
    start = zlib.crc32(text) % (more + 1) if more > 0 else 0
    return slice(start, start + most)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``rows`` labelled documents, none of them held out, and ``lines`` lines of each."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").where(~held_out(F.col("_id")))
    own = own.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            found = []
            for text in texts:
                f = line_features([text])
                some = stretch(f, text, lines)
                found.append((f.length[some].astype("<i8").tobytes(), f.own[some].astype("<f4").tobytes()) if len(f.text) else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["_id", "_label", "lengths", "own"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(own), "_id").select("_id", "_label", "_text")
    kind = picked.schema["_id"].dataType.simpleString()
    made = picked.mapInArrow(run, f"_id {kind}, _label int, lengths binary, own binary").where("lengths is not null")
    once = made.groupBy("_id").agg(F.min(F.struct("own", "lengths", "_label")).alias("x"))  # an id may have many rows
    got = once.select("_id", "x.*").collect()  # at most `rows` rows of `lines` lines
    got = sorted(got, key=lambda r: str(r["_id"]))
    lengths = [np.frombuffer(r["lengths"], "<i8") for r in got]
    if not got:
        return fit(line_features([]), np.zeros(0))
    text = np.repeat(np.arange(len(got)), [len(x) for x in lengths])
    found = Lines(text, np.concatenate(lengths), np.concatenate([np.frombuffer(r["own"], "<f4").reshape(-1, N) for r in got]))
    label = np.array([r["_label"] for r in got])
    del got, lengths  # the fit needs the driver's memory
    return fit(found, label)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep`` and the score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = raw_texts(batch.column(batch.num_columns - 1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(model.scores(texts[a:b]), pa.float64())], names=[*names, "score"])

    names = [id_col, *keep]
    picked = spread(docs.select(*(F.col(x) for x in names), F.col(text_col).cast("string").alias("_text")))
    return picked.mapInArrow(run, ", ".join(f"`{x}` {picked.schema[x].dataType.simpleString()}" for x in names) + ", score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled rows of ``documents``, predicts to be good."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = numbered(docs)
    scored = score(own, model, own.columns[0], own.columns[docs.columns.index("text")], tuple(own.columns[1:]))
    return scored.where(F.col("score") >= THRESHOLD).select(own.columns).toDF(*docs.columns)
