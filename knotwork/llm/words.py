"""Words of many texts at once: runs of bytes other than blank, tab, line feed, vertical tab, form feed, return."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone, whole.
SLICE = 1 << 21
#: bytes.split() parts at exactly these.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def offsets(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)


def parts(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that cut no word, so that a long one's words needn't all be held."""
    start = 0
    while len(text) - start > limit:
        end = start + limit
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, one after the other, equal for equal words; where each text's begin, and the end)."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    found, lengths = [], []
    for t in texts:
        n = 0
        for part in parts(t):
            words = part.split()
            found.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            n += len(words)
        lengths.append(n)
    return np.concatenate([np.zeros(0, np.int64), *found]), offsets(lengths)


def counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the mask are set in each text; ``at``: where the texts begin, and the end."""
    edges = at.tolist()
    return np.fromiter((np.count_nonzero(mask[a:b]) for a, b in zip(edges[:-1], edges[1:])), np.int64, len(edges) - 1)
