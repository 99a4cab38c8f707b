"""Exact, cached tokenisation on the executors.

Both public vocabularies split a text before merging, so a text falls apart into *chunks* whose ids do not
depend on what stands beside them: a chunk runs from the start of a run of white space to the start of the
next. Words repeat, so each Python worker keeps a bounded cache from chunk to result and asks the tokenizer
library only for words it has not seen. Results equal ``Tokenizer.encode`` on the whole text (tests/llm).

Texts that hold one of the vocabulary's special strings are cut at them first, as the library does.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from operator import sub

#: Unicode white space, as the library's regular expressions know it.
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
#: A blank inside or at the end of a longer run of white space: such a text is cut by CHUNK, not by blanks.
RUN = re.compile(f"[{WS}] ")
#: Entries that a worker's caches may hold (about 200 bytes each), that of words and each of the others; once full a
#: cache stays as it is, and what it does not hold is worked out each time.
WORDS, CACHE = 800_000, 100_000
#: Beginnings of pieces whose state a worker holds, and their bytes at most.
STATES, STATE_BYTES, SHORT = 400_000, 12, (2, 1)
#: A word of Latin letters, perhaps with marks behind it: nearly all words, and their pieces are plain. An apostrophe
#: may begin a piece of its own and ``<`` a special string, so they aren't among the marks. Nor is the dotted capital I
#: among the letters: in lower case it ends in a combining dot, which makes one piece with the marks behind it.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([,.;:!?#$%&*+=/()\[\]{}@~^|\"_-]{1,8})?").fullmatch
#: A word, one line break, and what stands behind it: nearly every such pair is new, its halves are not.
BREAK = re.compile(f"([^{WS}]+)\n([^{WS}].*)", re.DOTALL).fullmatch
BYTE_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path with a slash is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """A dict that makes missing values itself and never holds more than ``most`` of them."""

    most = CACHE

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64 and len(self) < self.most:
            self[key] = value
        return value


class Words(Cache):
    """From a word behind ``before``, given without it; marks behind the word are looked up on their own, and what has
    several of them isn't held as a whole: such words hardly ever come again. Nor is a word with a line break and what
    stands behind it, which ``line`` gives."""

    def __init__(self, before, word, mark, other, line, most=WORDS):
        self.before, self.word, self.mark, self.other, self.line, self.most = before, word, Cache(mark), other, line, most

    def __missing__(self, key):
        if (m := WORD(key)) is None:
            if cut := BREAK(key):
                return self[cut[1]] + self.line(cut[2])
            value = self.other(self.before + key)
        elif m[2]:
            value = self[m[1]] + self.mark[m[2]]
            if len(m[2]) > 1:
                return value
        else:
            value = self.word(m[1])
        if len(key) <= 64 and len(self) < self.most:
            self[key] = value
        return value


def cut_words(text: str) -> tuple[str, list[str]]:
    """(first chunk, the others without their leading blank), for texts without RUN."""
    first, *rest = text.split(" ")
    return first, rest


class Encoder:
    """ids(text) -> little-endian uint32 bytes, equal to the library's ids without added special tokens."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.byte_level = self.library.normalizer is None
        self.model, self.alphabet = self.library.model, byte_alphabet()
        if self.byte_level:
            import regex

            self.pieces = regex.compile(BYTE_PIECE).findall
            self.piece_ids = Cache(self.of_piece)
        self.after_blank = Words(" ", self.of_word, self.of_chunk, self.of_chunk, self.of_line)
        self.line_starts = Words("", self.of_start, self.of_chunk, self.of_chunk, self.of_line, CACHE)
        self.chunks = Cache(self.of_chunk)

    def of_piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def of_word(self, word: str) -> bytes:
        """Ids of a word of Latin letters behind a blank."""
        if self.byte_level:
            return self.of_piece(" " + word)
        low = word.lower()
        if low != word:
            return self.after_blank[low] if WORD(low) else self.of_chunk(" " + word)
        return self.of_piece(low)

    def of_start(self, word: str) -> bytes:
        """Ids of a word of Latin letters with nothing before it."""
        return self.of_piece(word)

    def of_line(self, rest: str) -> bytes:
        """Ids of a line break between two words and of what follows. The word vocabulary knows white space only as
        what parts words; in the byte vocabulary the break is a piece of its own."""
        return self.chunks["\n"] + self.line_starts[rest] if self.byte_level else self.after_blank[rest]

    def of_chunk(self, chunk: str) -> bytes:
        if self.byte_level:
            found = self.pieces(chunk)
            return self.piece_ids[found[0]] if len(found) == 1 else b"".join([self.piece_ids[x] for x in found])
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if RUN.search(text) or text[-1] == " ":
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        first, rest = cut_words(text)
        head = self.chunks[first] if first else b""
        return head + b"".join(map(self.after_blank.__getitem__, rest))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self.ordinary(text)
        return b"".join(
            array("I", [self.specials[x]]).tobytes() if i % 2 else self.ordinary(x)
            for i, x in enumerate(self.special.split(text))
        )


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """This worker's encoder; it lives as long as the worker, so later tasks find a warm cache."""
    return Encoder(name)


class Prefixes(Encoder):
    """Token counts of every prefix, by dynamic programming over the prefixes of each word.

    ``deltas(text)`` is one int16 a code point: by how much the exact token count of the prefix that ends
    there differs from that of the prefix before. Their running sum answers any truncation or budget question.

    For the bytes of one piece, ``last[i]`` is the last token of the encoding of the first ``i`` bytes: the only
    token ``t`` that ends there whose pair with ``last[i - len(t)]`` encodes to itself, and
    ``count[i] = count[i - len(t)] + 1``. A cut inside a run of white space makes the run one piece, and a cut
    inside ``'re``, ``'ve`` or ``'ll`` two; both are counted as the library would.
    """

    def __init__(self, name: str):
        super().__init__(name)
        if not self.byte_level:
            raise ValueError("prefix counts need a byte-level vocabulary without normaliser")
        back = {c: b for b, c in self.alphabet.items()}
        self.tokens = {bytes(back[c] for c in t): i for t, i in self.library.get_vocab().items() if t not in self.specials}
        self.longest = max(map(len, self.tokens))
        #: Lengths of the tokens of three bytes or more by their last three bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        #: (last token, count) of the first bytes of pieces: what pieces have in common isn't worked out again.
        self.states: dict[bytes, tuple[bytes, int]] = {}
        self.pair = Cache(self.fits)
        self.counts = Cache(self.count_piece)
        self.pair.most = self.counts.most = WORDS  # both are short, and dear to work out again
        self.runs = re.compile(f"([{WS}]*)([^{WS}]*)")

    def encoded(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin1").translate(self.alphabet))]

    def fits(self, pair: tuple[bytes, bytes]) -> bool:
        a, b = pair
        return self.encoded(a + b) == ([self.tokens[a], self.tokens[b]] if a else [self.tokens[b]])

    def count_piece(self, piece: str) -> list[int]:
        """Exact token count of each non-empty prefix (in code points) of a piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        n = len(raw)
        last, count = [b""], [0]
        tokens, pair, lengths, states = self.tokens, self.pair, self.lengths, self.states
        for i in range(1, min(n, STATE_BYTES) + 1):
            if (found := states.get(raw[:i])) is None:
                break
            last.append(found[0])
            count.append(found[1])
        for i in range(len(last), n + 1):
            for size in lengths.get(raw[i - 3 : i], SHORT) if i > 2 else SHORT:
                if size <= i and (t := raw[i - size : i]) in tokens and pair[last[i - size], t]:
                    last.append(t)
                    count.append(count[i - size] + 1)
                    break
            if i <= STATE_BYTES and len(states) < STATES:
                states[raw[:i]] = last[i], count[i]
        if n == len(piece):
            return count[1:]
        return [count[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80]

    def of_word(self, word: str) -> bytes:
        """Deltas of a word of Latin letters behind a blank: one piece, which only ``after_blank`` need hold."""
        return self.of_start(" " + word)

    def of_start(self, word: str) -> bytes:
        found = self.count_piece(word)
        return array("h", map(sub, found, [0, *found])).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        """The int16 deltas of a chunk's code points."""
        out, base = [], 0  # exact counts of the chunk's prefixes
        for run, body in self.runs.findall(chunk):
            if run:
                at_run = self.counts[run]
                out += [base + c for c in at_run]
            if not body:
                base = out[-1] if out else 0
                continue
            skip = len(run)
            for piece in self.pieces(run + body):
                inner = self.counts[piece]
                if piece in ("'re", "'ve", "'ll"):
                    inner = [inner[0], 2, inner[2]]
                if skip < len(piece):
                    out += [base + c for c in inner[skip:]]
                skip = max(0, skip - len(piece))
                base += inner[-1]
        return array("h", [b - a for a, b in zip([0, *out], out)]).tobytes()

    def deltas(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text or not (at := [m.span() for m in self.special.finditer(text)]):
            return self.ordinary(text)
        out, start = [], 0
        for a, b in at:
            inside = self.ordinary(text[start : b - 1])  # cut inside a special string, it is ordinary text
            whole = sum(array("h", self.ordinary(text[start:a])))
            out += [inside, array("h", [whole + 1 - sum(array("h", inside))]).tobytes()]
            start = b
        return b"".join([*out, self.ordinary(text[start:])])


@lru_cache(maxsize=2)
def prefixes(name: str) -> Prefixes:
    return Prefixes(name)


def forget() -> None:
    """Gives up this worker's encoders: workers outlive a stage, and other stages need their memory."""
    encoder.cache_clear()
    prefixes.cache_clear()
