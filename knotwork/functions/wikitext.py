"""Wiki markup to plain text, located links and a snippet, in Python workers.

One pass finds links and templates by their brackets (an opener without its closer is text), a second renders lines:
headings, lists, table cells, tags, quotes and entities. Offsets are code points of the markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import PLACEHOLDER
from ..storage import spread
from .ngrams import sentences
from .text import CLEANUP, MARKED

SCHEMA = "snippet struct<first_paragraph: string, first_sentence: string>, text string, links array<struct<target: string, anchor_text: string, left: int, right: int>>, list_items int"
SNIPPET = pa.struct([("first_paragraph", pa.string()), ("first_sentence", pa.string())])
LINK = pa.struct([("target", pa.string()), ("anchor_text", pa.string()), ("left", pa.int32()), ("right", pa.int32())])
#: Tags whose content is no text, and name spaces of images.
EXTENSIONS = "ref|math|gallery|source|syntaxhighlight|timeline|imagemap|score|references|templatestyles|chem|hiero|graph|mapframe"
IMAGES = ("file:", "image:", "fichier:")
IMAGE_OPTION = re.compile(r"\s*(thumb|thumbnail|frame|framed|frameless|border|left|right|center|centre|none|baseline|sub|super|top|text-top|middle|bottom|text-bottom|upright(=[\d. ]*)?|\d*x?\d+\s*px|(alt|link|lang|page|class)\s*=.*)\s*", re.S | re.I)
HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({EXTENSIONS})\b[^<>]*?/>|<({EXTENSIONS})\b[^<>]*>.*?</\2\s*>", re.S | re.I)
BRACKET = re.compile(r"\[\[|\]\]|\{\{|\}\}")
#: Nested deeper than this, a page counts as unparseable.
DEEPEST = 200


class Node(NamedTuple):
    kind: str  # "text", "link" or "template"
    start: int
    parts: list  # of Node, or the string of a text


class Link(NamedTuple):
    target: str
    anchor_text: str
    left: int
    right: int


def tree(markup: str) -> list[Node]:
    """Text, links and templates. What stands in comments and extension tags is gone; offsets stay."""
    shown = HIDDEN.sub(lambda m: "\0" * len(m.group()), markup)
    stack: list[tuple[str, int, list]] = [("", 0, [])]

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1][2].append(Node("text", a, [shown[a:b]]))

    at = 0
    for m in BRACKET.finditer(shown):
        if m.start() < at:
            continue
        mark = m.group()
        if mark in ("[[", "{{"):
            text(at, m.start())
            stack.append((mark, m.start(), []))
            if len(stack) > DEEPEST:
                raise ValueError("markup is nested too deeply")
            at = m.end()
            continue
        opener = "[[" if mark == "]]" else "{{"
        if not any(s[0] == opener for s in stack):
            continue
        text(at, m.start())
        at = m.end()
        while stack[-1][0] != opener:  # an inner opener that nothing closes is text
            demote(stack)
        _, start, parts = stack.pop()
        stack[-1][2].append(Node("link" if opener == "[[" else "template", start, parts))
    text(at, len(shown))
    while len(stack) > 1:
        demote(stack)
    return stack[0][2]


def demote(stack: list) -> None:
    mark, start, parts = stack.pop()
    stack[-1][2].extend([Node("text", start, [mark]), *parts])


def flat(parts: list[Node], captions: bool = True) -> str:
    out = []
    for i, n in enumerate(parts):
        if n.kind == "text":
            piece = n.parts[0]
            if i and parts[i - 1].kind == "link" and not captions and (m := re.match(r"[^\W\d_]+", piece)):
                piece = piece[m.end() :]  # excerpts leave out what is glued to a link
            out.append(piece)
        elif n.kind == "template":
            out.append(PLACEHOLDER)
        else:
            out.append(link_text(n, captions))
    return "".join(out)


def nodes(parts: list[Node], kind: str) -> Iterator[Node]:
    """All nodes of a kind, in order, those inside others too."""
    for n in parts:
        if n.kind == kind:
            yield n
        if n.kind != "text":
            yield from nodes(n.parts, kind)


def fields(node: Node) -> list[list[Node]]:
    """The parts of a link between its bars."""
    found: list[list[Node]] = [[]]
    for n in node.parts:
        if n.kind != "text":
            found[-1].append(n)
            continue
        start = n.start
        for k, piece in enumerate(n.parts[0].split("|")):
            if k:
                found.append([])
            if piece:
                found[-1].append(Node("text", start, [piece]))
            start += len(piece) + 1
    return found


def is_image(target: str) -> bool:
    return target.strip().lower().startswith(IMAGES)


def link_text(node: Node, captions: bool) -> str:
    target, *rest = fields(node)
    name = flat(target, captions)
    if is_image(name):
        titles = [t for f in rest if (t := flat(f, captions)).strip() and not IMAGE_OPTION.fullmatch(t)]
        return titles[-1] if captions and titles else ""
    return flat(rest[0], captions) if rest else name


def links(parts: list[Node], markup: str) -> Iterator[Link]:
    """All links that aren't images, in order, those inside captions, titles and templates too. A target that stands
    in the markup as it reads is located there, any other at the start of its link."""
    for n in nodes(parts, "link"):
        target, *rest = fields(n)
        name = plain(flat(target)).replace(PLACEHOLDER, "").strip()
        if not is_image(name):
            anchor = plain(flat(rest[0])).replace(PLACEHOLDER, "").strip() if rest else name
            if anchor:
                begin = target[0].start if target else n.start + 2
                left = max(begin, markup.find(name, begin))
                yield Link(name, anchor, left, left + len(name))


def plain(text: str) -> str:
    """Without quotes, tags and entities."""
    text = re.sub(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]+\s*([^\]]*)\]", r"\1", text.replace("\0", ""))
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", text)
    return html.unescape(re.sub(r"'{2,}", "", text)).replace("\xa0", " ")


def cells(row: str, mark: str) -> str:
    out = []
    for cell in re.split(r"\|\||!!" if mark == "!" else r"\|\|", row):
        head, bar, body = cell.partition("|")
        out.append((" : " if mark == "!" else " | ") + (body if bar and "=" in head else cell))
    return "".join(out)


def lines(text: str) -> tuple[str, int]:
    """(the rendered lines, how many list items there are)."""
    out, items, table = [], 0, 0
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            table += 1
        elif table and bare.startswith("|}"):
            table -= 1
            out.append(bare[2:])
        elif table and bare.startswith("|-"):
            continue
        elif table and bare.startswith("|+"):
            out.append(bare[2:])
        elif table and bare[:1] in ("|", "!"):
            out.append(cells(bare[1:], bare[0]))
        elif line[:1] in ("*", "#", ":", ";") and line:
            items += 1
            out.append(line.lstrip("*#:;"))
        elif m := re.fullmatch(r"(={1,6})(.*?)\1\s*", line):
            out.append(m[2])
        elif not re.fullmatch(r"-{4,}\s*|__[A-Z]+__\s*", line):
            out.append(line)
    return plain("\n".join(out)), items


def unmarked(text: str) -> str:
    return re.sub(MARKED, "", text).replace(PLACEHOLDER, "")


def clean(text: str) -> str:
    text = unmarked(text)
    for pattern, new in CLEANUP:
        text = re.sub(pattern, new, text)
    return text


def snippet(text: str) -> tuple[str | None, str | None]:
    """(the first line of two sentences or more, its first sentence); without such a line the first sentence of all."""
    first = None
    for line in text.split("\n"):
        found = [line[a:b] for a, b in sentences(line)]
        if len(found) > 1:
            return " ".join(found), found[0]
        if found and first is None:
            first = found[0]
    return None, first


def parse(markup: str) -> dict | None:
    """Snippet, text, links and list items of a page; None where it can't be parsed."""
    try:
        parts = tree(markup)
        text, items = lines(flat(parts))
        excerpt = unmarked(lines(flat(parts, captions=False))[0])
        paragraph, sentence = snippet(excerpt)
        return {"snippet": {"first_paragraph": paragraph, "first_sentence": sentence}, "text": clean(text), "links": [x._asdict() for x in links(parts, markup)], "list_items": items}
    except (ValueError, RecursionError):
        return None


def parsed(pages: DataFrame) -> DataFrame:
    """pages(id, wikitext) with the columns of SCHEMA; null where there is no markup or it can't be parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [parse(t) if t is not None else None for t in part.column(1).to_pylist()]
                get = lambda k: [f[k] if f else None for f in found]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(get("snippet"), SNIPPET), pa.array(get("text"), pa.string()), pa.array(get("links"), pa.list_(LINK)), pa.array(get("list_items"), pa.int32())], names=["id", "wikitext", "snippet", "text", "links", "list_items"])

    picked = spread(pages.select("id", "wikitext"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, wikitext string, {SCHEMA}")
