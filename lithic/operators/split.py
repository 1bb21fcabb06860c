"""Documents into passages that tile them byte for byte.

The rules are sequential (a fence opens until it closes, small sections join their neighbour), so one Arrow pass per
document does them; everything around it - titles, ids, triples, bodies - is columns. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


class Bounds(NamedTuple):
    """The size aimed at, the size below which sections join, the size never passed."""

    ceiling: int = 2000
    floor: int = 400
    most: int = 6000


Span = tuple[int, int]
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
_ATX = re.compile(r"(#{1,6})(?: (.*))?", re.S)
_ADOC = re.compile(r"(={1,6}) (.*)", re.S)
_RULE = re.compile(r"={2,}|-{2,}")
_SENTENCE = re.compile(rb"[.!?][\"')]?(?=[\t\n\v\f\r \x85\xa0]|\Z)")
_KEY = re.compile(r"([^\W\d]\w*?)(?:(?<=.)_\w*)?=")
#: A fenced block of this many groups of assignments, which are this share of its lines, is cut at the groups.
LEAST_GROUPS, LEAST_SHARE = 3, 0.6


class Line(NamedTuple):
    start: int
    end: int
    text: str  # without surrounding white space
    guarded: bool  # front matter or fence: no heading, no paragraph break

    @property
    def fence(self) -> bool:
        return self.text.startswith(("```", "~~~"))


class Piece(NamedTuple):
    heading: str
    path: tuple[str, ...]
    start: int
    end: int


def lines_of(data: bytes) -> list[Line]:
    raw = [(m.start(), m.end(), m.group().decode("utf-8", "replace").strip()) for m in _LINE.finditer(data)]
    out, head, fenced = [], bool(raw) and raw[0][2] == "---", False
    for i, (a, b, text) in enumerate(raw):
        if head:
            guarded, head = True, not (i and text == "---")
        elif text.startswith(("```", "~~~")):
            guarded, fenced = True, not fenced
        else:
            guarded = fenced
        out.append(Line(a, b, text, guarded))
    return out


def headings(lines: list[Line], adoc: bool) -> Iterator[tuple[int, int, str]]:
    """(offset, level, text) of each heading."""
    for line, below in pairwise([*lines, None]):
        if line.guarded or not line.text:
            continue
        if adoc:
            if m := _ADOC.fullmatch(line.text):
                yield line.start, len(m[1]), m[2].strip()
        elif m := _ATX.fullmatch(line.text):
            yield line.start, len(m[1]), (m[2] or "").rstrip("#").strip()
        elif line.text[0] not in "#-*+>|=" and below is not None and not below.guarded and _RULE.fullmatch(below.text):
            yield line.start, 1 if below.text[0] == "=" else 2, line.text


def sections(lines: list[Line], size: int, adoc: bool) -> list[Piece]:
    open_: list[tuple[int, str]] = []
    starts: list[tuple[int, str, tuple[str, ...]]] = []
    for at, level, text in headings(lines, adoc):
        open_ = [h for h in open_ if h[0] < level]
        open_.append((level, text))
        starts.append((at, text, tuple(t for _, t in open_)))
    if not starts or starts[0][0] > 0:
        starts.insert(0, (0, "", ()))
    ends = [s[0] for s in starts[1:]] + [size]
    return [Piece(text, path, at, end) for (at, text, path), end in zip(starts, ends, strict=True)]


def joined(parts: list[Piece], b: Bounds) -> list[Piece]:
    """A section below the floor takes in the next while both fit the ceiling; the first one's heading stays."""
    out: list[Piece] = []
    for p in parts:
        if out and out[-1].end - out[-1].start < b.floor and p.end - out[-1].start <= b.ceiling:
            out[-1] = out[-1]._replace(end=p.end)
        else:
            out.append(p)
    return out


def blocks(lines: list[Line], start: int, end: int) -> list[list[Line]]:
    """Runs of lines up to and with the blank lines that follow; guarded blank lines end nothing. They tile the range."""
    out: list[list[Line]] = []
    ended = False
    for line in lines:
        blank = not line.text and not line.guarded
        if not out or (ended and not blank):
            out.append([])
        ended = (blank and any(x.text or x.guarded for x in out[-1])) or (ended and blank)
        out[-1].append(line)
    return out


def _tile(cuts: list[Span], start: int, end: int) -> list[Span]:
    """The given spans and the gaps between them."""
    edges = [start, *(x for c in cuts for x in c), end]
    return [(a, b) for a, b in pairwise(edges) if b > a]


def key_groups(block: list[Line]) -> list[Span]:
    """Neighbouring assignments with one prefix, in a fenced block that is mostly assignments; else none."""
    if not any(x.guarded for x in block):
        return []
    body = [x for x in block if x.text and not x.fence]
    groups: list[tuple[str | None, int, int]] = []
    keys = [m[1] if (m := _KEY.match(x.text)) else None for x in body]
    before = None
    for line, key in zip(body, keys, strict=True):
        if key is not None and key == before:
            groups[-1] = (key, groups[-1][1], line.end)
        elif key is not None:
            groups.append((key, line.start, line.end))
        before = key
    found = sum(k is not None for k in keys)
    return [(a, z) for _, a, z in groups] if len(groups) >= LEAST_GROUPS and found >= LEAST_SHARE * len(body) else []


def _back_to_rune(data: bytes, at: int) -> int:
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at -= 1
    return at


def oversized(data: bytes, block: list[Line], b: Bounds) -> list[Span]:
    """A fence whole up to the most, else on lines; prose on sentence ends, and inside a sentence that is too long."""
    start, end = block[0].start, block[-1].end
    fenced = any(x.guarded for x in block)
    if fenced and end - start <= b.most:
        return [(start, end)]
    out, at, fit = [], start, start
    limit = b.most if fenced else b.ceiling
    for stop in [x.end for x in block] if fenced else [*(m.end() for m in _SENTENCE.finditer(data, start, end)), end]:
        if stop - at > limit and fit > at:
            out.append((at, fit))
            at = fit
        while stop - at > b.most:
            cut = _back_to_rune(data, at + b.most)
            out.append((at, cut))
            at = cut
        fit = stop
    if end > at:
        out.append((at, end))
    return out


def spans(data: bytes, lines: list[Line], p: Piece, b: Bounds) -> list[Span]:
    own = [x for x in lines if p.start <= x.start and x.end <= p.end]
    parts = blocks(own, p.start, p.end)
    groups = [g for block in parts for g in key_groups(block)]
    if groups:
        return _tile(groups, p.start, p.end)
    fences = [(block[0].start, block[-1].end) for block in parts if any(x.guarded for x in block)]
    if fences and (p.end - p.start) - sum(z - a for a, z in fences) >= b.floor:
        return _tile(fences, p.start, p.end)
    if p.end - p.start <= b.ceiling:
        return [(p.start, p.end)]
    out: list[Span] = []
    grows = False
    for block in parts:
        a, z = block[0].start, block[-1].end
        if z - a > b.ceiling:
            out += oversized(data, block, b)
            grows = False
        elif grows and z - out[-1][0] <= b.ceiling:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
            grows = True
    return out


def split(text: str, adoc: bool = False, b: Bounds = Bounds()) -> list[dict]:
    """Passages (ordinal, heading, heading_path, start, end, body) of one document; none of an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return []
    lines = lines_of(data)
    out: list[dict] = []
    for p in joined(sections(lines, len(data), adoc), b):
        for a, z in spans(data, lines, p, b):
            out.append({"ordinal": len(out), "heading": p.heading, "heading_path": list(p.path), "start": a, "end": z, "body": data[a:z].decode("utf-8", "replace")})
    return out


def passages(docs: DataFrame, id_col: str, text_col: str, adoc_col: str | None = None, b: Bounds = Bounds()) -> DataFrame:
    """(id, ordinal, heading, heading_path, start, end, body): made where the documents are read."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(adoc_col) if adoc_col else F.lit(False)).alias("adoc"))
    kind = source.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ordinal", pa.int32()), ("heading", pa.string()), ("heading_path", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256).to_pylist()
                rows = [{"id": r["id"], **p} for r in part for p in split(r["text"], r["adoc"], b)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return source.mapInArrow(run, f"id {kind.simpleString()}, ordinal int, heading string, heading_path array<string>, start long, `end` long, body string")
