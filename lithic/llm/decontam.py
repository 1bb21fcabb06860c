"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified by exact edit distance.

Symbols are words (letters and digits, A-Z lower-cased), edits are edits of words, and an item of W words is found where a
window of the document turns into it by at most floor(max_edits * W) edits. Windows of item size are embedded by CGK
random walks: at each step a walk writes the symbol under its pointer and then, by a random bit of step and symbol,
advances or stays, so that a few edits change few of the written symbols. Each table is keyed by some sampled steps of a
walk and holds all items of a width; a window is embedded once, looked up in every table of its width, and meets the items
that it finds there, whichever they are; the exact edit distance decides. Steps are sampled where a walk hardly ever writes
its padding, so that unlike windows find nothing: by measurement (tests) windows at the edit limit are found with a
probability above 0.99, and none of random ones are.

Which windows are embedded: by the pigeonhole principle W - e words that no edit touches lie in at most e + 1 runs, so a
window within e edits shares a run of ceil((W - e) / (e + 1)) words with the item. All windows around such a run are
embedded, e places to either side; no other window can pass the verification.

Items of fewer than min_words words are found where their words stand in a row, without edits. Items of scripts that put no
blanks between words (Han, Kana, Thai and others) are searched with characters as symbols, and edits of characters: those of
fewer than min_words words, and those that consist of such characters for the most part (these by words, too).

Items are taken in blocks of bounded size, each sent to all tasks; documents are read where they lie, without a shuffle.

Defined results: null or empty text has no windows and is clean; items that are null, or have no
letter or digit, are not looked for; ids may be null or repeat, each row is judged by itself; an empty table gives no rows; an empty
benchmark leaves all clean; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm.common import small_batches, text_or_empty
from lithic.llm.words import NOT_ALPHANUMERIC, Words, by_bytes, mix, split_words, texts_by_size

_WALK, _GRAM, _KEY = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03))
#: Items are sent to the tasks in blocks of so many bytes of text at most (or one longer item).
BLOCK_BYTES = 4 << 20
#: Windows are embedded so many words at a time.
WINDOW_WORDS = 250_000
#: A bitmap answers most look-ups; it has some 64 places a key, between these powers of two.
_LEAST_BITS, _MOST_BITS = 12, 22
_END = np.uint64(0)
#: Characters of scripts without blanks between words.
_SPACELESS = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


class Params(NamedTuple):
    """walks x tables samples of `sample` steps each, of the first `reach` x width steps."""

    max_edits: float = 0.2
    min_words: int = 5
    walks: int = 16
    tables: int = 20
    sample: int = 4
    reach: float = 1.2
    seed: int = 1


class Item(NamedTuple):
    id: object
    words: np.ndarray
    edits: int
    run: int


class Bitmap:
    """Which leading bits occur among keys."""

    def __init__(self, keys: np.ndarray):
        bits = min(max(_LEAST_BITS, (64 * len(keys)).bit_length()), _MOST_BITS)
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[keys >> self.shift] = True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        return self.there[keys >> self.shift]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * _GRAM) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * factor[j]
    return mix(out)


def embed(symbols: np.ndarray, walk: int, seed: int, steps: int) -> np.ndarray:
    """n x steps: what one CGK walk writes of n strings of equal length; past its end a string is padded."""
    n, width = symbols.shape
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    salts = mix(np.arange(steps, dtype=np.uint64) + np.uint64((seed << 32) + (walk << 16)) * np.uint64(65537))
    for j in range(steps):
        now = padded[rows, at]
        out[:, j] = now
        at = np.minimum(at + (mix(now ^ salts[j]) & np.uint64(1)).astype(np.int64), width)
    return out


def _steps(width: int, p: Params) -> int:
    return max(1, int(p.reach * width))


@lru_cache(maxsize=64)
def _sampled(width: int, p: Params) -> np.ndarray:
    """walks x tables x sample steps."""
    rng = np.random.default_rng([p.seed, width])
    return rng.integers(0, _steps(width, p), (p.walks, p.tables, p.sample))


def table_keys(symbols: np.ndarray, walk: int, p: Params) -> np.ndarray:
    """n x tables: the keys of n strings of one width in the tables of a walk; keys of different tables differ."""
    width = symbols.shape[1]
    factor = mix(np.arange(1, p.sample + 1, dtype=np.uint64) * _KEY) | np.uint64(1)
    written = embed(symbols, walk, p.seed, _steps(width, p))
    return mix((written[:, _sampled(width, p)[walk]] * factor).sum(axis=2) + np.arange(walk * p.tables, (walk + 1) * p.tables, dtype=np.uint64) * _GRAM)


class Tables:
    """All tables of one width: the keys of its items, sorted, and whose they are."""

    def __init__(self, items: np.ndarray, numbers: np.ndarray, p: Params):
        self.p = p
        keys = np.concatenate([table_keys(items, walk, p).ravel() for walk in range(p.walks)])
        of = np.tile(np.repeat(numbers, p.tables), p.walks)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], of[order]
        self.bitmap = Bitmap(keys)

    def meet(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a key in any table, each once."""
        found = [np.zeros((0, 2), np.int64)]
        for walk in range(self.p.walks):
            keys = table_keys(windows, walk, self.p)
            row, table = np.nonzero(self.bitmap.may_hold(keys))
            k = keys[row, table]
            low = np.searchsorted(self.keys, k, "left")
            many = np.searchsorted(self.keys, k, "right") - low
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.unique(np.stack([np.repeat(row, many), self.of[at]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def edit_distance(windows: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n word strings: the fewest edits that turn a prefix of it into the item, and that prefix's length."""
    n, width = windows.shape
    ramp = np.arange(width + 1)
    row = np.broadcast_to(ramp, (n, width + 1)).copy()
    for i, word in enumerate(item, 1):
        below = np.empty_like(row)
        below[:, 0] = i
        below[:, 1:] = np.minimum(row[:, :-1] + (windows != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(below - ramp, axis=1) + ramp
    best = row.argmin(axis=1)
    return row[np.arange(n), best], best


def by_words(texts: pa.Array) -> Words:
    return split_words(texts, breaks_at=NOT_ALPHANUMERIC)


def by_characters(texts: pa.Array) -> Words:
    """As by_words, but each character is a word of its own."""
    w = by_words(texts)
    start = np.flatnonzero(((w.data & 0xC0) != 0x80) & ~NOT_ALPHANUMERIC[w.data])
    lead = w.data[start]
    length = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead.astype(np.uint64)
    for j in range(1, 4):
        more = length > j
        code[more] = (code[more] << np.uint64(8)) | w.data[start[more] + j]
    first = np.searchsorted(start, w.doc_start)
    return Words(w.data, w.doc_start, start, start + length, np.repeat(np.arange(w.n_docs), np.diff(first)), mix(code), first)


class Block:
    """Items with the look-up of their runs, of words or of characters."""

    def __init__(self, ids: list, texts: list[str], p: Params, split=by_words):
        words = split(pa.array(texts, pa.string()))
        self.items: list[Item] = []
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for k, i in enumerate(ids):
            own = words.hash[words.first[k]:words.first[k + 1]]
            if not len(own):
                continue
            edits = int(p.max_edits * len(own) + 1e-9) if len(own) >= p.min_words else 0
            run = -(-(len(own) - edits) // (edits + 1))
            at = len(self.items)
            self.items.append(Item(i, own, edits, run))
            runs.setdefault(run, []).extend((int(g), at, q) for q, g in enumerate(_grams(own, run)))
        self.runs = {}
        for run, rows in runs.items():
            rows.sort()
            grams = np.array([r[0] for r in rows], np.uint64)
            self.runs[run] = (grams, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), Bitmap(grams))
        self.p = p
        self.tables = {}
        for width in {len(i.words) for i in self.items}:
            mine = np.array([k for k, i in enumerate(self.items) if len(i.words) == width])
            self.tables[width] = Tables(np.stack([self.items[k].words for k in mine]), mine, p)

    def starts(self, words: Words) -> dict[int, np.ndarray]:
        """For each width, the word places at which windows around runs shared with an item of that width start."""
        out: dict[int, list[np.ndarray]] = {}
        for run, (grams, item, place, bitmap) in self.runs.items():
            h = _grams(words.hash, run)
            at = np.flatnonzero(bitmap.may_hold(h))
            at = at[words.doc[at] == words.doc[at + run - 1]]
            low, high = np.searchsorted(grams, h[at], "left"), np.searchsorted(grams, h[at], "right")
            many = high - low
            if not many.sum():
                continue
            p = np.repeat(at, many)
            r = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            for k in np.unique(item[r]):
                mine = item[r] == k
                e = self.items[k].edits
                pairs = np.unique(np.stack([words.doc[p[mine]], p[mine] - place[r[mine]]], axis=1), axis=0)
                spread = (pairs[:, 1, None] + np.arange(-e, e + 1)).ravel()
                docs = np.repeat(pairs[:, 0], 2 * e + 1)
                inside = (spread >= words.first[docs]) & (spread < words.first[docs + 1])
                out.setdefault(len(self.items[k].words), []).append(np.unique(spread[inside]))
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def find(self, words: Words) -> list[tuple[int, object, int, int, int]]:
        """(text, item id, start byte, end byte, edits) of each item found in each text, at its best place."""
        out = []
        padded = np.concatenate([words.hash, np.zeros(1, np.uint64)])
        for width, starts in self.starts(words).items():
            last, most = words.first[words.doc[starts] + 1], max(self.items[k].edits for k in self.tables[width].of)
            at_once = max(1, WINDOW_WORDS // (width + most))
            for at in range(0, len(starts), at_once):
                s, end = starts[at:at + at_once], last[at:at + at_once]
                places = s[:, None] + np.arange(width + most)
                texts = np.where(places < end[:, None], padded[np.minimum(places, len(words.hash))], _END)
                window, number = self.tables[width].meet(np.ascontiguousarray(texts[:, :width]))
                for k in np.unique(number):
                    item, met = self.items[k], window[number == k]
                    edits, length = edit_distance(texts[met, :width + item.edits], item.words)
                    for j in np.flatnonzero(edits <= item.edits):
                        first = s[met[j]]
                        to = min(first + max(length[j], 1), end[met[j]]) - 1
                        base = words.doc_start[words.doc[first]]
                        out.append((int(words.doc[first]), item.id, int(words.start[first] - base), int(words.end[to] - base), int(edits[j])))
        best: dict[tuple[int, object], tuple] = {}
        for row in out:
            key = (row[0], row[1])
            if key not in best or (row[4], row[2]) < (best[key][4], best[key][2]):
                best[key] = row
        return sorted(best.values(), key=lambda r: (r[0], str(r[1])))


class Search:
    """Items by words, and those of scripts without blanks by characters."""

    def __init__(self, ids: list, texts: list[str], p: Params):
        n_words = np.diff(by_words(pa.array(texts, pa.string())).first)
        spaceless = np.array([len(_SPACELESS.findall(t)) for t in texts], np.int64)
        n_chars = np.diff(by_characters(pa.array(texts, pa.string())).first)
        few = n_words < p.min_words
        chars = (spaceless > 0) & (few | (2 * spaceless > n_chars))
        self.blocks = []
        for split, mine in ((by_words, ~(few & chars)), (by_characters, chars)):
            at = np.flatnonzero(mine & (n_words > 0))
            if len(at):
                self.blocks.append((split, Block([ids[k] for k in at], [texts[k] for k in at], p, split)))

    def find(self, texts: pa.Array) -> list[tuple[int, object, int, int, int]]:
        found: dict[tuple[int, object], tuple] = {}
        for split, block in self.blocks:
            for row in block.find(split(texts)):
                found.setdefault((row[0], row[1]), row)
        return sorted(found.values(), key=lambda r: (r[0], str(r[1])))


_blocks: dict[int, Search] = {}


def _finder(sent, key: int, p: Params, id_type: pa.DataType, item_type: pa.DataType):
    match = pa.list_(pa.struct([("item", item_type), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _blocks:
            _blocks.clear()
            _blocks[key] = Search(*sent.value, p)
        block = _blocks[key]
        for whole in batches:
            for batch in by_bytes(whole, 1):
                rows = [list(x) for x in batch.column(2).to_pylist()]
                for doc, item, start, end, edits in block.find(batch.column(1)):
                    rows[doc].append({"item": item, "start": start, "end": end, "edits": edits})
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), pa.array(rows, match)], names=["id", "text", "matches"])

    return find


def _in_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        if ids and size + len(row["text"]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield ids, texts


def contamination(docs: DataFrame, items: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document: id, matches (item, start and end byte in the text, edits), contaminated."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind, item_kind = source.schema["id"].dataType, wanted.schema["id"].dataType
    matches = f"array<struct<item:{item_kind.simpleString()},start:bigint,end:bigint,edits:bigint>>"
    out = source.withColumn("matches", F.expr(f"CAST(array() AS {matches})"))
    for ids, texts in _in_blocks(wanted):
        sent = spark.sparkContext.broadcast((ids, texts))
        out = out.mapInArrow(_finder(sent, hash((tuple(map(str, ids)), len(texts), id(sent))), params, to_arrow_type(kind), to_arrow_type(item_kind)),
                             f"id {kind.simpleString()}, text string, matches {matches}")
    return out.select("id", "matches", (F.size("matches") > 0).alias("contaminated"))


def _cleaner(sent, params: Params):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Search(*sent.value, params)
        for column in batches:
            out, at = np.ones(len(column), bool), 0
            for part in texts_by_size(column):
                out[[at + found[0] for found in block.find(pa.array(part, pa.string()))]] = False
                at += len(part)
            yield pd.Series(out)

    return clean


def decontaminate(docs: DataFrame, items: DataFrame, params: Params = Params(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; searched where they are read."""
    wanted = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    docs = small_batches(docs)
    for ids, texts in _in_blocks(wanted):
        clean = _cleaner(docs.sparkSession.sparkContext.broadcast((ids, texts)), params)
        docs = docs.where(clean(text_or_empty(text_col)))
    return docs
