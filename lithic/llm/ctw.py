"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is coded as its words (runs without white space, A-Z lower-cased) with a blank between them and a line feed at the
end. Each byte is eight binary decisions; each decision has a tree of contexts of 0 to 5 bytes. Every node holds a
Krichevsky-Trofimov estimate, and nodes are mixed with the weights that the block probabilities of the training text give
them: w = KT / (KT + product of the children's weighted probabilities). A context that training never saw is not mixed in.

Counting: each task counts the six-byte strings and the words of its documents (strings and words of held-out documents are
listed with a count of 0), and one aggregation sums them: what is gathered grows with the text. The trees are weighted in
partitions that hold whole subtrees below three bytes of context, sorted, and taken a subtree or some at a time, so that a
frequent pair of bytes is spread over tasks and none holds its partition; a second aggregation makes the nodes of two bytes,
of which UTF-8 text of all scripts has some two million, and from those come the 65,280 of one byte. The result is a table:
string -> log10 probability. Documents are then scored in one pass: strings and words frequent enough
to be among `most_hot` are looked up in a table of that bounded size, sent to all tasks; the rest are joined by a shuffle.

Defined results: null or empty text is its end alone; ids may be null (their fold is that of the empty text) or repeat,
each row is scored; an empty table gives no rows; with no training text the model is uniform and the base's counts are 0;
other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm.common import fold, small_batches, stage, text_or_empty, unstage
from lithic.llm.words import Words, by_bytes, mix, split_words

DEPTH = 5
#: Strings that are weighted at once, but for larger subtrees below three bytes.
CHUNK = 100_000
#: Nodes of two bytes are sent to the tasks up to this many (32 bytes each); beyond it tasks are given only those they need, by a join.
MOST_SECOND = 2_000_000
END = 10
#: The key of the end token; words have other keys but for one chance in 2^64.
END_KEY = int(mix(np.array([0x5EED], np.uint64))[0])
_B8, _B16, _B24, _LOW = np.uint64(8), np.uint64(16), np.uint64(24), np.uint64(255)


# ---- strings of a batch ----------------------------------------------------------------------------------------------

def coded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each text): words with a blank between them and an end."""
    n = words.n_docs
    empty = np.flatnonzero(np.diff(words.first) == 0)
    doc = np.concatenate([words.doc, empty])
    start = np.concatenate([words.start, np.zeros(len(empty), np.int64)])
    length = np.concatenate([words.end - words.start, np.zeros(len(empty), np.int64)])
    if len(empty):
        order = np.argsort(doc, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
    to = np.cumsum(length + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    at = np.repeat(to - length - 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[at] = words.data[np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
    last = np.searchsorted(doc, np.arange(n), side="right") - 1
    out[to[last] - 1] = END
    return out, np.concatenate([[0], to[last]]).astype(np.int64)


def strings(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of each byte: five bytes before it, the nearest first and highest, then itself. Before a text are ends."""
    data, first = coded(words)
    doc = np.repeat(np.arange(words.n_docs), np.diff(first))
    place = np.arange(len(data)) - first[doc]
    key = data.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        back = np.full(len(data), END, np.uint64)
        back[d:] = data[:-d]
        back[place < d] = END
        key |= back << np.uint64(48 - 8 * d)
    return key, doc


# ---- counting --------------------------------------------------------------------------------------------------------

class _Counts:
    """Sorted distinct keys with their counts, gathered chunk by chunk."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n if counted else np.zeros(len(k), np.int64)))
        self.size += len(k)
        if self.size > self.most:
            self._merge()

    def _merge(self) -> None:
        if self.parts:
            k, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            self.parts = [(k, np.bincount(at, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64))]
            self.size = len(k)

    def full(self) -> bool:
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


STRING, WORD = 0, 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {STRING: _Counts(), WORD: _Counts()}

    def emit(kind: int) -> Iterator[pa.RecordBatch]:
        k, n = held[kind].take()
        for at in range(0, len(k), 200_000):
            part = k[at:at + 200_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[at:at + 200_000])], names=["kind", "key", "n"])

    for whole in batches:
        for batch in by_bytes(whole, 0):
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words = split_words(batch.column(0))
            key, doc = strings(words)
            ends = np.full(words.n_docs, END_KEY, np.uint64)
            for counted in (True, False):
                mine = train == counted
                if mine.any():
                    held[STRING].add(key[mine[doc]], counted)
                    held[WORD].add(np.concatenate([words.hash[mine[words.doc]], ends[mine]]), counted)
            for kind in held:
                if held[kind].full():
                    yield from emit(kind)
    for kind in held:
        yield from emit(kind)


# ---- weighting -------------------------------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers by Stirling's series from x + 8 down."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


@lru_cache(maxsize=2)
def _gammas(offset: float) -> np.ndarray:
    return log_gamma(np.arange(1 << 14) + offset)


def _log_gamma_of_counts(n: np.ndarray, offset: float) -> np.ndarray:
    """ln gamma(n + offset) of whole numbers; small ones are looked up."""
    table = _gammas(offset)
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out[large] = log_gamma(n[large] + offset)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of a zeros and b ones."""
    return _log_gamma_of_counts(a, 0.5) + _log_gamma_of_counts(b, 0.5) - _log_gamma_of_counts(a + b, 1.0) - np.log(np.pi)


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the node's own estimate)."""
    both = np.logaddexp(kt, children)
    return both - np.log(2), np.exp(kt - both)


class Mixture(NamedTuple):
    """Of a one's probability: what nodes so far add, the weight left to deeper ones, and the whole if no deeper one was seen."""

    so_far: np.ndarray
    left: np.ndarray
    ends: np.ndarray

    def at(self, index: np.ndarray) -> Mixture:
        return Mixture(*(x[index] for x in self))


class Level(NamedTuple):
    """The binary nodes of one depth and one bit: keys context << 8 | prefix, counts, weights, and what below lies at each."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    log_w: np.ndarray
    own: np.ndarray
    of: np.ndarray  # the node of each node one deeper, or of each string

    def mixed(self, above: Mixture) -> Mixture:
        """The mixture at these nodes, given that of the contexts above each; a node that training never saw adds nothing."""
        seen, one = self.a + self.b > 0, (self.b + 0.5) / (self.a + self.b + 1)
        so_far, left, ends = above
        return Mixture(so_far + left * self.own * one, left * (1 - self.own), np.where(seen, so_far + left * one, ends))


def _shorter(key: np.ndarray) -> np.ndarray:
    """A node's key without the farthest byte of its context."""
    return ((key >> _B16) << _B8) | (key & _LOW)


def subtrees(keys: np.ndarray, n: np.ndarray, bit: int) -> list[Level]:
    """The nodes of depths 5, 4 and 3 over sorted strings, weighted from below."""
    symbol = keys & _LOW
    node = (keys & ~_LOW) | np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]  # as sorted as the strings
    of, one = np.cumsum(new) - 1, (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1
    count = lambda w: np.bincount(of, weights=w, minlength=int(new.sum()))
    a, b = count(np.where(one, 0, n)), count(np.where(one, n, 0))
    out = [Level(node[new], a, b, log_kt(a, b), np.ones(len(a)), of)]
    for _ in range(DEPTH - 3):
        below = out[-1]
        key, of = np.unique(_shorter(below.key), return_inverse=True)
        a, b, children = (np.bincount(of, weights=w, minlength=len(key)) for w in (below.a, below.b, below.log_w))
        out.append(Level(key, a, b, *weigh(log_kt(a, b), children), of))
    return out


def tops(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b, sum of ln weighted probabilities) that sorted strings add to the nodes of depth 2."""
    parts = []
    for bit in range(8):
        third = subtrees(keys, n, bit)[-1]
        key, of = np.unique(_shorter(third.key), return_inverse=True)
        parts.append((key, *(np.bincount(of, weights=w, minlength=len(key)) for w in (third.a, third.b, third.log_w))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Second(NamedTuple):
    """The nodes of two bytes, sorted by key, and the mixture at each."""

    key: np.ndarray
    mixture: Mixture

    def of(self, key: np.ndarray) -> Mixture:
        return self.mixture.at(np.searchsorted(self.key, key))


def log10_of(keys: np.ndarray, n: np.ndarray, second: Second) -> np.ndarray:
    """log10 probability of each sorted string's last byte after the five before it."""
    out = np.zeros(len(keys))
    for bit in range(8):
        levels = subtrees(keys, n, bit)
        mixture = second.of(_shorter(levels[-1].key))
        for level in levels[::-1]:
            mixture = level.mixed(mixture).at(level.of)
        one = (keys & _LOW) >> np.uint64(7 - bit) & np.uint64(1) == 1
        out += np.log10(np.where(one, mixture.ends, 1 - mixture.ends))
    return out


class Crown(NamedTuple):
    """Depths 1 and 0: counts and own weights, by nearest byte and prefix, and by prefix."""

    a1: np.ndarray
    b1: np.ndarray
    own1: np.ndarray
    a0: np.ndarray
    b0: np.ndarray
    own0: np.ndarray


def crown(key: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> Crown:
    """From the sums of depth 2 by nearest byte << 8 | prefix (at most 65,280 of them)."""
    a1, b1, below = np.zeros((3, 256, 256))
    a1[key >> 8, key & 255], b1[key >> 8, key & 255], below[key >> 8, key & 255] = a, b, children
    log_w, own1 = weigh(log_kt(a1, b1), below)
    seen = a1 + b1 > 0
    a0, b0 = a1.sum(axis=0), b1.sum(axis=0)
    _, own0 = weigh(log_kt(a0, b0), np.where(seen, log_w, 0.0).sum(axis=0))
    return Crown(a1, b1, own1, a0, b0, own0)


def second(key: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, above: Crown) -> Second:
    """The nodes of depth 2 mixed with the two depths above."""
    near, node = (key >> _B16).astype(np.int64), (key & _LOW).astype(np.int64)
    p = Mixture(np.zeros(len(key)), np.ones(len(key)), np.full(len(key), 0.5))
    for zeros, ones, w in ((above.a0[node], above.b0[node], above.own0[node]), (above.a1[near, node], above.b1[near, node], above.own1[near, node]), (a, b, own)):
        p = Level(key, zeros, ones, w, w, w).mixed(p)
    return Second(key, p)


def _chunks(batches: Iterator[pa.RecordBatch], columns: int = 2) -> Iterator[list[np.ndarray]]:
    """The columns of sorted (key, n...) in pieces of whole subtrees below three bytes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([batch.column(0).to_numpy().view(np.uint64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, columns))])
        if sum(len(x[0]) for x in held) < CHUNK:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        tree = whole[0] >> _B24
        cut = int(np.searchsorted(tree, tree[-1]))
        if cut:
            yield [x[:cut] for x in whole]
        held = [[x[cut:] for x in whole]]
    if sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, n in _chunks(batches):
        k, a, b, w = tops(key, n)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(a), pa.array(b), pa.array(w)], names=["key", "a", "b", "w"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, w = (batch.column(c).to_numpy() for c in (1, 2, 3))
        log_w, own = weigh(log_kt(a, b), w)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(log_w), pa.array(own)], names=["key", "a", "b", "log_w", "own"])


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(log10_of(key, n, sent.value))], names=["key", "n", "value"])

    return run


def _scored_with(above: Crown):
    """As _scored, for strings that come with the eight nodes of depth 2 above them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, nodes in _chunks(batches, 3):
            rows = np.array([[tuple(x.values()) for x in r] for r in nodes], float).reshape(-1, 4)
            at, first = np.unique(rows[:, 0].astype(np.uint64), return_index=True)
            known = second(at, *(rows[first, c] for c in (1, 2, 3)), above)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(log10_of(key, n, known))], names=["key", "n", "value"])

    return run


def string_table(counts: DataFrame, per_task: int = 1_000_000, most_second: int = MOST_SECOND) -> DataFrame:
    """(key, n, value): log10 probability of each string of (key, n)."""
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // per_task)
    spread = lambda df: df.repartition(parts, F.shiftright("key", 24)).sortWithinPartitions("key")
    sums = spread(counts.select("key", "n")).mapInArrow(_tops, "key long, a double, b double, w double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    nodes = stage(sums.mapInArrow(_weighed, "key long, a double, b double, log_w double, own double"), "ctw-second")
    nearest = (F.shiftright("key", 16) * 256 + F.col("key").bitwiseAND(255)).alias("key")
    got = nodes.select(nearest, "a", "b", "log_w").groupBy("key").agg(F.sum("a"), F.sum("b"), F.sum("log_w")).collect()  # 65,280 at most
    above = crown(np.array([r[0] for r in got], np.int64), *(np.array([r[c] for r in got], float) for c in (1, 2, 3)))
    if nodes.count() <= most_second:
        table = nodes.select("key", "a", "b", "own").orderBy("key").toArrow()
        key, a, b, own = (table.column(c).to_numpy() for c in range(4))
        sent = spark.sparkContext.broadcast(second(key.view(np.uint64), a, b, own, above))
        scored = spread(counts.select("key", "n")).mapInArrow(_scored(sent), "key long, n long, value double")
    else:
        eight = F.array(*[F.shiftright("key", 32) * 256 + (1 << bit) + F.shiftright(F.col("key").bitwiseAND(255), 8 - bit) for bit in range(8)])
        wanted = counts.select("key", "n", F.explode(eight).alias("node"))
        met = wanted.join(nodes.select(F.col("key").alias("node"), "a", "b", "own"), "node").groupBy("key", "n").agg(F.collect_list(F.struct(F.col("node").cast("double").alias("node"), "a", "b", "own")).alias("nodes"))
        scored = spread(met.select("key", "n", "nodes")).mapInArrow(_scored_with(above), "key long, n long, value double")
    out = stage(scored, "ctw-strings")
    unstage(nodes)
    return out


# ---- scoring ---------------------------------------------------------------------------------------------------------

class Hot(NamedTuple):
    """A look-up of bounded size: keys in the order of their hash, and where those of each leading bit pattern begin."""

    hash: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    shift: int

    @staticmethod
    def of(key: np.ndarray, value: np.ndarray) -> Hot:
        hashed = mix(key)
        order = np.argsort(hashed)
        bits = max(1, int(len(key)).bit_length())
        begin = np.searchsorted(hashed[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return Hot(hashed[order], value[order], begin, 64 - bits)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found)."""
        value, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        hashed = mix(keys)
        place = (hashed >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.begin[place], self.begin[place + 1]
        left = np.flatnonzero(at < end)
        at, end, hashed = at[left], end[left], hashed[left]
        while len(left):
            hit = self.hash[at] == hashed
            value[left[hit]], found[left[hit]] = self.value[at[hit]], True
            more = ~hit & (at + 1 < end)
            left, at, end, hashed = left[more], at[more] + 1, end[more], hashed[more]
        return value, found


def _hot(table: DataFrame, most: int) -> Hot:
    """The entries from some count on: at most `most`, by the counts' powers of two."""
    by_size = {r["k"]: r["m"] for r in table.groupBy(F.when(F.col("n") < 1, -1).otherwise(F.floor(F.log2(F.col("n").cast("double")))).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}
    total, least = 0, 64
    while least >= 0 and total + by_size.get(least - 1, 0) <= most:
        least -= 1
        total += by_size.get(least, 0)
    got = table.where(F.col("n") >= (2**least if least >= 0 else 0)).select("key", "value").toArrow() if least < 63 else None
    if got is None or not got.num_rows:
        return Hot.of(np.zeros(0, np.uint64), np.zeros(0))
    return Hot.of(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def _scorer(sent, id_type: pa.DataType):
    def lists(keys: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(keys.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_strings, hot_words, unseen = sent.value
        for whole in batches:
            for batch in by_bytes(whole, 1):
                n = batch.num_rows
                words = split_words(batch.column(1))
                key, doc = strings(words)
                value, found = hot_strings.look_up(key)
                score = np.bincount(doc, weights=value, minlength=n)
                ends = np.arange(n)
                token = np.concatenate([words.hash, np.full(n, END_KEY, np.uint64)])
                of = np.concatenate([words.doc, ends])
                n_bytes = np.bincount(doc, minlength=n)
                base_value, base_found = hot_words.look_up(token)
                base = np.bincount(of, weights=base_value, minlength=n)
                known = np.bincount(of, weights=base_found & (base_value > unseen), minlength=n).astype(np.int64)
                rest = np.flatnonzero(~base_found)
                rest = rest[np.argsort(of[rest], kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(id_type), pa.array(np.diff(words.first) + 1), pa.array(n_bytes), pa.array(known), pa.array(base), pa.array(score),
                     lists(token[rest], of[rest], n), lists(key[~found], doc[~found], n)],
                    names=["id", "n_tokens", "n_bytes", "n_known", "base", "score", "words", "strings"])

    return run


def _joined(rows: DataFrame, column: str, table: DataFrame, value: str) -> DataFrame:
    """(uid, value, known) summed over each row's keys that the bounded tables lack."""
    left = rows.select("uid", F.explode(column).alias("key")).groupBy("uid", "key").agg(F.count("*").alias("times"))
    return left.join(table.select("key", "n", "value"), "key").groupBy("uid").agg(
        F.sum(F.col("times") * F.col("value")).alias(value), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias(value + "_known"))


def score(docs: DataFrame, most_hot: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the text's code length).

    Learns from documents whose crc32(id as text) mod folds is not 0; scores all.
    """
    spark = docs.sparkSession
    held = fold(F.col(id_col)) % folds == 0
    source = small_batches(docs).select(text_or_empty(text_col).alias("text"), (~held).alias("train"))
    counted = source.mapInArrow(_count, "kind int, key long, n long")
    counts = stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts", ["kind"])
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    below = np.log10(total[0] + 0.1 * (total[1] + 1))
    words = words.withColumn("value", F.log10(F.col("n") + 0.1) - F.lit(float(below)))
    table = string_table(counts.where(F.col("kind") == STRING))
    # An entry of a known word has a value above that of a count of 0, halfway to that of 1.
    sent = spark.sparkContext.broadcast((_hot(table, most_hot), _hot(words, most_hot // 2), float(np.log10(0.5) - below)))
    texts = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["id"].dataType
    rows = texts.mapInArrow(_scorer(sent, to_arrow_type(kind)), f"id {kind.simpleString()}, n_tokens long, n_bytes long, n_known long, base double, score double, words array<long>, strings array<long>")
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "ctw-rows")
    more_words = _joined(rows, "words", words, "more_base")
    more_strings = _joined(rows, "strings", table, "more_score")
    out = rows.drop("words", "strings").join(more_words, "uid", "left").join(more_strings, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("id", (fold(F.col("id")) % folds == 0).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_base_known")).cast("long").alias("n_known"),
                      F.lit(int(total[0])).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
                      ((F.col("score") + zero("more_score")) * float(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
