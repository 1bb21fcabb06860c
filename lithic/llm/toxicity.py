"""Toxicity by a lexicon that tolerates misspelling, weighed by context.

A lexicon of words and word stems is learned from labelled documents (and starts from a short list). Its trie, intersected
with Levenshtein automata, finds terms in every word of every text, misspelled ones too. Each hit is judged in a window of
words: within quotation marks, or beside words of reporting, it counts as quotation, else as abuse. A logistic regression
on a document's sums gives the score. Labels are used in learning only; a score depends on the text alone.

Bounds: learning takes at most `sample` labelled rows of the training fold, chosen by a hash of their id; of the terms of
toxic rows at most `most_terms`, those of most rows, are weighed against clean ones; the lexicon keeps at most `size` terms. Near copies in the sample count once (one document per MinHash of its word shingles, twice over), so
that a group of copies can't make its own words a lexicon.

Defined results: null or empty texts have no hits and get the score of a text without hits; null ids are scored like any;
rows that repeat are each scored; labels that are null are passed over, of several labels of an id the highest counts; an
empty table gives no rows; without usable labels the short list and the fixed weights are used. Other columns are unread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm import logistic
from lithic.llm.automaton import Lexicon, Term
from lithic.llm.common import OWN, fold, small_batches, stage, text_or_empty, unstage
from lithic.llm.words import by_bytes, mix, shingles, split_words, texts_by_size

#: The list that learning starts from.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "vermin", "dumbass", "bastard", "asshole")
#: Words of reporting: a hit beside them is talked about, not used.
REPORTING = frozenset("said says saying called calls quote quotes quoted quoting word words term terms phrase wrote writes written slur slurs insult insults meaning means defined definition reported reports according claimed mentions mentioned".split())
#: Words of address.
ADDRESS = frozenset("you your youre u ur du dein dich ihr tu toi te vous votre usted tú eres".split())
QUOTES = '"“”„‟«»‹›「」『』'
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
STEM_LENGTHS = (4, 5, 6)
#: What an edit leaves of a hit's weight.
PER_EDIT = 0.6
#: Weights for the features when there are no labels to learn from: constant, abuse, quotation, distinct, density, address.
FALLBACK = np.array([-2.5, 1.8, 0.0, 0.8, 0.3, 0.3])


class Options(NamedTuple):
    sample: int = 20_000
    size: int = 512
    window: int = 8
    least_support: int = 5
    least_share: float = 0.01
    dense_support: int = 3  # enough for a term that toxic documents repeat and clean ones lack
    least_log_odds: float = 2.5
    most_terms: int = 200_000  # candidates that are sent to the tasks


class Model(NamedTuple):
    terms: list[Term]
    beta: np.ndarray
    window: int


def allowed_edits(term: str, stem: bool) -> int:
    """Short terms have too many neighbours among plain words."""
    n = len(term)
    return int(n >= 6) if stem else int(n >= 5) + int(n >= 9)


# ---- texts as code points ------------------------------------------------------------------------------------------

_SEPARATOR = np.zeros(0x110000, bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]
for _a, _b in ((0x80, 0xAA), (0xAB, 0xB5), (0xB6, 0xBA), (0xBB, 0xC0), (0x2000, 0x2070), (0x3000, 0x3040), (0xFF00, 0xFF10)):
    _SEPARATOR[_a:_b] = True
_INNER = np.zeros(0x110000, bool)
_AS_LETTER = np.arange(0x110000, dtype=np.uint32)
for _c, _l in DISGUISE.items():
    _AS_LETTER[ord(_c)] = ord(_l)
    _INNER[ord(_c)] = _SEPARATOR[ord(_c)]
_INNER[ord("*")] = True


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, text_start, word start, word end, the word's text) of lower-cased texts."""
    lower = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lower], np.int64)
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_start = np.concatenate([[0], np.cumsum(lengths)])
    gap = _SEPARATOR[points]
    inner = np.zeros(len(points), bool)
    inner[1:-1] = _INNER[points[1:-1]] & ~gap[:-2] & ~gap[2:]
    gap &= ~inner
    edge = np.zeros(len(points) + 1, bool)
    edge[text_start] = True
    before, after = np.ones(len(points), bool), np.ones(len(points), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    start = np.flatnonzero(~gap & (before | edge[:-1]))
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return points, text_start, start, end, np.searchsorted(text_start, start, side="right") - 1


FEATURES = 5


def features(texts: list[str], lexicon: Lexicon, window: int) -> np.ndarray:
    """A row per text: logs of 1 + abuse, quotation, distinct terms, abuse per 100 words, address."""
    points, text_start, start, end, doc = _points(texts)
    sums, n_words = np.zeros((len(texts), FEATURES)), np.bincount(doc, minlength=len(texts))
    if not len(start):
        return sums
    word, term, edits = lexicon.match(_AS_LETTER[points], start, end)
    quotes = np.flatnonzero(np.isin(points, np.array([ord(c) for c in QUOTES], np.uint32)))
    first_word = np.searchsorted(doc, np.arange(len(texts) + 1))
    seen: dict[int, set[int]] = {}
    for w, k, e in zip(word.tolist(), term.tolist(), edits.tolist(), strict=True):
        d = int(doc[w])
        low, high = max(w - window, first_word[d]), min(w + window, first_word[d + 1] - 1)
        left, right = int(np.searchsorted(quotes, start[w])), int(np.searchsorted(quotes, end[w]))
        quoted = left > 0 and right < len(quotes) and quotes[left - 1] >= max(start[low] - 2, text_start[d]) and quotes[right] < min(end[high] + 2, text_start[d + 1])
        near = {points[start[x]:end[x]].tobytes().decode("utf-32-le", "replace") for x in range(low, high + 1) if x != w}
        weight = lexicon.terms[k].weight * PER_EDIT**e
        if quoted or near & REPORTING:
            sums[d, 1] += weight
        else:
            sums[d, 0] += weight
            seen.setdefault(d, set()).add(k)
            sums[d, 4] += bool(near & ADDRESS)
    for d, terms in seen.items():
        sums[d, 2] = len(terms)
    sums[:, 3] = 100 * sums[:, 0] / np.maximum(n_words, 1)
    return np.log1p(sums)


# ---- learning ------------------------------------------------------------------------------------------------------

def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) with two MinHashes of the text's word shingles."""
    for whole in batches:
        for batch in by_bytes(whole, 0):
            h, of = shingles(split_words(batch.column(0)), 5)
            held = []
            for salt in (1, 2):
                least = np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, of, mix(h + np.uint64(salt)))
                held.append(pa.array(least.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *held], names=["text", "toxic", "a", "b"])


_COUNTED = "term string, t long, times long"


def _terms(text: str) -> Counter:
    """Words, with how often they occur, and stems - letters and a star - with their number of different words."""
    words = Counter(w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) <= 40)
    return words | Counter(w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, times) of a task's part of the sample."""
    docs: Counter = Counter()
    times: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = _terms(text)
            docs.update(found.keys())
            times.update(found)
    terms = sorted(docs)
    for at in range(0, len(terms), 50_000):
        part = terms[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([docs[t] for t in part], pa.int64()), pa.array([times[t] for t in part], pa.int64())], names=["term", "t", "times"])


def _counter_of(wanted: set[str]):
    """Counts the documents that hold each of the wanted terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs.update(wanted.intersection(_terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(docs.keys()), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["term", "c"])

    return run


def _featurer(terms: list[Term], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for whole in batches:
            for batch in by_bytes(whole, 0):
                x = features(batch.column(0).to_pylist(), lexicon, window)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _choose(counts: list[tuple[str, int, float]], o: Options) -> list[Term]:
    """The lexicon from (term, toxic documents, log odds), best first; a stem must add to its words, a word to chosen stems."""
    by_stem: dict[str, int] = {}
    for text, toxic, _ in counts:
        if not text.endswith("*"):
            for n in STEM_LENGTHS:
                by_stem[text[:n] + "*"] = max(toxic, by_stem.get(text[:n] + "*", 0))
    chosen: dict[str, Term] = {}

    def covered(text: str) -> bool:
        return any(text[:n] + "*" in chosen for n in STEM_LENGTHS if n <= len(text.rstrip("*")))

    for text, toxic, odds in sorted(counts, key=lambda c: (-c[1], -len(c[0]), c[0])):
        stem, plain = text.endswith("*"), text.rstrip("*")
        if len(chosen) < o.size and not covered(text) and not (stem and by_stem.get(text, 0) >= 0.9 * toxic):
            chosen[text] = Term(plain, odds / 5.0, stem, allowed_edits(plain, stem))
    for text in SEED_TERMS:
        if not covered(text) and text not in chosen:
            chosen[text] = Term(text, 0.8, False, allowed_edits(text, False))
    return list(chosen.values())


def learn(docs: DataFrame, labels: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """Learns from labelled rows whose crc32(id) mod folds isn't 0."""
    o = options
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) % folds != 0))
    usable = usable.groupBy(F.col(id_col).alias(OWN + "id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sample = usable.orderBy(F.xxhash64(OWN + "id"), OWN + "id").limit(o.sample)
    sample = stage(sample, "toxic-sample")
    rows = small_batches(docs).join(F.broadcast(sample), docs[id_col] == sample[OWN + "id"]).select(text_or_empty(text_col).alias("text"), "toxic")
    rows = rows.mapInArrow(_sketched, "text string, toxic int, a long, b long").withColumn("uid", F.monotonically_increasing_id())
    rows = stage(rows, "toxic-rows")  # the texts of at most `sample` ids
    single = stage(rows.select("uid", "a", "b").groupBy("a").agg(F.min(F.struct("uid", "b")).alias("x")).groupBy("x.b").agg(F.min("x.uid").alias("uid")).select("uid"), "toxic-single")
    known = rows.join(F.broadcast(single), "uid").select("text", "toxic")  # at most `sample` numbers
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    least = max(o.least_support, o.least_share * n_toxic)
    # Terms are gathered from toxic documents; clean ones are then searched for those that enough of them hold.
    toxic_terms = known.where("toxic = 1").mapInArrow(_term_counts, _COUNTED).groupBy("term").agg(F.sum("t").alias("t"), F.sum("times").alias("times")).where(F.col("t") >= min(o.dense_support, least))
    # What so few toxic documents hold that clean ones can't decide on it isn't sent on; the most frequent terms are.
    wanted = stage(toxic_terms.orderBy(F.desc("t"), "term").limit(o.most_terms), "toxic-wanted")
    clean_terms = known.where("toxic = 0").mapInArrow(_counter_of({r["term"] for r in wanted.select("term").collect()}), "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))
    counted = wanted.join(clean_terms, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    enough = (F.col("t") >= least) | ((F.col("t") >= max(o.dense_support, 0.2 * least)) & (F.col("c") == 0) & (F.col("times") >= 3 * F.col("t")))
    best = counted.withColumn("odds", odds).where(enough & (F.col("odds") >= o.least_log_odds)).orderBy(F.desc("t"), F.desc(F.length("term")), "term").limit(20 * o.size)
    terms = _choose([(r["term"], r["t"], r["odds"]) for r in best.collect()], o)
    if n_toxic and n_clean:
        got = known.select("text", "toxic").mapInArrow(_featurer(terms, o.window), "toxic int, x array<double>").collect()
        beta = logistic.fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), ridge=0.1)
    else:
        beta = FALLBACK
    for x in (sample, rows, single, wanted):
        unstage(x)
    return Model(terms, beta, o.window)


def _scorer(model: Model, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for whole in batches:
            for batch in by_bytes(whole, 1):
                x = features(batch.column(1).to_pylist(), lexicon, model.window)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(logistic.predict(model.beta, x))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, score (0 to 1)."""
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType
    return source.mapInArrow(_scorer(model, to_arrow_type(kind)), f"id {kind.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns; scored where they are read."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.terms)
        for texts in batches:
            parts = [logistic.predict(model.beta, features(part.tolist(), lexicon, model.window)) for part in texts_by_size(texts)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return small_batches(docs).where(scored(text_or_empty(text_col)) < threshold)
