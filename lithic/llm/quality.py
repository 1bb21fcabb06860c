"""Quality by hierarchical empirical Bayes: what a document's text says, with what its site and path are known for.

A logistic regression on text statistics gives each document's own evidence. Evidence (the label itself where it was
learned from) is averaged per path and per host by grouped aggregation, and shrunk: paths toward their host, hosts toward
all documents, by a beta prior whose strength is estimated from how much the groups differ. A document's log odds are then
moved by those of its path over the global ones, times `site_share`.

Bounds: the regression is fitted on at most `sample` labelled rows of the training fold (crc32 of the id mod 5 is not 0),
chosen by a hash of their id; of rows that repeat an id one counts, chosen by a hash of its text.

Defined results: null or empty text has all statistics zero; null host or path count as empty; ids may be null or repeat,
each row is scored; null labels are passed over, of several labels of an id the lowest counts; an empty table gives no
rows; without labels of both kinds every score is the global prior. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm import logistic
from lithic.llm.common import OWN, fold, small_batches, stage, text_or_empty, unstage
from lithic.llm.words import by_bytes, distinct, split_words


class Options(NamedTuple):
    sample: int = 20_000
    site_share: float = 0.5
    least_strength: float = 5.0
    most_strength: float = 1000.0


_KINDS = np.zeros(256, np.int64)  # 1 letter, 2 capital, 3 digit, 4 white space, 5 sentence marks, 0 other
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _b == 32 or 9 <= _b <= 13 else 5 if _c in ".,;:?!'\"-()" else 0


def statistics(texts: pa.Array) -> np.ndarray:
    """A row per text: shares of characters and words, repetition, lengths; all finite, about 0 to 1 or logs."""
    raw = split_words(texts, lower=False)
    words = split_words(texts)
    n = raw.n_docs
    of = np.repeat(np.arange(n), np.diff(raw.doc_start))
    kinds = np.bincount(of * 6 + _KINDS[raw.data], minlength=6 * n).reshape(n, 6)
    size, n_words = np.maximum(kinds.sum(axis=1), 1), np.maximum(np.diff(raw.first), 1)
    _, d, _ = distinct(words.hash, words.doc)
    kinds_of_words = np.bincount(d, minlength=n)
    again = np.bincount(words.doc[1:], weights=(words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]), minlength=n) if len(words.doc) else np.zeros(n)
    length = (raw.end - raw.start).astype(float)
    single = np.bincount(raw.doc, weights=length == 1, minlength=n)
    first = _KINDS[raw.data[raw.start]] if len(raw.start) else np.zeros(0, np.int64)
    last = _KINDS[raw.data[raw.end - 1]] if len(raw.start) else np.zeros(0, np.int64)
    odd = np.bincount(raw.doc, weights=(first == 0) | (last == 0), minlength=n)
    shout = np.bincount(of, weights=raw.data == ord("!"), minlength=n)
    lines = np.bincount(of, weights=raw.data == 10, minlength=n)
    x = np.stack([kinds[:, 0] / size, kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 5] / size, kinds[:, 4] / size, shout / n_words, odd / n_words, single / n_words,
                  again / n_words, kinds_of_words / n_words, np.bincount(raw.doc, weights=length, minlength=n) / n_words / 10, np.log1p(np.diff(raw.first)) / 10, np.log1p(lines) / 10], axis=1)
    return np.where((np.diff(raw.doc_start) > 0)[:, None], x, 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_bytes(whole, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(statistics(batch.column(0))), pa.list_(pa.float64()))], names=["y", "x"])


def _scorer(beta: np.ndarray | None, prior: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                p = np.full(batch.num_rows, prior) if beta is None else logistic.predict(beta[0], (statistics(batch.column(1)) - beta[1]) / beta[2])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(2), batch.column(3), pa.array(p)], names=["id", "host", "path", "p"])

    return run


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: float, o: Options) -> float:
    """The beta prior's strength by moments: how much less groups differ than single documents would make them."""
    seen = groups.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mean), 2)), F.sum(F.col("n") * F.col("n"))).first()
    total, k, spread, squares = (float(x or 0) for x in seen)
    within = mean * (1 - mean)
    if k < 2 or total <= 0 or within <= 0:
        return o.most_strength
    between = (spread - (k - 1) * within) / max(total - squares / total, 1e-9)
    return min(max(within / between - 1, o.least_strength), o.most_strength) if between > 0 else o.most_strength


def with_sites(docs: DataFrame, pages: DataFrame, id_col: str = "doc_id", page_id_col: str = "page_id", url_col: str = "url", other_host: str = "source") -> DataFrame:
    """docs with __lx_host and __lx_path: of the page with the document's id its URL's host and first path segment.

    Of several pages of an id the least URL counts; a document without a page has other_host for a host, and no path.
    """
    urls = pages.where(F.col(page_id_col).isNotNull() & F.col(url_col).isNotNull()).groupBy(F.col(page_id_col).alias(OWN + "page")).agg(F.min(url_col).alias(OWN + "url"))
    both = docs.join(urls, docs[id_col] == urls[OWN + "page"], "left")
    host = F.lower(F.regexp_extract(OWN + "url", "^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(OWN + "url", "^.*?://[^/?#]*/*([^/?#]*)", 1)
    return both.withColumns({OWN + "host": F.when(host != "", host).otherwise(F.coalesce(F.col(other_host).cast("string"), F.lit(""))), OWN + "path": F.coalesce(path, F.lit(""))}).drop(OWN + "page", OWN + "url")


def quality(docs: DataFrame, labels: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang",
            label_col: str = "quality") -> DataFrame:
    """A row per document: id, text_score (its own evidence), host_mean, path_mean, score (0 to 1), kept (score >= 0.5)."""
    o = options
    as_text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) % 5 != 0)).groupBy(F.col(id_col).alias(OWN + "id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    learned = stage(usable, "quality-labels")
    sample = learned.orderBy(F.xxhash64(OWN + "id"), OWN + "id").limit(o.sample)
    rows = docs.join(F.broadcast(sample), docs[id_col] == sample[OWN + "id"]).select(OWN + "id", text_or_empty(text_col).alias("text"), "y")
    rows = rows.groupBy(OWN + "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r")).select("r.text", "r.y")
    got = rows.mapInArrow(_features, "y int, x array<double>").collect()  # at most `sample` rows
    y = np.array([r["y"] for r in got], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    beta = None
    if 0 < y.sum() < len(y):
        x = np.array([r["x"] for r in got])
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        beta = (logistic.fit((x - centre) / scale, y), centre, scale)
    source = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), as_text(host).alias("host"), as_text(path).alias("path"))
    kind = source.schema["id"].dataType
    scored = stage(source.mapInArrow(_scorer(beta, float(prior), to_arrow_type(kind)), f"id {kind.simpleString()}, host string, path string, p double"), "quality-scored")
    # Labels that were learned from are better evidence than the score; the fold that was held out gives its scores only.
    evidence = scored.join(learned, scored["id"] == learned[OWN + "id"], "left").withColumn("e", F.coalesce(F.col("y").cast("double"), F.col("p")))
    paths = stage(evidence.groupBy("host", "path").agg(F.sum("e").alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = ((total[0] or 0.0) + 1) / ((total[1] or 0) + 2)
    k_host, k_path = _strength(hosts, mean, o), _strength(paths, mean, o)
    known = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"))
    sites = stage(paths.join(known, "host").select("host", "path", "host_mean", ((F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)).alias("path_mean")), "quality-sites")
    moved = _logit(F.col("p")) + o.site_share * (_logit(F.col("path_mean")) - _logit(F.lit(mean)))
    out = scored.join(sites, ["host", "path"]).select("id", F.col("p").alias("text_score"), "host_mean", "path_mean", (1 / (1 + F.exp(-moved))).alias("score"))
    unstage(paths)
    unstage(learned)
    return out.withColumn("kept", F.col("score") >= 0.5)
