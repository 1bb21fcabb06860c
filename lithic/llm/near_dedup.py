"""Near-duplicate documents by ProbMinHash.

Shingles of five words, each of weight 1 however often it occurs. Each shingle is a Poisson process of arrivals in m
registers; a register keeps the shingle that came first, and a document stops drawing arrivals once every register was
reached earlier. The share of equal registers estimates the probability Jaccard similarity, which at equal weights is that
of the shingle sets. Registers are banded; documents that share a band are compared by the exact Jaccard similarity of
their shingle sets, and links at the threshold or above join classes.

Texts with the same shingle set are one node from the start, so copies cost nothing. How the nodes of a bucket are compared
without all pairs is in lithic.llm.links. Four bits of each register make the sketch that is looked at first.

Defined results: null or empty text (and text of white space alone) has no shingles; all such documents are copies of each
other. A text of one to four words is one shingle. Null ids form classes like others and a class's id is its least id that
is not null. A row is known by its id and text: rows that repeat an id with other texts are decided by themselves, and of rows
that repeat both the one whose other columns come first, as JSON, stays. An empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithic.llm.common import OWN, small_batches, stage, text_or_empty, unstage
from lithic.llm.links import PLANES, digest_names, linked
from lithic.llm.words import by_bytes, distinct, mix, shingles, split_words

_TIME, _PLACE, _OTHER = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
#: Ids are broadcast up to this many (16 bytes each and their table: some 40 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles whose arrivals are drawn at once.
ELEMENTS = 200_000


def _turn(salt: np.uint64, step: int) -> np.uint64:
    return np.uint64(int(salt) * step & 0xFFFFFFFFFFFFFFFF)


def registers(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m shingle hashes: whose arrival came first in each register. Texts without shingles keep zeros."""
    first = np.full(n_docs * m, np.inf)
    holder = np.zeros(n_docs * m, np.uint64)
    last = np.full(n_docs, np.inf)
    for begin in range(0, len(element), ELEMENTS):
        part = slice(begin, begin + ELEMENTS)
        e, w, d = element[part], weight[part], doc[part]
        t, step = np.zeros(len(e)), 0
        while len(e):
            step += 1
            draw = mix(e + _turn(_TIME, step))
            t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            early = t < last[d]  # later arrivals of a shingle that comes too late would be later still
            e, w, d, t = e[early], w[early], d[early], t[early]
            place = ((mix(e + _turn(_PLACE, step)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            flat = d * m + place.astype(np.int64)
            np.minimum.at(first, flat, t)
            won = first[flat] == t
            holder[flat[won]] = e[won]
            live = d[np.append(True, d[1:] != d[:-1])] if len(d) else d
            last[live] = first.reshape(n_docs, m)[live].max(axis=1)
    return holder.reshape(n_docs, m)


def _fingerprints(h: np.ndarray, d: np.ndarray, n_docs: int) -> pa.Array:
    sums = np.zeros((n_docs, 2), np.uint64)
    for k, salt in enumerate((_TIME, _OTHER)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt), out=total[1:])
        edge = np.searchsorted(d, np.arange(n_docs + 1))
        sums[:, k] = total[edge[1:]] - total[edge[:-1]]
    return pa.array([row.tobytes() for row in sums], pa.binary())


def sketch_planes(held: np.ndarray) -> np.ndarray:
    """(texts, planes, registers) bits of each register, by its holder and its place: registers that differ show it independently of each other."""
    drawn = mix(held + np.arange(held.shape[1], dtype=np.uint64) * _OTHER)
    return np.stack([(drawn >> np.uint64(plane) & np.uint64(1)).astype(np.uint8) for plane in range(PLANES)], axis=1)


def sketch_words(m: int) -> int:
    """64-bit words of a plane."""
    return -(-m // 64)


def sketch_names(m: int) -> list[str]:
    return [f"s{i}" for i in range(PLANES * sketch_words(m))]


def _signer(k: int, bands: int, rows: int, id_type: pa.DataType):
    m = bands * rows
    factor = mix(np.arange(1, rows + 1, dtype=np.uint64) * _OTHER) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                n = batch.num_rows
                h, d, _ = distinct(*shingles(split_words(batch.column(1)), k))
                held = registers(h, d, np.ones(len(h)), n, m)
                keys = mix((held.reshape(n, bands, rows) * factor).sum(axis=2) + np.arange(bands, dtype=np.uint64) * _PLACE).view(np.int64)
                packed = np.packbits(sketch_planes(held), axis=2)
                sketch = np.zeros((n, PLANES, 8 * sketch_words(m)), np.uint8)
                sketch[:, :, :packed.shape[2]] = packed
                sketch = sketch.reshape(n, -1)
                size = np.bincount(d, minlength=n)
                some = size > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(id_type), batch.column(2), _fingerprints(h, d, n), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())),
                     *[pa.array(np.ascontiguousarray(w)) for w in sketch.view(np.int64).T]],
                    names=["id", "mark", "fp", "size", "bands", *sketch_names(m)])

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 0):
                n = batch.num_rows
                h, d, _ = distinct(*shingles(split_words(batch.column(0)), k))
                offsets = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_fingerprints(h, d, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["fp", "items"])

    return sets


def _digests(bands: int) -> list[Column]:
    """d0...: the lowest 32 bits of each band's key, two to a column."""
    low = lambda band: F.coalesce(F.get("bands", F.lit(band)), F.lit(0)).bitwiseAND(0xFFFFFFFF)
    return [(low(2 * w).bitwiseOR(F.shiftleft(low(2 * w + 1), 32)) if 2 * w + 1 < bands else low(2 * w)).alias(name) for w, name in enumerate(digest_names(bands))]


def _narrowed(wide: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The columns that are still needed, staged; the wide stage (bands and sketches: some 500 bytes a row) goes, so that the linking's rounds don't lie on disk beside it."""
    out = stage(wide.select(*columns), name)
    unstage(wide)
    return out


def _rows(docs: DataFrame, threshold: float, k: int, bands: int, rows: int, id_col: str, text_col: str, split_over: int) -> DataFrame:
    """(id, mark, class_id, class_size, kept) of each row; mark tells rows of one id but different texts apart."""
    text = text_or_empty(text_col)
    source = small_batches(docs).select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    kind = source.schema["id"].dataType
    sketch = sketch_names(bands * rows)
    signed = source.mapInArrow(_signer(k, bands, rows, to_arrow_type(kind)), f"id {kind.simpleString()}, mark long, fp binary, size long, bands array<long>, {', '.join(x + ' long' for x in sketch)}")
    signed = stage(signed.withColumn("uid", F.monotonically_increasing_id()), "near-signed")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "uid")
    least = F.min(F.struct(row.alias("row"), "size", "bands", *sketch))
    nodes = signed.groupBy("fp").agg(least.alias("x"), F.count("*").alias("n")).select("fp", "x.row", "n", "x.size", "x.bands", *[f"x.{x}" for x in sketch])
    # From here on a node is a number: what is shuffled per band is two of them.
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    signed = _narrowed(signed, ["id", "mark", "uid", "fp"], "near-rows-of")
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = stage(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-shared")
    cand = stage(spread.join(shared, "bucket").select("bucket", F.col("band").cast("byte").alias("band"), "node"), "near-cand")
    wanted = stage(cand.select("node").distinct().join(nodes.select("node", F.col("row.id").alias("id"), "fp", "size", *sketch, *_digests(bands)), "node"), "near-wanted")
    nodes = _narrowed(nodes, ["fp", "row", "n", "node"], "near-nodes-of")
    chosen = stage(wanted.select(F.col("id").alias(OWN + "id")).distinct(), "near-chosen")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = source.join(side, source["id"].eqNullSafe(side[OWN + "id"]), "left_semi").select("text")
    made = texts.mapInArrow(_setter(k), "fp binary, items array<long>").join(wanted.select("fp", "node"), "fp")
    sets = stage(made.groupBy("node").agg(F.first("items").alias("items")), "near-sets")
    known = linked(cand, sets, threshold, wanted, sketch, bands * rows, split_over, digests=digest_names(bands))
    named = nodes.select("fp", "row", "n", F.col("node").alias("c"))
    if known is not None:
        named = nodes.join(known, "node", "left").select("fp", "row", "n", F.coalesce("component", "node").alias("c"))
    named = stage(named, "near-named")
    classes = stage(named.groupBy("c").agg(F.min("row").alias("row"), F.sum("n").alias("class_size")), "near-classes")
    # Only nodes that hold several rows, or belong to a class of several, are looked up; other rows stand alone.
    of = stage(named.join(classes.where("class_size > 1"), "c").select("fp", classes["row"], "class_size"), "near-of")
    for x in (nodes, shared, wanted, cand, chosen, sets, known, named, classes):
        unstage(x)
    out = signed.select("id", "mark", "uid", "fp").join(of, "fp", "left")
    alone = F.col("class_size").isNull()
    return out.select("id", "mark", F.when(alone, F.col("id")).otherwise(F.col("row.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      (alone | (F.col("uid") == F.col("row.uid"))).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 44, rows: int = 8, id_col: str = "doc_id", text_col: str = "text", split_over: int = 1 << 30) -> DataFrame:
    """A row per document: id, class_id (the least id of its class), class_size, kept (it is the row that names the class).

    bands x rows registers find a pair of similarity s with probability 1 - (1 - s^rows)^bands: 0.9997 at 0.8, 0.006 at a third.
    """
    return _rows(docs, threshold, k, bands, rows, id_col, text_col, split_over).drop("mark")


def near_dedup(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 44, rows: int = 8, id_col: str = "doc_id", text_col: str = "text", split_over: int = 1 << 30) -> DataFrame:
    """The documents that name their class, one of each, with all their columns; the rest are near or exact copies of those."""
    found = stage(_rows(docs, threshold, k, bands, rows, id_col, text_col, split_over).where("class_size > 1"), "near-rows")
    own_id, own_mark, kept, times = (OWN + x for x in ("id", "mark", "kept", "times"))
    groups = stage(found.groupBy(F.col("id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.max("kept").alias(kept), F.count("*").alias(times)), "near-groups")
    looked = groups.where(f"NOT {kept} OR {times} > 1")
    side = F.broadcast(looked) if looked.count() <= BROADCAST_IDS else looked
    whole = docs.join(side, docs[id_col].eqNullSafe(side[own_id]) & (F.xxhash64(text_or_empty(text_col)) == side[own_mark]), "left")
    out = whole.where(F.col(own_mark).isNull())
    if not looked.where(kept).isEmpty():  # a row that names its class and is repeated: one of the equal rows stays
        rest = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
        order = F.to_json(F.struct(F.lit(0), *rest), {"ignoreNullFields": "false"})
        equal = whole.where(F.col(kept)).groupBy(own_id, own_mark).agg(F.min_by(F.struct(*docs.columns), order).alias(OWN + "row"))
        out = out.unionByName(equal.select(f"{OWN}row.*", F.lit(None).cast("boolean").alias(kept)), allowMissingColumns=True)
    unstage(found)
    return out.select(*docs.columns)
