"""Fuzzy dedup of lines by MinHash over character shingles, with DataFrame operations alone.

Lines are compared trimmed and lower-cased. Equal ones are one node from the start (a line that a third of all rows share
costs a row per task), known by two 64-bit hashes. A signature is made of hashes of a line's distinct shingles of eight
characters, sorted: those that begin with a word, with a to m or a character beyond ASCII, where there are enough of them
(what a shingle begins with depends on it alone, so the similarity of these subsets estimates that of the whole sets), else
all; about the border both are taken. The
leading bits of the hashes divide them into eight bands; a band's key is its least hash and the two after it. Lines that
share a key are compared with pivots instead of all pairs: by sizes and 512 bits of parity of all their shingles (which pass
every pair at the threshold), by hashes of their shingles that begin with a word, whose similarity may
lie 4.2 standard deviations below the threshold, and then by the exact Jaccard similarity of all their shingles; of two
components the likeliest pair first, the others only where it is no link. Links are joined to components by distributed union-find. Of a component the first line stays, by document id and place.

Eight bands of three rows find a pair whose subsets have similarity s with probability 1 - (1 - s^3)^8, 0.997 at 0.8; sets
of fewer than sixteen have rows of two and fewer, overlapping bands. A test measures the recall against brute force.

Defined results: null text has no lines; blank lines belong to the layout and always stay; lines of less than eight
characters are alike only if equal, and lines of one repeated character from eight on are alike at any length; a
null id sorts last; rows that repeat (same id and text) are one document, whose result each of them gets; lines of any length count whole; an empty table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import OWN, stage, text_or_empty, unstage
from lithic.llm.links import linked, parity_names, parity_words

#: Lines that go are broadcast up to this many (some 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LINES = 300_000
#: So are candidate lines and shared keys, rows of two or three numbers (some 50 bytes each).
BROADCAST_KEYS = 1_000_000
#: 64-bit words of parity of a line's shingles.
PARITY = 8
WHITE_SPACE = " \t\n\x0b\x0c\r"


class Options(NamedTuple):
    shingle: int = 8
    threshold: float = 0.8
    enough_words: int = 8  # shingles at words from which they make a signature
    border: int = 13  # and below which all shingles make one too
    few: int = 16  # hashes of a signature: fewer have keys of two, about the border of two and three
    few_border: int = 22


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(WHITE_SPACE)))


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(WHITE_SPACE)) == ""


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, place, line, h1, h2): the lines that aren't blank, normalised; mark tells documents with one id apart."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("place", "raw"))
    return rows.where(~_blank(F.col("raw"))).select("id", "mark", "place", _normal(F.col("raw")).alias("line")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, items): the normalised line of each row of wanted (node, h1, at: the hash of the document's mark and the place)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("place", "raw"))
    found = rows.select(F.xxhash64("mark", "place").alias("at"), "raw").join(wanted, "at").select("node", "h1", _normal(F.col("raw")).alias("line"))
    return found.where(F.xxhash64("line") == F.col("h1")).groupBy("node").agg(F.first("line").alias("items"))


def _runs(line: Column, k: int) -> Column:
    return F.when(F.length(line) <= k, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def shingles(line: Column, k: int) -> Column:
    """The distinct runs of k characters; a shorter line is one shingle."""
    return F.array_distinct(_runs(line, k))


def at_words(line: Column, k: int, begin: str = "") -> Column:
    """The runs of k characters that begin with a word, with repeats; begin restricts their first character."""
    return F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(f"(?s) (?=({begin}.{{{k - bool(begin)}}}))"), F.lit(1))


def _hashed(runs: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x))))


def _with_bands(lines: DataFrame, o: Options) -> DataFrame:
    """lines and their keys as column bands. Each array is a column of its own, so that it is made once and by generated code where there is some."""
    nothing = F.expr("CAST(array() AS array<bigint>)")
    edges = [F.lit((n << 61) - (1 << 63)).cast("long") for n in range(8)]

    def places(df: DataFrame, sketch: str) -> DataFrame:
        """Where in the sorted hashes those of each three leading bits begin, each place once; their number where none follow."""
        df = df.withColumn(OWN + "x", F.sort_array(F.concat(sketch, F.array(*edges))))
        return df.withColumn(sketch + "_places", F.array_distinct(F.array(*[(F.array_position(OWN + "x", e) - (1 + n)).cast("int") for n, e in enumerate(edges)]))).drop(OWN + "x")

    def keys(sketch: str, kind: int, rows: int) -> Column:
        """A key for each of those places: the least hash from there on and those that follow, the first after the last."""
        n = F.size(sketch)
        return F.transform(sketch + "_places", lambda i: F.when(i < n, F.xxhash64(F.lit(kind), *[F.get(sketch, (i + j) % n) for j in range(rows)])))

    def both(sketch: str, least: int, kind: int) -> list[Column]:
        n = F.size(sketch)
        return [F.when((n >= least) & (n < o.few_border), keys(sketch, kind, 2)).otherwise(nothing), F.when((n >= least) & (n >= o.few), keys(sketch, kind + 1, 3)).otherwise(nothing)]

    df = places(lines.withColumn("at", _hashed(at_words(F.col("line"), o.shingle, "[a-m\u0080-\uffff]"))), "at")
    df = places(df.withColumn("all", F.when(F.size("at") < o.border, _hashed(_runs(F.col("line"), o.shingle))).otherwise(nothing)), "all")
    single = F.when(F.size("all") == 1, F.array(F.xxhash64(F.lit(0), F.get("all", F.lit(0))))).otherwise(nothing)
    found = F.concat(*both("at", o.enough_words, 3), single, *both("all", 2, 1))
    return df.withColumn("bands", F.array_except(found, F.expr("array(CAST(NULL AS bigint))"))).drop("at", "all", "at_places", "all_places")


def _few(rows: DataFrame, most: int) -> DataFrame:
    """Staged rows, broadcast if they are no more than that; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def kept_places(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, kept): the places of the lines that stay in each document, blank lines left out."""
    o = options
    lines = _lines(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "place", "bands"))
    distinct = _with_bands(lines, o).groupBy("h1", "h2").agg(first.alias("x"))
    nodes = stage(distinct.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "x.no_id", "x.id", "x.mark", "x.place", "x.bands"), "line-nodes")
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = stage(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "line-shared")
    cand = stage(spread.join(_few(shared, BROADCAST_KEYS), "bucket").select("bucket", F.col("band").cast("byte").alias("band"), "node"), "line-cand")
    wanted = stage(cand.select("node").distinct().join(nodes.select("node", "h1", F.xxhash64("mark", "place").alias("at")), "node"), "line-wanted")
    sample = F.array_distinct(F.transform(at_words(F.col("items"), o.shingle), lambda x: F.hash(x)))
    texts = stage(_texts(docs, text_col, _few(wanted, BROADCAST_KEYS)).withColumn("sample", sample), "line-texts")
    about = stage(parity_words(texts.select("node", F.explode(shingles(F.col("items"), o.shingle)).alias("item")), PARITY), "line-about")
    known = linked(cand, texts, o.threshold, about, parities=parity_names(PARITY), items=lambda line: shingles(line, o.shingle), sample="sample")
    place = F.struct("no_id", "id", "mark", "place")
    best = nodes.select("node", "id", "mark", "place")
    gone = None
    if known is not None:
        members = stage(known.join(nodes.select("node", place.alias("p")), "node"), "line-members")
        gone = stage(members.join(members.groupBy("component").agg(F.min("p").alias("best")), "component").where("p <> best").select("node"), "line-gone")
        best = best.join(F.broadcast(gone) if gone.count() <= BROADCAST_LINES else gone, "node", "left_anti")
        unstage(members)
    out = stage(best.groupBy("id", "mark").agg(F.sort_array(F.collect_list("place")).alias("kept")), "line-kept")
    for x in (shared, cand, wanted, texts, about, known, gone, nodes):
        unstage(x)
    return out


def line_decisions(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_lines, dropped (the places of lines that another line stands for, counted from 0)."""
    text = text_or_empty(text_col)
    full = F.transform(F.split(text, "\n"), lambda line, i: F.when(~_blank(line), i))
    slim = stage(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.size(F.split(text, "\n")).alias("n_lines"), F.filter(full, lambda i: i.isNotNull()).alias("filled")), "line-slim")
    kept = kept_places(docs, options, id_col, text_col).select(F.col("id").alias("kid"), F.col("mark").alias("kmark"), "kept")
    both = slim.join(kept, (slim["mark"] == kept["kmark"]) & slim["id"].eqNullSafe(kept["kid"]), "left")
    return both.select("id", F.col("n_lines").cast("long").alias("n_lines"), F.when(F.col("kept").isNull(), F.col("filled")).otherwise(F.array_except("filled", "kept")).alias("dropped"))


def dedup_lines(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their texts without the dropped lines; a null text stays null."""
    kept = kept_places(docs, options, id_col, text_col).select(F.col("id").alias(OWN + "id"), F.col("mark").alias(OWN + "mark"), F.col("kept").alias(OWN + "kept"))
    text = text_or_empty(text_col)
    both = docs.join(kept, (F.xxhash64(text) == kept[OWN + "mark"]) & docs[id_col].eqNullSafe(kept[OWN + "id"]), "left")
    stays = F.filter(F.split(text, "\n"), lambda line, i: line.rlike(r"\A[\x20\x09-\x0D]*\z") | F.coalesce(F.array_contains(F.col(OWN + "kept"), i), F.lit(False)))
    return both.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(stays, "\n"))).select(*docs.columns)
