"""Links between nodes that share buckets: verified by exact Jaccard similarity, joined to components.

In a bucket nodes are compared with pivots, not with each other: at first with one in a few bands, which joins most of a
large group while its nodes meet seldom, then with one in every band, then with sixteen times as many in each round, until a
bucket is one component or all its nodes were pivots. Nodes of one component are never compared: of a bucket, members of
its largest component meet only the pivots outside it. So a large group of similar nodes costs a few comparisons each, and
no link between components that share a bucket is left untested. A pair is tested by its sizes, then by sketches (four bits
of each register; 4.2 standard deviations are allowed), and only then by its sets.

Where nodes bring digests of their bands' keys, rounds of several pivots test a pair only in the first band that it shares,
and of two pivots once, so that each pair is made once. A digest has 32 bits: an earlier band passes for shared by chance in
one pair of 90 million at most.

Rows of buckets are numbers only; sizes, sketches and digests are looked up for those that meet a pivot in the round.

A bucket of many unlike nodes doesn't shrink this way. Where `split_over` is given, a bucket whose comparisons would exceed
it is divided by the sizes of its nodes. Two sets at the threshold differ in size by that factor at most, so classes that
overlap by it keep every pair that can be linked together: no result depends on whether a bucket was divided.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import stage, unstage
from lithic.llm.components import components

FIRST_BANDS, MORE_PIVOTS = 4, 16
#: What a node is in a bucket and round.
MEMBER, FRESH_PIVOT, OLD_PIVOT = 0, 1, 2


#: Pairs are broadcast up to this many (some 60 bytes each).
BROADCAST_PAIRS = 500_000

#: Bits kept of each register, in as many planes: registers that differ show it with a chance of 15 in 16.
PLANES = 4


def most_differences(registers: int, threshold: float) -> int:
    """The registers that differ between the sketches of two sets at the threshold, and 4.2 standard deviations more."""
    q = (1 - threshold) * (1 - 2.0**-PLANES)
    return int(registers * q + 4.2 * math.sqrt(registers * q * (1 - q)))


def _differences(sketch: list[str]) -> Column:
    """How many registers differ: a register's bits stand at one place of each plane, planes one after the other."""
    words = len(sketch) // PLANES
    differ = [F.col(x).bitwiseXOR(F.col("other_" + x)) for x in sketch]
    count = F.lit(0)
    for w in range(words):
        any_plane = differ[w]
        for plane in range(1, PLANES):
            any_plane = any_plane.bitwiseOR(differ[plane * words + w])
        count = count + F.bit_count(any_plane)
    return count


def parity_words(sets: DataFrame, words: int) -> DataFrame:
    """(node, size, p0, p1, ...) of rows (node, item) without repeats: whether an odd number of items has each of 64 x words hashes.

    Two sets differ in as many items as their parities differ in bits, or more.
    """
    hashed = sets.select("node", F.xxhash64("item").alias("h"))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    word = F.pmod(F.shiftright("h", 6), F.lit(words))
    return hashed.groupBy("node").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(name) for i, name in enumerate(parity_names(words))])


def parity_names(words: int) -> list[str]:
    return [f"p{i}" for i in range(words)]


def _parity_bits(names: list[str]) -> Column:
    bits = F.lit(0)
    for name in names:
        bits = bits + F.bit_count(F.col(name).bitwiseXOR(F.col("other_" + name)))
    return bits


def _parities_allow(names: list[str], threshold: float) -> Column:
    """False only for sets below the threshold: those at it differ in (1 - t) / (1 + t) of the sum of their sizes at most."""
    return _parity_bits(names) * (1 + threshold) <= (1 - threshold) * (F.col("size") + F.col("other_size")) + 1e-6


def _beside(pairs: DataFrame, sets: DataFrame, column: str, few: bool) -> DataFrame:
    """pairs with that column of both nodes, as a and b. Few pairs are broadcast, so that the sets of no other nodes are shuffled."""
    a = sets.select(F.col("node").alias("u"), F.col(column).alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col(column).alias("b"))
    if few:
        return F.broadcast(pairs).join(a, "u").join(F.broadcast(pairs.select("u", "v")).join(b, "v"), ["u", "v"])
    return pairs.join(a, "u").join(b, "v")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float, items: Callable[[Column], Column] | None = None, few: bool = False) -> DataFrame:
    """The pairs whose sets' exact Jaccard similarity reaches the threshold, as links between their components."""
    make = items or (lambda c: c)

    def alike(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return both >= threshold * (F.size(x["a"]) + F.size(x["b"]) - both) - 1e-9

    # As fields of a variable the sets are made once.
    met = F.exists(F.array(F.struct(make(F.col("a")).alias("a"), make(F.col("b")).alias("b"))), alike)
    return _beside(pairs, sets, "items", few).where(met).select(F.col("cu").alias("u"), F.col("cv").alias("v"))


def _samples_similar(pairs: DataFrame, sets: DataFrame, threshold: float, sample: str, few: bool) -> DataFrame:
    """The pairs but for those whose samples' similarity is 4.2 standard deviations below the threshold."""
    def allow(x: Column) -> Column:
        any_ = x["n"] - x["both"]
        return x["both"] >= threshold * any_ - 4.2 * F.sqrt(threshold * (1 - threshold) * any_)

    counts = F.struct(F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("n"))
    return _beside(pairs, sets, sample, few).where(F.exists(F.array(counts), allow)).select("u", "v", "cu", "cv")


def _staged(pairs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    out = stage(pairs, name)
    return out, out.count() <= BROADCAST_PAIRS


def _linked_once(pairs: DataFrame, sets: DataFrame, threshold: float, items: Callable[[Column], Column] | None, sample: str) -> DataFrame:
    """The links (staged) that pairs (u, v, cu, cv, score) hold: of two components the pair of the least score is tested first, the others where it is no link."""
    def tested(some: DataFrame) -> DataFrame:
        met, few = _staged(some, "link-some")
        near, few_near = _staged(_samples_similar(met, sets, threshold, sample, few), "link-near")
        out = stage(_similar(near, sets, threshold, items, few_near).distinct(), "link-found")
        unstage(met)
        unstage(near)
        return out

    met = stage(pairs, "link-met")
    first = met.groupBy("cu", "cv").agg(F.min(F.struct("score", "u", "v")).alias("p"), F.count("*").alias("n"))
    first = stage(first.select("p.u", "p.v", "cu", "cv", "n"), "link-first")
    found = tested(first.drop("n"))
    if first.where("n > 1").isEmpty():
        unstage(met)
        unstage(first)
        return found
    open_ = first.where("n > 1").join(found.select(F.col("u").alias("cu"), F.col("v").alias("cv")), ["cu", "cv"], "left_anti").select("cu", "cv", F.col("u").alias("fu"), F.col("v").alias("fv"))
    rest = tested(met.drop("score").join(open_, ["cu", "cv"]).where("u <> fu OR v <> fv").select("u", "v", "cu", "cv"))
    out = stage(found.unionByName(rest), "link-found")
    for x in (met, first, found, rest):
        unstage(x)
    return out


def _merged(known: DataFrame | None, merges: DataFrame) -> DataFrame:
    """(node, component) after components were merged: merges maps a component's name to its new one."""
    if known is None:
        return stage(merges, "link-known")
    new = merges.select(F.col("node").alias("old"), F.col("component").alias("now"))
    moved = known.join(new, known["component"] == new["old"], "left").select("node", F.coalesce("now", "component").alias("component"))
    return stage(moved.unionByName(merges.join(known.select("node"), "node", "left_anti")), "link-known")


def _by_size(cand: DataFrame, hot: DataFrame, about: DataFrame, threshold: float) -> DataFrame:
    """cand with each hot bucket divided by sizes: a node enters its own class and the next, so that sizes within the threshold share one."""
    own = cand.join(hot, "bucket", "left_semi").join(about.select("node", "size"), "node")
    place = F.floor(F.log("size") / (1e-9 - math.log(threshold)))
    parts = own.withColumn("class", F.explode(F.array(place, place + 1))).withColumn("bucket", F.xxhash64("bucket", "class"))
    return stage(cand.join(hot, "bucket", "left_anti").unionByName(parts.select(*cand.columns)), "link-by-size")


def digest_names(bands: int) -> list[str]:
    """Columns of two 32-bit digests each, the first band's lowest."""
    return [f"d{i}" for i in range(-(-bands // 2))]


def _first_shared(names: list[str]) -> Column:
    """No band before the row's own has equal digests."""
    out = F.lit(True)
    for w, name in enumerate(names):
        x = F.col(name).bitwiseXOR(F.col("other_" + name))
        for lane, digest in enumerate((x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))):
            out = out & ((F.col("band") <= 2 * w + lane) | (digest != 0))
    return out


def _chosen(pivots: int) -> Column:
    """About `pivots` nodes of a bucket, one at least; those of fewer pivots are among those of more."""
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("n") < F.lit(pivots << 30)
    return (F.xxhash64("node") == F.col("least")) | (F.col("n") <= pivots) | (share if pivots > 1 else F.lit(False))


def linked(cand: DataFrame, sets: DataFrame, threshold: float, about: DataFrame | None = None, sketch: list[str] | None = None, registers: int = 0, split_over: int | None = None,
           items: Callable[[Column], Column] | None = None, sample: str | None = None, digests: list[str] | None = None, parities: list[str] | None = None) -> DataFrame | None:
    """(node, component) of the nodes of cand (bucket, band, node) that chains of similar nodes in common buckets connect.

    sets has (node, items): arrays without repeats, or what `items` makes them of; about has (node, size, sketch..., digests...,
    parities...) of each node, sample is a column of sets, of samples that are tested before items. None if nothing is linked.
    """
    sketch, digests, parities = sketch or [], digests or [], parities or []
    known, pivots, before, few = None, 1, 0, True
    given, left = cand, cand
    while True:
        own = cand.where(F.col("band") < FIRST_BANDS) if few else left
        columns = ["bucket", "band", "node"]
        members = own.select(*columns, F.col("node").alias("c"))
        if known is not None:
            members = stage(own.join(known, "node", "left").select(*columns, F.coalesce("component", "node").alias("c")), "link-members")
        parts = members.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.min(F.xxhash64("node")).alias("least"))
        open_ = stage(parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min(F.struct("least", "c")).alias("p"), F.max(F.struct("n", "c")).alias("x"), F.count("*").alias("k")).where("k > 1")
                      .select("bucket", "n", F.col("p.least").alias("least"), F.col("p.c").alias("least_c"), F.col("x.c").alias("most"), (F.col("n") - F.col("x.n")).alias("outside")), "link-open")
        largest = open_.agg(F.max("n")).first()[0]
        if split_over and about is not None and not few and largest and pivots >= MORE_PIVOTS:
            hot = open_.where(F.col("n") * F.col("outside") > split_over).select("bucket")
            if not hot.isEmpty():
                now = _by_size(left, hot, about, threshold)
                for x in (members, open_, left if left is not given else None):
                    unstage(x)
                left, split_over, pivots, before = now, None, 1, 0
                continue
        still = None
        if largest is not None:
            # The pairs of the pivots of earlier rounds were tested then, in other bands and buckets too for the most part.
            old = (_chosen(before) & (F.lit(True) if before > 1 or pivots > 1 else F.col("band") < FIRST_BANDS)) if before else F.lit(False)
            part = F.when(old, OLD_PIVOT).when(_chosen(pivots), FRESH_PIVOT).otherwise(MEMBER)
            # One pivot alone meets the nodes of other components than its own, where it is new.
            meets = (F.col("c") != F.col("least_c")) & (F.col("band") >= (FIRST_BANDS if before else 0)) if pivots == 1 else F.lit(True)
            outside = (F.col("c") != F.col("most")).alias("outside")
            still = stage(members.join(open_, "bucket").select(*columns, "c", "n", outside, part.cast("byte").alias("part"), meets.alias("meets")), "link-still")
            extra = digests if pivots > 1 else []
            wide = [] if about is None else ["size", *sketch, *parities, *extra]
            of = (lambda rows: rows) if about is None else (lambda rows: rows.join(about.select("node", *wide), "node"))
            chosen = of(still.where(F.col("part") == FRESH_PIVOT)).select(
                "bucket", F.explode(F.when(F.col("outside"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("outside"), F.col("node").alias("other"), F.col("c").alias("other_c"), *[F.col(s).alias("other_" + s) for s in wide])
            near = F.lit(True) if about is None else F.least("size", "other_size") >= threshold * F.greatest("size", "other_size") - 1e-9
            if sketch:
                near = near & (_differences(sketch) <= most_differences(registers, threshold))
            if parities:
                near = near & _parities_allow(parities, threshold)
            if extra:
                near = near & _first_shared(extra)
            score = [(_parity_bits(parities) / (F.col("size") + F.col("other_size") + 1)).alias("score")] if sample else []
            first = F.col("node") < F.col("other")
            meeting = of(still.where((F.col("part") != OLD_PIVOT) & F.col("meets")))
            pairs = meeting.join(chosen, ["bucket", "outside"]).where((F.col("c") != F.col("other_c")) & ((F.col("part") == MEMBER) | first) & near).select(
                F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), F.when(first, F.col("c")).otherwise(F.col("other_c")).alias("cu"), F.when(first, F.col("other_c")).otherwise(F.col("c")).alias("cv"), *score).distinct()
            found = _linked_once(pairs, sets, threshold, items, sample) if sample else stage(_similar(pairs, sets, threshold, items).distinct(), "link-found")
            if not found.isEmpty():
                old_known, known = known, _merged(known, components(found))
                unstage(old_known)
            unstage(found)
        # A bucket that is one component stays one, and in one whose nodes were all pivots (or all but one) every pair was tested: only the others go on.
        go_on = not few and largest is not None and largest > max(pivots, 2)
        if go_on:
            done, left = left, stage(still.where(F.col("n") > max(pivots, 2)).select(*columns), "link-left")
            unstage(done if done is not given else None)
        for x in (members, open_, still):
            unstage(x)
        if few:
            few, before = False, 1
        elif go_on:
            before, pivots = pivots, pivots * MORE_PIVOTS
        else:
            break
    unstage(left if left is not given else None)
    return known
