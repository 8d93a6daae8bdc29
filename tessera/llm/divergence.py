"""Audit of how sources of a language differ in their words, from count-level bitmaps.

Terms that stand in at least ``min_docs`` documents of a language are its kept terms.  Each group
(language and source) gives a kept term the smoothed share p = 1 + floor(SCALE * (count + 1) / (N + V)):
N is the group's count of all kept terms, V their number.  A pair of groups diverges by
f = floor((p - q)^2 / q), summed over all kept terms.

f depends on the two counts alone, so terms are never looked at one by one.  A bitmap holds, for a
group, a count and a block of 64 term ids, which of these terms occur so many times.  The popcount
of two groups' bitmaps, ANDed, is the size of a joint cell (i, j), which is multiplied by f(i, j).
Cells with a zero come by complement: with f(i, j) - f(i, 0) - f(0, j) + f(0, 0) for a joint cell,
f(i, 0) - f(0, 0) for every term of a group at count i, f(0, j) - f(0, 0) for the other's, and
f(0, 0) for all V terms, each term has its own f, and absent terms are stored nowhere.

Arithmetic is exact.  The shares of a group add up to SCALE + V at most, so that none of the sums
is above SCALE * (SCALE + V), which a long holds up to two thousand million terms.

Scale: texts are read once and counted in tasks of bounded memory; counts are summed with partial
aggregation.  Term ids follow frequency by ranges, so that few counts share a block; a block has at
most 64 bitmaps of a group and is one task's work of bounded size.  Tasks sum what pairs gain over all
their blocks.  A language or source with a third of all rows makes no larger group anywhere.
Groups are numbered in one task, as a row of a few bytes each.

Defined results: null text, language and source count as empty strings; a group without kept
terms has the share of count 0 everywhere; with V = 0 every pair's value is 0 and there are no terms;
a group alone in its language has no pair; rows with the same id are documents of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, text_or_empty

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: In UTF-8 with A-Z in lower case: bytes of ASCII letters and of all other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Distinct terms that a counting task holds before it hands them on, and cells of a comparison.
HELD_TERMS, CELLS = 300_000, 1 << 22
#: Bytes of a text whose terms are listed at once; those of a longer one come one by one.
LISTED_BYTES = 1 << 22
_COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes):
    low = text.lower()  # of bytes: ASCII alone
    return TERM.findall(low) if len(low) < LISTED_BYTES else (m.group() for m in TERM.finditer(low))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents; a null term says that the group occurs."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in seen.items():
            n = len(times) + 1
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *times], pa.binary()).cast(pa.string())]
            columns += [pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in batches:
        lang, source, text = (batch.column(c).to_pylist() for c in range(3))
        for key, data in zip(zip(lang, source, strict=True), text, strict=True):
            times, docs = seen.setdefault(key, (Counter(), Counter()))
            times.update(_terms(data))
            docs.update(set(_terms(data)))
            if len(times) > HELD_TERMS:
                yield from flush()
        if sum(len(times) for times, _ in seen.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """lang, source, term, n (occurrences), docs; and a row with null term for each group."""
    name = lambda c: text_or_empty(F.col(c).cast("string"))
    given = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).cast("binary").alias("text"))
    return given.mapInArrow(_counted, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, size: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / size), exact also where the product is beyond a long."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)")
    floor = F.call_function("div", wide, size.cast("decimal(19,0)"))
    small = F.call_function("div", F.lit(scale).cast("long") * (n + 1), size)
    return F.when(n < (1 << 62) // scale, small).otherwise(floor) + 1


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def joint_gains(group: np.ndarray, p: np.ndarray, zero: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block's bitmaps, each with its group, share and the group's share of count 0: pairs
    of groups and what joint cells add to each, in both directions."""
    parts = []
    step = max(1, CELLS // len(bits))
    for low in range(0, len(bits), step):
        both = np.bitwise_count(bits[low : low + step, None] & bits[None, :])
        both[group[low : low + step, None] >= group[None, :]] = 0
        i, j = np.nonzero(both)
        n, i = both[i, j].astype(np.int64), i + low
        for a, b in ((i, j), (j, i)):
            more = _gain(p[a], p[b]) - _gain(p[a], zero[b]) - _gain(zero[a], p[b]) + _gain(zero[a], zero[b])
            parts.append((group[a], group[b], n * more))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(a):
        return a, b, value
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(value, first)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps, sorted by block, to a, b, value summed over the blocks of the task."""
    held: list = []
    found, size = [], 0

    def compare(rows: list[np.ndarray]) -> int:
        parts = []
        ends = np.flatnonzero(np.r_[(rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]), True]) + 1
        for low, high in zip(np.r_[0, ends[:-1]], ends, strict=True):
            parts.append(joint_gains(*(x[low:high] for x in rows[2:5]), rows[5][low:high].view(np.uint64)))
        found.append(_summed(parts))
        return len(found[-1][0])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in range(6)]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        # The last block may go on in the next batch.
        whole = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
        held = [x[whole:] for x in rows]
        if whole:
            size += compare([x[:whole] for x in rows])
        if size > CELLS // 4:
            found = [_summed(found)]
            if (size := len(found[0][0])) > CELLS // 8:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["a", "b", "value"])
                found, size = [], 0
    if held:
        compare(held)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(found)], ["a", "b", "value"])


def bitmaps(cells: DataFrame, bits: int = 64) -> DataFrame:
    """lang_no, block, g, p, zero, bits: of ``cells`` (lang_no, g, id, p, zero), dealt and sorted by block."""
    shift = bits.bit_length() - 1
    rows = cells.select("lang_no", F.shiftright("id", shift).alias("block"), "g", "p", "zero", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(bits - 1).cast("int")).alias("bit"))
    level = rows.repartition("lang_no", "block").groupBy("lang_no", "block", "g", "p", "zero").agg(F.bit_or("bit").alias("bits"))
    return level.sortWithinPartitions("lang_no", "block")


class Audit:
    """Counts of a corpus, from which divergences are taken."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, scale: int = SCALE, **columns):
        counts = stored(term_counts(docs, **columns), "term-counts")
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        kept = stored(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        # Ids follow frequency; written, because they must not be drawn anew.
        order = ["lang", F.desc("total"), "term"]
        ids = stored(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "term-ids")
        #: lang, source, term, id, n, total: each kept term that occurs in a group.
        self.cells = stored(counts.drop("docs").join(ids, ["lang", "term"]), "cells")
        sizes = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
        groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        number = F.row_number().over(Window.orderBy("lang", "source"))
        groups = groups.withColumn("g", number.cast("long")).withColumn("lang_no", F.min("g").over(Window.partitionBy("lang")))
        zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("size") + F.col("terms"), scale))
        #: lang, source, size, terms, lang_size, g, lang_no, zero: each group that occurs.
        self.groups = stored(groups.withColumn("zero", zero), "groups")
        release(counts, kept, ids)
        own = self.groups.select("lang", "source", "g", "lang_no", "zero", "size", "terms", "lang_size")
        self.shares = self.cells.join(own, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size") + F.col("terms"), scale))
        self.scale = scale

    def pairs(self) -> DataFrame:
        """a, b, value: how each group diverges from each other group of its language."""
        joint = bitmaps(self.shares).mapInArrow(_compared, "a long, b long, value long")
        one = self.groups.where("terms > 0").select("lang_no", F.col("g").alias("a"), F.col("zero").alias("za"), "terms")
        other = self.groups.select("lang_no", F.col("g").alias("b"), F.col("zero").alias("zb"))
        met = one.join(other, "lang_no").where("a <> b")
        absent = met.select("a", "b", (F.col("terms") * gain(F.col("za"), F.col("zb"))).alias("value"))
        levels = self.shares.groupBy("lang_no", F.col("g").alias("a"), F.col("zero").alias("za"), "p").agg(F.count(F.lit(1)).alias("n"))
        met, p, za, zb = levels.join(other, "lang_no").where("a <> b"), F.col("p"), F.col("za"), F.col("zb")
        there = F.struct("a", "b", (F.col("n") * (gain(p, zb) - gain(za, zb))).alias("value"))
        back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") * (gain(zb, p) - gain(zb, za))).alias("value"))
        single = met.select(F.explode(F.array(there, back)).alias("x")).select("x.*")
        known = joint.unionByName(absent).unionByName(single).groupBy("a", "b").agg(F.sum("value").alias("value"))
        # Languages without kept terms: all pairs, each with 0.
        empty = self.groups.where("terms = 0")
        none = empty.select("lang_no", F.col("g").alias("a")).join(empty.select("lang_no", F.col("g").alias("b")), "lang_no").where("a <> b")
        return known.unionByName(none.select("a", "b", F.lit(0).cast("long").alias("value")))

    def terms(self) -> DataFrame:
        """g, term, value: kept terms whose share in a group is above that in its language."""
        q = share(F.col("total"), F.col("lang_size") + F.col("terms"), self.scale)
        return self.shares.withColumn("q", q).where("p > q").select("g", "term", gain(F.col("p"), F.col("q")).alias("value"))

    def report(self, top: int = TOP) -> DataFrame:
        """lang, source, part (pair, term), item, value, rank: all pairs and the first terms."""
        named = self.groups.select("g", "lang", "source")
        pairs = self.pairs().join(named.select(F.col("g").alias("b"), F.col("source").alias("item")), "b").select(F.col("a").alias("g"), F.lit("pair").alias("part"), "item", "value")
        terms = self.terms().select("g", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
        ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
        return ranked.join(named, "g").select("lang", "source", "part", "item", "value", "rank")


def divergence_report(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    return Audit(docs, **options).report(top)
