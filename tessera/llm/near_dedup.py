"""MinHash near-duplicates with DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles; the weight of a shingle is how often it
occurs.  Think of every (shingle, occurrence) as a region of width one and of unlimited
height (the rank).  Darts fall into a region as a Poisson process that is a function of the
region alone: hashed waiting times between darts, and a hashed coordinate for each dart.  A
document keeps, for each coordinate, its dart of the earliest rank.  Two documents keep the
same dart with a probability equal to their weighted Jaccard similarity.  Ranks are looked at
only up to the height that holds about k (ln k + 2) darts for the document's total weight, and
that height is doubled while a coordinate has none; work is linear in the document, not times k.

Rows of four coordinates make a band; documents that share a band meet in a bucket.  Texts with
the same words are one class from the start and meet once.  Links are verified exactly on the
shingles (similarity of 0.8 or more), and classes are the connected components of the links.

Within a bucket no all-pairs table arises.  A text's weight is the number of texts it meets in all
its buckets: the nearer a text is to the middle of its group, the more of its bands are common ones.
First each text is compared to the heaviest text of each of its buckets, which is the same one for
most of them.  Verified links merge classes; from then on a bucket that holds one class is done.
What is left is compared whole: texts of different classes in buckets of at most ``SMALL`` texts
with one another, those of larger buckets by an exact join.  With the units of these texts ordered
from rare to common, two texts of the similarity asked for share a unit at the beginning of both,
early enough that the rest can still reach it (``close_pairs``); at least one of the two is a guest,
a text outside the largest class of a bucket, so that the texts of a large class never meet one
another.  A pair at the limit of 0.8 is therefore missed only where no band is shared, which has a
probability of 0.0002.

Scale: hot groups are pre-aggregated (exact copies) or meet a single centre (near copies);
all joins are shuffle joins whose hot partitions adaptive execution splits; shingles travel for
texts in shared buckets only.  Steps are written to the shared folder, or held on the executors'
disks where they are a few operations away from written ones, and removed at the end.
Tables of buckets grow with the number of texts times bands, tables of pairs with the number of
classes that are left in them.  The exact join's pairs are those that the bounds cannot rule out,
which grow with the square of a group only where its texts have rare units in common.  Verification
is on 32 bits of each unit's hash: false matches raise a similarity by n / 2**32 for n units.

Defined results: null or wordless text is a class of its own for each id, and for each row without
one; fewer than five words are one
shingle; the class id is the smallest id of the class (nulls last), and of repeated rows with
that id the first read is the one that stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Marked, held, release, stored, text_or_empty

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES, BAND_ROWS = 64, 4
SMALL = 8
U = np.uint64
ONE = U(1)
SLACK = 1e-6  # keeps rounding from tightening a bound


def units_of(shingles: np.ndarray) -> np.ndarray:
    """A distinct key for each (shingle, occurrence)."""
    s = np.sort(shingles)
    if len(s) > 1 and (same := s[1:] == s[:-1]).any():
        place = np.arange(len(s))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), place, 0))
        return tk.mix(s + (place - begin).astype(U) * tk.STEP)
    return tk.mix(s)


def waiting(units: np.ndarray, dart: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The darts' own keys and the exponential waiting times before them."""
    keys = tk.mix(units + (np.atleast_1d(dart).astype(U) + ONE) * tk.BASE)
    return keys, -np.log(((keys >> U(11)).astype(np.float64) + 0.5) / 2.0**53)


def signature(units: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """For each coordinate the key of the earliest dart."""
    height = k * (math.log(k) + 2) / len(units)
    while True:
        if len(units) < 64:  # few regions with many darts each
            n = int(height + 8 * math.sqrt(height) + 16)
            keys, wait = waiting(units[:, None], np.arange(n)[None, :])
            ranks = np.cumsum(wait, axis=1)
            inside = ranks < height
            keys, ranks = keys[inside], ranks[inside]
        else:
            rank, left, found, dart = np.zeros(len(units)), units, [], 0
            while len(left):
                keys, wait = waiting(left, dart)
                rank = rank + wait
                hit = rank < height
                left, rank, dart = left[hit], rank[hit], dart + 1
                found.append((keys[hit], rank))
            keys, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((keys, ranks))
        keys = keys[order]
        at, first = np.unique(tk.mix(keys) % U(k), return_index=True)
        if len(at) == k:
            return keys[first]
        height *= 2


def band_keys(kept: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    grid = kept.reshape(-1, rows)
    out = np.arange(1, len(grid) + 1).astype(U) * tk.STEP
    for j in range(rows):
        out = tk.mix(out ^ grid[:, j])
    return out.view(np.int64)


def sketches(batches: Iterator[pa.RecordBatch], shingle: int, k: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("id")
        for first, last, data, offsets in tk.slices(texts):
            hashes, _, begins = tk.word_hashes(data, offsets)
            runs = tk.shingle_hashes(hashes, shingle)
            content, bands, units = [], [], []
            for n, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                if a == b:  # repeated rows of one id are one text, all others texts of their own
                    own = ids[first + n].as_py()
                    content.append(None if own is None else hashlib.blake2b(f"no words: {own}".encode(), digest_size=16).digest())
                    bands.append(None), units.append(None)
                    continue
                own = hashes[a:b]
                whole = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                s = runs[a : b - shingle + 1] if b - a >= shingle else np.frombuffer(whole[:8], U)
                u = units_of(s)
                content.append(whole), bands.append(band_keys(signature(u, k), rows))
                units.append(np.sort((u >> U(32)).astype(np.uint32)).tobytes())
            part = batch.slice(first, last - first)
            columns = [part.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(units, pa.binary())], [*names, "content", "bands", "units"])


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose weighted Jaccard similarity is at least ``least``."""
    for batch in batches:
        left, right = batch.column("ua"), batch.column("ub")
        keep = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint32), np.frombuffer(right[i].as_buffer(), np.uint32)
            if min(len(x), len(y)) >= least * max(len(x), len(y)):
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep[i] = both >= least * (len(x) + len(y) - both) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """row, label: the smallest row of each row's component.  Labels spread over links and
    then jump along themselves, so that rounds grow with the logarithm of a chain."""
    near = held(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = held(near.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(max_rounds):
        seen = near.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row")).agg(F.min("label").alias("seen"))
        spread = held(labels.join(seen, "row").select("row", "label", F.least("label", "seen").alias("next")))
        jump = spread.select(F.col("row").alias("next"), F.col("next").alias("far"))
        after = stored(spread.join(jump, "next").select("row", F.least("next", "far").alias("label"), "label").toDF("row", "label", "old"), "labels")
        settled = after.where("label <> old").isEmpty()
        release(labels, spread)
        labels = after
        if settled:
            release(near)
            out = labels.select("row", "label")
            out.stored_at = labels.stored_at
            return out
    raise RuntimeError("components did not settle")


def star_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``entries`` (key, row, weight): each text and the heaviest of its bucket."""
    about = held(entries.groupBy("key").agg(F.max(F.struct("weight", "row"))["row"].alias("other")))
    pairs = entries.join(about, "key").where("row <> other")
    pairs = stored(pairs.select(F.greatest("row", "other").alias("a"), F.least("row", "other").alias("b")).distinct(), "pairs")
    release(about)
    return pairs


def all_pairs(entries: DataFrame) -> DataFrame:
    """All pairs of different classes in a bucket; for buckets of bounded size."""
    other = entries.select("key", F.col("row").alias("b"), F.col("class").alias("other"))
    return entries.join(other, "key").where("row > b AND class <> other").select(F.col("row").alias("a"), "b")


def verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(units.select(F.col("row").alias("a"), F.col("units").alias("ua")), "a").join(units.select(F.col("row").alias("b"), F.col("units").alias("ub")), "b")
    return stored(both.select("a", "b", "ua", "ub").mapInArrow(lambda x: similar(x, similarity), "a long, b long"), "links")


def single_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, units = batch.column("row"), batch.column("units")
        for i in range(len(batch)):
            own = np.frombuffer(units[i].as_buffer(), np.int32)
            n = len(own)
            columns = [np.full(n, rows[i].as_py()), np.full(n, n), own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "n", "unit"])


def close_pairs(units: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs of ``rows`` (row, class, guest) of different classes, one a guest at least, that
    can reach ``similarity``.

    Of texts with x <= y units both must have t/(1+t) (x + y) in common, hence 2t/(1+t) x and
    t y.  The first common unit, in one order for all, then stands early enough in both."""
    each = units.join(rows.select("row"), "row").select("row", "units").mapInArrow(single_units, "row long, n long, unit int")
    each = held(each)
    often = held(each.groupBy("unit").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    ordered = each.join(often, "unit", "left").withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("often", F.lit(1)), "unit")))
    least = lambda share: F.ceil(F.col("n") * share - SLACK)
    early = ordered.where(F.col("often").isNotNull() & (F.col("place") <= F.col("n") - least(similarity) + 1)).select("unit", "row", "n", "place")
    early = stored(early.join(rows, "row"), "early")
    share = similarity / (1 + similarity)
    a = early.where(F.col("place") <= F.col("n") - least(2 * share) + 1).select("unit", F.col("row").alias("a"), "class", F.col("n").alias("x"), "place", "guest")
    b = early.select("unit", F.col("row").alias("b"), F.col("class").alias("other"), F.col("n").alias("y"), F.col("place").alias("at"), F.col("guest").alias("visits"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b, "unit").where("class <> other AND (x < y OR (x = y AND a < b))").where(F.col("x") >= similarity * F.col("y") - SLACK)
        pairs = pairs.where(1 + F.least(F.col("x") - F.col("place"), F.col("y") - F.col("at")) >= share * (F.col("x") + F.col("y")) - SLACK)
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    pairs = stored(met(a.where("guest"), b).union(met(a.where("NOT guest"), b.where("visits"))).distinct(), "pairs")
    release(each, often, early)
    return pairs


def shared_buckets(sketch: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, row, n, weight of the texts that share buckets, and these texts with their units."""
    bands = sketch.select("row", "bands").join(firsts.select(F.col("first").alias("row")), "row", "left_semi")
    every = held(bands.select(F.explode("bands").alias("key"), "row"))
    often = held(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = held(every.join(often, "key"))
    weights = held(shared.groupBy("row").agg(F.sum("n").alias("weight")))
    entries = stored(shared.join(weights, "row").select("key", "row", "n", "weight"), "entries")
    # The needed rows grow with the corpus: shuffled at every size, never broadcast.
    units = stored(sketch.select("row", "units").join(weights.select("row").hint("merge"), "row", "left_semi"), "units")
    release(every, often, shared, weights)
    return entries, units


def left_over(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """key, row, n, class of the buckets of more than two texts that hold several classes."""
    classed = entries.where("n > 2").select("key", "row", "n").join(labels, "row", "left").withColumn("class", F.coalesce("label", "row")).drop("label")
    classed = held(classed)
    mixed = held(classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key"))
    rest = stored(classed.join(mixed, "key", "left_semi"), "left-over")
    release(classed, mixed)
    return rest


def guests(entries: DataFrame) -> DataFrame:
    """row, class, guest: the texts of buckets with several classes, and whether a text is outside
    the largest class of one of them."""
    sizes = entries.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    hosts = held(sizes.groupBy("key").agg(F.max(F.struct("n", "class"))["class"].alias("host")))
    rows = stored(entries.join(hosts, "key").groupBy("row", "class").agg(F.max(F.col("class") != F.col("host")).alias("guest")), "guests")
    release(hosts)
    return rows


def near_links(sketch: DataFrame, firsts: DataFrame, similarity: float, small: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between texts of different words, and their components (row, label)."""
    entries, units = shared_buckets(sketch, firsts)
    tested = star_pairs(entries)
    links = verified(tested, units, similarity)
    labels = components(links)
    rest = left_over(entries, labels)
    candidates = [all_pairs(rest.where(F.col("n") <= small))]
    many = rest.where(F.col("n") > small)
    if not many.isEmpty():
        candidates.append(close_pairs(units, guests(many), similarity))
    more = stored(reduce(DataFrame.union, candidates).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    found = verified(more, units, similarity)
    release(entries, tested, rest, more, *candidates, units)
    if found.isEmpty():
        return links, labels
    both = stored(links.union(found), "links")
    release(links, found, labels)
    return both, components(both)


def near_classes(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, similarity: float = SIMILARITY, coordinates: int = COORDINATES, band_rows: int = BAND_ROWS, small: int = SMALL) -> DataFrame:
    """One row for each input row: id, row, digest (of the text), class_id, class_size, n_links,
    kept.

    ``n_links`` counts the verified links that were needed, to texts of other words."""
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    given = given.withColumn("digest", F.xxhash64("text"))
    kind = f"row long, id {given.schema['id'].dataType.simpleString()}, digest long, content binary, bands array<long>, units binary"
    sketch = stored(given.mapInArrow(lambda x: sketches(x, shingle, coordinates, band_rows), kind), "sketch")
    firsts = stored(sketch.where("content IS NOT NULL").groupBy("content").agg(F.min("row").alias("first")), "firsts")
    links, labels = near_links(sketch, firsts, similarity, small)
    label = labels.withColumnRenamed("row", "first")
    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    classes = firsts.join(label, "first", "left").join(degree, "first", "left")
    classes = classes.select("content", F.coalesce("label", "first").alias("class"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    classes = stored(classes.select("content", "class", "n_links"), "classes")
    rows = sketch.select("row", "id", "digest", "content")
    known = rows.join(classes, "content").select("row", "id", "digest", "class", "n_links")
    alone = rows.where("content IS NULL").select("row", "id", "digest", F.col("row").alias("class"), F.lit(0).cast("long").alias("n_links"))
    rows = stored(known.unionByName(alone), "classed")
    release(sketch, firsts, links, labels, classes)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    about = stored(rows.groupBy("class").agg(best, F.count(F.lit(1)).alias("class_size")), "about")
    return rows.join(about, "class").select("id", "row", "digest", F.col("best.id").alias("class_id"), "class_size", "n_links", (F.col("best.row") == F.col("row")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    marked = Marked(docs, id_col, text_col)
    return marked.kept(near_classes(marked.rows, "id", "text", **options))
