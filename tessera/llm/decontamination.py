"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Of every ``w`` consecutive k-gram hashes the smallest is a fingerprint.  A shared span of
``k + w - 1`` words holds ``w`` common k-grams and therefore a common fingerprint: no shared
window of that length (10 words here) is missed.  Training fingerprints are joined to test
fingerprints, and each hit is extended word by word to the windows that contain it.

Items shorter than a window are a window as a whole; they are joined by the hash of all
their words, for each short length that the benchmark has (nine at most).

Scale: documents are read in one pass.  A text becomes segments of ``SEGMENT`` words, each with the
nine words that follow it, so that every window lies whole in one of them; whatever is made of words
stays within a segment, and memory does not depend on how long a text is.  The test side is broadcast
only if its fingerprints are counted and few; otherwise fingerprints and short windows are written and
the same join is shuffled, and adaptive execution splits its hot fingerprints.  They carry their
surroundings only (15 words), never the text.  Hits are shuffled by row.

Defined results: null text has no words and no hit; a benchmark item without words has no
window; items with null id make words hit but are not listed; repeated items are listed once;
rows with the same id are scanned apart; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Marked, shifted, stored, text_or_empty, words

WINDOW, K = 10, 5
#: Test fingerprints (some 200 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Words of a text that are looked at together.
SEGMENT = 256


def _combined(a: Column, b: Column) -> Column:
    """Hash of each pair, as long as the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.xxhash64(x, y))


def halves(wanted: set[int]) -> list[tuple[int, int]]:
    """(n, the largest power of two below n) for the grams that those ``wanted`` are made of."""
    needed, open_ = set(), list(wanted)
    while open_:
        if (n := open_.pop()) > 1 and n not in needed:
            needed.add(n)
            low = 1 << (n - 1).bit_length() - 1
            open_ += [low, n - low]
    return [(n, 1 << (n - 1).bit_length() - 1) for n in sorted(needed)]


def fingerprints(rows: DataFrame, window: int, k: int, short: list[int] = ()) -> DataFrame:
    """Adds ``marks``: a k-gram's hash where it is a fingerprint, else null; and ``g{n}``, the hash of
    each n words, for each n of ``short``.

    Minima of windows that hang over the end count too, which only adds fingerprints.
    """
    span, kept = window - k + 1, rows.columns
    rows = rows.withColumn("g1", F.transform("words", lambda x: F.xxhash64(x)))
    for n, low in halves({k, *short}):
        rows = rows.withColumn(f"g{n}", _combined(F.col(f"g{low}"), shifted(F.col(f"g{n - low}"), low)))

    def running(rows: DataFrame, name: str, pick) -> DataFrame:
        """``name`` becomes the smallest or largest of each ``span`` elements from there on."""
        width = 1
        while width < span:
            step = min(width, span - width)
            rows = rows.withColumn(name, F.zip_with(name, shifted(F.col(name), step), lambda a, b: pick(a, b)))
            width += step
        return rows

    g = f"g{k}"
    rows = running(rows.withColumn("m", F.col(g)), "m", F.least)
    none = F.array_repeat(F.lit(None).cast("long"), span - 1)
    rows = running(rows.withColumn("m", F.concat(none, "m")), "m", F.greatest)
    # The largest minimum of the windows that hold a k-gram is its own hash: one of them chose it.
    marks = F.slice(F.zip_with(g, "m", lambda a, b: F.when(a == b, a)), 1, F.size(g))
    return rows.select(*kept, marks.alias("marks"), *[f"g{n}" for n in short])


def segments(rows: DataFrame, window: int, size: int = SEGMENT) -> DataFrame:
    """A row for each ``size`` words: the other columns, ``at`` (its first word's place) and its
    ``words`` with the ``window - 1`` that follow.  A text without words has one row."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(size))
    part = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, size + window - 1).alias("words")))
    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.explode(part).alias("part")).select(*kept, "part.*")


def grams(rows: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """Of segments a row for each fingerprint: i, n (k), mark, ``around`` (up to window-k words on
    either side of it) and how many of them stand ``before`` it; for each place and length n of
    ``short`` one with -n, the hash and the words; and for each text one row with n = 0."""
    reach, kept = window - k, [c for c in rows.columns if c not in ("at", "words")]
    rows = fingerprints(rows, window, k, short)

    def row(n: int, mark: Column, i: Column, before: Column, width: Column) -> Column:
        around = F.slice("words", i - before + 1, width)
        return F.struct((F.col("at") + i).alias("i"), F.lit(n).alias("n"), mark.alias("mark"), before.alias("before"), around.alias("around"))

    def picked(mark: Column, i: Column) -> Column:
        before = F.least(i, F.lit(reach))
        return F.when(mark.isNotNull(), row(k, mark, i, before, before + window))

    def whole(n: int) -> Column:
        return F.transform(f"g{n}", lambda mark, i: row(-n, mark, i, F.lit(0), F.lit(n)))

    # One row that each text has, whatever else it has.
    first = F.array(F.when(F.col("at") == 0, row(0, F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(0))))
    every = F.array_compact(F.concat(first, F.transform("marks", picked), *map(whole, short)))
    return rows.select(*kept, F.explode(every).alias("g")).select(*kept, "g.*")


def benchmark_marks(items: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """item, n, mark, lead and test: for a fingerprint the words up to window-k on either side
    of it, of which ``lead`` stand before; for a short item all its words."""
    names = ["item", "n", "mark", "lead", "test"]
    long_ = grams(segments(items.where(F.size("words") >= window), window), window, k, []).where("n > 0")
    out = long_.select("item", "n", "mark", F.col("before").alias("lead"), F.col("around").alias("test")).distinct()
    if not short:
        return out
    few = items.where(F.size("words").between(1, window - 1)).withColumns({"at": F.lit(0), "n_words": -F.size("words")})
    few = grams(few, window, k, short).where("n = n_words")
    return out.unionByName(few.select("item", "n", "mark", F.col("before").alias("lead"), F.col("around").alias("test")).select(names))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row, doc_id, n_words, item, start, end: each window of an item where it stands in a
    document, in words, end exclusive; and one row with null start for each document."""
    if not 0 < k <= window:
        raise ValueError("a k-gram must fit the window")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_or_empty(item_text_col)).alias("words")).distinct()
    lengths = items.select(F.size("words").alias("n")).where(F.col("n").between(1, window - 1)).distinct()
    short = sorted(r.n for r in lengths.collect())  # under ``window`` numbers
    marks = benchmark_marks(items, window, k, short)
    few = marks.limit(broadcast_rows + 1).count() <= broadcast_rows

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(text_or_empty(text_col)).alias("words"))
    each = grams(segments(rows.withColumn("n_words", F.size("words").cast("long")), window), window, k, short)
    first = F.col("n") == 0
    if few:
        hits = each.join(F.broadcast(marks), ["n", "mark"], "left").where(F.col("test").isNotNull() | first)
    else:
        each = stored(each, "picked")
        hits = each.join(marks, ["n", "mark"]).unionByName(each.where(first), allowMissingColumns=True)
    # Extend: each test window that holds the k-gram, laid over the document's words.
    at = lambda o: F.col("before") - F.col("lead") + o
    fits = lambda o: (at(o) >= 0) & (F.slice("around", F.greatest(at(o), F.lit(0)) + 1, window) == F.slice("test", o + 1, window))
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("test") - window, F.lit(0))), fits), lambda o: F.col("i") - F.col("lead") + o)
    starts = F.when(F.col("n") > 0, starts).when((F.col("n") < 0) & (F.col("around") == F.col("test")), F.array("i"))
    found = hits.select("row", "doc_id", "n_words", "item", "n", "i", F.explode_outer(starts).alias("start"))
    width = F.when(F.col("n") < 0, -F.col("n")).otherwise(window)
    return found.where(F.col("start").isNotNull() | first).select("row", "doc_id", "n_words", "item", "start", (F.col("start") + width).alias("end"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: words inside any window, and the items with a window."""
    found = contaminated_windows(docs, benchmark, **options)

    def cover(state: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], state["upto"]), F.lit(0))
        return F.struct(F.greatest(state["upto"], span["end"]).alias("upto"), (state["n"] + fresh).alias("n"))

    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    item = F.when(F.col("start").isNotNull(), F.col("item"))
    rows = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("at"), F.array_sort(F.collect_set(item)).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("at", zero, cover, lambda s: s["n"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with their columns."""
    marked = Marked(docs, id_col, text_col)
    keyed = marked.rows.withColumn("key", F.struct("id", "digest"))
    found = contaminated_windows(keyed, benchmark, "key", "text", **options).where("start IS NOT NULL")
    return marked.given(marked.among(stored(found.select("doc_id.id", "doc_id.digest").distinct(), "contaminated"), "left_anti"))
