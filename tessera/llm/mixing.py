"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's target is its weight's share of the whole, at most ``max_epochs`` times its size;
what is cut off is shared again by weight until no source is above (water filling, solved in
closed form over sources sorted by size per weight).  Full epochs of a source come first; the
rest is a weighted sample without replacement: each document gets the key -ln(u) / quality,
documents are taken in the order of their keys until the budget is spent, and the document in
which it ends is taken up to the budget.

Scale: sizes are counted once and written as a narrow table, dealt out by ranges of source, key,
id, size and row.  Range bounds follow the rows, so that a slice holds about as many whatever the
sources and weights are, also where many rows have one id.  Slice sums (partial sums before the
shuffle) tell in which slice a budget ends, and only that slice is summed row by row.  Joins to the
small per-source table are shuffle joins whose hot partitions adaptive execution splits, or
broadcast joins where Spark's own size limit allows.  Sources themselves are ranked in one task, as
a row of a few bytes each.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own and the last one; null quality counts as 1; u is a hash of id and seed, so reruns agree;
a null id has the key of the digest of its text; repeated rows each count; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, text_or_empty

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def white_space_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target; one row for each source of ``sizes`` (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    behind, ahead = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - max_epochs * F.coalesce(F.sum("source_size").over(behind), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(ahead))
    # The first source whose share fits sets the level of all that come after it.
    fits = F.col("weight") * F.col("level") <= max_epochs * F.col("source_size")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("source_size") / F.col("weight"))).over(Window.partitionBy())
    return sources.select("source", "source_size", F.least(F.lit(float(max_epochs)) * F.col("source_size"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", quality: DataFrame | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, slices: int | None = None, seed: str = SEED) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken.

    ``quality``: id, weight (above 0); several weights of an id count by the largest.
    ``slices``: as many as there are shuffle partitions, if not said."""
    slices = slices or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("/"), F.md5(text_or_empty(text_col).cast("binary"))))
    rows = docs.select(F.col(id_col).alias("id"), named.alias("name"), F.col(source_col).cast("string").alias("source"), white_space_words(text_or_empty(text_col)).alias("size"))
    if quality is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        best = quality.where("weight > 0").groupBy(F.col("id").alias("__id")).agg(F.max("weight").cast("double").alias("quality"))
        rows = rows.join(best, F.col("id") == F.col("__id"), "left").drop("__id").fillna(1.0, ["quality"])
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), "name").cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("place", 1 - F.pow(u, 1 / F.col("quality"))).drop("name", "quality").withColumn("row", F.monotonically_increasing_id())
    drawn = stored(rows, "mix-drawn")
    # Stored with the numbers of their slices: bounds that are drawn anew would deal otherwise.
    rows = stored(drawn.repartitionByRange(slices, "source", "place", "id", "size", "row").withColumn("slice", F.spark_partition_id()), "mix-sizes")
    release(drawn)

    sources = stored(source_targets(rows, weights, max_epochs), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select("source", "source_size", "target", epochs.cast("long").alias("epochs")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sums = sums.withColumn("key", key)
    ends = sums.join(sources.select(key.alias("key"), "source_size", "target", "epochs", "rest"), "key")
    ends = stored(ends.select("key", F.col("slice").alias("part"), "source_size", "target", "epochs", "rest", "before", "slice_size"), "mix-slices")
    rows = rows.withColumn("key", key).join(ends.withColumnRenamed("part", "slice"), ["key", "slice"])

    whole = F.col("before") + F.col("slice_size") <= F.col("rest")
    cut = (F.col("before") < F.col("rest")) & ~whole
    out = lambda df, more: df.select("id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).alias("taken"))
    plain = out(rows.where(~cut), F.when(whole, F.col("size")).otherwise(F.lit(0).cast("long")))
    upto = F.sum("size").over(Window.partitionBy("key", "slice").orderBy("place", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    edge = rows.where(cut).withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0)))
    part = F.greatest(F.least(F.col("size"), F.col("rest") - F.col("upto")), F.lit(0))
    return plain.unionByName(out(edge, part))
