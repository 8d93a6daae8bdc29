"""Column expressions and shared-storage helpers that several operators use."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import exists, held, release, shared_dir, stored  # noqa: F401  (for the operators)

#: Everything that is not part of a word once A-Z is in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_or_empty(text: Column | str) -> Column:
    """The text, an empty one where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case.  Pure ASCII takes the fast path."""
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def words(text: Column) -> Column:
    """Words of the whole text, in order.

    Splitting at the gaps is linear in the text, which extracting all matches is not:
    that copies the subject once for each match.
    """
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def shifted(array: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often and deep in a lambda it is used."""
    return F.transform(F.array(value), body)[0]


def sums_before(values: Column, block: int = 64, levels: int = 2) -> Column:
    """For each element of an array of integers the sum of those before it.

    Blocks are summed, and blocks of their sums, so that the time is linear in the array up to
    ``block ** levels`` blocks."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    before = lambda xs, start: F.transform(xs, lambda _, i: start + total(F.slice(xs, 1, i)))
    if not levels:
        return let(values, lambda xs: before(xs, F.lit(0).cast("long")))

    def blocks(xs: Column) -> Column:
        last = F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * block + 1, block))

    def joined(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, sums_before(F.transform(parts, total), block, levels - 1), before))

    return let(values, lambda xs: let(blocks(xs), joined))


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fifth that no model learns from; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Marked:
    """Rows of ``docs`` that an operator's decisions find again by id and digest of the text,
    without a copy of the table.  Columns have names of their own meanwhile (c0, c1 ...), which
    clash with none of an operator's."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest=F.xxhash64):
        self.names = docs.columns
        own = [f"c{n}" for n in range(len(self.names))]
        at = dict(zip(self.names, own, strict=True))
        self.rows = docs.toDF(*own).withColumns({"id": F.col(at[id_col]), "digest": digest(text_or_empty(at[text_col])), "text": F.col(at[text_col])})

    def among(self, side: DataFrame, how: str, rows: DataFrame | None = None) -> DataFrame:
        rows = self.rows if rows is None else rows
        side = side.select(F.col("id").alias("other_id"), F.col("digest").alias("other_digest"))
        return rows.join(side, rows["id"].eqNullSafe(side["other_id"]) & (rows["digest"] == side["other_digest"]), how)

    def given(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(self.names)])

    def kept(self, groups: DataFrame) -> DataFrame:
        """The rows that ``groups`` (id, digest and kept of every row) marks as kept.  Of repeated
        rows with id and digest in common, the first by the text of the whole row stays."""
        groups = stored(groups.select("id", "digest", "kept"), "groups")  # ends the join, whose hot partitions can then be split
        about = groups.groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        about = stored(about.where("kept"), "kept")
        release(groups)
        kept, often = self.among(about, "left_semi"), about.where("n > 1")
        if often.isEmpty():
            return self.given(kept)
        whole = F.struct(*[f"c{n}" for n in range(len(self.names))])
        one = self.among(often, "left_semi").groupBy("id", "digest").agg(F.min_by(whole, F.to_json(whole)).alias("one")).select("one.*")
        return self.given(self.among(often, "left_anti", kept)).unionByName(self.given(one))
