"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a
document and its tokens, a delete takes them away, a revision adds the difference.  Each batch
of changes is summed (partial sums before the shuffle) and committed under its identifier as a
Parquet folder whose success marker is the commit; a batch that has been committed is not
applied again, one that failed half way counts for nothing and is written anew.  Reading totals adds
up the deltas of committed batches; ``compact`` folds them into one, next to a ledger of the batches
in it, which stay committed.

Scale: a batch is one shuffle of partial sums; totals are a row for each group and batch.  The driver
lists folders of batches that were not compacted yet; the ledger of the others is a table.

Defined results: null text has no tokens but is a document; a null source or language is a
group of its own; groups whose documents and tokens are all gone have no row; repeated rows each
count; an empty batch is committed and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, words

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Fixed value: how the byte-level vocabulary splits texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_bpe_counter(path: str):
    """An Arrow function that counts tokens of a ``.tiktoken`` vocabulary; each worker loads it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(np.array(n, np.int64))], [*names, "tokens"])

    return count


def word_inserts(docs: DataFrame, tokenizer: str = "words-1", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Insert changes with the number of words, counted by Spark itself."""
    n = F.size(words(text_or_empty(text_col))).cast("long")
    return docs.select(F.lit("insert").alias("op"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))


def white_space_inserts(docs: DataFrame, tokenizer: str = "white-space-1", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    n = F.size(F.array_remove(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return docs.select(F.lit("insert").alias("op"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))


def bpe_inserts(docs: DataFrame, path: str, tokenizer: str, text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Insert changes with the tokens of a public byte-level vocabulary."""
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(byte_bpe_counter(path), "source string, lang string, tokens long")
    return counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", F.lit(None).cast("long").alias("old_tokens"))


class Rollup:
    """Totals under ``path``, a folder that all executors share.

    ``deltas/b-<batch>`` has the sums of a batch, ``compacted`` those of all batches in ``ledger``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        files, place = self._files(path)
        return files.exists(place)

    def _folder(self, batch: str) -> str:
        return f"{self.path}/deltas/b-{quote(batch, safe='')}"

    def _compacted(self) -> bool:
        return self._exists(f"{self.path}/compacted/_SUCCESS")

    def fresh(self) -> list[str]:
        """Committed batches that are not compacted."""
        files, place = self._files(f"{self.path}/deltas")
        names = [str(f.getPath().getName()) for f in files.listStatus(place)] if files.exists(place) else []
        return sorted(unquote(n[2:]) for n in names if self._exists(f"{self.path}/deltas/{n}/_SUCCESS"))

    def ledger(self) -> DataFrame:
        """batch: all committed ones."""
        rows = self.spark.createDataFrame([(b,) for b in self.fresh()], "batch string")
        return rows.union(self.spark.read.schema("batch string").parquet(f"{self.path}/ledger")) if self._compacted() else rows

    def committed(self, batch: str) -> bool:
        if self._exists(f"{self._folder(batch)}/_SUCCESS"):
            return True
        return self._compacted() and not self.ledger().where(F.col("batch") == batch).isEmpty()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (op: insert, delete or revise; source, lang, tokenizer, tokens,
        old_tokens) under ``batch``; False if that batch was there already."""
        if self.committed(batch):
            return False
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        tokens = F.when(F.col("op") == "insert", F.col("tokens")).when(F.col("op") == "delete", -F.col("tokens")).when(F.col("op") == "revise", F.col("tokens") - F.col("old_tokens"))
        checked = F.when(docs.isNull() | tokens.isNull(), F.raise_error(F.lit("a change needs a known op and its counts"))).otherwise(docs)
        sums = changes.groupBy(*KEYS).agg(F.sum(checked).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        paths = [self._folder(b) for b in self.fresh()] + [f"{self.path}/compacted"] * self._compacted()
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        deltas = self.spark.read.schema(TOTALS).parquet(*paths)
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: str) -> Rollup:
        """A rollup of the same totals and the same committed batches, under another path; the
        totals are written last, and with them all of it counts."""
        other = Rollup(self.spark, into)
        self.ledger().write.mode("overwrite").parquet(f"{other.path}/ledger")
        self.totals().write.mode("overwrite").parquet(f"{other.path}/compacted")
        return other
