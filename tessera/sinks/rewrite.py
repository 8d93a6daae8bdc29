"""Label files edited where they lie: only the tokens that change are touched, all files or none.

A rewrite is planned as a table of edits in a journal folder of the dataset.  Tasks write each file's
new bytes beside it under the journal's name and list both digests; a commit mark then says that all
of them are there; only after that are they put in place, by renaming.  Whatever is killed can be taken up by
``recover``: without the mark the new files go and nothing has changed, with it the rest is put in
place.  A task that runs twice finds by the digests what is done already; a file that somebody else has
changed meanwhile is an error and stays as it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.labels import number
from ..sources.places import tasks_of
from .files import local_path

JOURNALS = ".tessera_rewrite"
EDITS = "label_path string, edits array<struct<line_no:int,first:int,last:int,text:string>>"
_PREPARED = "path string, old string, new string, edits int"
_TOKEN = re.compile(rb"\S+")


def edited(data: bytes, edits: list[tuple[int, int, int, str | None]]) -> bytes:
    """``data`` with tokens first..last (exclusive; none: put in before first) of its lines, counted
    from 1, replaced by a text; null takes the line out.  All other bytes stay."""
    lines, wanted = data.splitlines(keepends=True), {}
    for line, *edit in edits:
        wanted.setdefault(line, []).append(edit)
    for line, changes in wanted.items():
        if not 0 < line <= len(lines):
            raise ValueError(f"there is no line {line}")
        if any(text is None for *_, text in changes):
            lines[line - 1] = b""
            continue
        for first, last, text in sorted(changes, reverse=True):
            at = [m.span() for m in _TOKEN.finditer(lines[line - 1])]
            if last > len(at) or first > len(at):
                raise ValueError(f"line {line} has no token {last}")
            low = at[first][0] if first < len(at) else at[-1][1]
            high = at[last - 1][1] if last > first else low
            put = text.encode() if last > first else text.encode() + b" " if first < len(at) else b" " + text.encode()
            lines[line - 1] = lines[line - 1][:low] + put + lines[line - 1][high:]
    return b"".join(lines)


def line_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """label_path, line_no, first, last, text: what turns the lines of ``before`` into those of
    ``after`` (both label_path, line_no, class_id, attrs): classes, attributes, lines that went."""
    keys = ["label_path", "line_no"]
    old = before.select(*keys, F.col("class_id").alias("c"), F.col("attrs").alias("a"), *([F.split(F.trim("source_line"), r"\s+").alias("t")] if "source_line" in before.columns else [F.lit(None).cast("array<string>").alias("t")]))
    new = after.select(*keys, F.col("class_id").alias("d"), F.col("attrs").alias("b"), F.lit(True).alias("there"))
    both = old.join(new, keys, "left")
    n = F.coalesce(F.size("a"), F.lit(0))
    # An empty block of attributes is a block: its count stands after the class.
    bare = (n == 0) & ~F.coalesce((F.get("t", F.lit(1)).try_cast("double") == 0) & (F.size("t") >= 6), F.lit(False))
    edit = lambda first, last, text: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), text.cast("string").alias("text"))
    zero, one = F.lit(0), F.lit(1)
    head = F.array_join(F.concat(F.array(F.size("b").cast("string")), F.transform("b", lambda x: number(x))), " ")
    gone = F.when(F.col("there").isNull(), edit(zero, one, F.lit(None)))
    moved = F.when(F.col("there") & (F.col("c") != F.col("d")), edit(zero, one, F.col("d")))
    changed = F.col("there") & (F.size("b") > 0) & ~F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    attrs = F.when(changed, edit(one, F.when(bare, one).otherwise(n + 2), head))
    return both.select(*keys, F.explode(F.array_compact(F.array(gone, moved, attrs))).alias("e")).select(*keys, "e.*")


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _put(path: str, data: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)


def _fresh(path: str, name: str) -> str:
    return f"{path}.{name}.new"


class Rewrite:
    """One journal: ``prepare``, ``commit``, ``replace`` and ``finish`` in this order."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None):
        self.spark, self.name = spark, name or uuid.uuid4().hex
        self.journal = os.path.join(os.path.abspath(root), JOURNALS, self.name)
        self.root = os.path.abspath(root)

    def _uri(self, part: str) -> str:
        return f"file://{self.journal}/{part}"

    def plan(self, edits: DataFrame, texts: dict[str, str] | None = None) -> None:
        """``edits`` as of ``line_edits``; ``texts`` are whole small files below the root."""
        os.makedirs(self.journal, exist_ok=True)
        each = F.struct("line_no", "first", "last", "text")
        rows = edits.withColumn("label_path", local_path(F.col("label_path"))).groupBy("label_path").agg(F.array_sort(F.collect_list(each)).alias("edits"))
        _put(os.path.join(self.journal, "texts.json"), json.dumps(texts or {}).encode())
        rows.write.mode("overwrite").parquet(self._uri("plan"))

    def _over(self, rows: DataFrame, path: Column, work: Callable, schema: str) -> DataFrame:
        return rows.repartition(tasks_of(self.spark), path).mapInArrow(work, schema)

    def prepare(self) -> None:
        name = self.name

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for path, edits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with open(path, "rb") as source:
                        data = source.read()
                    changed = edited(data, [(e["line_no"], e["first"], e["last"], e["text"]) for e in edits])
                    _put(_fresh(path, name), changed)
                    shutil.copymode(path, _fresh(path, name))
                    out.append((path, _digest(data), _digest(changed), len(edits)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "old", "new", "edits"])

        rows = self.spark.read.schema(EDITS).parquet(self._uri("plan"))
        self._over(rows, F.col("label_path"), work, _PREPARED).write.mode("overwrite").parquet(self._uri("prepared"))

    @property
    def committed(self) -> bool:
        return os.path.exists(os.path.join(self.journal, "COMMIT"))

    def commit(self) -> None:
        _put(os.path.join(self.journal, "COMMIT"), b"")

    def prepared(self) -> DataFrame:
        return self.spark.read.schema(_PREPARED).parquet(self._uri("prepared"))

    def replace(self) -> int:
        """Puts all files in place that are not there yet; how many there are."""
        name = self.name

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = batch.column(0).to_pylist()
                for path, old, new in zip(paths, *(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
                    with open(path, "rb") as source:
                        now = _digest(source.read())
                    if now not in (old, new):
                        raise RuntimeError(f"{path} has changed since the rewrite was planned")
                    if now == old and os.path.exists(_fresh(path, name)):
                        os.replace(_fresh(path, name), path)
                yield pa.RecordBatch.from_arrays([pa.array(paths)], ["path"])

        count = self._over(self.prepared(), F.col("path"), work, "path string").count()
        with open(os.path.join(self.journal, "texts.json"), encoding="utf-8") as f:
            for place, text in json.load(f).items():
                _put(os.path.join(self.root, place), text.encode())
        return count

    def roll_back(self) -> None:
        """Takes away what was prepared; nothing of the dataset has changed."""
        name = self.name

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    if os.path.exists(_fresh(path, name)):
                        os.remove(_fresh(path, name))
                yield batch.select(["label_path"])

        if os.path.exists(os.path.join(self.journal, "plan/_SUCCESS")):
            self._over(self.spark.read.schema(EDITS).parquet(self._uri("plan")).select("label_path"), F.col("label_path"), work, "label_path string").count()
        self.finish()

    def finish(self) -> None:
        shutil.rmtree(self.journal, ignore_errors=True)


def unfinished(root: str) -> list[str]:
    folder = os.path.join(os.path.abspath(root), JOURNALS)
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def recover(spark: SparkSession, root: str) -> dict[str, str]:
    """Ends every rewrite that was cut short: completed if it was committed, else undone."""
    done = {}
    for name in unfinished(root):
        rewrite = Rewrite(spark, root, name)
        if rewrite.committed:
            rewrite.replace()
            rewrite.finish()
            done[name] = "completed"
        else:
            rewrite.roll_back()
            done[name] = "undone"
    return done


def rewrite(spark: SparkSession, root: str, edits: DataFrame, texts: dict[str, str] | None = None) -> int:
    """Does ``edits`` to the label files under ``root``; how many files changed."""
    if unfinished(root):
        raise RuntimeError(f"a rewrite of {root} was cut short: recover it first")
    one = Rewrite(spark, root)
    one.plan(edits, texts)
    one.prepare()
    one.commit()
    count = one.replace()
    one.finish()
    return count
