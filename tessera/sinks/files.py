"""Copies, backups and lists of files; the executors do the copying.

Folders must be shared by all executors, like every output folder of a cluster.  A file is put
in place by renaming, so that a task that runs twice leaves whole files.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.labels import write_texts

GROUPS = ("quality", "stats", "vis", "evaluation", "dataset", "annotation", "conversion")  # fixed values


def local_path(path: Column) -> Column:
    """A path without the scheme that Spark's file sources put before it, and without the escapes
    that come with it; another path as it is."""
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return F.when(path.startswith("file:"), F.coalesce(F.try_url_decode(F.regexp_replace(plain, r"\+", "%2B")), plain)).otherwise(path)


def operation_dir(root: str, group: str, operation: str) -> str:
    """Where the results of a task go unless the caller says otherwise."""
    if group not in GROUPS:
        raise ValueError(f"unknown group {group!r}")
    return os.path.join(root, f"tessera_{group}", operation)


def copy_files(plan: DataFrame, overwrite: bool = True) -> None:
    """Copies ``source`` to ``target`` for each row; sources that do not exist are skipped."""

    def copy(rows):
        for r in rows:
            if not os.path.isfile(r.source) or (not overwrite and os.path.exists(r.target)):
                continue
            os.makedirs(os.path.dirname(r.target), exist_ok=True)
            part = f"{r.target}.{uuid.uuid4().hex}.part"
            shutil.copy2(r.source, part)
            os.replace(part, r.target)

    plan.select("source", "target").foreachPartition(copy)


def backup_plan(paths: DataFrame, root: str, folder: str | None = None, stamp: str | None = None) -> DataFrame:
    """source, target of the label files to save before an edit: each once, under its place in
    ``root``; files from elsewhere go under ``external``, equal names there get a number."""
    base = os.path.join(folder or os.path.join(root, "labels_backup"), stamp or datetime.now().strftime("%Y%m%d_%H%M%S_%f"))
    inside = os.path.abspath(root).rstrip("/") + "/"
    own = F.col("source").startswith(inside)
    rows = paths.select(local_path(F.col("label_path")).alias("source")).where("source IS NOT NULL").distinct()
    name = F.element_at(F.split("source", "/"), -1)
    rows = rows.withColumn("place", F.when(own, F.substr("source", F.lit(len(inside) + 1))).otherwise(F.concat(F.lit("external/"), name)))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("place").orderBy("source")) - 1)
    numbered = F.regexp_replace("place", r"(\.[^./]*)?$", "")
    target = F.when(F.col("again") == 0, F.col("place")).otherwise(F.concat(numbered, F.lit("_"), F.col("again").cast("string"), F.regexp_extract("place", r"(\.[^./]*)$", 1)))
    return rows.select("source", F.concat(F.lit(base + "/"), target).alias("target"))


def backup_splits(root: str, folder: str, splits: Sequence[str] = ("train", "val", "test")) -> list[str]:
    """Moves the existing split lists of ``root`` into one dated folder; returns what moved."""
    found = [p for s in splits if os.path.isfile(p := os.path.join(root, f"{s}.txt"))]
    if found:
        base = os.path.join(folder, datetime.now().strftime("%Y%m%d_%H%M%S_%f"))
        os.makedirs(base, exist_ok=True)
        for p in found:
            shutil.move(p, os.path.join(base, os.path.basename(p)))
    return found


def write_lines(lines: DataFrame, path: str, head: str = "", between: str = "\n", tail: str = "", last: str = "") -> None:
    """One text file of the rows of ``lines`` (one text column) in their order: Spark writes
    the parts, which are then put together as streams of bytes, so no row is held by the driver.

    ``between`` stands between rows, ``last`` after the last one if there is any; the file ends
    in ``tail``."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    try:
        lines.write.option("lineSep", between).text(f"file://{os.path.abspath(parts)}")
        sep = between.encode()
        with open(f"{parts}.one", "wb") as out:
            out.write(head.encode())
            first = True
            for name in sorted(n for n in os.listdir(parts) if n.startswith("part-")):
                left = os.path.getsize(os.path.join(parts, name)) - len(sep)
                if left < 0:
                    continue
                if not first:
                    out.write(sep)
                first = False
                with open(os.path.join(parts, name), "rb") as source:
                    while left > 0:
                        left -= out.write(source.read(min(left, 1 << 20)))
            out.write((tail if first else last + tail).encode())
        os.replace(f"{parts}.one", path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def write_splits(images: DataFrame, root: str, column: str = "file_name") -> None:
    """train.txt, val.txt and test.txt of the ``split`` column, names in order; lists of before
    are overwritten, see ``backup_splits``."""
    for split in ("train", "val", "test"):
        write_lines(images.where(F.col("split") == split).select(column).orderBy(column), os.path.join(root, f"{split}.txt"))


def fill_missing_labels(images: DataFrame, labelled: DataFrame, folder: str) -> int:
    """Writes an empty label file for each image that has none; how many."""
    lacking = images.select("image").distinct().join(labelled.select("image").distinct(), "image", "left_anti").withColumn("value", F.lit("")).persist()
    n = lacking.count()
    write_texts(lacking, folder)
    lacking.unpersist()
    return n
