"""Very many small files from one table, written in two jobs whatever their number.

Rows are dealt out by ranges of (file, order), so that a file of very many lines is several tasks'
work and a task has runs of whole files.  Each task writes its run of a file as a part under a name that no
other attempt has, and says so in a manifest, which is a table.  A second job puts the files together:
dealt by file, it streams the parts of each in their order behind a heading into place, by renaming.
Neither names nor lines pass through the driver, and what tasks that failed have left is in no manifest and goes
with the folder of parts.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import release, stored

_PART = "file string, place long, part string, lines long, bytes long"


def write_groups(rows: DataFrame, root: str, file: Column, order: Sequence[str], line: Column, head: str = "", end: str = "\n") -> DataFrame:
    """Files under ``root``, each with ``head`` and its lines in order, every line followed by
    ``end``; ``file`` is the path below ``root`` of the file to which a row belongs.  Returns the
    manifest: file, lines, bytes."""
    root = os.path.abspath(root)
    parts = os.path.join(root, f".parts-{uuid.uuid4().hex}")
    named = rows.select(file.alias("file"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], line.alias("line")).where("file IS NOT NULL")
    given = stored(named, "groups")  # read twice: bounds of the ranges are drawn from it
    keys = ["file", *[f"o{n}" for n in range(len(order))]]
    dealt = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select("file", "line", F.spark_partition_id().cast("long").alias("place"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part for each file of the task; parts lie in folders of a thousand."""
        own, count, now, out, state = uuid.uuid4().hex, 0, None, None, [0, 0]
        done: list[tuple] = []
        for batch in batches:
            for name, text, place in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if name != now:
                    if out:
                        out.close()
                        done.append((now, at, path, *state))
                    folder = os.path.join(parts, own, str(count // 1000))
                    os.makedirs(folder, exist_ok=True)
                    path, count, now, at, state = os.path.join(folder, str(count)), count + 1, name, place, [0, 0]
                    out = open(path, "wb")  # noqa: SIM115
                state[0] += 1
                state[1] += out.write(((text or "") + end).encode())
            if len(done) > 10_000:
                yield _batch(done, _PART_SCHEMA)
                done = []
        if out:
            out.close()
            done.append((now, at, path, *state))
        if done:
            yield _batch(done, _PART_SCHEMA)

    manifest = stored(dealt.mapInArrow(write, _PART), "manifest")
    release(given)
    # As many parts as there are ranges, at most, and one for nearly all.
    whole = manifest.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(root, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                made = f"{target}.{uuid.uuid4().hex}.part"
                with open(made, "wb") as out:
                    out.write(head.encode())
                    for p in listed:
                        with open(p["part"], "rb") as source:
                            shutil.copyfileobj(source, out, 1 << 20)
                os.replace(made, target)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 2, 3)], ["file", "lines", "bytes"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    out = stored(whole.repartition(n, "file").mapInArrow(join, "file string, lines long, bytes long"), "written")
    release(manifest)
    shutil.rmtree(parts, ignore_errors=True)
    return out


_PART_SCHEMA = pa.schema([("file", pa.string()), ("place", pa.int64()), ("part", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
