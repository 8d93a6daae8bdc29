"""Files where they lie: listed, measured and read by tasks, under all the names they have.

Spark's own readers leave out names that begin with ``_`` or ``.`` and empty files, and read whole
files.  These do neither: folders are listed round by round (each round is the folders that the one
before found), names are handed on in batches while a folder is still being listed, and a file is
read as far as the caller asks.  A store that only Spark can open is left to Spark's readers.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..store import stored

#: Names, and bytes of contents, that are handed on at a time.
NAMES, BYTES = 10_000, 8 << 20
#: What is read of a file first, and at a time further on.
HEAD, BLOCK = 64 << 10, 4 << 10
_REMOTE = r"^(hdfs|s3|s3a|gs):/"


def plain(path: str) -> str:
    """The path of a mounted file, or the URI of another."""
    return os.path.abspath(re.sub("^file:/+", "/", path)) if re.match("^file:/|^[^:]*$|^/", path) else re.sub("^s3a:", "s3:", path)


def is_mounted(path: str) -> bool:
    return path.startswith("/")


def is_open(path: str) -> bool:
    """Whether tasks can open a path themselves."""
    return is_mounted(plain(path)) or bool(re.match(_REMOTE, path))


def _remote(path: str):
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    return files, place, path[: len(path.rstrip("/")) - len(place.rstrip("/"))]


def entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder to look into) of what a folder holds, one by one.  Links to
    folders are not followed."""
    if is_mounted(folder):
        with os.scandir(folder) as found:
            for x in found:
                deeper = x.is_dir(follow_symlinks=False)
                if deeper or not x.is_dir():
                    yield x.path, deeper
        return
    from pyarrow import fs

    files, place, head = _remote(folder)
    for x in files.get_file_info(fs.FileSelector(place)):
        yield head + x.path, x.type == fs.FileType.Directory


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "folder"])
    rows: list[tuple[str, bool]] = []
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            for x in entries(folder):
                rows.append(x)
                if len(rows) == NAMES:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def tasks_of(spark: SparkSession, most: int | None = None) -> int:
    """Into how many tasks names are dealt; said outright, because names are so few bytes that
    adaptive execution would put them all into one."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return n if most is None else max(1, min(n, most))


def walk(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path of every file under a folder, whatever it is called; empty where there is no folder."""
    root = plain(root)
    if is_mounted(root) and not os.path.isdir(root):
        return spark.createDataFrame([], "path string")
    frontier, count, found = spark.createDataFrame([(root,)], "path string"), 1, []
    while count:
        level = stored(frontier.repartition(tasks_of(spark, count), "path").mapInArrow(_listed, "path string, folder boolean"), "listing")
        found.append(level.where("NOT folder").select("path"))
        frontier = level.where("folder").select("path")
        count = frontier.count() if recursive else 0
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


class Source:
    """A file read at places: its first ``HEAD`` bytes at once, then blocks where they are asked for."""

    def __init__(self, path: str, open_: Callable | None = None):
        if open_ is None and not is_mounted(path):
            files, place, _ = _remote(path)
            open_ = lambda _: files.open_input_file(place)
        self.file = open_(path) if open_ else open(path, "rb", buffering=0)  # noqa: SIM115
        self.file.seek(0, 2)
        self.size = self.file.tell()
        self.start, self.held = 0, b""
        self.fill(0, HEAD)

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def fill(self, at: int, n: int) -> None:
        self.file.seek(at)
        parts, left = [], min(n, max(self.size - at, 0))
        while left > 0 and (part := self.file.read(left)):
            parts.append(part)
            left -= len(part)
        self.start, self.held = at, b"".join(parts)

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from a place on, fewer where the file ends."""
        n = max(0, min(n, self.size - place))
        if not self.start <= place <= place + n <= self.start + len(self.held):
            self.fill(place, max(n, BLOCK))
        return self.held[place - self.start : place - self.start + n]

    def blocks(self, place: int = 0, n: int = 1 << 20) -> Iterator[bytes]:
        while place < self.size:
            self.fill(place, n)
            if not self.held:
                return
            place += len(self.held)
            yield self.held


def read_each(files: DataFrame, path_col: str, adds: str, read: Callable[[Source], tuple], missing: tuple | None = None) -> DataFrame:
    """``files`` with the columns ``adds`` that ``read`` takes from each open file; where it can't be
    opened, those of ``missing``, or an error.  Tasks open the files, each a share of the names."""
    spark = files.sparkSession
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, {adds}"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    at, width = files.columns.index(path_col), len(files.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, size, rows = 0, 0, []

            def made(high: int, low: int, rows: list) -> pa.RecordBatch:
                own = [batch.column(k).slice(low, high - low) for k in range(width)]
                new = [pa.array([r[k] for r in rows], arrow.field(width + k).type) for k in range(len(arrow) - width)]
                return pa.RecordBatch.from_arrays(own + new, schema=arrow)

            for n, path in enumerate(batch.column(at).to_pylist()):
                try:
                    with Source(plain(path)) as source:
                        rows.append(read(source))
                except OSError:
                    if missing is None:
                        raise
                    rows.append(missing)
                size += sum(len(v) for v in rows[-1] if isinstance(v, (bytes, str)))
                if size > BYTES:
                    yield made(n + 1, low, rows)
                    low, size, rows = n + 1, 0, []
            if rows:
                yield made(batch.num_rows, low, rows)

    return files.repartition(tasks_of(spark), path_col).mapInArrow(run, schema)


def read_texts(files: DataFrame, path_col: str = "path", name: str = "value") -> DataFrame:
    """The files with their whole texts."""
    return read_each(files, path_col, f"{name} string", lambda s: (b"".join(s.blocks()).decode(errors="replace"),))


def read_contents(files: DataFrame, path_col: str = "path", name: str = "content") -> DataFrame:
    return read_each(files, path_col, f"{name} binary", lambda s: (b"".join(s.blocks()),))


def with_sizes(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The files with their sizes, of which nothing is read."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    names, at = [*files.columns, "bytes"], files.columns.index(path_col)

    def run(batches):
        for batch in batches:
            sizes = pa.array(map(_size, map(plain, batch.column(at).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], names)

    return files.repartition(tasks_of(files.sparkSession), path_col).mapInArrow(run, f"{kinds}, bytes long")


def _size(path: str) -> int:
    if is_mounted(path):
        return os.stat(path).st_size
    files, place, _ = _remote(path)
    return files.get_file_info(place).size


def with_digests(files: DataFrame, path_col: str = "path", algorithm: str = "sha256") -> DataFrame:
    """The files with digests of their contents, read block by block."""
    hashlib.new(algorithm)  # an unknown name is an error here

    def digest(source: Source) -> tuple:
        total = hashlib.new(algorithm)
        for block in source.blocks():
            total.update(block)
        return (total.hexdigest(),)

    return read_each(files, path_col, "digest string", digest)


def read_list(spark: SparkSession, paths: list[str], root: str | None = None) -> DataFrame:
    """file_no, line_no, name, path of every line that is not blank of text files, in their order
    and with repeats; a name that is no whole path lies under ``root``, if that is given."""

    def lines(batches):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(path, encoding="utf-8") as text:
                    rows = []
                    for n, line in enumerate(text):
                        if name := line.strip():
                            whole = name if root is None or os.path.isabs(name) or "://" in name else os.path.join(root, name)
                            rows.append((number, n, name, os.path.normpath(whole) if root and "://" not in whole else whole))
                        if len(rows) == NAMES:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    names = ["file_no", "line_no", "name", "path"]
    given = spark.createDataFrame([(n, plain(p)) for n, p in enumerate(paths)], "file_no long, path string")
    return given.repartition(tasks_of(spark, len(paths)), "path").mapInArrow(lines, "file_no long, line_no long, name string, path string")
