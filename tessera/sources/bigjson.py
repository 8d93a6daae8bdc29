"""One large JSON document read by many tasks.

A document's members are containers (``"images": [{...}, ...]`` or ``"imgs": {"1": {...}, ...}``), and their
elements are what a reader wants.  The file is cut into byte ranges wherever they fall.  A first job reads each
range once and says, for both cases (it begins inside a string or not), whether it ends inside one and how much
deeper it ends.  Running over these few numbers gives each range's true beginning, with which a second
job finds the elements that begin in each range, and reads on to the end of the last one.

Whether a first byte is escaped is seen from the backslashes before it.  Bytes below 128 are never part of
another character in UTF-8, so that ranges may cut characters.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored
from .places import Source, plain

BYTES = 32 << 20
QUOTE, BACKSLASH, OPEN, CLOSE = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]"))
#: Members of a document, which have names of their own and are few.
MEMBERS = 10_000
_FOUND = "at long, deep int, name string, value string, end long"


def _escaped(source: Source, at: int) -> bool:
    """Whether the byte at a place follows an odd number of backslashes."""
    n = 0
    while at - n > 0 and source.at(at - n - 1, 1)[0] == BACKSLASH:
        n += 1
    return n % 2 == 1


@dataclass
class Scan:
    """Brackets of a piece of text that stand outside strings, and the state at its end."""

    places: np.ndarray
    steps: np.ndarray
    inside: bool
    escaped: bool

    @classmethod
    def of(cls, data: bytes, inside: bool, escaped: bool) -> Scan:
        code = np.frombuffer(data, np.uint8)
        slash = code == BACKSLASH
        # How many backslashes stand right before each byte, from the last byte that is none.
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(code))))
        before = np.arange(len(code)) - 1 - np.r_[-1, last[:-1]]
        before = np.where(np.r_[-1, last[:-1]] < 0, before + escaped, before) if len(code) else before
        quotes = np.flatnonzero((code == QUOTE) & (before % 2 == 0))
        kind = np.isin(code, OPEN).astype(np.int8) - np.isin(code, CLOSE).astype(np.int8)
        places = np.flatnonzero(kind)
        outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
        places = places[outside]
        end = bool(len(code)) and slash[-1] and (before[-1] + 1) % 2 == 1
        return cls(places, kind[places].astype(np.int64), bool((len(quotes) + inside) % 2), end if len(code) else escaped)


def _ranges(spark: SparkSession, size: int, width: int) -> DataFrame:
    count = max(1, -(-size // width))
    return spark.range(0, count, 1, count).select("id", (F.col("id") * width).alias("low"), F.least(F.col("id") * width + width, F.lit(size)).alias("high"))


def _name_before(source: Source, at: int) -> str | None:
    """The member's name before a place, where there is one."""
    reach = 1 << 10
    while True:
        low = max(0, at - reach)
        text = source.at(low, at - low).rstrip()
        if not text.endswith(b":"):
            return None
        text = text[:-1].rstrip()
        end = len(text) - 1
        k = text.rfind(b'"', 0, end)
        while k > 0 and (len(text[:k]) - len(text[:k].rstrip(b"\\"))) % 2:
            k = text.rfind(b'"', 0, k)
        if k >= 0 and (k > 0 or low == 0):
            return json.loads(text[k : end + 1])
        if low == 0:
            return None
        reach *= 4


def measured_range(source: Source, low: int, high: int) -> tuple:
    """Whether a range ends inside a string and how much deeper, if it begins outside; the same if
    it begins inside one."""
    escaped, data = _escaped(source, low), source.at(low, high - low)
    return tuple(x for inside in (False, True) for scan in [Scan.of(data, inside, escaped)] for x in (scan.inside, int(scan.steps.sum())))


def beginnings(measured: list[tuple]) -> tuple[dict[int, tuple[bool, int]], bool]:
    """Where each range (id, and what was measured) begins, and whether the document is whole."""
    begins, inside, depth = {}, False, 0
    for number, *cases in sorted(measured):
        begins[number] = (inside, depth)
        ends, deeper = cases[2:] if inside else cases[:2]
        inside, depth = ends, depth + deeper
    return begins, not inside and not depth


def _found(source: Source, low: int, high: int, inside: bool, depth: int) -> Iterator[tuple]:
    """(place, depth, name, text or null, end or null): members that begin or end in a range, and
    whole elements that begin in it."""
    data = source.at(low, high - low)
    scan = Scan.of(data, inside, _escaped(source, low))
    after = np.cumsum(scan.steps) + depth
    before = after - scan.steps
    for k in np.flatnonzero((scan.steps > 0) & (before == 1)).tolist():
        at = low + int(scan.places[k])
        yield at, 1, _name_before(source, at), None, None
    for k in np.flatnonzero((scan.steps < 0) & (after == 1)).tolist():
        yield low + int(scan.places[k]), 1, None, None, low + int(scan.places[k]) + 1
    starts, ends = (scan.places[x].tolist() for x in (np.flatnonzero((scan.steps > 0) & (before == 2)), np.flatnonzero((scan.steps < 0) & (after == 2))))
    if ends and (not starts or ends[0] < starts[0]):
        ends = ends[1:]  # of an element that began before
    for a, b in zip(starts, ends, strict=False):
        yield low + a, 2, _name_before(source, low + a), data[a : b + 1].decode(), low + b + 1
    if len(starts) > len(ends):
        parts, at, state, deep = [data[starts[-1] :]], high, (scan.inside, scan.escaped), int(after[-1])
        for block in source.blocks(high):
            more = Scan.of(block, *state)
            depths = np.cumsum(more.steps) + deep
            done = np.flatnonzero(depths == 2)
            if len(done):
                parts.append(block[: int(more.places[done[0]]) + 1])
                end = at + int(more.places[done[0]]) + 1
                yield low + starts[-1], 2, _name_before(source, low + starts[-1]), b"".join(parts).decode(), end
                return
            parts.append(block)
            at, state, deep = at + len(block), (more.inside, more.escaped), int(depths[-1]) if len(depths) else deep
        raise ValueError("the document ends within an element")


def members(spark: SparkSession, path: str, width: int = BYTES) -> DataFrame:
    """member, at, name, value of the elements (objects or arrays) of a document's members: where an
    element begins, its own name if the member is an object, and its text.

    A member without such elements has one row, its whole text, with null ``at``."""
    path = plain(path)
    size = os.path.getsize(path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Source(path) as source:
                    rows.append((k, *measured_range(source, low, high)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "in0", "d0", "in1", "d1"])

    ranges = _ranges(spark, size, width)
    measured = ranges.mapInArrow(measure, "id long, in0 boolean, d0 long, in1 boolean, d1 long").collect()  # one for each range
    begins, whole_document = beginnings([tuple(r) for r in measured])
    if not whole_document:
        raise ValueError(f"{path} is no whole JSON document")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["at", "deep", "name", "value", "end"])
        for batch in batches:
            for k, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with Source(path) as source:
                    for row in _found(source, low, high, *begins[k]):
                        rows.append(row)
                        held += len(row[3] or "")
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    found = stored(ranges.mapInArrow(find, _FOUND), "json-elements")
    marks = found.where("deep = 1").orderBy("at").limit(2 * MEMBERS + 1).collect()
    if len(marks) > 2 * MEMBERS:
        raise ValueError(f"{path} has more than {MEMBERS} members")
    spans = [(a.name, a.at, b.end) for a, b in zip(marks[::2], marks[1::2], strict=True)]
    elements = found.where("deep = 2")
    member = F.coalesce(*[F.when((F.col("at") > low) & (F.col("at") < high), F.lit(name)) for name, low, high in spans]) if spans else F.lit(None).cast("string")
    elements = elements.select(member.alias("member"), "at", "name", "value")
    full = {r.member for r in elements.select("member").distinct().collect()}  # at most as many as members
    rest = [(n, low, high) for n, low, high in spans if n not in full]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with Source(path) as source:
                texts = [source.at(low, high - low).decode() for low, high in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None] * len(texts), pa.int64()), pa.array([None] * len(texts), pa.string()), pa.array(texts, pa.string())], ["member", "at", "name", "value"])

    if not rest:
        return elements
    plain_ones = spark.createDataFrame(rest, "member string, low long, high long").mapInArrow(whole, "member string, at long, name string, value string")
    return elements.unionByName(plain_ones)
