"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds P[i] = sum of (c_j + 1) B^j over its first i code points, modulo a
prime.  (P[j] - P[i]) B^-i is then the hash of the span from i to j alone, wherever it stands: equality of
any two spans is one comparison, and as equality of extensions is monotone, the longest common
extension of two places is found by binary search.  Two bases make 62 bits.

A fingerprint holds a sample of the array, which is enough for the same search: the length, the hash of
the whole text, and the hashes of the first and of the last i * step code points, where the step is the
smallest power of two that gives at most ``SAMPLES`` of each.  Texts of any lengths share the multiples of the
larger step.  The likeness of two fingerprints is the share of the longer text that equal spans cover: the
longest common sampled beginning and end, and blocks between them, whose hashes are differences of samples.
Equal texts have equal fingerprints and likeness 1.

Documents meet the one that follows them without any ordering in one place: bounds are drawn from a sample
of the keys (id, digest, row), rows are dealt out by them, and the row that a bound names also goes to the part
that ends there, as the next of its last row.  The first row of all does so for the last part.

Scale: texts are read once for the keys (digests, in the JVM) and once to be dealt out; they travel once,
compressed.  A part holds about as many rows whatever the ids are, also where many rows are equal.  A
task works on about a million code points at a time; a longer text takes 16 bytes for each of its own and
its neighbour's.  The driver holds the bounds, some tens for each part.

Defined results: null text is empty, and its likeness to an empty one is 1; null ids come last; rows of one
id are ordered by digest, equal rows by their place in the table; the only row is its own next; an empty
table gives an empty result; other columns are ignored.  Ids are whole numbers.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import text_or_empty

PRIME = (1 << 31) - 1
BASES = (1_000_003_711, 1_618_033_989)
SAMPLES, BLOCK = 32, 8
#: Code points that are hashed at a time; parts for each shuffle partition; keys drawn for each part.
CHUNK, PARTS, DRAWN = 1 << 20, 3, 32
_KEY = ["none", "down", "digest", "row"]


class _Powers:
    """B^i and B^-i for i below CHUNK as tables, beyond by their products."""

    def __init__(self, base: int):
        self.base = base
        self.tables = [self._table(b) for b in (base, pow(base, -1, PRIME))]

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out = np.ones(CHUNK, np.int64)
        n = 1
        while n < CHUNK:
            out[n : 2 * n] = out[:n] * pow(base, n, PRIME) % PRIME
            n *= 2
        return out

    def at(self, i: np.ndarray, inverse: bool = False) -> np.ndarray:
        high, low = np.divmod(i, CHUNK)
        out = self.tables[inverse][low]
        for h in np.unique(high[high > 0]).tolist():
            more = pow(self.base, (-1 if inverse else 1) * h * CHUNK, PRIME)
            out = np.where(high == h, out * more % PRIME, out)
        return out


_powers: dict[int, _Powers] = {}


def powers(base: int) -> _Powers:
    if base not in _powers:
        _powers[base] = _Powers(base)
    return _powers[base]


class Prefixes:
    """Prefix arrays of texts, one after another."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.arrays = [self._prefixes(codes, powers(b)) for b in BASES]

    @staticmethod
    def _prefixes(codes: np.ndarray, power: _Powers) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.int64)
        for low in range(0, len(codes), CHUNK):
            part = codes[low : low + CHUNK].astype(np.int64) + 1
            sums = np.cumsum(part * power.tables[0][: len(part)] % PRIME) % PRIME
            out[low + 1 : low + 1 + len(part)] = (out[low] + sums * pow(power.base, low, PRIME)) % PRIME
        return out

    def spans(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the spans from ``low`` to ``high`` of the texts with these numbers."""
        a, b = self.starts[text] + low, self.starts[text] + high
        array = self.arrays[which]
        return (array[b] - array[a]) % PRIME * powers(BASES[which]).at(a, inverse=True) % PRIME

    def equal(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of so many code points at i of text a and at j of text b are equal."""
        return np.logical_and.reduce([self.spans(a, i, i + size, k) == self.spans(b, j, j + size, k) for k in range(len(BASES))])

    def common(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions: how far the texts agree from i of a and j of b on."""
        low, high = np.zeros_like(i), np.minimum(self.sizes[a] - i, self.sizes[b] - j)
        while np.any(low < high):
            middle = (low + high + 1) // 2
            same = self.equal(a, i, b, j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def fingerprints(self, samples: int = SAMPLES) -> list[Fingerprint]:
        n = self.sizes
        step = np.ones_like(n)
        while np.any(wide := n // step > samples):
            step[wide] *= 2
        count = n // step
        every = np.arange(len(n))
        whole = [self.spans(every, np.zeros_like(n), n, k) for k in range(len(BASES))]
        each, ends = np.repeat(every, count), np.cumsum(count)
        size = (np.arange(len(each)) - np.repeat(ends - count, count) + 1) * step[each]
        front = self.spans(each, np.zeros_like(size), size, 0).tolist()
        back = self.spans(each, n[each] - size, n[each], 0).tolist()
        joined = [(a << 32) + b for a, b in zip(*(w.tolist() for w in whole), strict=True)]
        return [Fingerprint(n, w, s, front[e - c : e], back[e - c : e]) for n, w, s, c, e in zip(n.tolist(), joined, step.tolist(), count.tolist(), ends.tolist(), strict=True)]


@dataclass
class Fingerprint:
    """A sampled prefix array: hashes of the first and of the last 1, 2, ... steps."""

    size: int
    whole: int
    step: int
    front: list[int]
    back: list[int]

    def __str__(self) -> str:
        listed = lambda xs: np.array(xs, ">u4").tobytes().hex()
        return f"{self.size}-{self.whole:016x}-{listed(self.front)}-{listed(self.back)}"

    @classmethod
    def parse(cls, text: str, samples: int = SAMPLES) -> Fingerprint:
        size, whole, front, back = text.split("-")
        step = 1
        while int(size) // step > samples:
            step *= 2
        listed = lambda x: np.frombuffer(bytes.fromhex(x), ">u4").tolist()
        return cls(int(size), int(whole, 16), step, listed(front), listed(back))


def _agreeing(a: list[int], b: list[int], step_a: int, step_b: int) -> int:
    """Code points up to which the samples agree, by binary search at multiples of the larger step."""
    step = max(step_a, step_b)
    i, j = step // step_a, step // step_b
    last = min(len(a) // i, len(b) // j)
    return step * bisect.bisect_left(range(1, last + 1), True, key=lambda k: a[k * i - 1] != b[k * j - 1])


def _same_blocks(a: list[int], b: list[int], step_a: int, step_b: int) -> list[int]:
    """Blocks of the larger step whose spans are equal, as differences of the samples tell."""
    step = max(step_a, step_b)
    x, y = (np.array([0, *v[step // own - 1 :: step // own]], np.int64) for v, own in ((a, step_a), (b, step_b)))
    last = min(len(x), len(y))
    return np.flatnonzero((np.diff(x[:last]) - np.diff(y[:last])) % PRIME == 0).tolist()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text that equal spans cover: the common beginning and end and, between
    them, blocks (of ``BLOCK`` code points at least) equal at one distance from either end."""
    if a.size == b.size and a.whole == b.whole:
        return 1.0
    step = max(a.step, b.step)
    front, back = (_agreeing(x, y, a.step, b.step) for x, y in ((a.front, b.front), (a.back, b.back)))
    spans = [(0, front), (a.size - back, a.size)]
    if step >= BLOCK:
        spans += [(k * step, k * step + step) for k in _same_blocks(a.front, b.front, a.step, b.step)]
        spans += [(a.size - k * step - step, a.size - k * step) for k in _same_blocks(a.back, b.back, a.step, b.step)]
    covered = upto = 0
    for low, high in sorted(spans):
        covered += max(0, high - max(low, upto))
        upto = max(upto, high)
    return min(covered, b.size) / max(a.size, b.size)


def edited(text: str, after: str) -> str:
    """The text, its last half replaced by as much of the beginning of the one after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _dealt(batches: Iterator[pa.RecordBatch], bounds: list[tuple], first: tuple) -> Iterator[pa.RecordBatch]:
    """Rows with their part and their text compressed; those that bounds name for two parts."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
        rows, part, guest = [], [], []
        for n, key in enumerate(keys):
            own = bisect.bisect_right(bounds, key)
            rows.append(n)
            part.append(own)
            guest.append(False)
            if key == first or own and bounds[own - 1] == key:
                rows.append(n)
                part.append(len(bounds) if key == first else own - 1)
                guest.append(True)
        take = pa.array(rows, pa.int32())
        data = [pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        out = [pa.array(part, pa.int32()), pa.array(guest), *(batch.column(c).take(take) for c in (*_KEY, "id")), pa.array(data, pa.binary()).take(take)]
        yield pa.RecordBatch.from_arrays(out, ["part", "guest", *_KEY, "id", "data"])


def _described(ids: list, texts: list[str]) -> dict:
    """All but the last of the texts, each of which the one after it follows."""
    n = len(texts) - 1
    changed = [edited(t, after) for t, after in zip(texts, texts[1:], strict=False)]
    arrays = Prefixes(texts + changed)
    prints = arrays.fingerprints()
    own, other, after = prints[:n], prints[n + 1 :], prints[1 : n + 1]
    number, zero = np.arange(n), np.zeros(n, np.int64)
    columns = {
        "id": ids[:n], "n_chars": [len(t) for t in texts[:n]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "fingerprint": [str(p) for p in own], "edited_fingerprint": [str(p) for p in other],
        "near_edited": [likeness(*x) for x in zip(own, other, strict=True)], "near_next": [likeness(*x) for x in zip(own, after, strict=True)],
        "common_edited": arrays.common(number, zero, number + n + 1, zero), "common_next": arrays.common(number, zero, number + 1, zero),
    }
    return columns


def _met(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, each part's guest at its end."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    ids, texts, size = [], [], 0
    made = lambda columns: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns.values(), schema, strict=True)], schema=schema)
    for batch in batches:
        for guest, one, data in zip(*(batch.column(c).to_pylist() for c in ("guest", "id")), batch.column("data").to_pylist(), strict=True):
            ids.append(one)
            texts.append(unpack(data).decode())
            size += len(texts[-1])
            if len(texts) > 1 and (guest or size > CHUNK):
                yield made(_described(ids, texts))
                ids, texts = ([], []) if guest else (ids[-1:], texts[-1:])
                size = sum(map(len, texts))
    if texts:
        raise RuntimeError("rows changed their places between two readings; store the table first")


def describe(docs: DataFrame, id_col="doc_id", text_col="text", parts: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    longest common beginnings common_edited and common_next in code points; one row for each."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    keys = given.withColumns({"none": F.col("id").isNull(), "down": F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit(0).cast("long")), "digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    kind = given.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
    first = keys.select(*_KEY).orderBy(*_KEY).first()
    if first is None:
        return spark.createDataFrame([], out)
    parts = parts or PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    of, drawn = 1 << 30, given.count()
    few = F.pmod(F.xxhash64("row"), F.lit(of)) < int(min(1.0, DRAWN * parts / drawn) * of)
    sample = sorted({tuple(r) for r in keys.where(few).select(*_KEY).collect()} - {tuple(first)})  # some tens for each part
    bounds = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    dealt = keys.select(*_KEY, "id", "text").mapInArrow(partial(_dealt, bounds=bounds, first=tuple(first)), f"part int, guest boolean, none boolean, down long, digest long, row long, id {kind}, data binary")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", *_KEY)
    return ordered.select("guest", "id", "data").mapInArrow(partial(_met, schema=to_arrow_schema(spark.createDataFrame([], out).schema)), out)
