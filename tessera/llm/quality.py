"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

All pairwise interactions of features are in the model, at a cost linear in the features by
the sum-of-squares identity.  Features are log word counts in ``BUCKETS`` hash buckets, of unit
length for each document, standardised statistics of the text's structure, and standardised
logarithms of numeric metadata columns that the caller names (never a label, language, source or id),
with a sign for those that are missing.

Fit: a sample of at most ``MAX_ROWS`` labelled documents outside the held-out fifth, the first by a
hash of their id; the sample's features (not its texts) come to the driver.  The model is a few
hundred kilobytes at any corpus size.  Scoring reads whole texts in Arrow batches and shuffles
nothing.

Defined results: null counts as empty and is scored by its statistics; several labels of an
id count by the largest; with no labels, or labels of one kind only, the score is their share
(0.5 without any); rows with the same id are scored apart; a metadata value that is null, no
number or below 0 is missing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import held_out

BUCKETS, FACTORS, MAX_ROWS, EPOCHS = 1 << 14, 8, 4000, 8
STATS = 13
CUT = 0.3


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket, value) of hashed words, sorted by owner, and statistics of each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    hashes, length, begins = tk.word_hashes(data, offsets)
    count = np.diff(begins)
    owner = np.repeat(np.arange(n), count)
    bucket = (hashes >> tk.U(20)) % tk.U(BUCKETS)
    key, times = np.unique(owner.astype(np.uint64) * tk.U(BUCKETS) + bucket, return_counts=True)
    own, bucket = (key // tk.U(BUCKETS)).astype(np.int64), (key % tk.U(BUCKETS)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(own, value**2, n))
    value = value / norm[own]

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    space = (data == 32) | ((data >= 9) & (data <= 13))
    lines = np.flatnonzero(data == 10)
    n_lines = np.bincount(np.searchsorted(offsets, lines, "right") - 1, minlength=n) + 1
    # Repeated lines: equal ends of prefix sums over words would miss punctuation, so by bytes.
    starts = np.unique(np.concatenate((offsets[:-1][size > 0], lines + 1)))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    prefix = np.concatenate(([0], np.cumsum(data.astype(tk.U) * tk.powers(tk.BASE, max(1, len(data)))[: len(data)], dtype=tk.U))).astype(tk.U)
    line = tk.mix((prefix[ends] - prefix[starts]) * tk.powers(tk.INVERSE, max(1, len(data)))[starts]) if len(starts) else np.zeros(0, tk.U)
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    pairs = np.unique(np.stack((line_owner.astype(tk.U), line)), axis=1) if len(line) else np.zeros((2, 0), tk.U)
    fresh = np.bincount(pairs[0].astype(np.int64), minlength=n)
    symbol = ~space & ~tk.IS_WORD[data] & ~((data >= 65) & (data <= 90)) & ~np.isin(data, np.frombuffer(b".,'\"", np.uint8))
    stats = np.stack((
        np.log1p(size), np.log1p(count), _share(np.bincount(owner, length, n), count),
        _share(total((data >= 48) & (data <= 57)), size), _share(total((data >= 65) & (data <= 90)), size),
        _share(total(symbol), size), _share(total(symbol), count), _share(total(space), size), _share(size, n_lines) ** 0.5,
        _share(np.bincount(own, minlength=n), count), _share(np.bincount(own, times**2, n) ** 0.5, count),
        1 - _share(fresh, np.bincount(line_owner, minlength=n)), _share(total((data == 46) | (data == 44)), count),
    ), axis=1)
    return own, bucket, value, stats


class Model:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, centre: np.ndarray, scale: np.ndarray, metadata: tuple[str, ...] = ()):
        self.bias, self.w, self.v, self.centre, self.scale, self.metadata = bias, w, v, centre, scale, metadata

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.scale, -4, 4) / 4

    def score(self, own, bucket, value, stats) -> np.ndarray:
        n, x = len(stats), self.standard(stats)
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        linear = self.bias + x @ ws + np.bincount(own, value * self.w[bucket], n)
        sums, squares = x @ vs, (x**2) @ (vs**2)
        for f in range(self.v.shape[1]):
            part = value * self.v[bucket, f]
            sums[:, f] += np.bincount(own, part, n)
            squares[:, f] += np.bincount(own, part**2, n)
        z = linear + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Stochastic gradients with per-weight step sizes; the order is fixed by the seed."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + stats.shape[1]
    scale = stats.std(axis=0)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors)), stats.mean(axis=0), np.where(scale > 0, scale, 1.0))
    dense = model.standard(stats)
    gw, gv, gb, rate, decay = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2, 0.1, 1e-4
    tail = np.arange(BUCKETS, size)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.concatenate((rows[i][0], tail)), np.concatenate((rows[i][1], dense[i]))
            v = model.v[at]
            vx = v * x[:, None]
            sums = vx.sum(axis=0)
            z = model.bias + model.w[at] @ x + 0.5 * (sums @ sums - (vx**2).sum())
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gb += error**2
            model.bias -= rate * error / gb**0.5
            g = error * x + decay * model.w[at]
            gw[at] += g**2
            model.w[at] -= rate * g / np.sqrt(gw[at])
            g = error * x[:, None] * (sums - vx) + decay * v
            gv[at] += g**2
            model.v[at] -= rate * g / np.sqrt(gv[at])
    return model


def about(batch: pa.RecordBatch) -> np.ndarray:
    """Statistics of the metadata of a batch: a logarithm and a sign of absence for each column."""
    given = [c for c in batch.schema.names if c.startswith("meta")]
    out = np.zeros((len(batch), 2 * len(given)))
    for n, c in enumerate(given):
        x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        known = np.isfinite(x) & (x >= 0)
        out[:, 2 * n], out[:, 2 * n + 1] = np.log1p(np.where(known, x, 0)), ~known
    return out


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, more, order = batch.column("label").to_numpy(zero_copy_only=False), about(batch), batch.column("order")
        for first, last, data, offsets in tk.slices(batch.column("text")):
            own, bucket, value, stats = features(data, offsets)
            stats = np.hstack((stats, more[first:last]))
            cut = np.searchsorted(own, np.arange(last - first + 1))
            lists = [pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            lists = [x.cast(pa.list_(x.type.value_type)) for x in lists]
            yield pa.RecordBatch.from_arrays([order[first:last], pa.array(label[first:last], pa.int32()), *lists, pa.array(list(stats), pa.list_(pa.float64()))], ["order", "label", "bucket", "value", "stats"])


def with_metadata(docs: DataFrame, metadata: tuple[str, ...]) -> list:
    """Columns meta0, meta1 ... as doubles."""
    return [F.col(c).cast("double").alias(f"meta{n}") for n, c in enumerate(metadata)]


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality", max_rows: int = MAX_ROWS, metadata: tuple[str, ...] = ()) -> Model | float:
    """The model, or the share of label 1 where there is nothing to tell apart.

    The sample is drawn among labelled ids that documents have; features of its rows are bounded
    in size, and at most ``max_rows`` of them are kept where an id has several rows."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(label_id))).groupBy(F.col(label_id).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    there = docs.select(F.col(id_col).alias("id"))
    known = known.join(there, F.col("id") == F.col("__id"), "left_semi").withColumn("order", F.xxhash64("__id", F.lit("quality")))
    known = known.orderBy("order", "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *with_metadata(docs, metadata)).join(F.broadcast(known), F.col("id") == F.col("__id"))
    sample = rows.drop("id", "__id").mapInArrow(extracted, "order long, label int, bucket array<int>, value array<float>, stats array<double>")
    sample = sample.orderBy("order", "label", F.xxhash64("bucket", "value", "stats")).limit(max_rows).toPandas()
    if len(set(sample["label"])) < 2:
        return float(sample["label"].mean()) if len(sample) else 0.5
    pairs = [(np.asarray(a, np.int64), np.asarray(b, np.float64)) for a, b in zip(sample["bucket"], sample["value"], strict=True)]
    stats = np.stack(sample["stats"].to_numpy())
    order = np.lexsort((*stats.T[::-1], sample["label"].to_numpy()))  # the same at any partitioning
    model = train([pairs[i] for i in order], stats[order], sample["label"].to_numpy()[order])
    model.metadata = metadata
    return model


def score(docs: DataFrame, model: Model | float, id_col="doc_id", text_col="text", cut: float = CUT) -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted."""
    metadata = () if isinstance(model, float) else model.metadata
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), *with_metadata(docs, metadata))

    def judge(batches):
        for batch in batches:
            out = np.full(len(batch), model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                more = about(batch)
                for first, last, data, offsets in tk.slices(batch.column("text")):
                    own, bucket, value, stats = features(data, offsets)
                    out[first:last] = model.score(own, bucket, value, np.hstack((stats, more[first:last])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
