"""Pictures written anew with values of 8 bits, by the tasks that read them."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import places
from ..sources.images import tiff_directories
from ..sources.masks import png_pixels

#: PNG colour types by the samples of a pixel.
COLOUR_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
#: TIFF compressions that are read here (none, and two numbers for deflate).
STORED, DEFLATED = 1, (8, 32946)


def stretched(values: np.ndarray, stretch: bool = True, value_range: tuple[float, float] | None = None, preserve_zero: bool = True) -> np.ndarray:
    """``images.to_uint8`` for the pixels of one picture that a task holds."""
    if values.dtype == np.uint8:
        return values
    source, out = values.astype(np.float64), np.zeros(values.shape, np.uint8)
    counts = np.isfinite(source)
    if not stretch:
        out[counts] = np.rint(np.clip(source[counts], 0, 255))
        return out
    if preserve_zero:
        counts &= source != 0
    if counts.any():
        low, high = value_range or (source[counts].min(), source[counts].max())
        least, steps = (1, 254) if preserve_zero else (0, 255)
        out[counts] = 255 if low == high else np.rint(least + (np.clip(source[counts], low, high) - low) / (high - low) * steps)
    return out


def png(values: np.ndarray) -> bytes:
    """A PNG of height x width x samples of 8 bits."""
    values = values if values.ndim == 3 else values[:, :, None]
    height, width, samples = values.shape
    lines = np.zeros((height, 1 + width * samples), np.uint8)
    lines[:, 1:] = values.reshape(height, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[samples], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def tiff_pixels(source: places.Source) -> np.ndarray:
    """height x width x samples of the first picture of a TIFF in strips, stored or deflated."""
    tags = next(tiff_directories(source), {})
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, samples, packing = one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(259, STORED)
    kind = {(1, 1): "u1", (8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4"}.get((bits, one(339, 1)))
    if kind is None or packing not in (STORED, *DEFLATED) or 273 not in tags or one(317, 1) != 1 or one(284, 1) != 1:
        raise ValueError("a TIFF whose pixels are not read: tiles, another compression, a predictor or planes")
    strips = (source.at(at, n) for at, n in zip(tags[273], tags[279], strict=True))
    data = b"".join(s if packing == STORED else zlib.decompress(s) for s in strips)
    if bits == 1:
        row = (width * samples + 7) // 8
        lines = np.unpackbits(np.frombuffer(data, np.uint8)[: height * row].reshape(height, row), axis=1)[:, : width * samples]
        return (lines if one(262, 1) else 1 - lines).reshape(height, width, samples).astype(bool)
    order = "<" if source.at(0, 2) == b"II" else ">"
    return np.frombuffer(data, order + kind)[: height * width * samples].reshape(height, width, samples)


def pixels(source: places.Source) -> np.ndarray:
    """Of a PNG that is not interlaced, or of a TIFF in strips."""
    first = source.at(0, 26)
    if first[:2] in (b"II", b"MM"):
        return tiff_pixels(source)
    values = png_pixels(b"".join(source.blocks()))
    return values.astype(bool) if first[24] == 1 else values


def existing(plan: DataFrame) -> DataFrame:
    """``target`` of the rows whose target is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([os.path.exists(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    return plan.select("target").mapInArrow(run, "target string")


def write_uint8(plan: DataFrame, overwrite: bool = False, **options) -> None:
    """Writes ``path`` to ``target`` for each row of ``plan`` (path, target, dtype): pictures of 8 bits are copied,
    others stretched and written as PNG.  Targets that coincide (in any case of letters), that are
    there already and may not be replaced, and pictures without a readable header are errors before
    anything is written.  Each file is put in place by renaming, so that a repeated task does no harm."""
    for found, what in (
        (plan.where("dtype IS NULL").select("path"), "no header can be read of"),
        (plan.groupBy(F.lower("target").alias("target")).count().where("count > 1").select("target"), "several pictures would become"),
    ):
        if names := sorted(r[0] for r in found.limit(5).collect()):
            raise ValueError(f"{what} {', '.join(names)}")
    if not overwrite and (names := sorted(r[0] for r in existing(plan).limit(5).collect())):
        raise FileExistsError(f"there already: {', '.join(names)}; overwrite=True replaces them")

    def write(rows) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(r.target), exist_ok=True)
            part = f"{r.target}.{uuid.uuid4().hex}.part"
            with places.Source(places.plain(r.path)) as source:
                blocks = source.blocks() if r.dtype == "uint8" else [png(stretched(pixels(source), **options))]
                with open(part, "wb") as out:
                    out.writelines(blocks)
            if r.dtype == "uint8" and places.is_mounted(r.path):
                shutil.copystat(places.plain(r.path), part)
            os.replace(part, r.target)

    plan.select("path", "target", "dtype").repartition(places.tasks_of(plan.sparkSession), "path").foreachPartition(write)
