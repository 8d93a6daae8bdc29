"""Label masks: pictures whose pixels are classes, read to outlines inside the tasks.

A mask is a PNG of grey values or palette places (1 to 16 bits) or of colours (RGB or RGBA; alpha does not
count).  A colour is one number, red, green and blue packed, and ``r,g,b`` in text; which values there are is
a dictionary over the whole corpus.  Connected areas of equal pixels are found from runs, and the outline
of each is followed along the edges of its runs; holes are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..store import stored
from . import places
from .labels import list_files, stem

#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Above all grey values: what marks a packed colour.
COLOUR = 1 << 24
AREAS = "width int, height int, areas array<struct<value:int,area:long,outline:array<int>>>"


def png_pixels(data: bytes) -> np.ndarray:
    """height x width x samples of a PNG that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("a mask is a PNG")
    at, head, packed = 8, None, []
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[9] not in SAMPLES or head[12]:
        raise ValueError("a mask is a PNG that is not interlaced")
    width, height, depth, samples = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], SAMPLES[head[9]]
    row, step = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, row + 1)
    lines = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        above = lines[y] = _unfiltered(raw[y, 0], raw[y, 1:], above, step)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * samples * depth].reshape(height, width * samples, depth)
        return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8).reshape(height, width, samples)
    values = lines.view(">u2").astype(np.uint16) if depth == 16 else lines
    return values.reshape(height, width, samples)


def _unfiltered(how: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a line from what its filter left of them."""
    if how == 0:
        return row
    if how == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if how == 2:
        return row + above
    left, corner, out = [0] * step, [0] * step, bytearray(len(row))
    for x, (value, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        k = x % step
        if how == 3:
            guess = left[k] + up >> 1
        else:
            a, b, c = abs(up - corner[k]), abs(left[k] - corner[k]), abs(left[k] + up - 2 * corner[k])
            guess = left[k] if a <= b and a <= c else up if b <= c else corner[k]
        out[x] = left[k] = value + guess & 255
        corner[k] = up
    return np.frombuffer(bytes(out), np.uint8)


def values_of(pixels: np.ndarray) -> np.ndarray:
    """One number for each pixel: the grey value, or the packed colour above ``COLOUR``."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int32)
    eight = (pixels >> 8 if pixels.dtype == np.uint16 else pixels).astype(np.int32)
    return COLOUR + (eight[:, :, 0] << 16) + (eight[:, :, 1] << 8) + eight[:, :, 2]


def parse_value(value) -> int:
    """The number of a grey value, of ``#rrggbb``, ``r,g,b`` or three numbers."""
    if isinstance(value, (tuple, list)):
        value = ",".join(map(str, value[:3]))
    text = str(value).strip()
    if text.startswith("#"):
        return COLOUR + int(text[1:7], 16)
    if "," not in text:
        return int(text)
    parts = [int(p) for p in text.strip("()[]").split(",")]
    if len(parts) != 3 or not all(0 <= p < 256 for p in parts):
        raise ValueError(f"a colour is #rrggbb or r,g,b: {value!r}")
    return COLOUR + (parts[0] << 16) + (parts[1] << 8) + parts[2]


def value_text(value: int) -> str:
    return str(value) if value < COLOUR else f"{value - COLOUR >> 16},{value >> 8 & 255},{value & 255}"


def labelled_runs(grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """top, left, right (exclusive), value and area number of the runs of equal pixels in rows.

    Runs that touch runs of their value above are given the smallest number among them until no
    number changes; an area's number is its first run's."""
    height, width = grid.shape
    fresh = np.ones(grid.shape, bool)
    fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
    run = np.cumsum(fresh.ravel()).reshape(grid.shape) - 1
    first = np.flatnonzero(fresh.ravel())
    top, left = np.divmod(first, width)
    right = left + np.diff(np.append(first, grid.size))
    touch = grid[1:] == grid[:-1]
    low, high = np.unique(np.stack((run[:-1][touch], run[1:][touch])), axis=1)
    number = np.arange(len(first))
    while True:
        least, before = np.minimum(number[low], number[high]), number.copy()
        np.minimum.at(number, low, least)
        np.minimum.at(number, high, least)
        number = number[number]
        if (number == before).all():
            return top, left, right, grid.ravel()[first], number


def _edges(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Directed edges of an area by where they begin, the area on their right: along the tops of
    runs where nothing is above, down their ends, back along bottoms, up their beginnings."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    rows: dict[int, list[tuple[int, int]]] = {}
    for y, a, b in zip(top.tolist(), left.tolist(), right.tolist(), strict=True):
        rows.setdefault(y, []).append((a, b))
        out.setdefault((b, y), []).append((b, y + 1))
        out.setdefault((a, y + 1), []).append((a, y))
    for y in sorted({*rows, *(y + 1 for y in rows)}):
        marks = [(x, +1 if k == 0 else -1, 0) for r in rows.get(y - 1, ()) for k, x in enumerate(r)] + [(x, +1 if k == 0 else -1, 1) for r in rows.get(y, ()) for k, x in enumerate(r)]
        inside, before = [0, 0], None
        for x, step, which in sorted(marks):
            if before is not None and x > before and inside[0] != inside[1]:
                a, b = ((before, y), (x, y)) if inside[1] else ((x, y), (before, y))
                out.setdefault(a, []).append(b)
            inside[which] += step
            before = x
    return out


def outline(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """x, y, x, y ... of the corners of an area's outer border, from its first pixel on."""
    edges, start = _edges(top, left, right), (int(left[0]), int(top[0]))
    points, at, way = [], start, (0, -1)
    while True:
        # Where two pixels of the area touch at a corner alone, the turn to the right stays with one.
        ahead = edges[at]
        turns = [((b[0] > at[0]) - (b[0] < at[0]), (b[1] > at[1]) - (b[1] < at[1])) for b in ahead]
        pick = max(range(len(ahead)), key=lambda k: way[0] * turns[k][1] - way[1] * turns[k][0])
        if turns[pick] != way or not points:
            points.append(at)
        at, way = ahead.pop(pick), turns[pick]
        if at == start:
            break
    if len(points) > 2 and (points[0][0] == points[1][0] == points[-1][0] or points[0][1] == points[1][1] == points[-1][1]):
        points = points[1:]
    return [c for p in points for c in p]


def traced(grid: np.ndarray, background: int = 0, min_area: int = 1) -> list[dict]:
    """value, area and outline of the 4-connected areas, in the order of their first pixels."""
    if not grid.size:
        return []
    top, left, right, value, number = labelled_runs(grid)
    order = np.argsort(number, kind="stable")
    ends = np.flatnonzero(np.r_[number[order][1:] != number[order][:-1], True]) + 1
    out = []
    for low, high in zip(np.r_[0, ends[:-1]], ends, strict=True):
        own = order[low:high]
        area = int((right[own] - left[own]).sum())
        if value[own[0]] != background and area >= min_area:
            out.append({"value": int(value[own[0]]), "area": area, "outline": outline(top[own], left[own], right[own])})
    return out


def outlines(masks: DataFrame) -> DataFrame:
    """image, value, area, polygon of masks (image, width, height, areas)."""
    rows = masks.select("image", "width", "height", F.explode("areas").alias("a")).select("*", "a.*")
    at = lambda i: F.get("outline", i)
    point = lambda k: F.struct((at(2 * k) / F.col("width")).alias("x"), (at(2 * k + 1) / F.col("height")).alias("y"))
    polygon = F.transform(F.sequence(F.lit(0), (F.size("outline") / 2).cast("int") - 1), point)
    return rows.select("image", "value", "area", polygon.alias("polygon"))


def read_masks(spark: SparkSession, path: str, background=0, min_area: int = 1, class_map: Mapping | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, classes) of a folder of label masks: a polygon for each connected area.
    Values become classes by ``class_map`` (values or colours to names; names in their order), or by
    their text where there is none.  A background that is a grey value means that grey in colour
    masks too.

    Pixels stay inside the task that reads a file; only areas come out of it."""
    given = parse_value(background)
    grey = {given, COLOUR + given * 0x010101} if given < 256 else {given}

    def read(source: places.Source) -> tuple:
        grid = values_of(png_pixels(b"".join(source.blocks())))
        nothing = next((v for v in grey if (v >= COLOUR) == (grid.size > 0 and grid.flat[0] >= COLOUR)), -1)
        return grid.shape[1], grid.shape[0], traced(grid, nothing, min_area)

    files = list_files(spark, path, "*.png").select(stem(F.col("path")).alias("image"), "path")
    masks = stored(places.read_each(files, "path", AREAS, read).drop("path"), "masks")
    found = outlines(masks)
    if class_map is None:
        named = F.when(F.col("value") < COLOUR, F.col("value").cast("string")).otherwise(F.concat_ws(",", *[(F.shiftright(F.col("value") - COLOUR, by).bitwiseAND(255)).cast("string") for by in (16, 8, 0)]))
        values = numbered(found.select("value").distinct().withColumn("class_name", named), "class_name")
        classes = values.select("value", (F.col("id") - 1).cast("int").alias("class_id"), "class_name")
    else:
        kept = {parse_value(v): str(n) for v, n in class_map.items() if parse_value(v) not in grey}
        names = list(dict.fromkeys(kept.values()))
        classes = spark.createDataFrame([(v, names.index(n), n) for v, n in kept.items()], "value int, class_id int, class_name string")
    ann = found.join(classes, "value").withColumn("pos", F.struct("value", F.col("polygon")[0]["y"].alias("y"), F.col("polygon")[0]["x"].alias("x")))
    ann = _ordered(ann).withColumns({c: F.lit(None).cast("double") for c in ("cx", "cy", "w", "h")})
    pics = masks.select("image", F.concat("image", F.lit(".png")).alias("file_name"), "width", "height")
    return pics, ann.select("image", "ord", "line_no", "class_id", "cx", "cy", "w", "h", "polygon", "area"), classes.select("class_id", "class_name").distinct()


def _ordered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("image").orderBy("pos")) - 1  # an image's areas
    return rows.withColumn("ord", place).withColumn("line_no", F.col("ord") + 1)


def mask_components(masks: DataFrame, background: int = 0, min_area: int = 1) -> DataFrame:
    """image, value, area, polygon of the connected areas of label masks that are tables already
    (image, pixels: rows of integers)."""
    kind = masks.schema["image"].dataType.simpleString()
    arrow = places.to_arrow_schema(masks.sparkSession.createDataFrame([], f"image {kind}, {AREAS}").schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [np.array(p or [], np.int64) for p in batch.column(1).to_pylist()]
            grids = [g if g.ndim == 2 else np.zeros((0, 0), np.int64) for g in grids]
            columns = [batch.column(0), pa.array([g.shape[1] for g in grids], pa.int32()), pa.array([g.shape[0] for g in grids], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([traced(g, background, min_area) for g in grids], arrow.field(3).type)], schema=arrow)

    return outlines(masks.select("image", "pixels").mapInArrow(label, f"image {kind}, {AREAS}"))
