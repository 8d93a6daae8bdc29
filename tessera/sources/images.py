"""Pictures: what their headers say, and whether their files are whole; pixels are left alone.

A header is read from the first 64 KB of a file, and beyond them only where the format's own
marks point further (JPEG segments, TIFF directories).  ``intact`` follows each format to its end:
chunks and checksums of a PNG, segments and scans of a JPEG up to its end mark, blocks of a GIF up to
its trailer, chunks of a WebP, strips and tiles of a TIFF, rows of a BMP.  Nothing is decoded."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import places
from .labels import is_image, list_files, stem
from .places import Source

HEADER = ("format", "mode", "dtype", "bit_depth", "channels", "width", "height")
KIND = "bytes long, format string, mode string, dtype string, bit_depth int, channels int, width int, height int, intact boolean"
#: By PNG colour type, samples of a pixel and the mode's name.
PNG_KINDS = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}
#: Modes by the number of samples, and the types of other modes than 8-bit ones.
MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}
DTYPES = {"1": ("bool", 1), "I;16": ("uint16", 16), "I": ("int32", 32), "F": ("float32", 32)}
#: Bytes of a value of each TIFF type.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE = (None,) * len(HEADER)


def _row(kind: str, mode: str | None, width: int, height: int, channels: int | None = None) -> tuple:
    dtype, depth = DTYPES.get(mode, ("uint8", 8))
    return kind, mode, dtype, depth, channels or len(mode or "L"), width, height


def header(source: Source) -> tuple:
    """The columns of ``HEADER``; nulls where the header can't be read."""
    try:
        return _header(source)
    except (struct.error, IndexError, ValueError):  # the file ends within it
        return NONE


def _header(source: Source) -> tuple:
    first = source.at(0, 32)
    if first[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, depth, kind = struct.unpack(">IIBB", first[16:26])
        channels, mode = PNG_KINDS.get(kind, (1, None))
        mode = {(0, 1): "1", (0, 16): "I;16"}.get((kind, depth), mode)
        return _row("PNG", mode, width, height, channels)
    if first[:2] == b"BM":
        width, height, _, bits = struct.unpack("<iiHH", first[18:30])
        mode = {1: "1", 4: "P", 8: "P"}.get(bits, "RGBA" if bits == 32 else "RGB")
        return _row("BMP", mode, width, abs(height), 1 if mode in ("1", "P") else None)
    if first[:6] in (b"GIF87a", b"GIF89a"):
        return _row("GIF", "P", *struct.unpack("<HH", first[6:10]))
    if first[:2] == b"\xff\xd8":
        for mark, at, _ in jpeg_segments(source):
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width, channels = struct.unpack(">HHB", source.at(at + 5, 5))
                return _row("JPEG", "CMYK" if channels == 4 else MODES.get(channels, "RGB"), width, height, channels)
    if first[:4] in (b"II*\0", b"MM\0*"):
        return tiff(source)
    if first[:4] == b"RIFF" and first[8:12] == b"WEBP":
        return webp(first)
    return NONE


def jpeg_segments(source: Source, at: int = 2):
    """(mark, place, end) of the segments up to the first scan, that one included."""
    while True:
        lead, mark = source.at(at, 2)
        if lead != 0xFF:
            return
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:  # fill bytes and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            yield mark, at, at + 2
            return
        end = at + 2 + struct.unpack(">H", source.at(at + 2, 2))[0]
        yield mark, at, end
        if mark == 0xDA:
            return
        at = end


def tiff_directories(source: Source):
    """Tags of each directory: numbers by tag, read where the directory says."""
    order = "<" if source.at(0, 2) == b"II" else ">"
    at, seen = struct.unpack(order + "I", source.at(4, 4))[0], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack(order + "H", source.at(at, 2))[0]
        rows, tags = source.at(at + 2, 12 * count + 4), {}
        for k in range(count):
            tag, kind, n, _ = struct.unpack_from(order + "HHII", rows, 12 * k)
            if kind not in (3, 4):  # short and long
                continue
            size = n * TIFF_SIZES[kind]
            place = struct.unpack_from(order + "I", rows, 12 * k + 8)[0]
            data = rows[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else source.at(place, size)
            tags[tag] = struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", data)
        yield tags
        at = struct.unpack_from(order + "I", rows, 12 * count)[0]


def tiff(source: Source) -> tuple:
    """From the tags of the first picture."""
    tags = next(tiff_directories(source), {})
    width, height = (tags.get(t, (0,))[0] for t in (256, 257))
    if not width or not height:
        return NONE
    bits, channels = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    mode = MODES.get(channels, "RGBA") if channels > 1 else {1: "1", 16: "I;16", 32: "F" if tags.get(339, (1,))[0] == 3 else "I"}.get(bits, "P" if tags.get(262, (1,))[0] == 3 else "L")
    return _row("TIFF", mode, width, height, channels)


def webp(first: bytes) -> tuple:
    """From the lossy, lossless or extended first chunk."""
    kind = first[12:16]
    if kind == b"VP8 " and first[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", first[26:30])
        return _row("WEBP", "RGB", width & 0x3FFF, height & 0x3FFF)
    if kind == b"VP8L" and first[20] == 0x2F:
        bits = struct.unpack("<I", first[21:25])[0]
        return _row("WEBP", "RGBA" if bits >> 28 & 1 else "RGB", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    if kind == b"VP8X" and len(first) >= 30:
        width, height = (int.from_bytes(first[a : a + 3], "little") + 1 for a in (24, 27))
        return _row("WEBP", "RGBA" if first[20] & 0x10 else "RGB", width, height)
    return NONE


def whole_png(source: Source) -> bool:
    """Whether all chunks are there up to the last one, with their right checksums."""
    at = 8
    while at + 12 <= source.size:
        size, kind = struct.unpack(">I4s", source.at(at, 8))
        if at + 12 + size > source.size:
            return False
        check, left, place = 0, size + 4, at + 4
        while left:
            part = source.at(place, min(left, 1 << 20))
            check, left, place = zlib.crc32(part, check), left - len(part), place + len(part)
        if check != struct.unpack(">I", source.at(at + 8 + size, 4))[0]:
            return False
        if kind == b"IEND":
            return True
        at += 12 + size
    return False


def _scan_end(source: Source, at: int) -> int | None:
    """Where a JPEG scan's data end: at the first mark that is no stuffed byte and no restart."""
    last = b""
    for block in source.blocks(at):
        data = last + block
        k = data.find(b"\xff")
        while 0 <= k < len(data) - 1:
            if data[k + 1] != 0 and data[k + 1] != 0xFF and not 0xD0 <= data[k + 1] <= 0xD7:
                return at + k
            k = data.find(b"\xff", k + 1)
        at += len(data)
        last = b"\xff" if data[-1:] == b"\xff" else b""
        at -= len(last)
    return None


def whole_jpeg(source: Source) -> bool:
    """Whether segments and scans follow one another up to the end mark."""
    at, scans = 2, 0
    while True:
        mark = None
        for mark, _, end in jpeg_segments(source, at):  # noqa: B007
            if end > source.size:
                return False
        if mark == 0xD9:
            return scans > 0
        if mark != 0xDA or (at := _scan_end(source, end)) is None:
            return False
        scans += 1


def _sub_blocks(source: Source, at: int) -> int:
    while size := source.at(at, 1)[0]:
        at += 1 + size
    return at + 1


def whole_gif(source: Source) -> bool:
    """Whether blocks follow one another up to the trailer."""
    flags, at = source.at(10, 1)[0], 13
    at += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    pictures = 0
    while True:
        kind = source.at(at, 1)[0]
        if kind == 0x3B:
            return pictures > 0
        if kind == 0x21:
            at = _sub_blocks(source, at + 2)
        elif kind == 0x2C:
            flags = source.at(at + 9, 1)[0]
            at = _sub_blocks(source, at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            pictures += 1
        else:
            return False


def whole_bmp(source: Source) -> bool:
    """Whether all rows are there, or all that the header counts if they are compressed."""
    offset, size = struct.unpack("<I", source.at(10, 4))[0], struct.unpack("<I", source.at(14, 4))[0]
    if size < 40:
        return offset < source.size
    width, height, _, bits, packed, data = struct.unpack("<iiHHII", source.at(18, 20))
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    return offset + (data if packed in (1, 2) else rows) <= source.size


def whole_webp(source: Source) -> bool:
    """Whether the chunks fill what the file says it holds."""
    end, at = 8 + struct.unpack("<I", source.at(4, 4))[0], 12
    while at + 8 <= end <= source.size:
        at += 8 + (struct.unpack("<I", source.at(at + 4, 4))[0] + 1 & ~1)
    return end <= source.size and at in (end, end + 1)


def whole_tiff(source: Source) -> bool:
    """Whether the strips or tiles of each directory lie inside the file."""
    found = False
    for tags in tiff_directories(source):
        for offsets, counts in ((273, 279), (324, 325)):
            if offsets not in tags:
                continue
            found = True
            if len(tags[offsets]) != len(tags.get(counts, ())) or any(a + n > source.size for a, n in zip(tags[offsets], tags[counts], strict=True)):
                return False
    return found


WHOLE = {"PNG": whole_png, "JPEG": whole_jpeg, "GIF": whole_gif, "BMP": whole_bmp, "WEBP": whole_webp, "TIFF": whole_tiff}


def examined(source: Source, whole: bool = True) -> tuple:
    """Size, header, and whether the file is intact (null if that was not looked at)."""
    head = header(source)
    if head[0] is None or not whole:
        return source.size, *head, None if head[0] else False
    try:
        return source.size, *head, WHOLE[head[0]](source)
    except (struct.error, IndexError, ValueError):  # the file ends within a structure
        return source.size, *head, False


def read_headers(spark: SparkSession, path: str | DataFrame, whole: bool = False) -> DataFrame:
    """image, path, bytes, the header and ``intact`` of each image under a folder, or of a table's
    (image, path); ``whole`` looks at the files to their ends."""
    if isinstance(path, str):
        files = list_files(spark, path).where(is_image(F.col("path"))).select(stem(F.col("path")).alias("image"), "path")
        if not places.is_open(path):
            return _read_by_spark(spark, path, whole)
    else:
        files = path.select("image", "path")
    return places.read_each(files, "path", KIND, lambda source: examined(source, whole), (None, *NONE, False))


def _read_by_spark(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """From a store that only Spark reads: files come whole."""
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [examined(Source("", lambda _, c=c: io.BytesIO(c)), whole) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (i, p, *r), strict=True)) for i, p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows, strict=True)], schema)

    out = spark.createDataFrame([], f"image string, path string, {KIND}")
    names, schema = out.columns, places.to_arrow_schema(out.schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(is_image(F.col("path")))
    return files.select(stem(F.col("path")).alias("image"), "path", "content").mapInArrow(run, out.schema)


def bad_images(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """image, issue: expected images that are missing, and those whose header can't be read
    or that are damaged after it."""
    found = headers.where("bytes IS NOT NULL")  # a file that went while it was looked at has none
    missing = expected.join(found.select("image"), "image", "left_anti").select("image", F.lit("missing_image").alias("issue"))
    return missing.union(found.where("width IS NULL OR width <= 0 OR NOT intact").select("image", F.lit("bad_image").alias("issue")))


def to_uint8(pixels: DataFrame, low: float | None = None, high: float | None = None, preserve_zero: bool = True, stretch: bool = True) -> DataFrame:
    """Turns ``values`` (array of doubles) of each image into numbers of 8 bits.

    They are stretched to 0..255 over a fixed range (both ends) or over the image's own;  with
    ``preserve_zero`` zeros stay zeros and all others go to 1..255, so that the two stay apart.
    A flat image becomes 255; without ``stretch`` values are clipped and rounded.  Nulls and
    values that are not finite become 0."""
    if (low is None) != (high is None) or (low is not None and not -float("inf") < low < high < float("inf")):
        raise ValueError("a range has two finite ends, the second above the first")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    counts = lambda v: finite(v) & (v != 0) if preserve_zero else finite(v)
    if not stretch:
        clipped = lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)))
        return pixels.withColumn("values", F.transform("values", lambda v: F.when(finite(v), clipped(v)).otherwise(0.0).cast("int")))
    real = F.filter("values", counts)
    rows = pixels.withColumn("lo", F.lit(low) if low is not None else F.array_min(real)).withColumn("hi", F.lit(high) if high is not None else F.array_max(real))
    least, steps = (1.0, 254.0) if preserve_zero else (0.0, 255.0)
    inside = lambda v: (F.least(F.greatest(v, F.col("lo")), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scaled = lambda v: F.when(F.col("hi") == F.col("lo"), F.lit(255.0)).otherwise(F.rint(least + inside(v) * steps))
    return rows.withColumn("values", F.transform("values", lambda v: F.when(counts(v), scaled(v)).otherwise(0.0).cast("int"))).drop("lo", "hi")
