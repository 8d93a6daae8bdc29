"""Label text: parsing and writing, in column expressions.

A label line is ``class cx cy w h [conf]`` or ``class x1 y1 ... xn yn [conf]`` with normalised
numbers.  Where the corpus has an attribute schema, ``n a1 .. an`` may stand after the class.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import places

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")  # fixed values
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
POINT = "array<struct<x:double,y:double>>"
ANNOTATION = T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("class_id", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "w", "h")], T.StructField("polygon", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    T.StructField("attrs", T.ArrayType(T.DoubleType())), T.StructField("confidence", T.DoubleType()), T.StructField("source_line", T.StringType()),
])


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def label_path_of(path: Column) -> Column:
    """The first folder ``images`` (or ``image``) becomes ``labels`` (``label``); else a sibling."""
    moved = F.when(path.rlike("(^|/)images/"), F.regexp_replace(path, r"^((?:.*?/)?)images/", "$1labels/")).when(path.rlike("(^|/)image/"), F.regexp_replace(path, r"^((?:.*?/)?)image/", "$1label/")).otherwise(path)
    return F.regexp_replace(moved, r"\.[^./]+$", ".txt")


def parse_lines(files: DataFrame, text: str = "value", task: str = "auto", attributes: bool = False, strict: bool = True) -> DataFrame:
    """Annotations of label files; the other columns of ``files`` are kept.

    ``line_no`` counts all lines from 1, ``ord`` those that are not blank from 0.  A line that
    can't be read fails the job if ``strict``, else it comes with its reason in ``problem``."""
    if task not in ("auto", "detect", "segment"):
        raise ValueError(f"unknown task {task!r}")
    keep = [c for c in files.columns if c != text]
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda s, i: F.struct((i + 1).alias("line_no"), F.trim(F.regexp_replace(s, r"[\t\x0B\f]", " ")).alias("source_line"))), lambda s: s["source_line"] != "")
    rows = files.select(*keep, F.posexplode(lines).alias("ord", "l")).select(*keep, "l.line_no", "ord", "l.source_line")
    rows = rows.withColumn("t", F.split("source_line", r"\s+"))
    numeric = F.forall("t", lambda x: x.rlike(_NUMBER))
    rows = rows.withColumn("v", F.when(numeric, F.transform("t", lambda x: x.cast("double"))))
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    if attributes:
        n = F.get("v", F.lit(1))
        block = (n == F.floor(n)) & (n >= 0) & (F.size("v") - 2 - n >= 4)
        rows = rows.withColumn("k", F.when(block, n.cast("int")))
        rest = F.when(F.col("k").isNotNull(), F.slice("v", F.coalesce("k", F.lit(0)) + 3, F.greatest(F.size("v") - F.coalesce("k", F.lit(0)) - 2, F.lit(0)))).otherwise(rest)
        attrs = F.when(F.col("k").isNotNull(), F.slice("v", 3, F.coalesce("k", F.lit(0)))).otherwise(F.array().cast("array<double>"))
    else:
        attrs = F.array().cast("array<double>")
    rows = rows.withColumn("g", rest).withColumn("attrs", attrs)
    size = F.size("g")
    box = size.isin(4, 5) if task != "segment" else F.lit(False)
    poly = (size >= 6) if task != "detect" else F.lit(False)
    points = F.transform(F.sequence(F.lit(0), F.floor(size / 2).cast("int") - 1), lambda i: F.struct(F.get("g", 2 * i).alias("x"), F.get("g", 2 * i + 1).alias("y")))
    problem = F.when(~numeric, "not a number").when(F.size("t") < 5, "too few values").when(~(box | poly), "geometry does not fit the task")
    value = lambda i: F.when(problem.isNull() & box, F.get("g", F.lit(i)))
    out = rows.select(
        *keep, "line_no", "ord", F.get("v", F.lit(0)).cast("int").alias("class_id"), value(0).alias("cx"), value(1).alias("cy"), value(2).alias("w"), value(3).alias("h"),
        F.when(problem.isNull() & poly & ~box, points).alias("polygon"), "attrs",
        F.when(problem.isNull(), F.when(box, F.get("g", F.lit(4))).when(size % 2 == 1, F.element_at("g", -1))).alias("confidence"), "source_line", problem.alias("problem"),
    )
    if not strict:
        return out
    checked = F.when(F.col("problem").isNull(), F.col("class_id")).otherwise(F.raise_error(F.concat(F.col("problem"), F.lit(": "), F.col("source_line"))).cast("int"))
    return out.withColumn("class_id", checked).drop("problem")


def read_labels(spark: SparkSession, path: str, task: str = "auto", attributes: bool = False, strict: bool = True, stems: DataFrame | None = None, recursive: bool = True, suffix: str = ".txt") -> DataFrame:
    """Annotations of all label files under a folder (or in it alone), by ``image`` (the stem); a
    stem that occurs twice keeps its last path.  Files are chosen by ``stems`` before any is read."""
    if not places.is_open(path):
        files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
        files = files.select("value", F.col("_metadata.file_path").alias("label_path")).withColumn("image", stem(F.col("label_path")))
        if stems is not None:
            files = files.join(stems.select("image").distinct(), "image", "left_semi")
        last = files.groupBy("image").agg(F.max("label_path").alias("label_path"))
        return parse_lines(files.join(last, ["image", "label_path"], "left_semi"), "value", task, attributes, strict)
    files = list_labels(spark, path, suffix, recursive)
    if stems is not None:
        files = files.join(stems.select("image").distinct(), "image", "left_semi")
    return parse_lines(places.read_texts(files, "label_path"), "value", task, attributes, strict)


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path of every file under a folder, empty ones and those that begin with ``_`` or ``.`` too,
    which Spark's readers leave out.

    Tasks do the listing, see ``places``.  A store that only Spark reads is listed by its file
    index instead, which is held by the driver's JVM and leaves those names out."""
    if places.is_open(path):
        return places.walk(spark, path, recursive).where(F.element_at(F.split("path", "/"), -1).rlike(_glob_pattern(glob)))
    index = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(path)
    jvm = spark._jvm
    found = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(index._jdf.inputFiles())
    names = spark._jsparkSession.createDataset(found, jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    return DataFrame(names, spark).select(F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B"))).alias("path"))


def count_files(spark: SparkSession, path: str, glob: str = "*", images_only: bool = False) -> int:
    files = list_files(spark, path, glob)
    return files.where(is_image(F.col("path"))).count() if images_only else files.count()


def _glob_pattern(glob: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else re.escape(c) for c in glob) + "$"


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """image, path, file_name of the images under a folder; contents are not read."""
    files = list_files(spark, path).where(is_image(F.col("path")))
    return files.select(stem(F.col("path")).alias("image"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def list_labels(spark: SparkSession, path: str, suffix: str = ".txt", recursive: bool = True) -> DataFrame:
    """image, label_path of the label files under a folder; of equal stems the last path counts."""
    return list_files(spark, path, f"*{suffix}", recursive).groupBy(stem(F.col("path")).alias("image")).agg(F.max("path").alias("label_path"))


def number(value: Column, precision: int = 6) -> Column:
    """Fixed digits without trailing zeros behind the point."""
    digits = F.format_string(f"%.{precision}f", value)
    return F.regexp_replace(digits, r"\.?0+$", "") if precision else digits


def to_line(include_confidence: bool = False, include_attributes: bool = True, precision: int = 6) -> Column:
    """The label line of an annotation row."""
    box = F.array(*[number(F.col(c), precision) for c in ("cx", "cy", "w", "h")])
    flat = F.flatten(F.transform("polygon", lambda q: F.array(number(q["x"], precision), number(q["y"], precision))))
    parts = [F.array(F.col("class_id").cast("string"))]
    if include_attributes:
        head = F.concat(F.array(F.size("attrs").cast("string")), F.transform("attrs", lambda a: number(a, precision)))
        parts.append(F.when(F.coalesce(F.size("attrs"), F.lit(0)) > 0, head).otherwise(F.array().cast("array<string>")))
    parts.append(F.when(F.col("polygon").isNotNull(), flat).otherwise(box))
    if include_confidence:
        parts.append(F.when(F.col("confidence").isNotNull(), F.array(number(F.col("confidence"), precision))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*parts), " ")


def label_texts(ann: DataFrame, images: DataFrame, keep_empty: bool = True, **options) -> DataFrame:
    """image, value: the label text of each image, lines in order."""
    lines = ann.select("image", "ord", to_line(**options).alias("line")).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("lines"))
    text = lines.select("image", F.concat(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), F.lit("\n")).alias("value"))
    if not keep_empty:
        return text
    return images.select("image").distinct().join(text, "image", "left").select("image", F.coalesce("value", F.lit("")).alias("value"))


def write_texts(texts: DataFrame, folder: str, suffix: str = ".txt") -> None:
    """One file for each row (image, value), written by the executors into a folder that they
    share.  A file is put in place by renaming, so that a repeated task leaves whole files."""

    def write(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, f"{r.image}{suffix}")
            part = f"{path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as out:
                out.write(r.value)
            os.replace(part, path)

    texts.foreachPartition(write)
