"""Interchange formats as DataFrames: readers to annotations, writers from them."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import circle, pixel_points, polygon_area, to_centre
from ..operators.dataset import decoded
from ..operators.ranking import numbered
from ..store import stored
from . import bigjson, places
from .images import read_headers
from .labels import POINT, is_image, list_files, stem
from .masks import mask_components, read_masks  # noqa: F401  (a format like the others)

COCO = """images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>,
annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,segmentation:string>>"""
VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
LABELME = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>,attributes:map<string,string>>>"
TT100K = "types array<string>, imgs map<string,struct<path:string,objects:array<struct<category:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>>"


def _pairs(flat: Column, width: Column, height: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct((F.get(flat, 2 * i) / width).alias("x"), (F.get(flat, 2 * i + 1) / height).alias("y")))


def _numbered(rows: DataFrame, order: Sequence) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("image").orderBy(*order)) - 1).withColumn("line_no", F.col("ord") + 1)


#: Size of a document above which its members are read by several tasks.
PARALLEL_BYTES = 32 << 20


def _members(spark: SparkSession, path: str, schema: str, parallel_bytes: int, width: int = bigjson.BYTES) -> dict[str, DataFrame]:
    """pos and the value ``x`` of each element of a document's arrays: by one task, or by many where
    the document is large."""
    fields = {f.name: f.dataType.elementType for f in T.StructType.fromDDL(schema).fields}
    local = places.plain(path)
    if not places.is_mounted(local) or not os.path.isfile(local) or os.path.getsize(local) < parallel_bytes:
        doc = spark.read.schema(schema).option("multiLine", True).json(path)
        return {n: doc.select(F.posexplode(n).alias("pos", "x")) for n in fields}
    found = bigjson.members(spark, local, width).where("at IS NOT NULL")
    return {n: found.where(F.col("member") == n).select(F.col("at").alias("pos"), F.from_json("value", kind).alias("x")) for n, kind in fields.items()}


def read_coco(spark: SparkSession, path: str, task: str = "detect", class_names: Sequence[str] | None = None, parallel_bytes: int = PARALLEL_BYTES, width: int = bigjson.BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, classes): categories in the order of their ids or by the names
    given; rows of unknown categories or short boxes go; the first polygon of six numbers or
    more is used for ``segment``."""
    parts = _members(spark, path, COCO, parallel_bytes, width)
    images = parts["images"].select(F.col("x.id").alias("image_id"), stem(F.col("x.file_name")).alias("image"), "x.file_name", "x.width", "x.height")
    cats = parts["categories"].select(F.col("x.id").alias("category_id"), F.col("x.name").alias("class_name"))
    if class_names is None:
        classes = cats.withColumn("class_id", F.row_number().over(Window.orderBy("category_id")) - 1)  # a row for each category
    else:
        classes = cats.join(spark.createDataFrame(list(enumerate(class_names)), "class_id int, class_name string"), "class_name")
    ann = parts["annotations"].select("pos", "x.*").where(F.size("bbox") >= 4)
    ann = ann.join(images, "image_id").join(F.broadcast(classes) if class_names is not None else classes, "category_id")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    polygon = F.array_compact(F.transform(F.from_json("segmentation", "array<array<double>>"), lambda s: F.when(F.size(s) >= 6, s)))
    shape = F.when(F.size(polygon) > 0, _pairs(F.get(polygon, F.lit(0)), F.col("width"), F.col("height"))) if task == "segment" else F.lit(None).cast(POINT)
    ann = ann.withColumn("polygon", shape).withColumns({k: F.when(F.col("polygon").isNull(), e) for k, e in to_centre(x, y, x + w, y + h, F.col("width"), F.col("height")).items()})
    return images.drop("image_id"), _numbered(ann, ["pos"]).select("image", "ord", "line_no", "class_id", "cx", "cy", "w", "h", "polygon"), classes.select("class_id", "class_name")


def coco_tables(images: DataFrame, ann: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of a COCO document, as tables.

    Image ids count from 1 in the order of file names; annotation ids follow image and place."""
    listed = numbered(images.select("image", "file_name", "width", "height"), "file_name", "image")
    rows = ann.drop("width", "height").join(listed.select("image", F.col("id").alias("image_id"), "width", "height"), "image")
    w, h = F.col("w") * F.col("width"), F.col("h") * F.col("height")
    flat = F.flatten(F.transform(pixel_points("polygon", F.col("width"), F.col("height")), lambda q: F.array(q["x"], q["y"]))) if "polygon" in ann.columns else F.lit(None).cast("array<double>")
    area = F.when(F.col("polygon").isNotNull(), polygon_area(pixel_points("polygon", F.col("width"), F.col("height")))).otherwise(w * h) if "polygon" in ann.columns else w * h
    out = rows.select(
        "image_id", "ord", F.col("class_id").alias("category_id"),
        F.array(F.col("cx") * F.col("width") - w / 2, F.col("cy") * F.col("height") - h / 2, w, h).alias("bbox"), area.alias("area"), F.when(flat.isNotNull(), F.array(flat)).alias("segmentation"), F.lit(0).alias("iscrowd"),
    )
    out = numbered(out, "image_id", "ord").select("id", *[c for c in out.columns if c != "ord"])
    return listed.select("id", "file_name", "width", "height"), out, classes.select(F.col("class_id").alias("id"), F.col("class_name").alias("name"))


def read_voc(spark: SparkSession, path: str, class_names: Sequence[str] | None = None, skip_difficult: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, classes); names are numbered by first file and place, after those
    that are given."""
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    docs = docs.select(stem(F.col("filename")).alias("image"), F.col("filename").alias("file_name"), "size.width", "size.height", "object")
    rows = docs.select("image", "width", "height", F.posexplode("object").alias("pos", "o")).select("*", "o.name", "o.difficult", "o.bndbox.*")
    if skip_difficult:
        rows = rows.where(F.coalesce("difficult", F.lit(0)) != 1)
    rank = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for k, n in enumerate(class_names)], F.lit(len(class_names))) if class_names else F.lit(0)
    names = rows.groupBy("name").agg(F.min(F.struct(rank.alias("given"), "image", "pos")).alias("seen"))
    classes = names.select((F.row_number().over(Window.orderBy("seen")) - 1).alias("class_id"), F.col("name").alias("class_name"))  # a row for each name
    box = to_centre(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("width"), F.col("height"))
    ann = rows.join(classes, F.col("name") == F.col("class_name")).withColumns(box)
    return docs.drop("object"), _numbered(ann, ["pos"]).select("image", "ord", "line_no", "class_id", "cx", "cy", "w", "h"), classes


def read_labelme(spark: SparkSession, path: str, class_names: Sequence[str] | None = None, task: str = "auto", attributes: Sequence[tuple[str, Sequence[str]]] = ()) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of known classes: rectangles keep their two points as given,
    circles become 24-gons, attributes become the places of their options (0 if missing).
    Without ``class_names`` classes are the labels there are, in order, see ``labelme_names``; with
    them, another label is an error."""
    docs = spark.read.schema(LABELME).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    docs = docs.select(stem(F.col("imagePath")).alias("image"), F.col("imagePath").alias("file_name"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), "shapes")
    rows = docs.select("image", "width", "height", F.posexplode("shapes").alias("pos", "s")).select("image", "width", "height", "pos", "s.*")
    at = lambda i, k: F.get(F.get("points", F.lit(i)), F.lit(k))
    plain = F.transform("points", lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))
    points = F.when(F.col("shape_type") == "circle", circle(at(0, 0), at(0, 1), at(1, 0), at(1, 1))).otherwise(plain)
    rows = rows.withColumn("p", F.transform(points, lambda q: F.struct((q["x"] / F.col("width")).alias("x"), (q["y"] / F.col("height")).alias("y"))))
    many = (F.col("shape_type") != "rectangle") & (F.size("p") >= 3) & F.lit(task != "detect")
    xs, ys = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    around = to_centre(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), F.lit(1.0), F.lit(1.0))
    given = to_centre(F.get("p", F.lit(0))["x"], F.get("p", F.lit(0))["y"], F.get("p", F.lit(1))["x"], F.get("p", F.lit(1))["y"], F.lit(1.0), F.lit(1.0))
    box = {k: F.when(~many, F.when(F.col("shape_type") == "rectangle", given[k]).otherwise(around[k])) for k in given}
    raw = [F.coalesce(F.array_position(F.array(*map(F.lit, options)), F.try_element_at("attributes", F.lit(name))) - 1, F.lit(0)) if options else F.try_element_at("attributes", F.lit(name)).try_cast("double") for name, options in attributes]
    attrs = F.array(*[F.coalesce(F.greatest(r, F.lit(0)).cast("double"), F.lit(0.0)) for r in raw]).cast("array<double>")
    class_names = labelme_names(spark, path) if class_names is None else class_names
    names = spark.createDataFrame(list(enumerate(class_names)), "class_id int, label string")
    ann = rows.withColumns({**box, "polygon": F.when(many, F.col("p")), "attrs": attrs}).join(F.broadcast(names), "label", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("(none)")))).cast("int")
    ann = ann.withColumn("class_id", F.coalesce("class_id", unknown))
    return docs.drop("shapes"), _numbered(ann, ["pos"]).select("image", "ord", "line_no", "class_id", "cx", "cy", "w", "h", "polygon", "attrs")


def tt100k_images(spark: SparkSession, path: str, parallel_bytes: int = PARALLEL_BYTES, width: int = bigjson.BYTES) -> tuple[DataFrame, DataFrame]:
    """(path and objects of each image, classes) of a dictionary-of-images document."""
    local = places.plain(path)
    if not places.is_mounted(local) or not os.path.isfile(local) or os.path.getsize(local) < parallel_bytes:
        doc = spark.read.schema(TT100K).option("multiLine", True).json(path)
        return doc.select(F.explode(F.map_entries("imgs")).alias("e")).select("e.value.path", "e.value.objects"), doc.select(F.posexplode("types").alias("class_id", "class_name"))
    found = bigjson.members(spark, local, width)
    kind = T.StructType.fromDDL(TT100K)["imgs"].dataType.valueType
    rows = found.where("member = 'imgs' AND at IS NOT NULL").select(F.from_json("value", kind).alias("x")).select("x.path", "x.objects")
    return rows, found.where("member = 'types'").select(F.posexplode(F.from_json("value", "array<string>")).alias("class_id", "class_name"))


def tt100k_issues(rows: DataFrame, root: str, present: DataFrame) -> DataFrame:
    """image_path, issue of the images of a document: paths that leave the dataset (``unsafe_path``),
    images that are not among ``present`` (path, under ``root``), and names that several paths have
    (``name_collision``), each of which a dataset of one folder could not hold."""
    base = root.rstrip("/") + "/"
    paths = rows.select("path").distinct()
    unsafe = F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)") | F.col("path").rlike("^[A-Za-z]:")
    known = present.select(F.col("path").alias("there"))
    missing = paths.where(~unsafe).join(known, F.concat(F.lit(base), "path") == F.col("there"), "left_anti")
    name = F.element_at(F.split("path", "/"), -1)
    often = paths.groupBy(F.lower(F.regexp_replace(name, r"\.[^.]+$", "")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = paths.withColumn("name", F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))).join(often, "name", "left_semi")
    shown = lambda df, issue: df.select(F.col("path").alias("image_path"), F.lit(issue).alias("issue"))
    return shown(paths.where(unsafe), "unsafe_path").union(shown(missing, "missing_image")).union(shown(twice, "name_collision"))


def import_tt100k(spark: SparkSession, path: str, root: str | None = None, strict: bool = True, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, classes) of a dictionary-of-images document and the pictures beside it
    (or under ``root``).  Unsafe paths, missing pictures and colliding names are an error, or left
    out where not ``strict``."""
    root = places.plain(root or os.path.dirname(places.plain(path)))
    rows, classes = tt100k_images(spark, path, **options)
    rows, present = stored(rows, "tt100k"), stored(list_files(spark, root).where(is_image(F.col("path"))), "pictures")
    issues = stored(tt100k_issues(rows, root, present), "issues")
    if strict and (first := issues.orderBy("issue", "image_path").first()):
        raise ValueError(f"{first.issue}: {first.image_path}")
    bad = issues.select(F.col("image_path").alias("path")).distinct()
    rows = rows.join(bad, "path", "left_anti")
    files = rows.select(F.concat(F.lit(root + "/"), "path").alias("path")).distinct().select(stem(F.col("path")).alias("image"), "path")
    heads = stored(read_headers(spark, files).select("image", "path", "width", "height"), "headers")
    ann = _tt100k_boxes(rows, heads, classes)
    return heads.withColumn("file_name", F.element_at(F.split("path", "/"), -1)), ann, classes


def read_tt100k(spark: SparkSession, path: str, sizes: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(annotations with ``split`` and ``clipped``, classes) of a dictionary-of-images document;
    ``sizes``: image, width, height.  Boxes are clipped to the image; empty ones go."""
    rows, classes = tt100k_images(spark, path, **options)
    return _tt100k_boxes(rows, sizes, classes), classes


def _tt100k_boxes(rows: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    rows = rows.select("path", F.posexplode("objects").alias("pos", "o"))
    rows = rows.select(stem(F.col("path")).alias("image"), F.element_at(F.split("path", "/"), 1).alias("split"), "pos", F.col("o.category").alias("class_name"), "o.bbox.*")
    rows = rows.join(sizes.select("image", "width", "height"), "image").join(classes, "class_name")
    clip = {c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(s).cast("double"))) for c, s in (("xmin", "width"), ("ymin", "height"), ("xmax", "width"), ("ymax", "height"))}
    rows = rows.withColumn("clipped", (F.col("xmin") < 0) | (F.col("ymin") < 0) | (F.col("xmax") > F.col("width")) | (F.col("ymax") > F.col("height"))).withColumns(clip).where("xmax > xmin AND ymax > ymin")
    rows = rows.withColumns(to_centre(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("width"), F.col("height")))
    return _numbered(rows, ["pos"]).select("image", "split", "ord", "line_no", "class_id", "cx", "cy", "w", "h", "clipped")


def labelme_names(spark: SparkSession, path: str, limit: int = 10_000) -> list[str]:
    """The labels of LabelMe documents, in order: a table of class names, which has a bound."""
    docs = spark.read.schema(LABELME).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = docs.select(F.explode("shapes.label").alias("label")).where("label IS NOT NULL").distinct().orderBy("label").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return [r.label for r in rows]


def xany_documents(images: DataFrame, ann: DataFrame, classes: DataFrame, schema: Mapping[str, Sequence[str] | None] | None = None) -> DataFrame:
    """image, value: a JSON document of shapes in pixels for each image, with the decoded
    attributes of ``schema``."""
    x1, x2 = (F.col("cx") - F.col("w") / 2) * F.col("width"), (F.col("cx") + F.col("w") / 2) * F.col("width")
    y1, y2 = (F.col("cy") - F.col("h") / 2) * F.col("height"), (F.col("cy") + F.col("h") / 2) * F.col("height")
    corner = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))
    has = F.col("polygon").isNotNull() if "polygon" in ann.columns else F.lit(False)
    points = F.when(has, F.transform("polygon", lambda q: F.array(q["x"] * F.col("width"), q["y"] * F.col("height")))).otherwise(corner) if "polygon" in ann.columns else corner
    rows = ann.join(images.select("image", "width", "height"), "image").join(classes, "class_id", "left")
    cells = [x for k, (n, o) in enumerate((schema or {}).items()) for x in (F.lit(n), decoded(k, o))]
    attributes = F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull()) if cells else F.lit(None).cast("map<string,string>")
    shape = F.struct(attributes.alias("attributes"), "ord", F.coalesce("class_name", F.col("class_id").cast("string")).alias("label"), F.when(has, "polygon").otherwise("rectangle").alias("shape_type"), points.alias("points"))
    shapes = rows.groupBy("image").agg(F.array_sort(F.collect_list(shape), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("s"))
    named = F.transform(F.coalesce("s", F.array().cast(shapes.schema["s"].dataType)), lambda q: F.struct(q["label"].alias("label"), q["shape_type"].alias("shape_type"), q["points"].alias("points"), q["attributes"].alias("attributes")))
    docs = images.join(shapes, "image", "left")
    return docs.select("image", F.to_json(F.struct(F.col("file_name").alias("imagePath"), F.col("width").alias("imageWidth"), F.col("height").alias("imageHeight"), named.alias("shapes"))).alias("value"))
