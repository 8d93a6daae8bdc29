"""Report files: CSV, JSON, COCO documents and the text table of metrics."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import by_class, class_name, decoded, has_value, seg_to_det
from ..sources.labels import number
from ..store import release, stored
from .files import write_lines
from .keyed import write_groups

#: Columns of the reports.
COMPARE = ("image", "class_id", "class_name", "status", "iou", "gt_line", "pred_line", "confidence")
EDIT = ("operation", "image", "label_path", "line_no", "old_class_id", "old_class_name", "new_class_id", "new_class_name", "action", "attr_name", "old_attr_value", "new_attr_value")
QUERY = ("image", "image_path", "label_path", "line_no", "class_id", "class_name", "task", "cx", "cy", "width", "height", "points", "confidence", "attributes")
ISSUES = ("image", "path", "code", "message")
METRICS = ("Class", "Images", "Instances", "Precision", "Recall", "mAP50", "mAP50-95")
CLASS_METRICS = ("class_id", "class_name", "images", "labels", "predictions", "precision", "recall", "f1", "ap50", "ap75", "map")
SIZE_METRICS = ("size", "images", "labels", "predictions", "precision", "recall", "f1", "ap50", "ap75", "map", "fitness")
ERRORS = (
    "image", "status", "error_type", "class_id", "class_name", "pred_class_id", "pred_class_name", "pred_conf", "gt_class_id", "gt_class_name", "best_iou", "pred_box_xyxy", "gt_box_xyxy",
    "pred_line", "gt_line", "pred_idx", "gt_idx",
)
DUPLICATES = ("image", "gt_idx_i", "gt_idx_j", "iou", "cls_i", "name_i", "cls_j", "name_j", "type", "line_i", "line_j")
BOXES = ("category", "center_x", "center_y", "width", "height", "image")
#: Files of error rows and the rows in each; the last two are older names.
ERROR_FILES = {
    "fp_report.csv": "status = 'fp'", "fn_report.csv": "status = 'fn'", "class_error.csv": "error_type IN ('class_error_pred', 'fn_class_error')", "tp_report.csv": "status = 'tp'",
    "false_positive_background.csv": "status = 'fp'", "false_negative_missed_gt.csv": "status = 'fn'",
}


def _cell(c: str) -> Column:
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def csv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[_cell(f"`{c}`") for c in columns])


def write_csv_groups(rows: DataFrame, root: str, folder: Column, order: Sequence[str], name: str = "review.csv", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file ``name`` in each folder that ``folder`` names, all of them in one go; how many
    lines each has."""
    columns = columns or rows.columns
    return write_groups(rows, root, F.concat(folder, F.lit(f"/{name}")), order, csv_line(columns), ",".join(columns) + "\r\n", "\r\n")


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """One CSV file with a header; nulls are blank."""
    head = ("﻿" if bom else "") + ",".join(rows.columns) + "\r\n"
    write_lines(rows.select(csv_line(rows.columns)), path, head, "\r\n", last="\r\n")


def with_columns(rows: DataFrame, columns: Sequence[str], **values: Column) -> DataFrame:
    """``rows`` with exactly these columns; those that neither has are null."""
    return rows.withColumns(values).select(*[F.col(c) if c in rows.columns or c in values else F.lit(None).cast("string").alias(c) for c in columns])


def attributes_text(classes: Sequence[str], schema: Mapping) -> Column:
    """The attributes of a row by name, decoded, as a JSON object; {} without any."""

    def shown(own: Mapping) -> Column:
        cells = [x for k, (n, o) in enumerate(own.items()) for x in (F.lit(n), F.when(F.size("attrs") > k, decoded(k, o if isinstance(o, (list, tuple)) else None)))]
        return F.to_json(F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull())) if cells else F.lit("{}")

    if not by_class(schema):
        return shown(schema)
    return F.coalesce(*[F.when(F.col("class_id") == k, shown(schema[n])) for k, n in enumerate(classes) if n in schema], F.lit("{}"))


def query_rows(ann: DataFrame, images: DataFrame, classes: Sequence[str], schema: Mapping | None = None) -> DataFrame:
    """The rows of a query as its report shows them, polygons by the boxes around them; attributes
    are decoded where there is a ``schema``, else numbers."""
    where = images.select("image", *[F.col(c).alias(a) for c, a in (("path", "image_path"), ("label_path", "label_path")) if c in images.columns])
    has = F.col("polygon").isNotNull() if "polygon" in ann.columns else F.lit(False)
    points = F.when(has, F.size("polygon")) if "polygon" in ann.columns else F.lit(None).cast("int")
    rows = ann.withColumns({"__task": F.when(has, "segment").otherwise("detect"), "__points": points}).drop("label_path", "width", "height")
    rows = (seg_to_det(rows) if "polygon" in ann.columns else rows).join(where, "image", "left")
    attrs = F.array_join(F.transform("attrs", lambda a: a.cast("string")), " ") if "attrs" in ann.columns else F.lit(None).cast("string")
    attrs = attributes_text(classes, schema) if schema and "attrs" in ann.columns else attrs
    return with_columns(rows, QUERY, class_name=class_name(classes), task=F.col("__task"), width=F.col("w"), height=F.col("h"), points=F.col("__points"), attributes=attrs)


def write_duplicates(found: DataFrame, path: str) -> None:
    """Pictures of equal content, those of one digest together."""
    write_csv(found.select("digest", "image").orderBy("digest", "image"), path)


def write_image_issues(issues: DataFrame, images: DataFrame, path: str) -> None:
    """Pictures that are missing or damaged, with their files."""
    names = images.select("image", F.col("file_name"), *[F.col(c) for c in ("path",) if c in images.columns])
    said = F.when(F.col("issue") == "missing_image", "there is no such file").otherwise("its header cannot be read, or the file ends before the picture does")
    rows = with_columns(issues.join(names, "image", "left").drop("image"), ISSUES, image=F.col("file_name"), code=F.col("issue"), message=said)
    write_csv(rows.orderBy("image", "code"), path)


def edit_rows(report: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """The rows of an edit's report with class names from before and after."""
    more = [c for c in ("old_attr_value", "new_attr_value") if c in report.columns]
    report = report.withColumns({c: number(F.col(c)) for c in more})
    values = {"old_class_id": F.col("old_class"), "old_class_name": class_name(old, "old_class"), "new_class_id": F.col("new_class"), "new_class_name": F.when(F.col("new_class").isNotNull(), class_name(new, "new_class")), "action": F.when(F.col("new_class").isNull(), "delete").otherwise("update")}
    return with_columns(report, EDIT, **values)


def compare_rows(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The rows of a comparison; boxes are told by their lines, counted from 1 here."""
    return with_columns(rows, COMPARE, class_name=class_name(classes), gt_line=F.col("g") + 1, pred_line=F.col("p") + 1)


def serialised(box: Column) -> Column:
    """x1,y1,x2,y2 in square brackets, six digits each."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string("%.6f", box[c]) for c in ("x1", "y1", "x2", "y2")]), F.lit("]"))


def error_rows(found: DataFrame, gt: DataFrame, pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The rows of an error analysis with names, boxes and lines of both sides (the tables that
    the analysis numbered, with corners and, if known, source_line)."""
    side = lambda df, key, name: df.select("image", F.col("ord").alias(key), F.struct("x1", "y1", "x2", "y2").alias(f"{name}_box"), *([F.col("source_line").alias(f"{name}_line")] if "source_line" in df.columns else []), *([F.col("confidence").alias("pred_conf")] if name == "pred" else []))
    rows = found.join(side(gt, "g", "gt"), ["image", "g"], "left").join(side(pred, "p", "pred"), ["image", "p"], "left")
    own = F.when(F.col("status") == "fn", F.col("g_class")).otherwise(F.col("p_class"))
    name = lambda c: F.when(F.col(c).isNotNull(), class_name(classes, c))
    rows = rows.withColumn("class_id", own)
    return with_columns(
        rows, ERRORS, class_name=name("class_id"), pred_class_id=F.col("p_class"), pred_class_name=name("p_class"), gt_class_id=F.col("g_class"), gt_class_name=name("g_class"), best_iou=F.round("iou", 6),
        pred_box_xyxy=F.when(F.col("pred_box").isNotNull(), serialised(F.col("pred_box"))), gt_box_xyxy=F.when(F.col("gt_box").isNotNull(), serialised(F.col("gt_box"))), pred_idx=F.col("p"), gt_idx=F.col("g"),
    )


def duplicate_rows(found: DataFrame, gt: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The pairs of ``duplicate_labels`` with classes and lines."""
    line = [F.col("source_line").alias("line")] if "source_line" in gt.columns else [F.lit(None).cast("string").alias("line")]
    side = lambda key, n: gt.select("image", F.col("ord").alias(key), F.col("class_id").alias(f"cls_{n}"), class_name(classes).alias(f"name_{n}"), *[x.alias(f"line_{n}") for x in line])
    rows = found.join(side("first", "i"), ["image", "first"]).join(side("second", "j"), ["image", "second"])
    kind = F.when(F.col("kind") == "same_class_duplicate", F.col("kind")).otherwise("overlap_different_class")
    return with_columns(rows, DUPLICATES, gt_idx_i=F.col("first"), gt_idx_j=F.col("second"), type=kind)


def write_errors(found: DataFrame, folder: str) -> list[str]:
    """The six reports of an error analysis; a row may stand in several."""
    found = stored(found, "errors")
    for name, rows in ERROR_FILES.items():
        write_csv(found.where(rows), os.path.join(folder, name), bom=True)
    release(found)
    return [os.path.join(folder, n) for n in ERROR_FILES]


def box_rows(ann: DataFrame, classes: Sequence[str]) -> DataFrame:
    return with_columns(ann.drop("width", "height"), BOXES, category=class_name(classes), center_x=F.col("cx"), center_y=F.col("cy"), width=F.col("w"), height=F.col("h"))


def attribute_rows(ann: DataFrame, classes: Sequence[str], schema) -> DataFrame:
    """category, image, the decoded attributes, how many of them do not mean none, and whether any."""
    options = lambda o: o if isinstance(o, (list, tuple)) else None
    cells = [decoded(k, options(o)).alias(n) for k, (n, o) in enumerate(schema.items())]
    count = sum((F.coalesce(has_value(k, options(o)), F.lit(False)).cast("int") for k, o in enumerate(schema.values())), F.lit(0))
    return ann.select(class_name(classes).alias("category"), "image", *cells, count.alias("attribute sum"), (count > 0).cast("int").alias("with attribute"))


def write_coco(images: DataFrame, ann: DataFrame, categories: DataFrame, path: str) -> None:
    """One COCO document of its three tables, written row by row."""
    each = lambda df: F.to_json(F.struct(*df.columns))
    parts = [("images", images), ("annotations", ann), ("categories", categories)]
    for name, df in parts:
        write_lines(df.orderBy("id").select(each(df)), f"{path}.{name}", f'"{name}": [\n', ",\n", "\n]")
    with open(f"{path}.part", "wb") as out:
        out.write(b"{\n")
        for k, (name, _) in enumerate(parts):
            out.write(b",\n" if k else b"")
            with open(f"{path}.{name}", "rb") as source:
                while block := source.read(1 << 20):
                    out.write(block)
            os.remove(f"{path}.{name}")
        out.write(b"\n}\n")
    os.replace(f"{path}.part", path)


def _shown(column: str, digits: int = 3) -> Column:
    """A number with so many significant digits, in short form."""
    x = F.col(column)
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(x)))).cast("int")
    fixed = F.coalesce(*[F.when(places == k, F.format_string(f"%.{k}f", x)) for k in range(16)], F.format_string(f"%.{digits - 1}e", x))
    return F.when(x == 0, F.lit("0")).otherwise(F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed))


def _table(rows: DataFrame, last: str) -> DataFrame:
    """line, place: cells of METRICS, right-aligned but for the first, below a heading."""
    heading = rows.sparkSession.createDataFrame([(-1, *METRICS)], ", ".join(["place int", *(f"`{c}` string" for c in METRICS)]))
    cells = heading.union(rows.select("place", F.col("name"), F.col("images").cast("string"), F.col("labels").cast("string"), _shown("precision"), _shown("recall"), _shown("map50"), _shown(last)))
    widths = cells.agg(*[F.max(F.char_length(F.col(f"`{c}`"))).alias(f"w{n}") for n, c in enumerate(METRICS)])
    space = lambda n, c: F.repeat(F.lit(" "), F.col(f"w{n}") - F.char_length(F.col(f"`{c}`")))
    line = [F.concat(F.col(f"`{c}`"), space(n, c)) if n == 0 else F.concat(space(n, c), F.col(f"`{c}`")) for n, c in enumerate(METRICS)]
    return cells.join(F.broadcast(widths)).select("place", F.concat_ws(" ", *line).alias("line"))


#: Fixed value: the heading of the second table.
SIZE_HEADING = "Target size metrics (small area < 32² px, 32² <= medium area < 96² px, large area >= 96² px):"


def metrics_text(metrics: DataFrame, macro: DataFrame, classes: Sequence[str], sizes: DataFrame | None = None) -> str:
    """The metrics of each class as a table of text, after a line for all, and a table of sizes
    below it.  There is one row for each class name, so the driver may hold them."""
    used = metrics.where("labels > 0 OR predictions > 0")
    images = F.lit(None).cast("long") if "images" in macro.columns else None
    whole = macro if images is None else macro.withColumn("images", F.col("images").cast("long"))
    if images is None:
        whole = macro.join(F.broadcast(used.agg(F.coalesce(F.max("images"), F.lit(0)).alias("images"))))
    columns = ["place", "name", "images", "labels", "precision", "recall", "map50", "map"]
    rows = whole.select(F.lit(0).alias("place"), F.lit("all").alias("name"), "images", F.coalesce("labels", F.lit(0)).alias("labels"), *columns[4:])
    each = used.select((F.col("class_id") + 1).alias("place"), class_name(classes).alias("name"), "images", "labels", "precision", "recall", F.col("ap50").alias("map50"), F.col("ap").alias("map"))
    text = [r.line for r in _table(rows.union(each.select(columns)), "map").orderBy("place").collect()]
    if sizes is not None:
        order = F.when(F.col("size") == "small", 0).when(F.col("size") == "medium", 1).otherwise(2)
        text += ["", SIZE_HEADING, *(r.line for r in _table(sizes.select(order.alias("place"), F.col("size").alias("name"), *columns[2:]), "map").orderBy("place").collect())]
    return "\n".join(text)


def metric_rows(metrics: DataFrame, classes: Sequence[str]) -> DataFrame:
    return with_columns(metrics, CLASS_METRICS, class_name=class_name(classes), map=F.col("ap")).orderBy("class_id")


def size_rows(sizes: DataFrame) -> DataFrame:
    return with_columns(sizes, SIZE_METRICS, ap50=F.col("map50"), ap75=F.col("map75"))


def write_metrics(metrics: DataFrame, macro: DataFrame, classes: Sequence[str], folder: str, sizes: DataFrame | None = None, about: dict | None = None) -> list[str]:
    """metrics.csv, metrics.json and metrics.txt, and size_metrics.csv where there are sizes."""
    at = lambda n: os.path.join(folder, n)
    rows = metric_rows(metrics, classes)
    write_csv(rows, at("metrics.csv"))
    doc = {"report_type": "detection_metrics"} | macro.first().asDict() | (about or {}) | {"classes": [r.asDict() for r in rows.collect()]}  # a row for each class name
    if sizes is not None:
        write_csv(size_rows(sizes), at("size_metrics.csv"))
        doc["size_metrics"] = {r["size"]: r.asDict() for r in size_rows(sizes).collect()}
    with open(at("metrics.json"), "w", encoding="utf-8") as out:
        json.dump(doc, out, indent=2, ensure_ascii=False)
    with open(at("metrics.txt"), "w", encoding="utf-8") as out:
        out.write(metrics_text(metrics, macro, classes, sizes) + "\n")
    return [at(n) for n in ("metrics.csv", "metrics.json", "metrics.txt", *(["size_metrics.csv"] if sizes is not None else []))]
