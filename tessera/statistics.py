"""Statistics of a dataset as tables, for one folder and for each modality of scenes."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.geometry import corners
from .operators import dataset as ds
from .operators import tables
from .sinks import reports
from .sources.layout import Dataset
from .store import stored


def shared_schema(attributes: Mapping) -> dict:
    """Attributes that all classes share, with their options if they are a list."""
    return {n: o if isinstance(o, list) else None for n, o in attributes.items() if not isinstance(o, dict)}


def class_table(data: Dataset) -> DataFrame:
    return data.images.sparkSession.createDataFrame(list(enumerate(data.classes)), "class_id int, class_name string")


def stats(data: Dataset, sizes: DataFrame, labelled: DataFrame, schema: Mapping) -> dict[str, DataFrame]:
    """The tables of a dataset.  ``sizes``: image, width, height; ``labelled``: images with a label file."""
    ann = ds.seg_to_det(data.annotations.withColumn("points", F.size("polygon"))).join(sizes, "image", "left")
    ann = stored(ann, "boxes")  # read for each table
    out = {
        "totals": ds.totals(ann, data.images, data.orphans, labelled, schema),
        "classes": ds.class_counts(ann, class_table(data)),
        "boxes": ds.describe(ann, ds.box_series()),
        "images": ds.describe(sizes, {"image_width": F.col("width"), "image_height": F.col("height")}),
        "aspect": ds.histogram(ann, F.col("w") / F.col("h"), ds.SHAPE_EDGES),
        "per_image": ds.objects_per_image(ann, data.images),
    }
    if schema:
        out |= {"attributes": ds.attribute_counts(ann, schema), "class_attributes": ds.attribute_counts(ann, schema, by_class=True)}
    return out


def stat_tables(data: Dataset, sizes: DataFrame, schema: Mapping, selected=None) -> dict[str, DataFrame]:
    """The table behind each selected statistic (a list of names or such a text; all: every one)."""
    chosen = tables.selected_statistics(selected)
    ann = stored(ds.seg_to_det(data.annotations), "boxes")
    sizes = sizes.select("image", "width", "height")
    sized = ann.join(sizes, "image", "left").withColumns(corners())

    def row(*columns: str | Column) -> DataFrame:
        return sized.select(ds.class_name(data.classes).alias("category"), *columns)

    w, h = F.col("w"), F.col("h")
    known = {
        "class_counts": lambda: ds.class_counts(ann, class_table(data)),
        "box_number": lambda: ds.objects_per_image(ann, data.images),
        "box_width": lambda: row("w"),
        "box_height": lambda: row("h"),
        "box_area": lambda: row((w * h).alias("area")),
        "attribute": lambda: ds.attribute_counts(ann, schema) if schema else None,
        "image_shape": lambda: tables.image_shapes(sizes),
        "box_shape": lambda: row("w", "h"),
        "box_shape_pix": lambda: row((w * F.col("width")).alias("width"), (h * F.col("height")).alias("height")),
        "box_shape_rate": lambda: ds.histogram(ann, w / h, ds.SHAPE_EDGES),
        "box_pos_start": lambda: row("x1", "y1"),
        "box_pos_center": lambda: row("cx", "cy"),
        "box_pos_end": lambda: row("x2", "y2"),
        "legacy_csv": lambda: reports.box_rows(ann, data.classes),
    }
    found = {n: make() for n, make in known.items() if n in chosen}
    if schema and {"legacy_csv", "attribute"} & chosen:
        found["legacy_attribute_csv"] = reports.attribute_rows(ann, data.classes, schema)
    return {n: t for n, t in found.items() if t is not None}


def write(found: Mapping[str, DataFrame], folder: str) -> list[str]:
    """A CSV file for each table."""
    for name, rows in found.items():
        reports.write_csv(rows, os.path.join(folder, f"{name}.csv"))
    return sorted(os.listdir(folder))
