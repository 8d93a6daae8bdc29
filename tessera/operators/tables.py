"""Flat tables for export, drawing and review, and filters of evaluation pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import pixel_box, size_bucket
from .dataset import apply_class_map, class_name, decoded, filter_geometry, has_value
from .ranking import numbered  # noqa: F401  (a table operator like those below)

COLOURS = 9  # fixed value: drawing colours repeat after so many classes


def annotation_table(ann: DataFrame, classes: Sequence[str], schema: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row for each annotation with its class name and a column for each attribute."""
    extra = [decoded(k, options).alias(f"attr_{name}") for k, (name, options) in enumerate((schema or {}).items())]
    return ann.select("image", "line_no", "class_id", class_name(classes).alias("class_name"), "cx", "cy", "w", "h", (F.col("w") * F.col("h")).alias("area"), *extra)


def attribute_table(ann: DataFrame, classes: Sequence[str], schema: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row for each annotation and attribute: stored number and decoded text."""
    cells = F.array(*[F.struct(F.lit(n).alias("attribute"), F.get("attrs", F.lit(k)).alias("raw"), decoded(k, o).alias("value")) for k, (n, o) in enumerate(schema.items())])
    rows = ann.select("image", "line_no", class_name(classes).alias("class_name"), F.explode(cells).alias("c"))
    return rows.select("image", "line_no", "class_name", "c.*").where("raw IS NOT NULL")


def positive_attributes(ann: DataFrame, schema: Mapping[str, Sequence[str]]) -> DataFrame:
    """How many annotations have how many attributes that do not mean none."""
    count = sum((F.coalesce(has_value(k, o), F.lit(False)).cast("int") for k, o in enumerate(schema.values())), F.lit(0))
    return ann.groupBy(count.alias("positive")).agg(F.count(F.lit(1)).alias("n"))


def image_shapes(images: DataFrame) -> DataFrame:
    return images.select("image", "width", "height", (F.col("width") / F.col("height")).alias("aspect"))


def class_counts_for(ann: DataFrame, names: DataFrame) -> DataFrame:
    """Objects of each class in the images that ``names`` (image) lists."""
    return ann.join(names.select("image").distinct(), "image", "left_semi").groupBy("class_id").agg(F.count(F.lit(1)).alias("objects"))


def type_summary(headers: DataFrame) -> DataFrame:
    """How many images have which format, bits, channels and size."""
    return headers.groupBy("format", "bit_depth", "channels", "width", "height").agg(F.count(F.lit(1)).alias("n"))


def draw_list(ann: DataFrame, classes: Sequence[str], least: float | None = None, show_confidence: bool = False) -> DataFrame:
    """What to draw: integer corners, colour and label of each box; a null confidence passes."""
    rows = ann if least is None else ann.where(F.col("confidence").isNull() | (F.col("confidence") >= least))
    text = class_name(classes)
    if show_confidence:
        text = F.concat(text, F.coalesce(F.format_string(" %.2f", "confidence"), F.lit("")))
    box = {k: v.alias(k) for k, v in pixel_box(F.col("width"), F.col("height")).items()}
    return rows.select("image", "ord", *box.values(), F.pmod("class_id", F.lit(COLOURS)).alias("colour"), text.alias("label"))


#: Statistics that a user can select, the first ones by default.
DEFAULT_STATISTICS = ("class_counts", "box_number", "box_width", "box_height", "box_area", "attribute")
MORE_STATISTICS = ("image_shape", "box_shape", "box_shape_pix", "box_shape_rate", "box_pos_start", "box_pos_center", "box_pos_end", "legacy_csv")


def selected_statistics(selected: str | Sequence[str] | None) -> set[str]:
    if selected is None:
        return {*DEFAULT_STATISTICS}
    names = {s.strip() for s in (selected.split(",") if isinstance(selected, str) else selected) if s.strip()}
    every = {*DEFAULT_STATISTICS, *MORE_STATISTICS}
    if "all" in names:
        return every
    if names - every:
        raise ValueError(f"unknown statistics {', '.join(sorted(names - every))}")
    return names


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def review_crop_name(found: DataFrame) -> DataFrame:
    """Adds the file name of each error's crop; places count from 1."""
    place = lambda c, none: F.when((F.col("error_type") == none) | F.col(c).isNull(), "none").otherwise((F.col(c) + 1).cast("string"))
    return found.where("status <> 'tp'").withColumn("crop", F.concat(F.col("image").cast("string"), F.lit("_pred"), place("p", "fn_no_pred"), F.lit("_gt"), place("g", "background_fp")))


def evaluation_filter(gt: DataFrame, pred: DataFrame, class_ids=None, exclude=None, min_confidence: float = 0.0, min_pixels: float | None = None, class_rules: Mapping[int, Mapping] | None = None, **rule) -> tuple[DataFrame, DataFrame]:
    """Both sides by the same classes and sizes; confidence applies to predictions alone, and
    image sizes come from the ground truth where it knows them.  ``class_rules`` (by id) replace
    the general rule and may hold ``min_pixels`` too."""
    class_rules = {k: dict(v) for k, v in (class_rules or {}).items()}
    pixels = {k: v.pop("min_pixels") for k, v in class_rules.items() if "min_pixels" in v}

    def keep(rows: DataFrame) -> DataFrame:
        rows = filter_geometry(rows, class_ids, class_rules, **rule)
        if exclude:
            rows = rows.where(~F.col("class_id").isin(*exclude))
        for k, least in pixels.items():
            large = (F.col("w") * F.col("width") >= least) & (F.col("h") * F.col("height") >= least)
            rows = rows.where((F.col("class_id") != k) | F.coalesce(large, F.lit(True)))
        if min_pixels is not None:
            rows = rows.where(F.coalesce((F.col("w") * F.col("width") >= min_pixels) & (F.col("h") * F.col("height") >= min_pixels), F.lit(True)))
        return rows

    if min_pixels is not None or pixels:
        sizes = gt.groupBy("image").agg(F.max("width").alias("gw"), F.max("height").alias("gh"))
        pred = pred.join(sizes, "image", "left").withColumn("width", F.coalesce("gw", "width")).withColumn("height", F.coalesce("gh", "height")).drop("gw", "gh")
    if min_confidence > 0:
        pred = pred.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    return keep(gt), keep(pred)


def with_size(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("size", size_bucket(F.col("w"), F.col("h"), F.col("width"), F.col("height")))


def resize_target(width: Column, height: Column, to_width: int | None = None, to_height: int | None = None, scale: float | None = None) -> tuple[Column, Column]:
    """Target size: by scale, by both sides, or by one with the aspect kept; one pixel at least."""
    one = lambda v: F.greatest(F.lit(1), F.bround(v)).cast("int")
    if scale is not None:
        return one(width * scale), one(height * scale)
    if to_width and to_height:
        return F.lit(to_width), F.lit(to_height)
    if to_width:
        return F.lit(to_width), one(height * to_width / width)
    if to_height:
        return one(width * to_height / height), F.lit(to_height)
    raise ValueError("a width, a height or a scale is needed")


def find_image(images: DataFrame, name: str) -> DataFrame:
    """The images that ``name`` fits best: by path, by file name, then by stem."""
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    tier = F.when(F.col("path") == name, 0).when(F.col("path").endswith(f"/{name}"), 1).when(F.col("file_name") == name, 2).when(stem == name, 3)
    ranked = images.withColumn("tier", tier).where("tier IS NOT NULL")
    best = ranked.agg(F.min("tier").alias("tier"))  # one row
    return ranked.join(F.broadcast(best), "tier", "left_semi").drop("tier")


def attribute_matrix(ann: DataFrame, classes: Sequence[str], schema: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row for each class, and one for all: how many annotations have each attribute."""
    counts = [F.count(F.when(has_value(k, o), 1)).alias(n) for k, (n, o) in enumerate(schema.items())]
    each = ann.groupBy("class_id").agg(*counts).select(class_name(classes).alias("class_name"), *schema)
    return each.unionByName(ann.agg(*counts).select(F.lit("all").alias("class_name"), *schema))


def missing_labels(images: DataFrame, ann: DataFrame) -> DataFrame:
    return images.join(ann.select("image").distinct(), "image", "left_anti")


def repeated_names(images: DataFrame) -> DataFrame:
    """Images whose file name stood before (by ``image``)."""
    again = F.row_number().over(Window.partitionBy("file_name").orderBy("image"))
    return images.withColumn("__n", again).where("__n > 1").drop("__n")


def resolve_listed(images: DataFrame, listed: DataFrame) -> DataFrame:
    """name, n_matches, image for each listed ``name``: by path or file name, and only where
    neither fits by stem.  A caller that forces names into a split refuses ``n_matches`` <> 1."""
    names = listed.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", "")
    keys = F.array_distinct(F.array_compact(F.array("path", "file_name"))) if "path" in images.columns else F.array("file_name")
    exact = images.select("image", F.explode(keys).alias("name")).distinct()
    by_stem = images.select(F.col("image"), stem(F.col("file_name")).alias("stem")).distinct()
    found = names.join(exact, "name", "left")
    hit = found.where("image IS NOT NULL")
    rest = found.where("image IS NULL").select("name", stem(F.col("name")).alias("stem")).join(by_stem, "stem", "left").select("name", "image")
    return hit.select("name", "image").unionByName(rest).groupBy("name").agg(F.count("image").alias("n_matches"), F.min("image").alias("image"))


def merged_sides(gt: DataFrame, pred: DataFrame, classes, merges: Mapping[str, Sequence], compact: bool = True):
    """Both sides of an evaluation with classes merged by ``merges`` (target to sources)."""
    if not merges or not all(merges.values()):
        raise ValueError("a map of merges needs targets, and each target sources")
    steps = {"merge": merges, "compact": compact}
    (gt, names, _), (pred, _, _) = apply_class_map(gt, classes, **steps), apply_class_map(pred, classes, **steps)
    return gt, pred, names
