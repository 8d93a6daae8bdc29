"""Corrections of labels from the names of reviewed crops.

A crop ``<image>_<n>`` stands for the n-th box (from 1) of an image, ``<image>_pred<p>_gt<g>``
for a prediction and a box, either of which may be ``none``.  Each returns the corrected table
and an outcome for each crop, from one join of the names to the annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_of, corners, iou
from .dataset import seg_to_det

CROP, ERROR_CROP = r"^(.+)_([1-9][0-9]*)$", r"^(.+)_pred(none|[1-9][0-9]*)_gt(none|[1-9][0-9]*)$"  # fixed values


def crop_names(crops: DataFrame) -> DataFrame:
    """crop, image, n of names (crop) without suffix; n is null for other names."""
    part = lambda k: F.nullif(F.regexp_extract("crop", CROP, k), F.lit(""))
    return crops.select("crop", part(1).alias("image"), part(2).cast("int").alias("n"))


def error_crop_names(crops: DataFrame) -> DataFrame:
    part = lambda k: F.nullif(F.regexp_extract("crop", ERROR_CROP, k), F.lit(""))
    return crops.select("crop", part(1).alias("image"), part(2).try_cast("int").alias("p"), part(3).try_cast("int").alias("g"), (part(1).isNotNull()).alias("valid"))


def correct_from_crops(ann: DataFrame, crops: DataFrame, target_class: int | None, images: DataFrame | None = None, labelled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The boxes that crops name get ``target_class``, or go where that is None.

    ``images`` (image; as many rows as pictures have the name) and ``labelled`` (image; those with
    a label file) tell names of several pictures, which nothing is done to, and pictures without a
    label file from names of no picture; without them the annotations say which images there are."""
    named = crop_names(crops)
    given = ann if images is None else images
    pictures = given.groupBy("image").agg((F.count(F.lit(1)) if images is not None else F.lit(1)).alias("pictures"))
    files = ann.select("image") if images is None else given.select("image") if labelled is None else labelled.select("image")
    known = named.join(pictures, "image", "left").join(files.distinct().withColumn("has_label", F.lit(True)), "image", "left")
    wanted = known.where("n IS NOT NULL AND pictures = 1").select("image", (F.col("n") - 1).alias("ord")).distinct()
    hit = ann.join(wanted, ["image", "ord"], "left_semi")
    rest = ann.join(wanted, ["image", "ord"], "left_anti")
    out = rest if target_class is None else rest.unionByName(hit.withColumn("class_id", F.lit(target_class)))
    known = known.join(ann.select("image", (F.col("ord") + 1).alias("n"), F.col("class_id").alias("old_class")), ["image", "n"], "left")
    outcome = F.when(F.col("n").isNull(), "invalid_name").when(F.col("pictures").isNull(), "missing_image").when(F.col("pictures") > 1, "ambiguous_image")
    outcome = outcome.when(F.col("has_label").isNull(), "missing_label").when(F.col("old_class").isNull(), "invalid_index")
    outcome = outcome.when(F.lit(target_class).isNull(), "deleted").when(F.col("old_class") == F.lit(target_class), "unchanged").otherwise("updated")
    return out, known.select("crop", "image", "n", "old_class", outcome.alias("outcome"))


def correction_summary(outcomes: DataFrame) -> DataFrame:
    """outcome, crops, targets: how many crop files and how many boxes or names each outcome has;
    crops beyond the targets name a box again."""
    target = F.coalesce(F.concat_ws("_", "image", "n"), "crop")
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("crops"), F.count_distinct(target).alias("targets"))


def dedup_additions(rows: DataFrame, least: float = 0.5, by: tuple[str, ...] = ("image",)) -> DataFrame:
    """Of boxes to add to an image, one that overlaps a better one (confidence, then place) goes;
    ``by`` may tell classes apart."""
    items = rows.withColumns(corners()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("rank"), "ord", "x1", "y1", "x2", "y2"))).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda acc, q: F.when(F.exists(acc, lambda a: iou(box_of(a), box_of(q)) >= least), acc).otherwise(F.array_append(acc, q)))
    return rows.join(items.select(*by, F.explode(kept).alias("k")).select("image", "k.ord"), ["image", "ord"], "left_semi")


def correct_from_error_crops(gt: DataFrame, pred: DataFrame, crops: DataFrame, target_class: int | None, dedup_iou: float | None = 0.5, replace: bool = False, delete_pred_none: bool = False) -> tuple[DataFrame, DataFrame]:
    """Named boxes get the class (or go); a prediction without a box is added.  Predictions are
    told by line number.

    With ``replace`` a box that is named with a prediction becomes that prediction (the best, if
    there are several): its box or polygon, its attributes if it has any, and its class where there
    is no ``target_class``.  Of replaced boxes of one class that overlap by ``dedup_iou`` the best
    stays and the others go."""
    named = error_crop_names(crops)
    use = named.where("valid")
    touched = use.where("g IS NOT NULL").select("image", (F.col("g") - 1).alias("ord"), "p")
    if not delete_pred_none:
        gone = touched if target_class is None else touched.where("false")
    else:
        gone = touched.where("p IS NULL") if target_class is not None else touched
    gone = gone.select("image", "ord").distinct()
    taken = [c for c in ("cx", "cy", "w", "h", "polygon", "attrs") if c in pred.columns and c in gt.columns]
    best = pred.select("image", F.col("line_no").alias("p"), *[F.col(c).alias(f"new_{c}") for c in (*taken, "class_id")], F.coalesce("confidence", F.lit(1.0)).alias("rank"))
    chosen = touched.join(best, ["image", "p"]).withColumn("r", F.row_number().over(Window.partitionBy("image", "ord").orderBy(F.desc("rank"), "p"))).where("r = 1").drop("r", "p")
    if replace:
        gone = gone.join(chosen.select("image", "ord"), ["image", "ord"], "left_anti")
        if dedup_iou is not None:
            boxes = chosen.select("image", "ord", F.col("new_class_id").alias("class_id"), F.col("rank").alias("confidence"), *[F.col(f"new_{c}").alias(c) for c in taken])
            boxes = seg_to_det(boxes) if "polygon" in taken else boxes
            gone = gone.union(boxes.join(dedup_additions(boxes, dedup_iou, ("image", "class_id")), ["image", "ord"], "left_anti").select("image", "ord"))
    marked = touched.select("image", "ord").distinct().withColumn("named", F.lit(True))
    out = gt.join(gone, ["image", "ord"], "left_anti").join(marked, ["image", "ord"], "left")
    if replace:
        out = out.join(chosen, ["image", "ord"], "left")
        new = F.col("new_class_id").isNotNull()
        put = {c: F.when(new, F.col(f"new_{c}")).otherwise(F.col(c)) for c in taken if c != "attrs"}
        if "attrs" in taken:
            put["attrs"] = F.when(new & (F.size("new_attrs") > 0), F.col("new_attrs")).otherwise(F.col("attrs"))
        if "confidence" in gt.columns:
            put["confidence"] = F.when(~new, F.col("confidence"))
        out = out.withColumns(put | {"class_id": F.coalesce("new_class_id", "class_id")})
    if target_class is not None:
        out = out.withColumn("class_id", F.when(F.col("named"), F.lit(target_class)).otherwise(F.col("class_id")))
    out = out.select(*gt.columns)
    adds = pred.join(use.where("g IS NULL AND p IS NOT NULL").select("image", F.col("p").alias("line_no")).distinct(), ["image", "line_no"], "left_semi")
    if dedup_iou is not None:
        adds = dedup_additions(adds, dedup_iou)
    if target_class is not None:
        last = gt.groupBy("image").agg((F.max("ord") + 1).alias("next"))
        adds = adds.withColumn("class_id", F.lit(target_class)).join(last, "image", "left")
        place = F.coalesce("next", F.lit(0)) + F.row_number().over(Window.partitionBy("image").orderBy("ord")) - 1
        adds = adds.withColumn("ord", place.cast("int")).withColumn("line_no", F.col("ord") + 1).withColumn("confidence", F.lit(None).cast("double"))
        out = out.unionByName(adds.drop("next"), allowMissingColumns=True).select(*gt.columns)
    action = F.when(~F.col("valid"), "invalid_name").when(F.col("g").isNull() & F.col("p").isNotNull(), "append").when(F.col("g").isNull(), "nothing").otherwise("update" if target_class is not None else "delete")
    return out, named.select("crop", "image", "p", "g", action.alias("outcome"))
