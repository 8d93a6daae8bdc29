"""Scenes of several modalities: images that share a scene name and one label file."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scene_of(stem, suffix: str | None):
    """The stem without its configured suffix."""
    if not suffix:
        return stem
    return F.when(stem.endswith(suffix), F.substring(stem, F.lit(1), F.length(stem) - len(suffix))).otherwise(stem)


def associate(modalities: Mapping[str, tuple[DataFrame, str | None]], labels: DataFrame, label_suffix: str | None = None, required: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes, issues).  ``modalities``: name to (images: image, path; suffix).  A scene is
    complete if it has a label and exactly one image of each required modality."""
    required = tuple(modalities) if required is None else required
    parts = [df.select(scene_of(F.col("image"), s).alias("scene"), F.lit(m).alias("modality"), "path", F.lit(bool(s)) & ~F.col("image").endswith(s or "") if s else F.lit(False)) .toDF("scene", "modality", "path", "unmatched") for m, (df, s) in modalities.items()]
    files = reduce(DataFrame.union, parts)
    marks = labels.select(scene_of(F.col("image"), label_suffix).alias("scene"), F.lit("label").alias("modality"), F.col("path"), F.lit(False).alias("unmatched"))
    each = files.union(marks).groupBy("scene", "modality").agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path"), F.max("unmatched").alias("unmatched"))
    scenes = each.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("modality", "path"))).alias("paths"), F.map_from_entries(F.collect_list(F.struct("modality", "n"))).alias("counts"))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at("counts", F.lit(m)), F.lit(0)) == 1 for m in (*required, "label")])
    scenes = scenes.withColumn("complete", whole)
    lacks = F.array_except(F.array(*map(F.lit, required)), F.map_keys("paths"))
    image_less = F.size(F.array_except(F.map_keys("paths"), F.array(F.lit("label")))) == 0
    issues = [
        each.where("n > 1").select("scene", F.when(F.col("modality") == "label", "duplicate_scene_label").otherwise("duplicate_scene_image").alias("code"), F.lit("error").alias("level"), "modality"),
        each.where("unmatched").select("scene", F.lit("suffix_not_matched").alias("code"), F.lit("warning").alias("level"), "modality"),
        scenes.where(image_less).select("scene", F.lit("orphan_label").alias("code"), F.lit("warning").alias("level"), F.lit("label").alias("modality")),
        scenes.where(~F.array_contains(F.map_keys("paths"), "label")).select("scene", F.lit("orphan_image").alias("code"), F.lit("warning").alias("level"), F.lit(None).cast("string").alias("modality")),
        scenes.where(~image_less & (F.size(lacks) > 0)).select("scene", F.lit("missing_modality").alias("code"), F.lit("warning").alias("level"), F.array_join(lacks, ",").alias("modality")),
    ]
    return scenes, reduce(DataFrame.union, issues)


def empty_parts(modalities: Mapping[str, tuple[DataFrame, str | None]], labels: DataFrame) -> DataFrame:
    """Issues of modalities without any image and of a label folder without any label."""
    sides = [(m, "empty_modality", df) for m, (df, _) in modalities.items()] + [("label", "empty_labels", labels)]
    none = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("scene"), F.lit(code).alias("code"), F.lit("warning").alias("level"), F.lit(m).alias("modality"), "n") for m, code, df in sides]
    return reduce(DataFrame.union, none).where("n = 0").drop("n")


def one_modality(scenes: DataFrame, modality: str, complete_only: bool = True) -> DataFrame:
    """scene, path, label_path of one modality."""
    rows = scenes.where("complete") if complete_only else scenes
    return rows.select("scene", F.try_element_at("paths", F.lit(modality)).alias("path"), F.try_element_at("paths", F.lit("label")).alias("label_path")).where("path IS NOT NULL")
