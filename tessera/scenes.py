"""A facade over a folder of scenes: several images of different modalities share one label."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import corners
from .operators import dataset as ds
from .operators import tables
from .sinks import files, pictures
from . import statistics
from .sources import images, labels, layout, multimodal
from .store import release, stored


class Scenes:
    """``image_dirs``: modality to folder under ``root``; ``suffixes``: what file stems of a
    modality (or of ``label``) have after the scene's name; ``required``: modalities that a
    complete scene needs (all, if not given); ``label_extension``: what label files end in.  Tables are read once; ``reload`` reads anew."""

    def __init__(self, spark: SparkSession, root: str, image_dirs: Mapping[str, str], suffixes: Mapping[str, str] | None = None, required: Sequence[str] | None = None, labels_dir: str = "labels", task: str = "auto", attribute_file: str | None = None, label_extension: str = ".txt"):
        unknown = (set(suffixes or ()) - {*image_dirs, "label"}) | (set(required or ()) - {*image_dirs})
        if unknown or "label" in image_dirs:
            raise ValueError(f"unknown or reserved modalities: {sorted(unknown) or ['label']}")
        self.spark, self.root, self.dirs, self.suffixes = spark, root, dict(image_dirs), dict(suffixes or {})
        self.required, self.labels_dir, self.task = tuple(required or image_dirs), labels_dir, task
        self.extension = f".{label_extension.lstrip('.')}"
        self.classes = layout.find_class_names(root)
        self.attributes = layout.attribute_schema(attribute_file) if attribute_file else {}
        self.scenes: DataFrame | None = None
        self.reload()

    def reload(self) -> None:
        if self.scenes is not None:
            release(self.scenes)
        found = {m: (labels.list_images(self.spark, os.path.join(self.root, d)), self.suffixes.get(m)) for m, d in self.dirs.items()}
        folder, suffix = os.path.join(self.root, self.labels_dir), self.suffixes.get("label")
        marks = labels.list_files(self.spark, folder, f"*{self.extension}").select(labels.stem(F.col("path")).alias("image"), "path")
        scenes, self.issues = multimodal.associate(found, marks, suffix, self.required)
        self.issues = self.issues.unionByName(multimodal.empty_parts(found, marks))
        self.scenes = stored(scenes, "scenes")
        ann = labels.read_labels(self.spark, folder, self.task, bool(self.attributes), suffix=self.extension)
        self.annotations = ann.withColumn("image", multimodal.scene_of(F.col("image"), suffix))

    def check(self) -> DataFrame:
        """Issues of the association and of the annotations: scene, code, level, modality."""
        own = ds.validate(self.annotations, len(self.classes) or None).select(F.col("image").alias("scene"), "code", "level", F.lit("label").alias("modality"))
        return self.issues.unionByName(own)

    def complete(self) -> DataFrame:
        return self.scenes.where("complete").select("scene")

    def view(self, modality: str, complete_only: bool = True) -> layout.Dataset:
        """One modality as a dataset of its own, with the shared annotations."""
        rows = multimodal.one_modality(self.scenes, modality, complete_only)
        pics = rows.select(F.col("scene").alias("image"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "label_path")
        return layout.Dataset(self.root, pics, self.annotations.join(pics.select("image"), "image", "left_semi"), self.classes, self.attributes)

    def headers(self, modality: str, complete_only: bool = True) -> DataFrame:
        """image (the scene) and the header of its picture."""
        heads = images.read_headers(self.spark, os.path.join(self.root, self.dirs[modality])).drop("image")
        return self.view(modality, complete_only).images.select("image", "path").join(heads, "path")

    def types(self) -> DataFrame:
        """How many pictures of each kind every modality has."""
        heads = [self.headers(m, False).withColumn("modality", F.lit(m)) for m in self.dirs]
        all_heads = heads[0]
        for h in heads[1:]:
            all_heads = all_heads.unionByName(h)
        kinds = ["modality", "format", "mode", "dtype", "bit_depth", "channels", "width", "height"]
        return all_heads.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))

    def stats(self) -> dict[str, DataFrame]:
        """Counts of the shared annotations, once, the picture types and the counts by modality."""
        names = self.spark.createDataFrame(list(enumerate(self.classes)), "class_id int, class_name string")
        return {
            "classes": ds.class_counts(self.annotations, names),
            "aspect": ds.histogram(self.annotations, F.col("w") / F.col("h")),
            "types": self.types(),
            "modalities": self.modality_counts(),
        }

    def modality_counts(self) -> DataFrame:
        """modality, image_count, missing_scene_count over the complete scenes, in which a modality that is
        not required may be missing."""
        whole = self.scenes.where("complete")
        has = [F.count(F.when(F.array_contains(F.map_keys("paths"), m), 1)).alias(f"n{k}") for k, m in enumerate(self.dirs)]
        counts = whole.agg(F.count(F.lit(1)).alias("n"), *has)
        cells = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"n{k}").alias("image_count"), (F.col("n") - F.col(f"n{k}")).alias("missing_scene_count")) for k, m in enumerate(self.dirs)])
        return counts.select(F.explode(cells).alias("c")).select("c.*")

    def modality_stats(self, modality: str) -> dict[str, DataFrame]:
        """The tables of one modality of the complete scenes, as of a dataset of its own."""
        view = self.view(modality)
        sizes = stored(self.headers(modality).select("image", "width", "height"), "sizes")
        return statistics.stats(view, sizes, view.images.select("image"), statistics.shared_schema(self.attributes))

    def stat_tables(self, modality: str, selected=None) -> dict[str, DataFrame]:
        """The table behind each selected statistic of one modality of the complete scenes."""
        return statistics.stat_tables(self.view(modality), self.headers(modality), statistics.shared_schema(self.attributes), selected)

    def write_stats(self, out: str | None = None, selected=None) -> dict[str, str]:
        """A folder for each modality, in it a CSV file for each selected statistic."""
        base = out or files.operation_dir(self.root, "stats", "tables")
        folders = {m: os.path.join(base, m) for m in self.dirs}
        for modality, folder in folders.items():
            statistics.write(self.stat_tables(modality, selected), folder)
        return folders

    def convert_to_uint8(
        self,
        out: str | None = None,
        modalities: Sequence[str] | None = None,
        stretch: bool = True,
        value_range: tuple[float, float] | None = None,
        preserve_zero: bool = True,
        overwrite: bool = False,
    ) -> DataFrame:
        """Writes all pictures of the modalities with values of 8 bits to a folder for each: those that have
        them are copied, others (PNG and TIFF) become PNG; see ``images.to_uint8`` for the values.
        Returns modality, image_count, converted_count, copied_uint8_count, out_dir."""
        chosen = [*self.dirs] if modalities is None else [*modalities]
        if unknown := [m for m in chosen if m not in self.dirs]:
            raise ValueError(f"unknown modalities: {', '.join(unknown)}")
        if value_range is not None and not -float("inf") < value_range[0] < value_range[1] < float("inf"):
            raise ValueError("a range has two finite ends, the second above the first")
        base, plans = os.path.abspath(out or files.operation_dir(self.root, "conversion", "uint8")), []
        for m in chosen:
            folder = os.path.abspath(os.path.join(self.root, self.dirs[m]))
            place = F.substring(files.local_path(F.col("path")), F.lit(len(folder) + 1), F.lit(1 << 30))
            place = F.when(F.col("dtype") != "uint8", F.regexp_replace(place, r"\.[^./]+$", ".png")).otherwise(place)
            heads = images.read_headers(self.spark, folder)
            plans.append(heads.select(F.lit(m).alias("modality"), "path", "dtype", F.concat(F.lit(f"{base}/{m}"), place).alias("target")))
        plan = plans[0]
        for more in plans[1:]:
            plan = plan.unionByName(more)
        plan = stored(plan, "uint8-plan")
        pictures.write_uint8(plan, overwrite, stretch=stretch, value_range=value_range, preserve_zero=preserve_zero)
        counts = plan.groupBy("modality").agg(F.count(F.lit(1)).alias("image_count"), F.count(F.when(F.col("dtype") != "uint8", 1)).alias("converted_count"))
        every = self.spark.createDataFrame([(m, f"{base}/{m}") for m in dict.fromkeys(chosen)], "modality string, out_dir string")
        rows = every.join(counts, "modality", "left").fillna(0)
        return rows.select("modality", "image_count", "converted_count", (F.col("image_count") - F.col("converted_count")).alias("copied_uint8_count"), "out_dir")

    def _sized(self, modality: str, complete_only: bool) -> DataFrame:
        sizes = self.headers(modality, complete_only).select("image", "width", "height")
        return self.annotations.join(sizes, "image").withColumns(corners())

    def draw(self, modality: str, least: float | None = None, show_confidence: bool = False, complete_only: bool = True) -> DataFrame:
        return tables.draw_list(self._sized(modality, complete_only), self.classes, least, show_confidence)

    def crop(self, modality: str, padding: int | float = 0, min_size: int = 1, complete_only: bool = True) -> DataFrame:
        return ds.crop_rects(self._sized(modality, complete_only), padding, min_size)
