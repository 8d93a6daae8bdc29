"""A facade over one dataset folder, and the registry of its tasks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import corners, letterbox
from .operators import dataset as ds
from .operators import corrections, tables
from .operators import evaluation as ev
from .sinks import files, reports, rewrite
from .sources import formats, images, labels, layout, places
from . import statistics
from .store import stored


class Manager:
    """Tasks on the dataset under ``root``; tables are lazy, results go where the caller says."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.root = spark, root
        self.data = layout.load(spark, root, **options)

    @property
    def classes(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.data.classes)), "class_id int, class_name string")

    # --- looking
    def layout_detect(self) -> str:
        return layout.detect(self.root)

    def layout_report(self) -> dict:
        return layout.report(self.spark, self.root)

    def check(self) -> DataFrame:
        issues = ds.validate(self.data.annotations, len(self.data.classes) or None)
        if self.data.orphans is not None:
            issues = issues.unionByName(self.data.orphans.select("image", F.lit(None).cast("int").alias("line_no"), F.lit("warning").alias("level"), F.lit("orphan_label").alias("code")))
        warned = lambda rows, code: rows.select("image", F.lit(None).cast("int").alias("line_no"), F.lit("warning").alias("level"), F.lit(code).alias("code"))
        if "path" in self.data.images.columns:
            issues = issues.unionByName(warned(tables.repeated_names(self.data.images), "duplicate_image_name"))
        return issues.unionByName(warned(self.data.images.join(self._labelled(), "image", "left_anti"), "missing_label"))

    def _labelled(self) -> DataFrame:
        """Images that have a label file, be it empty."""
        folder = self.data.labels_dir
        return labels.list_labels(self.spark, folder).select("image") if folder else self.data.annotations.select("image").distinct()

    def stats(self) -> dict[str, DataFrame]:
        """Counts, descriptions of all series, shape bins and attributes; polygons count by the
        boxes around them, sizes in pixels where an image's size is known."""
        return statistics.stats(self.data, self._sizes(), self._labelled(), self._schema())

    def _schema(self) -> dict:
        return statistics.shared_schema(self.data.attributes)

    def stat_tables(self, selected=None) -> dict[str, DataFrame]:
        """The table behind each selected statistic (a list of names or such a text; all: every one)."""
        return statistics.stat_tables(self.data, self._sizes(), self._schema(), selected)

    def write_stats(self, out: str | None = None, selected=None) -> list[str]:
        """A CSV file for each selected statistic."""
        return statistics.write(self.stat_tables(selected), out or files.operation_dir(self.root, "stats", "tables"))

    def _sizes(self) -> DataFrame:
        """image, width, height; images without a file have none."""
        if "path" not in self.data.images.columns:
            return self.data.images.select("image", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
        return self._headers().select("image", "width", "height")

    def _headers(self, whole: bool = False) -> DataFrame:
        """Headers of the dataset's pictures, of which only the first bytes are read."""
        return images.read_headers(self.spark, self.data.images, whole)

    def query_class(self, classes, out: str | None = None) -> DataFrame:
        return self._queried(ds.query_class(self.data.annotations, self.data.classes.ids(classes)), out)

    def query_attr(self, name: str, values=None, nonzero: bool = False, out: str | None = None) -> DataFrame:
        names = list(self.data.attributes)
        options = self.data.attributes[name]
        return self._queried(ds.query_attribute(self.data.annotations, names.index(name), options if isinstance(options, list) else None, values, nonzero), out)

    def _queried(self, rows: DataFrame, out: str | None) -> DataFrame:
        """The rows of a query, with ``out`` also as a CSV file."""
        if out:
            shown = reports.query_rows(rows, self.data.images, self.data.classes, self.data.attributes)
            reports.write_csv(shown.orderBy("image", "line_no"), out)
        return rows

    def duplicates(self, out: str | None = None) -> DataFrame:
        """Pictures of equal content.  Only those whose size others have too are read."""
        sized = stored(places.with_sizes(self.data.images.select("path")), "sizes")
        often = sized.groupBy("bytes").count().where("count > 1").select("bytes")
        hashed = stored(places.with_digests(sized.join(often, "bytes", "left_semi")), "digests")
        found = ds.repeated(hashed, "path")
        if out:
            reports.write_duplicates(found, out)
        return found

    def bad_images(self, out: str | None = None) -> DataFrame:
        issues = images.bad_images(self._headers(whole=True), self.data.images)
        if out:
            issues = stored(issues, "issues")
            reports.write_image_issues(issues, self.data.images, out)
        return issues

    # --- changing: each returns the edited table with its report
    def filter(self, predicate: Column | None = None, class_rules=None, **rule) -> DataFrame:
        """Annotations that pass a condition of one's own and the rules for geometry; rules of
        single classes (a mapping by name or id, or a file with one) replace the general one."""
        rows = self.data.annotations if predicate is None else self.data.annotations.where(predicate)
        if isinstance(class_rules, str):
            class_rules = layout.read_mapping(class_rules)
        if class_rules:
            class_rules = {self.data.classes.id(k): v for k, v in class_rules.items()}
        return ds.filter_geometry(rows, class_rules=class_rules, **rule)

    def delete_class(self, classes, **options):
        return ds.delete_class(self.data.annotations, self.data.classes, classes, **options)

    def replace_class(self, sources, target, **options):
        return ds.replace_class(self.data.annotations, self.data.classes, sources, target, **options)

    def merge_class(self, sources, target, **options):
        return ds.merge_classes(self.data.annotations, self.data.classes, sources, target, **options)

    def rename_class(self, old, new):
        return ds.rename_class(self.data.annotations, self.data.classes, old, new)

    def apply_map(self, **steps):
        return ds.apply_class_map(self.data.annotations, self.data.classes, **steps)

    def seg2det(self) -> DataFrame:
        return ds.seg_to_det(self.data.annotations)

    def pseudo(self, least: float = 0.0, **options) -> DataFrame:
        return ds.pseudo_labels(self.data.annotations, least, **options)

    def split(self, train_include=None, val_include=None, **shares) -> DataFrame:
        """Images with their split; names in the lists (tables, or text files) are forced."""
        listed = [layout.read_image_list(self.spark, x).select("name") if isinstance(x, str) else x for x in (train_include, val_include)]
        return ds.split_with_lists(self.data.images, *listed, **shares)

    def write(self, out: str, annotations: DataFrame | None = None, classes=None, images: DataFrame | None = None, attributes: dict | None = None, copy_images: bool = False, overwrite_images: bool = True, backup_dir: str | None = None, **options) -> None:
        """Label texts, class and attribute files and, with ``copy_images``, the images under
        their file names.  ``backup_dir`` gets the label files of before in a dated folder."""
        pics = images if images is not None else self.data.images
        ann = annotations if annotations is not None else self.data.annotations
        if backup_dir:
            self.backup_labels(backup_dir)
        # A label is named like its image's file.
        named = pics.select("image", labels.stem(F.col("file_name")).alias("stem"))
        texts = labels.label_texts(ann, pics, **options).join(named, "image").select(F.col("stem").alias("image"), "value")
        labels.write_texts(texts, os.path.join(out, "labels"))
        if copy_images and "path" in pics.columns:
            plan = pics.select(files.local_path(F.col("path")).alias("source"), F.concat(F.lit(os.path.join(out, "images") + "/"), "file_name").alias("target"))
            files.copy_files(plan, overwrite_images)
        layout.write_names(out, classes if classes is not None else self.data.classes)
        layout.write_attributes(out, attributes if attributes is not None else self.data.attributes)

    def select(self, names: DataFrame | str) -> DataFrame:
        """Images whose stem or file name is listed, in a table (name) or a text file."""
        return ds.select_images(self.data.images, layout.read_image_list(self.spark, names).select("name") if isinstance(names, str) else names)

    def merge(self, *others: Manager | str, **options):
        """Images, annotations, class names and attributes of this dataset and others (or their
        folders) together; attributes of all stand at the places of the common schema."""
        others = [Manager(self.spark, m, attribute_file=layout.attribute_file(m)) if isinstance(m, str) else m for m in others]
        parts = (self, *others)
        schemas = [m.data.attributes for m in parts]
        return (*ds.merge_datasets([(m.data.images, m.data.annotations, m.data.classes) for m in parts], schemas=schemas, **options), ds.merge_attributes(schemas, extend=True))

    def write_yaml(self, out: str | None = None, **options) -> None:
        layout.write_names(out or self.root, self.data.classes, **options)

    def write_splits(self, out: str | None = None, **shares) -> DataFrame:
        """Split lists in ``out``; those of before move to a dated folder next to them."""
        files.backup_splits(out or self.root, os.path.join(out or self.root, "split_backup"))
        parts = stored(self.split(**shares), "splits")
        files.write_splits(parts, out or self.root)
        return parts

    def backup_labels(self, folder: str | None = None) -> int:
        plan = stored(files.backup_plan(self.data.annotations.select("label_path"), self.root, folder), "backup")
        files.copy_files(plan)
        return plan.count()

    def fill_missing_labels(self) -> int:
        return files.fill_missing_labels(self.data.images, self._labelled(), self.data.labels_dir or os.path.join(self.root, "labels"))

    def rewrite(self, annotations: DataFrame, classes=None) -> int:
        """Turns the label files into those of ``annotations`` (this dataset's after an edit) where
        they lie; how many changed.  See ``sinks.rewrite``: all files or none."""
        texts = {} if classes is None or [*classes] == [*self.data.classes] else layout.class_texts(self.root, classes)
        return rewrite.rewrite(self.spark, self.root, stored(rewrite.line_edits(self.data.annotations, annotations), "edits"), texts)

    def recover(self) -> dict[str, str]:
        """Ends the rewrites that were cut short."""
        return rewrite.recover(self.spark, self.root)

    def set_attr(self, name: str, value: float, classes=None, where_value: float | None = None):
        ids = None if classes is None else self.data.classes.ids(classes)
        out, report = ds.set_attribute(self.data.annotations, list(self.data.attributes).index(name), value, ids, where_value)
        return out, report.withColumn("attr_name", F.lit(name))

    def delete_attr(self, name: str, values=None, nonzero: bool = False):
        out, report = ds.delete_by_attribute(self.data.annotations, list(self.data.attributes).index(name), values, nonzero)
        return out, report.withColumn("attr_name", F.lit(name))

    def _crops(self, folder: str) -> DataFrame:
        return labels.list_images(self.spark, folder).select(F.col("image").alias("crop"))

    def _target(self, target) -> int | None:
        return None if target is None or str(target).lower() in ("none", "null") else self.data.classes.id(target)

    def correct_from_crops(self, crops: str, target):
        """The boxes that the crops in a folder name get the class ``target`` (none: go)."""
        return corrections.correct_from_crops(self.data.annotations, self._crops(crops), self._target(target), self.data.images, self._labelled())

    def correct_from_error_crops(self, crops: str, target, pred: str, **options):
        return corrections.correct_from_error_crops(self.data.annotations, layout.load(self.spark, pred).annotations, self._crops(crops), self._target(target), **options)

    # --- drawing: tables of what to draw or cut, in pixels
    def _sized(self, images_only: bool = False) -> DataFrame:
        sizes = self._sizes()
        pics = self.data.images.drop("width", "height").join(sizes, "image", "left")
        return pics if images_only else self.data.annotations.join(sizes, "image")

    def draw(self, least: float | None = None, show_confidence: bool = False, limit: int | None = None) -> DataFrame:
        """What to draw on each image, or on the first ``limit`` ones by name."""
        rows = self._sized()
        if limit is not None:
            rows = rows.join(self.data.images.select("image").distinct().orderBy("image").limit(limit), "image", "left_semi")
        return tables.draw_list(rows.withColumns(corners()), self.data.classes, least, show_confidence)

    def crop(self, padding: int | float = 0, min_size: int = 1, by_attribute: bool = False) -> DataFrame:
        """Crop rectangles, each with its class name; ``by_attribute`` gives a row for each
        attribute of a box that does not mean none as well (null for the box itself)."""
        rows = self._sized().withColumns(corners())
        rects = ds.crop_rects(rows, padding, min_size).withColumn("class_name", ds.class_name(self.data.classes))
        schema = self._schema()
        if not by_attribute or not schema:
            return rects
        cells = [F.when(ds.has_value(k, o), F.struct(F.lit(n).alias("attribute"), ds.decoded(k, o).alias("value"))) for k, (n, o) in enumerate(schema.items())]
        none = F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"))
        each = rows.select("image", "ord", F.explode(F.concat(F.array(none), F.array_compact(F.array(*cells)))).alias("a")).select("image", "ord", "a.*")
        return rects.join(each, ["image", "ord"])

    def manual_box(self, image: str, min_pixels: int = 2) -> DataFrame:
        """The boxes of one image that are large enough to be worked on, as lines of its label."""
        found = tables.find_image(self.data.images, image)
        names = [r.path for r in found.select("path").orderBy("path").limit(6).collect()]
        if len(names) != 1:
            raise ValueError(f"no image fits {image!r}" if not names else f"several images fit {image!r}: {', '.join(names[:5])}")
        rows = self._sized().join(found.select("image"), "image", "left_semi")
        return ds.filter_pixels(rows, min_pixels).select("image", "ord", labels.to_line().alias("line"))

    def resize(self, width: int | None = None, height: int | None = None, scale: float | None = None, keep_ratio: bool = True, out: str | None = None) -> DataFrame:
        """Target sizes and, with ``out``, the labels of the resized images; their pixels are
        left to others.  Both sides and ``keep_ratio`` mean a letterbox, whose labels move with
        the picture; otherwise normalised labels stay as they are."""
        w, h = tables.resize_target(F.col("width"), F.col("height"), width, height, scale)
        if out:
            self.write(out, self._letterboxed(width, height) if keep_ratio and width and height and scale is None else None)
        return self._sized(True).select("image", "width", "height", w.alias("to_width"), h.alias("to_height"))

    def _letterboxed(self, width: int, height: int) -> DataFrame:
        known = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width")).otherwise(F.raise_error(F.concat(F.lit("no size is known of image "), "image")).cast("int"))
        rows = self._sized().withColumn("width", known)
        rows = rows.withColumns(letterbox(F.col("width"), F.col("height"), width, height))
        moved = {"cx": F.col("cx") * F.col("sx") + F.col("ox"), "cy": F.col("cy") * F.col("sy") + F.col("oy"), "w": F.col("w") * F.col("sx"), "h": F.col("h") * F.col("sy")}
        points = F.transform("polygon", lambda q: F.struct((q["x"] * F.col("sx") + F.col("ox")).alias("x"), (q["y"] * F.col("sy") + F.col("oy")).alias("y")))
        return rows.withColumns(moved | {"polygon": points}).select(*self.data.annotations.columns)

    # --- evaluating: predictions are another dataset or a folder of label files
    def _sides(self, pred: str, classes=None, exclude=None, min_confidence: float = 0.0, min_pixels: float | None = None, merge=None, compact: bool = True, class_rules=None, stems=None, with_sizes: bool = False, **rule):
        """Both sides as boxes (polygons by the boxes around them) after merges and filters, and
        the class names then; class ids and names are those after merging."""
        stems = layout.read_stems(self.spark, stems) if isinstance(stems, str) else stems
        gt, other, names = self.data.annotations, layout.load(self.spark, pred, stems=stems).annotations, self.data.classes
        if stems is not None:
            gt = gt.join(stems.select("image").distinct(), "image", "left_semi")
        if merge:
            gt, other, names = tables.merged_sides(gt, other, names, layout.read_mapping(merge) if isinstance(merge, str) else merge, compact)
        sized = with_sizes or min_pixels is not None or bool(class_rules)
        gt, other = (ds.seg_to_det(x) for x in (gt, other))
        if sized:
            sizes = stored(self._sizes(), "sizes")
            gt, other = (x.join(sizes, "image", "left") for x in (gt, other))
        ids = None if classes is None else [k for k in names.ids(classes) if k not in (names.ids(exclude) if exclude is not None else [])]
        rules = layout.read_mapping(class_rules) if isinstance(class_rules, str) else class_rules
        rules = {names.id(k): v for k, v in (rules or {}).items()}
        gt, other = tables.evaluation_filter(gt, other, ids, names.ids(exclude) if exclude is not None else None, min_confidence, min_pixels, rules, **rule)
        gt, other = (x.withColumns(corners()) for x in (gt, other))
        return (*map(tables.with_size, (gt, other)), names, ids) if with_sizes else (gt, other, names, ids)

    def eval_compare(self, pred: str, out: str | None = None, iou_threshold: float = 0.5, confidence_threshold: float | None = None, **options) -> DataFrame:
        """The comparison; with ``out`` also as compare.csv."""
        gt, other, names, _ = self._sides(pred, **options)
        rows = ev.compare(gt, other, iou_threshold, confidence_threshold)
        if out:
            reports.write_csv(reports.compare_rows(rows, names), os.path.join(out, "compare.csv"))
        return rows

    def eval_metrics(self, pred: str, nms_iou: float | None = 0.5, thresholds=ev.THRESHOLDS, include_empty: bool = False, sizes: bool = False, out: str | None = None, **options) -> DataFrame:
        """A row for each class, and for each selected one without any box.  With ``out`` the
        reports are written: class rows, totals, the table as text and, with ``sizes``, sizes."""
        rows, macro, by_size, names, ids = self._metrics(pred, nms_iou, thresholds, include_empty, sizes, **options)
        if out:
            about = {"selected_class_ids": ids, "iou_thresholds": [*thresholds], "nms_iou": nms_iou, "ignore_empty_classes": not include_empty}
            reports.write_metrics(rows if include_empty else rows.where("labels > 0"), macro, names, out, by_size, about)
        return rows

    def _metrics(self, pred: str, nms_iou=0.5, thresholds=ev.THRESHOLDS, include_empty: bool = False, sizes: bool = False, **options):
        gt, other, names, ids = self._sides(pred, with_sizes=sizes, **options)
        gt, other = stored(gt, "gt"), stored(other, "pred")
        rows = ev.class_metrics(gt, other, nms_iou, thresholds)
        if ids is not None:
            chosen = self.spark.createDataFrame([(k,) for k in sorted(set(ids))], "class_id int")
            rows = chosen.join(rows, "class_id", "left").fillna(0)
        rows = stored(rows, "metrics")
        macro = ev.macro_metrics(rows, not include_empty).withColumn("images", F.lit(self.data.images.count()))
        return rows, macro, ev.size_metrics(gt, other, nms_iou, thresholds, not include_empty) if sizes else None, names, ids

    def eval_size_metrics(self, pred: str, nms_iou: float | None = 0.5, thresholds=ev.THRESHOLDS, include_empty: bool = False, **options) -> DataFrame:
        gt, other, *_ = self._sides(pred, with_sizes=True, **options)
        return ev.size_metrics(gt, other, nms_iou, thresholds, not include_empty)

    def eval_error_analysis(self, pred: str, match_iou: float = 0.5, low_iou: float = 0.1, nms_iou: float | None = 0.5, duplicate_iou: float = 0.9, out: str | None = None, **options) -> DataFrame:
        """A row for each match and error; with ``out`` also the report files, the confusion
        matrix and the labels that all but coincide."""
        gt, other, names, _ = self._sides(pred, **options)
        found = ev.errors(gt, other, match_iou, low_iou, nms_iou)
        if out:
            found, gt, kept = stored(found, "errors"), ev.reindex(gt), ev.reindex(ev.suppress(other, nms_iou))
            reports.write_errors(reports.error_rows(found, gt, kept, names), out)
            reports.write_csv(ev.confusion(found), os.path.join(out, "confusion_matrix.csv"))
            reports.write_csv(reports.duplicate_rows(ev.duplicate_labels(gt, duplicate_iou), gt, names), os.path.join(out, "duplicate_gt.csv"))
        return found

    def eval_review_pack(self, pred: str, out: str | None = None, copy_images: bool = True, copy_texts: bool = False, **options) -> DataFrame:
        """The errors by review group and crop name.  With ``out`` each group is a folder with
        its rows and, if they exist, its images; all groups are written together.  ``copy_texts``
        adds the predictions' label files of the images reviewed, in ``pred_txt``."""
        rows = tables.review_crop_name(ev.review_group(self.eval_error_analysis(pred, **options)))
        if out:
            rows = stored(rows, "review")
            reports.write_csv_groups(rows, out, F.col("review_group"), ["image", "g", "p"])
            if copy_images:
                self._copy_reviewed(rows.select("image", F.col("review_group").alias("folder")), out)
            if copy_texts:
                self._copy_texts(pred, rows, os.path.join(out, "pred_txt"))
        return rows

    def eval_compare_pack(self, pred: str, out: str, statuses=("fp", "fn"), copy_images: bool = True, copy_texts: bool = False, **options) -> dict[str, int]:
        """A folder for each of the statuses with its rows of the comparison and its images; how
        many rows each has."""
        gt, other, names, _ = self._sides(pred, **{k: v for k, v in options.items() if k not in ("iou_threshold", "confidence_threshold")})
        chosen = {k: options[k] for k in ("iou_threshold", "confidence_threshold") if k in options}
        rows = reports.compare_rows(ev.compare(gt, other, **chosen).where(F.col("status").isin(*statuses)), names)
        rows = stored(rows.withColumn("folder", F.col("status")), "review")
        written = reports.write_csv_groups(rows, out, F.col("folder"), ["image", "gt_line", "pred_line", "class_id"], columns=reports.COMPARE)
        if copy_images:
            self._copy_reviewed(rows.select("image", "folder"), out)
        if copy_texts:
            self._copy_texts(pred, rows, os.path.join(out, "pred_txt"))
        return {r.file.split("/")[0]: r.lines for r in written.collect()}  # one for each status

    def _copy_reviewed(self, rows: DataFrame, out: str) -> None:
        """The images of ``rows`` (image, folder), each once in its folder's ``images``."""
        if "path" in self.data.images.columns:
            pics = self.data.images.select("image", files.local_path(F.col("path")).alias("source"), "file_name")
            target = F.concat(F.lit(f"{out}/"), "folder", F.lit("/images/"), "file_name")
            files.copy_files(rows.distinct().join(pics, "image").select("source", target.alias("target")))

    def _copy_texts(self, pred: str, rows: DataFrame, folder: str) -> None:
        """The predictions' label files of the images of ``rows``."""
        texts = layout.load(self.spark, pred).labels_dir
        if texts:
            listed = labels.list_labels(self.spark, texts).join(rows.select("image").distinct(), "image", "left_semi")
            target = F.concat(F.lit(f"{folder}/"), F.element_at(F.split("label_path", "/"), -1))
            files.copy_files(listed.select(F.col("label_path").alias("source"), target.alias("target")))

    def copy_query(self, rows: DataFrame, out: str) -> int:
        """Copies images and label files of a query's rows into a folder; how many images."""
        pics = stored(self.data.images.join(rows.select("image").distinct(), "image", "left_semi"), "query")
        ann = self.data.annotations.join(pics.select("image"), "image", "left_semi")
        self.write(out, ann, images=pics, copy_images=True)
        return pics.count()

    def labels_with_class(self, classes) -> DataFrame:
        """image, label_path of label files that hold one of the classes."""
        rows = self.query_class(classes)
        return rows.select("image", *[c for c in ("label_path",) if c in rows.columns]).distinct()

    def eval_metrics_text(self, pred: str, sizes: bool = False, **options) -> str:
        rows, macro, by_size, names, _ = self._metrics(pred, sizes=sizes, **options)
        return reports.metrics_text(rows, macro, names, by_size)

    def eval_merged_metrics(self, pred: str, merges, compact: bool = True, **options) -> tuple[DataFrame, ds.Classes]:
        rows, _, _, names, _ = self._metrics(pred, merge=merges, compact=compact, **options)
        return rows, names

    def export_xany(self, out: str) -> None:
        pics = self.data.images.join(self._sizes(), "image")
        labels.write_texts(formats.xany_documents(pics, self.data.annotations, self.classes, self._schema()), out, ".json")

    def export_coco(self, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The three tables of a COCO document, written to ``path`` where there is one."""
        out = formats.coco_tables(self._sized(True), self.data.annotations, self.classes)
        if path:
            reports.write_coco(*out, path)
        return out


def import_tables(reader: Callable, out: str | None = None):
    """A task that reads another format and, with ``out``, writes it as a dataset."""

    def run(spark: SparkSession, *args, out: str | None = out, **options):
        pics, ann, classes = reader(spark, *args, **options)
        if out:
            labels.write_texts(labels.label_texts(full(ann), pics), os.path.join(out, "labels"))
            layout.write_names(out, [r.class_name for r in classes.orderBy("class_id").collect()])
        return pics, ann, classes

    return run


def labelme(spark: SparkSession, path: str, class_names=None, **options):
    class_names = formats.labelme_names(spark, path) if class_names is None else class_names
    pics, ann = formats.read_labelme(spark, path, class_names, **options)
    return pics, ann, spark.createDataFrame(list(enumerate(class_names)), "class_id int, class_name string")


def full(ann: DataFrame) -> DataFrame:
    """With the columns that label lines need."""
    lacks = {"polygon": labels.POINT, "attrs": "array<double>", "confidence": "double"}
    return ann.withColumns({c: F.lit(None).cast(t) for c, t in lacks.items() if c not in ann.columns})


def written(group: str, operation: str, method: Callable) -> Callable:
    """A task whose result is written as a dataset: labels, class and attribute files and images,
    with the report of an edit and a copy of the label files of before.

    ``out`` is the folder (by default one below the dataset's), ``dry_run`` writes nothing.
    ``in_place`` edits the dataset's own label files instead, where only the tokens that change are
    touched (after a copy, if ``backup_dir`` is given), and returns how many files changed and the
    edit's report."""

    def run(m: Manager, *args, out: str | None = None, dry_run: bool = False, copy_images: bool = True, backup_dir: str | None = None, include_confidence: bool = False, keep_empty: bool = True, report: str | None = None, in_place: bool = False, **options):
        if in_place and group != "annotation":
            raise ValueError(f"{operation} makes another dataset: it has no in_place")
        result = method(m, *args, **options)
        if dry_run:
            return result
        parts = result if isinstance(result, tuple) else (result,)
        ann, pics, names, changes, attributes = None, None, m.data.classes, None, None
        if operation == "merge":
            pics, ann, names, attributes = parts
        elif operation == "select":
            pics, ann = parts[0], m.data.annotations.join(parts[0].select("image").distinct(), "image", "left_semi")
        else:
            ann = parts[0]
            names = next((x for x in parts[1:] if isinstance(x, ds.Classes)), names)
            changes = next((x for x in parts[1:] if isinstance(x, DataFrame)), None)
        if in_place:
            if backup_dir:
                m.backup_labels(backup_dir)
            changes = changes if changes is None else stored(changes, "report")  # of the files as they were
            return m.rewrite(ann, names), changes
        folder = out or files.operation_dir(m.root, group, operation)
        m.write(folder, ann, names, pics, attributes, copy_images=copy_images, backup_dir=backup_dir or os.path.join(folder, "labels_backup"), include_confidence=include_confidence, keep_empty=keep_empty)
        if changes is not None:
            # A report has the ids from before unused classes are taken out.
            known = names if operation in ("rename_class", "apply_map") else [*m.data.classes, *(n for n in names if n not in m.data.classes)]
            rows = reports.edit_rows(changes, m.data.classes, known) if "old_class" in changes.columns and "operation" in changes.columns else changes
            reports.write_csv(rows, report or os.path.join(folder, "report.csv"))
        return result

    return run


def run_task(spark: SparkSession, task: str, root: str, *args, **options):
    """A task by its name: on the dataset at ``root``, or on the file that an import reads."""
    if task not in TASKS:
        raise KeyError(f"unknown task {task!r}; there are {', '.join(sorted(TASKS))}")
    if task.startswith("import."):
        return TASKS[task](spark, root, *args, **options)
    return TASKS[task](Manager(spark, root, attribute_file=options.pop("attribute_file", None)), *args, **options)


def normalised(m: Manager, out: str | None = None, copy_images: bool = True, **options) -> None:
    """The dataset in the flat layout: images, labels, class and attribute files."""
    m.write(out or files.operation_dir(m.root, "dataset", "normalize"), copy_images=copy_images, **options)


#: Task names and the methods that do them.
TASKS: dict[str, Callable] = {
    "check": Manager.check, "stats": Manager.stats, "layout.detect": Manager.layout_detect, "query.class": Manager.query_class, "query.attr": Manager.query_attr,
    "dataset.filter": written("dataset", "filter", Manager.filter), "dataset.split": Manager.write_splits, "dataset.duplicates": Manager.duplicates, "dataset.bad_images": Manager.bad_images, "dataset.normalize": normalised,
    "ann.delete_class": written("annotation", "delete_class", Manager.delete_class), "ann.replace_class": written("annotation", "replace_class", Manager.replace_class), "ann.merge_class": written("annotation", "merge_class", Manager.merge_class), "ann.rename_class": written("annotation", "rename_class", Manager.rename_class), "ann.apply_map": written("annotation", "apply_map", Manager.apply_map),
    "convert.seg2det": written("conversion", "seg2det", Manager.seg2det), "convert.pseudo": written("conversion", "pseudo", Manager.pseudo), "export.coco": Manager.export_coco, "export.xany": Manager.export_xany,
    "dataset.select": written("dataset", "select", Manager.select), "dataset.merge": written("dataset", "merge", Manager.merge), "dataset.yaml": Manager.write_yaml, "ann.set_attr": written("annotation", "set_attr", Manager.set_attr), "ann.delete_attr": written("annotation", "delete_attr", Manager.delete_attr),
    "ann.correct_from_crops": written("annotation", "correct_from_crops", Manager.correct_from_crops), "ann.correct_from_error_crops": written("annotation", "correct_from_error_crops", Manager.correct_from_error_crops), "convert.resize": Manager.resize,
    "vis.draw": Manager.draw, "vis.crop": Manager.crop, "vis.manual_box": Manager.manual_box,
    "import.coco": import_tables(formats.read_coco), "import.voc": import_tables(formats.read_voc), "import.labelme": import_tables(labelme), "import.mask": import_tables(formats.read_masks), "import.tt100k": import_tables(formats.import_tt100k),
    "eval.compare": Manager.eval_compare, "eval.metrics": Manager.eval_metrics, "eval.error_analysis": Manager.eval_error_analysis, "eval.review_pack": Manager.eval_review_pack, "eval.compare_pack": Manager.eval_compare_pack, "ann.recover": Manager.recover,
}
