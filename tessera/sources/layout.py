"""Dataset folders: which layout they have, their class names, and loading them as tables."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import Classes
from . import places
from .labels import ANNOTATION, is_image, label_path_of, list_files, list_images, list_labels, read_labels, stem

SPLITS = ("train", "val", "test")  # fixed values
LAYOUTS = ("image_list", "split_dirs", "flat", "mixed")  # fixed values
#: Texts that are no labels where they lie beside pictures.
ROLES = ("class.txt", "classes.txt", *(f"{s}.txt" for s in SPLITS))
CLASS_SOURCES = ("class.txt", "classes.txt", "dataset.yaml", "data.yaml")  # fixed values


def detect(root: str) -> str:
    """image_list, split_dirs, flat, mixed or unknown."""
    has = lambda *p: os.path.exists(os.path.join(root, *p))
    if any(has(f"{s}.txt") for s in SPLITS):
        return "image_list"
    if has("images") and has("labels"):
        return "split_dirs" if any(has("images", s) for s in SPLITS) else "flat"
    return "mixed" if os.path.isdir(root) and any(files for _, _, files in os.walk(root)) else "unknown"


def class_names(path: str) -> Classes:
    """Names of a text file (one on a line) or of a YAML's ``names`` (list, or map by id)."""
    with open(path, encoding="utf-8") as f:
        if not path.endswith((".yaml", ".yml")):
            return Classes(line.strip() for line in f if line.strip())
        names = (yaml.safe_load(f) or {}).get("names", [])
    return Classes(str(names[k]) for k in sorted(names, key=int)) if isinstance(names, dict) else Classes(map(str, names))


def eval_class_names(path: str) -> Classes:
    """Lines may also be ``id name``; ids between are named by their number."""
    if path.endswith((".yaml", ".yml")):
        return class_names(path)
    rows = [r.split(None, 1) for r in class_names(path)]
    if not rows or not all(len(r) == 2 and r[0].isdigit() for r in rows):
        return class_names(path)
    known = {int(k): n for k, n in rows}
    return Classes(known.get(k, str(k)) for k in range(max(known) + 1))


def find_class_names(root: str) -> Classes:
    source = class_source(root)
    return class_names(source) if source else Classes()


def class_source(root: str) -> str | None:
    """The file that names the classes of a dataset, or of a YAML file that stands for one."""
    if os.path.isfile(root):
        return root
    return next((p for name in CLASS_SOURCES if os.path.exists(p := os.path.join(root, name))), None)


def read_dataset_yaml(path: str) -> dict:
    """All that a dataset's YAML file says; empty where there is nothing in it."""
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    if not isinstance(doc, dict):
        raise ValueError(f"{path} is no mapping")
    return doc


def _placed(value, base: str) -> str:
    """A path of a YAML file, with variables and a home folder put in, below ``base``."""
    text = os.path.expanduser(os.path.expandvars(str(value)).strip())
    return os.path.normpath(text if os.path.isabs(text) else os.path.join(base, text))


def dataset_root(path: str) -> str:
    """The folder of a dataset; a YAML file may name it (``path``, relative to the file)."""
    if not os.path.isfile(path):
        return path
    return _placed(read_dataset_yaml(path).get("path") or ".", os.path.dirname(os.path.abspath(path)))


def dataset_part(path: str, split: str) -> str | None:
    """The list or folder that a dataset's YAML file names for a split (the first of several), below
    the dataset or beside the file."""
    value = read_dataset_yaml(path).get(split) if os.path.isfile(path) else None
    value = next((v for v in value if v is not None), None) if isinstance(value, list) else value
    if value is None:
        return None
    places_ = [_placed(value, base) for base in (dataset_root(path), os.path.dirname(os.path.abspath(path)))]
    return next((p for p in places_ if os.path.exists(p)), places_[0] if places_[0].endswith(".txt") else None)


def report(spark: SparkSession, root: str) -> dict:
    """What a folder holds: its layout, folders, split lists, splits, numbers of files, classes."""
    root = dataset_root(root)
    kind, names = detect(root), find_class_names(root)
    at = lambda d: p if os.path.isdir(p := os.path.join(root, d)) else None
    pics, texts = (root, root) if kind == "mixed" else (at("images"), at("labels"))
    lists = [p for s in SPLITS if os.path.exists(p := os.path.join(root, f"{s}.txt"))]
    splits = [s for s in SPLITS if any(d and os.path.isdir(os.path.join(d, s)) for d in (pics, texts))]
    images = list_images(spark, pics).count() if pics else 0
    if kind == "image_list":
        splits = [s for s in SPLITS if os.path.join(root, f"{s}.txt") in lists]
        images = read_image_list(spark, *lists).count()
    n_labels = list_files(spark, texts, "*.txt").count() if texts else 0
    return {
        "layout": kind, "root": root, "images_dir": pics, "labels_dir": texts, "split_files": lists, "splits": splits, "image_count": images, "label_count": n_labels,
        "class_source": class_source(root), "class_count": len(names), "classes": list(names),
    }


def write_attributes(root: str, attributes: dict | None) -> None:
    """attribute.yaml, if there are attributes."""
    if attributes:
        os.makedirs(root, exist_ok=True)
        with open(os.path.join(root, "attribute.yaml"), "w", encoding="utf-8") as f:
            yaml.safe_dump({"attributes": attributes}, f, sort_keys=False, allow_unicode=True)


def read_stems(spark: SparkSession, source: str) -> DataFrame:
    """image: the stems that a text file lists, or those of the images or labels in a folder."""
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    if os.path.isdir(source):
        files = list_files(spark, source)
        named = files.where(is_image(F.col("path")) | F.lower("path").endswith(".txt")).select(stem(F.col("path")).alias("image"))
    else:
        named = read_image_list(spark, source).select(stem(F.col("name")).alias("image"))
    return named.distinct()


def attribute_schema(path: str) -> dict:
    """Attribute options by name, or by class and name; every scalar stays a text."""
    with open(path, encoding="utf-8") as f:
        doc = yaml.load(f, Loader=yaml.BaseLoader) or {}
    return doc.get("attributes", doc)


def read_mapping(path_or_text: str) -> dict:
    """A mapping (class rules, a merge map) in a JSON or YAML file, or given as such text."""
    if os.path.exists(path_or_text):
        with open(path_or_text, encoding="utf-8") as f:
            path_or_text = f.read()
    doc = yaml.safe_load(path_or_text)  # JSON is YAML
    if not isinstance(doc, dict):
        raise ValueError("a mapping is needed")
    return doc


def write_names(root: str, names: Sequence[str], train="images", val="images", test: str | None = None) -> None:
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "class.txt"), "w", encoding="utf-8") as f:
        f.writelines(f"{n}\n" for n in names)
    doc = {"train": train, "val": val, "nc": len(names), "names": [*names]} | ({"test": test} if test else {})
    with open(os.path.join(root, "dataset.yaml"), "w", encoding="utf-8") as f:
        yaml.safe_dump(doc, f, sort_keys=False, allow_unicode=True)


def class_texts(root: str, names: Sequence[str]) -> dict[str, str]:
    """The file that names the classes of a dataset, as it is with other names (by its place below
    the root): other lines of a YAML file stay."""
    source = class_source(root) or os.path.join(root, CLASS_SOURCES[0])
    if not source.endswith((".yaml", ".yml")):
        return {os.path.relpath(source, root): "".join(f"{n}\n" for n in names)}
    with open(source, encoding="utf-8") as f:
        doc = (yaml.safe_load(f) or {}) | {"nc": len(names), "names": [*names]}
    return {os.path.relpath(source, root): yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)}


def attribute_file(root: str) -> str | None:
    """The attribute schema that lies beside a dataset's folders."""
    return p if os.path.exists(p := os.path.join(dataset_root(root), "attribute.yaml")) else None


def read_image_list(spark: SparkSession, *paths: str, root: str | None = None) -> DataFrame:
    """file_no, line_no, name, path of every line that is not blank: the lists' order and repeats
    are in the numbers, relative paths lie under ``root`` (as they are without it)."""
    return places.read_list(spark, [*paths], root)


@dataclass
class Dataset:
    """Tables of a corpus: images, annotations and orphan labels are lazy."""

    root: str
    images: DataFrame
    annotations: DataFrame
    classes: Classes
    attributes: dict
    orphans: DataFrame | None = None
    images_dir: str | None = None
    labels_dir: str | None = None


def load(spark: SparkSession, root: str, images_dir: str = "images", labels_dir: str = "labels", task: str = "auto", layout: str = "auto", split_file: str | None = None, attribute_file: str | None = None, only_val: bool = False, stems: DataFrame | str | None = None) -> Dataset:
    """Images joined to labels by stem; a bare folder of label files has images without a file,
    and only the files of the folder itself.  ``root`` may be a YAML file that names its folder.

    ``only_val`` keeps the validation part: what val.txt lists, or what lies in a folder val;
    ``stems`` (image, or a list or folder to read them from) keeps the images of these stems."""
    given, root = root, dataset_root(root)
    layout = detect(root) if layout == "auto" else layout
    if layout not in (*LAYOUTS, "unknown"):
        raise ValueError(f"unknown layout {layout!r}; there are {', '.join(LAYOUTS)}")
    attributes = attribute_schema(attribute_file) if attribute_file else {}
    stems = read_stems(spark, stems) if isinstance(stems, str) else stems
    pics, texts = os.path.join(root, images_dir), os.path.join(root, labels_dir)
    if not os.path.isdir(pics) and not os.path.isdir(texts):
        # Pictures and texts side by side, if there are pictures; else a folder of label files.
        if layout == "mixed" and not list_images(spark, root).isEmpty():
            pics = texts = root
        else:
            ann = read_labels(spark, root, task, bool(attributes), stems=stems, recursive=False)
            bare = ann.select("image").distinct().withColumn("file_name", F.concat("image", F.lit(".jpg")))
            return Dataset(root, bare, ann, find_class_names(given), attributes, labels_dir=root)
    images = list_images(spark, pics)
    if stems is not None:
        images = images.join(stems.select("image").distinct(), "image", "left_semi")
    images = images.withColumn("label_path", label_path_of(F.col("path"))).withColumn("split", F.coalesce(*[F.when(F.col("path").contains(f"/{s}/"), s) for s in SPLITS]))
    wanted = [split_file] if split_file else [p for s in SPLITS if layout == "image_list" and os.path.exists(p := os.path.join(root, f"{s}.txt"))]
    if only_val and not split_file:
        named = dataset_part(given, "val")
        if named and os.path.isdir(named):
            listed = list_images(spark, named).select("image")
            listed = listed if stems is None else listed.join(stems.select("image"), "image", "left_semi")
            part = load(spark, root, images_dir, labels_dir, task, layout, attribute_file=attribute_file, stems=listed)
            part.classes = find_class_names(given)
            return part
        wanted = [p] if (p := named or os.path.join(root, "val.txt")) and os.path.exists(p) else []
        if not wanted and not os.path.isdir(os.path.join(pics, "val")):
            raise FileNotFoundError(f"no val.txt and no {images_dir}/val under {root}")
        images = images if wanted else images.where("split = 'val'")
    if wanted:
        names = read_image_list(spark, *wanted).select(F.explode(F.array("name", stem(F.col("name")), F.element_at(F.split("name", "/"), -1))).alias("key")).distinct()
        keyed = images.select("image", F.explode(F.array("image", "file_name")).alias("key")).join(names, "key", "left_semi").select("image").distinct()
        images = images.join(keyed, "image", "left_semi")
    if not os.path.isdir(texts):
        none = spark.createDataFrame([], ANNOTATION).withColumn("image", F.lit(None).cast("string"))
        return Dataset(root, images, none, find_class_names(given), attributes, images_dir=pics)
    known = images.select("image").distinct()
    orphans = list_labels(spark, texts).join(known, "image", "left_anti")
    if pics == texts:
        # Of texts beside the pictures only those of pictures are labels, whatever the others hold.
        ann = read_labels(spark, texts, task, bool(attributes), stems=known)
        orphans = orphans.where(~F.col("label_path").isin(*[os.path.join(places.plain(root), n) for n in ROLES]))
    else:
        ann = read_labels(spark, texts, task, bool(attributes)).join(known, "image", "left_semi")
    return Dataset(root, images, ann, find_class_names(given), attributes, orphans, pics, texts)


def write_json(rows: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small result as one JSON document; a larger one belongs into Spark's own writers."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows: write it with DataFrame.write")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(True) for r in got], f, indent=2, ensure_ascii=False)
