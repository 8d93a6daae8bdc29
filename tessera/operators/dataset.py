"""Queries, filters, edits, unions, splits, checks and statistics of annotation tables.

An annotation is a row (image, ord, line_no, class_id, cx, cy, w, h, polygon, attrs, confidence);
tables may lack the columns that an operator does not use.  Edits return the edited table and a
report table made by the same predicate; nothing is changed in place.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polygon_box, polygon_crosses_itself
from ..store import stored
from ..sources.labels import POINT, to_line
from .ranking import numbered, numbered_within


class UnknownClass(KeyError):
    """A class that the table of names does not hold."""


class Classes(list):
    """Ordered class names; a class id is a place in the list."""

    def name(self, class_id: int) -> str:
        return self[class_id] if 0 <= class_id < len(self) else str(class_id)

    def id(self, value: int | str) -> int:
        text = str(value).strip()
        if text in self:
            return self.index(text)
        if text.lstrip("-").isdigit():
            if self and not 0 <= int(text) < len(self):
                raise UnknownClass(text)
            return int(text)
        raise UnknownClass(text)

    def ids(self, values) -> list[int]:
        values = [values] if isinstance(values, (int, str)) else values
        return [self.id(v) for v in values]

    def ensured(self, value: int | str) -> tuple[Classes, int]:
        try:
            return self, self.id(value)
        except UnknownClass:
            return Classes([*self, str(value)]), len(self)


def _mapped(column: str, ids: Mapping[int, int]) -> Column:
    """``column`` with ids replaced; the map is as small as the list of classes."""
    changed = {a: b for a, b in ids.items() if a != b}
    if not changed:
        return F.col(column)
    table = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)).cast("int")


def class_name(classes: Sequence[str], column: str = "class_id") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, classes)), F.when(F.col(column) >= 0, F.col(column))), F.col(column).cast("string")) if classes else F.col(column).cast("string")


# --- filters and queries -------------------------------------------------------------------


def keep_rule(min_width=None, min_height=None, min_size_logic: str = "or", min_area=None, max_area=None, min_confidence=None) -> Column:
    """``or`` drops a box with either side too small, ``and`` one with both; a null confidence
    passes; a box without geometry fails any size rule."""
    if min_size_logic not in ("or", "and"):
        raise ValueError("min_size_logic is 'or' or 'and'")
    keep, w, h = F.lit(True), F.col("w"), F.col("h")
    small = [c < least for c, least in ((w, min_width), (h, min_height)) if least is not None]
    if small:
        keep = keep & ~reduce(Column.__or__ if min_size_logic == "or" else Column.__and__, small)
    if min_area is not None:
        keep = keep & (w * h >= min_area)
    if max_area is not None:
        keep = keep & (w * h <= max_area)
    if min_confidence is not None:
        keep = keep & F.coalesce(F.col("confidence") >= min_confidence, F.lit(True))
    return F.coalesce(keep, F.lit(False))


def filter_geometry(ann: DataFrame, class_ids=None, class_rules: Mapping[int, Mapping] | None = None, **rule) -> DataFrame:
    """The general rule, replaced as a whole for classes that have one of their own."""
    keep = keep_rule(**rule)
    for k, own in (class_rules or {}).items():
        own = {{"width": "min_width", "height": "min_height", "logic": "min_size_logic"}.get(n, n): v for n, v in own.items()}
        keep = F.when(F.col("class_id") == k, keep_rule(**own)).otherwise(keep)
    if class_ids is not None:
        keep = F.col("class_id").isin(*class_ids) & keep
    return ann.where(keep)


def filter_pixels(ann: DataFrame, min_pixels: float) -> DataFrame:
    """Drops boxes with either side below ``min_pixels``; images of unknown size pass."""
    return ann.where(F.coalesce((F.col("w") * F.col("width") >= min_pixels) & (F.col("h") * F.col("height") >= min_pixels), F.lit(True)))


def query_class(ann: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    return ann.where(F.col("class_id").isin(*class_ids))


def decoded(position: int, options: Sequence[str] | None) -> Column:
    """Text of an attribute: its option, else the stored number as text."""
    raw = F.get("attrs", F.lit(position))
    text = raw.cast("string")
    if not options:
        return text
    at = F.when((raw >= 0) & (raw < len(options)), raw.cast("int"))
    return F.coalesce(F.get(F.array(*map(F.lit, options)), at), text)


NO_VALUES = ("", "0", "0.0", "false", "none", "no", "normal")  # fixed values: texts that mean "none"


def has_value(position: int, options: Sequence[str] | None) -> Column:
    return ~F.lower(F.trim(decoded(position, options))).isin(*NO_VALUES)


def query_attribute(ann: DataFrame, position: int, options: Sequence[str] | None = None, values: Sequence[str] | None = None, nonzero: bool = False) -> DataFrame:
    """Stored text or decoded text among ``values``, or any value that does not mean none."""
    hit = F.lit(False)
    if values:
        hit = hit | F.get("attrs", F.lit(position)).cast("string").isin(*map(str, values)) | decoded(position, options).isin(*map(str, values))
    if nonzero:
        hit = hit | has_value(position, options)
    return ann.where((F.size("attrs") > position) & hit)


def select_images(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images named by file name or stem in ``wanted`` (name)."""
    keys = wanted.select(F.explode(F.array(F.trim("name"), F.regexp_replace(F.element_at(F.split(F.trim("name"), "/"), -1), r"\.[^.]+$", ""), F.element_at(F.split(F.trim("name"), "/"), -1))).alias("key")).where("key <> ''").distinct()
    named = images.withColumn("__keys", F.array("file_name", F.regexp_replace("file_name", r"\.[^.]+$", "")))
    hit = named.select("image", F.explode("__keys").alias("key")).join(keys, "key", "left_semi").select("image").distinct()
    return images.join(hit, "image", "left_semi")


def pseudo_labels(ann: DataFrame, least: float = 0.0, drop_confidence: bool = True) -> DataFrame:
    kept = ann.where(F.col("confidence").isNull() | (F.col("confidence") >= least))
    return kept.withColumn("confidence", F.lit(None).cast("double")) if drop_confidence else kept


def seg_to_det(ann: DataFrame) -> DataFrame:
    """Polygons become the boxes around them."""
    box, has = polygon_box("polygon"), F.col("polygon").isNotNull() & F.col("cx").isNull()
    return ann.withColumns({c: F.when(has, e).otherwise(F.col(c)) for c, e in box.items()}).withColumn("polygon", F.lit(None).cast(ann.schema["polygon"].dataType))


# --- edits -----------------------------------------------------------------------------------


def _report(ann: DataFrame, hit: Column, operation: str, new: Column, more: Mapping[str, Column] | None = None) -> DataFrame:
    line = "line_no" if "line_no" in ann.columns else "ord"
    path = ["label_path"] if "label_path" in ann.columns else []
    return ann.where(hit).select(F.lit(operation).alias("operation"), "image", F.col(line).alias("line_no"), F.col("class_id").alias("old_class"), new.cast("int").alias("new_class"), *path, *[v.alias(k) for k, v in (more or {}).items()])


def compacted(classes: Classes, removed: Sequence[int]) -> tuple[Classes, dict[int, int]]:
    """Names without the removed ones, and where the others go; unknown ids stay."""
    left = [k for k in range(len(classes)) if k not in set(removed)]
    return Classes(classes[k] for k in left), {k: n for n, k in enumerate(left)}


def delete_class(ann: DataFrame, classes: Classes, gone, compact: bool = False):
    ids = classes.ids(gone)
    hit = F.col("class_id").isin(*ids)
    names, moved = compacted(classes, ids) if compact else (classes, {})
    return ann.where(~hit).withColumn("class_id", _mapped("class_id", moved)), names, _report(ann, hit, "delete_class", F.lit(None))


def replace_class(ann: DataFrame, classes: Classes, sources, target, compact: bool = False, add_missing: bool = True, operation: str = "replace_class"):
    ids = classes.ids(sources)
    names, to = classes.ensured(target) if add_missing else (classes, classes.id(target))
    hit = F.col("class_id").isin(*ids)
    out = ann.withColumn("class_id", _mapped("class_id", {k: to for k in ids}))
    report = _report(ann, hit, operation, F.lit(to))
    if compact:
        names, moved = compacted(names, [k for k in ids if k != to])
        out = out.withColumn("class_id", _mapped("class_id", moved))
    return out, names, report


def merge_classes(ann: DataFrame, classes: Classes, sources, target, compact: bool = True, add_missing: bool = True):
    return replace_class(ann, classes, sources, target, compact, add_missing, "merge_class")


def rename_class(ann: DataFrame, classes: Classes, old, new: str):
    k = classes.id(old)
    names = Classes(new if n == k else c for n, c in enumerate(classes))
    return ann, names, _report(ann, F.col("class_id") == k, "rename_class", F.lit(k))


def class_map(classes: Classes, rename: Mapping | None = None, merge: Mapping | None = None, drop: Sequence | None = None, compact: bool = True) -> tuple[Classes, dict[int, int | None]]:
    """Names after renames, merges and drops in that order, and where each old id goes (None:
    dropped).  Every step resolves names against the result of the one before."""
    now: dict[int, int | None] = {k: k for k in range(len(classes))}
    names = Classes(classes)

    def move(step: Mapping[int, int | None]) -> None:
        for k, v in now.items():
            if v is not None:
                now[k] = step.get(v, v)

    for old, new in (rename or {}).items():
        names[names.id(old)] = new
    for target, sources in (merge or {}).items():
        ids = names.ids(sources)
        names, to = names.ensured(target)
        move({k: to for k in ids})
        if compact:
            names, moved = compacted(names, [k for k in ids if k != to])
            move(moved)
    if drop:
        ids = names.ids(drop)
        move({k: None for k in ids})
        if compact:
            names, moved = compacted(names, ids)
            move(moved)
    return names, now


def apply_class_map(ann: DataFrame, classes: Classes, **steps):
    """One pass over the rows, whatever the number of steps."""
    names, now = class_map(classes, **steps)
    gone = [k for k, v in now.items() if v is None]
    hit = F.col("class_id").isin(*[k for k, v in now.items() if v != k]) if any(v != k for k, v in now.items()) else F.lit(False)
    table = {k: v for k, v in now.items() if v is not None}
    new = F.when(~F.col("class_id").isin(*gone), _mapped("class_id", table)) if gone else _mapped("class_id", table)
    kept = ann.where(~F.col("class_id").isin(*gone)) if gone else ann
    return kept.withColumn("class_id", _mapped("class_id", table)), names, _report(ann, hit, "apply_map", new)


def set_attribute(ann: DataFrame, position: int, value: float, class_ids=None, where_value: float | None = None):
    """Sets one attribute; the list is padded with zeros up to it in every row of the classes,
    also where ``where_value`` does not hold."""
    chosen = F.col("class_id").isin(*class_ids) if class_ids is not None else F.lit(True)
    padded = F.concat("attrs", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(position + 1) - F.size("attrs"))))
    old = F.coalesce(F.get("attrs", F.lit(position)), F.lit(0.0))
    hit = chosen & ((old == float(where_value)) if where_value is not None else F.lit(True))
    put = F.transform(padded, lambda x, i: F.when(hit & (i == position), F.lit(float(value))).otherwise(x))
    return ann.withColumn("attrs", F.when(chosen, put).otherwise(F.col("attrs"))), _report(ann, hit, "set_attr", F.col("class_id"), {"old_attr_value": old, "new_attr_value": F.lit(float(value))})


def delete_by_attribute(ann: DataFrame, position: int, values: Sequence[float] | None = None, nonzero: bool = False, class_ids=None):
    """Drops rows by the stored number of an attribute; a missing one reads 0."""
    raw = F.coalesce(F.get("attrs", F.lit(position)), F.lit(0.0))
    hit = F.lit(False)
    if values:
        hit = hit | raw.isin(*map(float, values))
    if nonzero:
        hit = hit | (raw != 0)
    if class_ids is not None:
        hit = hit & F.col("class_id").isin(*class_ids)
    return ann.where(~hit), _report(ann, hit, "delete_attr", F.lit(None), {"old_attr_value": raw, "new_attr_value": F.lit(None).cast("double")})


# --- unions and splits ------------------------------------------------------------------------


def merge_datasets(
    parts: Sequence[tuple[DataFrame, DataFrame, Classes]], source_prefix: bool = True, schemas: Sequence[Mapping | None] = (), rename_duplicates: bool = True
) -> tuple[DataFrame, DataFrame, Classes]:
    """Union of (images, annotations, classes): classes are aligned by name in the order they are
    first seen, names get the part's prefix, and names that still collide a number of their own.
    With ``schemas``, one for each part, attributes are aligned to ``merge_attributes`` of them.
    Without ``rename_duplicates`` a file name of several images is an error."""
    merged = merge_attributes(schemas, extend=True)
    parts = [(i, align_attributes(a, schema or {}, merged, own), own) for (i, a, own), schema in zip(parts, [*schemas, *[None] * len(parts)], strict=False)]
    names = Classes()
    for _, _, own in parts:
        names = Classes([*names, *(c for c in own if c not in names)])
    all_images, all_ann = [], []
    for n, (images, ann, own) in enumerate(parts):
        key = F.concat(F.lit(f"d{n}_"), F.col("image").cast("string"))
        file = F.concat(F.lit(f"d{n}_"), "file_name") if source_prefix else F.col("file_name")
        all_images.append(images.withColumn("part", F.lit(n)).withColumn("file_name", file).withColumn("image", key))
        all_ann.append(ann.withColumn("image", key).withColumn("class_id", _mapped("class_id", {k: names.index(c) for k, c in enumerate(own)})))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), all_images)
    if not rename_duplicates:
        twice = together.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
        if twice:
            raise ValueError("several images are named " + ", ".join(sorted(str(r.file_name) for r in twice)))
    images = unique_names(together, "part", "image")
    return images, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), all_ann), names


def unique_names(images: DataFrame, *order: str) -> DataFrame:
    """The first image (by ``order``) of a file name keeps it; the others get ``_1``, ``_2`` ...
    before the suffix, in turn, without the numbers that file names have already.

    Only repeated names are numbered, by ranges of name and order, so that a name of very many
    images is neither one task nor one array."""
    often = stored(images.where("file_name IS NOT NULL").groupBy("file_name").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("file_name"), "names")
    if often.isEmpty():
        return images
    stem, suffix = F.regexp_replace("file_name", r"\.[^.]+$", ""), F.regexp_extract("file_name", r"(\.[^.]+)$", 1)
    rows = numbered_within(images.join(often, "file_name", "left_semi"), "file_name", *order, name="__place")
    rows = rows.withColumns({"__rank": F.col("__place") - 1, "__taken": F.lit(0)})
    # Names in use that a number could make.
    part = lambda k: F.regexp_extract("file_name", r"^(.*)_([1-9][0-9]{0,8})(\.[^.]+)?$", k)
    used = images.select(part(1).alias("__stem"), part(3).alias("__suffix"), part(2).try_cast("long").alias("__k")).where("__k IS NOT NULL").distinct()
    taken = used.join(often.withColumns({"__stem": stem, "__suffix": suffix}), ["__stem", "__suffix"]).select("file_name", "__k")
    # The i-th number taken, k, stands behind k - i images; images and taken numbers in that order are 1, 2, ...
    taken = numbered_within(taken, "file_name", "__k", name="__i").select("file_name", (F.col("__k") - F.col("__i")).alias("__rank"), F.lit(1).alias("__taken"))
    both = rows.where("__rank > 0").unionByName(taken, allowMissingColumns=True)
    others = numbered_within(both, "file_name", "__rank", "__taken", name="__number").where("__taken = 0")
    named = others.withColumn("file_name", F.concat(stem, F.lit("_"), F.col("__number").cast("string"), suffix)).select(*images.columns)
    once = images.join(often, "file_name", "left_anti").select(*images.columns)
    return once.unionByName(rows.where("__rank = 0").select(*images.columns)).unionByName(named)


def merge_attributes(schemas: Sequence[Mapping | None], extend: bool = False) -> dict:
    """Attributes of several schemas in the order they are first seen; the first that names an
    attribute says its options, after which ``extend`` puts those that only later ones have.
    Schemas by class are then merged class by class."""
    merged: dict = {}
    for schema in schemas:
        for name, options in (schema or {}).items():
            known = merged.get(name)
            if name not in merged:
                merged[name] = [*options] if isinstance(options, (list, tuple)) else options
            elif extend and isinstance(known, Mapping) and isinstance(options, Mapping):
                merged[name] = merge_attributes([known, options], extend)
            elif extend and isinstance(known, list) and isinstance(options, (list, tuple)):
                merged[name] = [*known, *(o for o in options if o not in known)]
    return merged


def by_class(schema: Mapping) -> bool:
    """Whether a schema has attributes for each class rather than for all."""
    return bool(schema) and all(isinstance(v, Mapping) for v in schema.values())


def aligned_attributes(own: Mapping, merged: Mapping) -> Column:
    """``attrs`` of rows that follow the schema ``own`` at the places and with the options of
    ``merged``, in one pass: each place of the new list takes the value of the old place of that name
    (0 where there is none), and a number of an option becomes the number of the same option.
    Values that are no option's number stay; rows without attributes stay without."""
    names, places = list(own), []
    for name, options in merged.items():
        if name not in own:
            places.append(F.lit(0.0))
            continue
        value = F.coalesce(F.get("attrs", F.lit(names.index(name))), F.lit(0.0))
        old = own[name]
        if isinstance(old, (list, tuple)) and isinstance(options, (list, tuple)):
            moved = {k: options.index(o) for k, o in enumerate(old) if o in options and options.index(o) != k}
            if moved:
                value = F.coalesce(*[F.when(F.floor(value) == k, F.lit(float(to))) for k, to in moved.items()], value)
        places.append(value)
    return F.when(F.size("attrs") > 0, F.array(*places)).otherwise(F.col("attrs")) if places else F.col("attrs")


def align_attributes(ann: DataFrame, own: Mapping, merged: Mapping, classes: Sequence[str]) -> DataFrame:
    """``ann`` with its attributes as ``merged`` has them; see ``aligned_attributes``."""
    if not own or own == merged:
        return ann
    if not by_class(own):
        return ann.withColumn("attrs", aligned_attributes(own, merged))
    moved = [F.when(F.col("class_id") == k, aligned_attributes(own[n], merged[n])) for k, n in enumerate(classes) if n in own and own[n] != merged[n]]
    return ann.withColumn("attrs", F.coalesce(*moved, "attrs"))


def split_images(images: DataFrame, train: float = 0.8, val: float = 0.2, test: float = 0.0, seed: int = 233, exact: bool = True) -> DataFrame:
    """Adds ``split``.  Images stand in the order of a hash of image and seed; train and val take
    the whole part of their share of them, in turn, and test has the rest.

    Without ``exact`` the hash alone decides: shares hold on average, no row moves, and an image
    keeps its split when others come or go."""
    total = train + val + test
    if min(train, val, test) < 0 or total <= 0:
        raise ValueError("shares must not be negative, nor all zero")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("image").cast("string")).cast("binary")), 1, 13)
    u = F.conv(digits, 16, 10).cast("long") / float(1 << 52)
    if not exact:
        return images.withColumn("split", F.when(u < train / total, "train").when(u < (train + val) / total, "val").otherwise("test"))
    images = images.drop("split")
    n = images.count()
    ranked = numbered(images.withColumn("__u", u), "__u", "image", name="__rank")
    a, b = int(n * train / total), int(n * val / total)
    return ranked.withColumn("split", F.when(F.col("__rank") <= a, "train").when(F.col("__rank") <= a + b, "val").otherwise("test")).select(*images.columns, "split")


def split_with_lists(images: DataFrame, train_include: DataFrame | None = None, val_include: DataFrame | None = None, **shares) -> DataFrame:
    """A split in which images that lists name (table of name) are forced into train or val; the
    shares are those of the others.  A name that no image or several images have is an error."""
    from .tables import resolve_listed

    images = images.drop("split")
    forced = []
    for split, listed in (("train", train_include), ("val", val_include)):
        if listed is not None:
            found = resolve_listed(images, listed)
            odd = found.where("n_matches <> 1").limit(5).collect()
            if odd:
                raise ValueError(f"{split} list: " + ", ".join(f"{r.name} fits {r.n_matches} images" for r in odd))
            forced.append(found.select("image").distinct().withColumn("forced", F.lit(split)))
    if not forced:
        return split_images(images, **shares)
    forced = reduce(DataFrame.union, forced)
    both = forced.groupBy("image").count().where("count > 1").limit(5).collect()
    if both:
        raise ValueError("forced into both splits: " + ", ".join(str(r.image) for r in both))
    rest = split_images(images.join(forced, "image", "left_anti"), **shares)
    return images.join(forced.withColumnRenamed("forced", "split"), "image").select(*images.columns, "split").unionByName(rest.select(*images.columns, "split"))


def split_exact(names: Sequence[str], train: float = 0.8, val: float = 0.2, test: float = 0.0, seed: int = 233, train_include: Sequence[str] = (), val_include: Sequence[str] = ()) -> dict[str, list[str]]:
    """The seeded shuffle of a list of names: floor counts, the remainder goes to ``test``.
    For lists that fit one machine."""
    if set(train_include) & set(val_include):
        raise ValueError("a name is forced into both splits")
    total = train + val + test
    if total <= 0:
        raise ValueError("shares must not be all zero")
    rest = [n for n in names if n not in {*train_include, *val_include}]
    random.Random(seed).shuffle(rest)
    a = int(len(rest) * train / total)
    b = int(len(rest) * val / total)
    return {"train": [*train_include, *rest[:a]], "val": [*val_include, *rest[a : a + b]], "test": rest[a + b :]}


# --- checks -------------------------------------------------------------------------------------


def exact_duplicates(files: DataFrame, key: str = "image", content: str = "content", bits: int = 256) -> DataFrame:
    """digest, images, n of contents that occur more than once.  Contents are read once: digests
    are stored, and what follows is made of them."""
    return repeated(stored(files.select(F.col(key).alias("image"), F.sha2(F.col(content).cast("binary"), bits).alias("digest")), "digests"))


def repeated(hashed: DataFrame, key: str = "image") -> DataFrame:
    """digest, image, n of digests that occur more than once; they are counted before names are
    listed, so that only duplicates are gathered."""
    often = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(often, "digest").select("digest", F.col(key).alias("image"), "n")


def missing_label_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose ``label_path`` is not among the paths of ``files`` (label_path)."""
    return images.where("label_path IS NOT NULL").join(files.select("label_path").distinct(), "label_path", "left_anti")


def orphan_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    return labels.join(images.select("image").distinct(), "image", "left_anti")


def duplicate_lines(ann: DataFrame) -> DataFrame:
    """Second and later annotations of an image that are written as the same line, with their
    confidence, whatever their text was when they were read.

    Equal lines have equal numbers once these are rounded, so that hashes of rounded numbers say
    which rows can have one; only these are written out and compared."""
    lacks = {"polygon": POINT, "attrs": "array<double>", "confidence": "double"}
    rows = ann.withColumns({"__" + c: F.col(c) if c in ann.columns else F.lit(None).cast(t) for c, t in lacks.items()})
    rows = rows.withColumns({c: F.col("__" + c) for c in lacks})
    rounded = [F.round(c, 6) for c in ("cx", "cy", "w", "h", "confidence")]
    lists = [F.transform("attrs", lambda x: F.round(x, 6)), F.transform("polygon", lambda q: F.struct(F.round(q["x"], 6), F.round(q["y"], 6)))]
    rows = rows.withColumn("__key", F.xxhash64("class_id", *rounded, *lists))
    often = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("image", "__key"))).where("__n > 1")
    w = Window.partitionBy("image", "__key", "__line").orderBy("line_no")
    line = often.withColumn("__line", to_line(include_confidence=True))
    return line.withColumn("__r", F.row_number().over(w)).where("__r > 1").select(*ann.columns)


def validate(ann: DataFrame, n_classes: int | None = None) -> DataFrame:
    """image, line_no, level, code: one row for each issue, found in a single pass."""
    outside = lambda c: F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    issue = lambda level, code, when: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = [issue("warning", "coord_out_of_range", outside(c)) for c in ("cx", "cy", "w", "h")]
    found.append(issue("error", "invalid_box_size", (F.col("w") <= 0) | (F.col("h") <= 0)))
    if n_classes:
        found.append(issue("error", "class_out_of_range", (F.col("class_id") < 0) | (F.col("class_id") >= n_classes)))
    if "confidence" in ann.columns:
        found.append(issue("warning", "confidence_out_of_range", outside("confidence")))
    if "polygon" in ann.columns:
        found += [issue("error", "invalid_polygon", F.size("polygon") < 3), issue("warning", "polygon_self_intersection", polygon_crosses_itself("polygon"))]
        values = F.flatten(F.transform(F.coalesce("polygon", F.array().cast(POINT)), lambda q: F.array(q["x"], q["y"])))
        # One for each value.
        outer = F.transform(F.filter(values, lambda v: ~v.between(0, 1)), lambda v: F.struct(F.lit("warning").alias("level"), F.lit("coord_out_of_range").alias("code")))
    else:
        outer = None
    each = F.array_compact(F.array(*found))
    rows = ann.select("image", "line_no", F.explode(each if outer is None else F.concat(each, outer)).alias("i")).select("image", "line_no", "i.*")
    if {"cx", "cy", "w", "h"} <= set(ann.columns):
        rows = rows.unionByName(duplicate_lines(ann).select("image", "line_no", F.lit("warning").alias("level"), F.lit("duplicate_annotation").alias("code")))
    return rows


# --- statistics -----------------------------------------------------------------------------------

#: Edges of the aspect-ratio histogram; the right one of a pair belongs to the bin.
ASPECT_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.5, 3.0, 4.0, 5.0)


#: Edges of the shape-rate bins.
SHAPE_EDGES = (
    0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0, 2.1, 2.2, 2.4, 2.6, 3.0, 3.5, 4.0, 5.0,
)


def box_series() -> dict[str, Column]:
    """The described series of boxes; ``width`` and ``height`` are those of the image, ``points``
    the number of a polygon's points."""
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return {
        "box_width": w, "box_height": h, "box_area": w * h, "box_width_pix": w * F.col("width"), "box_height_pix": h * F.col("height"), "box_shape_rate": F.when(h != 0, w / h),
        "box_pos_start_x": x - w / 2, "box_pos_start_y": y - h / 2, "box_pos_center_x": x, "box_pos_center_y": y, "box_pos_end_x": x + w / 2, "box_pos_end_y": y + h / 2,
        "polygon_points": F.when(F.col("points") > 0, F.col("points")), "confidence": F.col("confidence"),
    }


def totals(ann: DataFrame, images: DataFrame, orphans: DataFrame | None, labelled: DataFrame, schema: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row: images, labels, orphan_labels, annotations, empty_images, and boxes and images
    with and without an attribute that does not mean none."""
    has = reduce(Column.__or__, [F.coalesce(has_value(k, o), F.lit(False)) for k, o in enumerate((schema or {}).values())], F.lit(False))
    per = ann.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(has, 1)).alias("with"))
    every = images.select("image").join(per, "image", "left")
    one = every.agg(
        F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"), F.count(F.when(F.col("n").isNull(), 1)).alias("empty_images"),
        F.coalesce(F.sum("with"), F.lit(0)).alias("boxes_with_attribute"), F.count(F.when(F.col("with") > 0, 1)).alias("images_with_attribute"),
    )
    n_labels = labelled.join(images.select("image"), "image", "left_semi").agg(F.count(F.lit(1)).alias("labels"))
    n_orphans = orphans.agg(F.count(F.lit(1)).alias("orphan_labels")) if orphans is not None else images.sparkSession.createDataFrame([(0,)], "orphan_labels long")
    one = one.join(F.broadcast(n_labels)).join(F.broadcast(n_orphans))  # one row each
    return one.withColumns({"boxes_without_attribute": F.col("annotations") - F.col("boxes_with_attribute"), "images_without_attribute": F.col("images") - F.col("images_with_attribute")})


def class_counts(ann: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects and images of each class, with zeros for classes without any."""
    counts = ann.groupBy("class_id").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("image").alias("images"))
    rows = classes.join(counts, "class_id", "full")
    return rows.select("class_id", F.coalesce("class_name", F.col("class_id").cast("string")).alias("class_name"), F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("images", F.lit(0)).alias("images"))


def describe(ann: DataFrame, series: Mapping[str, Column]) -> DataFrame:
    """series, n, low, high, mean: all series in one aggregation."""
    wide = ann.agg(*[F.struct(F.count(e).alias("n"), F.min(e).alias("low"), F.max(e).alias("high"), F.avg(e).alias("mean")).alias(n) for n, e in series.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("v")) for n in series])
    return wide.select(F.explode(rows).alias("r")).select("r.series", "r.v.*")


def histogram(ann: DataFrame, value: Column, edges: Sequence[float] = ASPECT_EDGES) -> DataFrame:
    """bin, low, high, n: bins (low, high], the first with its left edge; the rest is dropped."""
    # The value stands in few places, so that a long expression for it stays short here.
    below = F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e < value))
    at = F.when(value == float(edges[0]), 0).when(below.between(1, len(edges) - 1), below - 1)
    counts = ann.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin IS NOT NULL")
    bins = ann.sparkSession.createDataFrame([(n, float(lo), float(hi)) for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return bins.join(counts, "bin", "left").fillna(0, ["n"])


def objects_per_image(ann: DataFrame, images: DataFrame) -> DataFrame:
    """How many images have how many objects, empty ones included."""
    per = ann.groupBy("image").agg(F.count(F.lit(1)).alias("objects"))
    return images.select("image").join(per, "image", "left").fillna(0, ["objects"]).groupBy("objects").agg(F.count(F.lit(1)).alias("images"))


def empty_images(ann: DataFrame, images: DataFrame) -> DataFrame:
    return images.join(ann.select("image").distinct(), "image", "left_anti")


def attribute_counts(ann: DataFrame, schema: Mapping[str, Sequence[str]], by_class: bool = False) -> DataFrame:
    """attribute, value, n (and class_id): how often each decoded value occurs."""
    cells = F.array(*[F.struct(F.lit(name).alias("attribute"), decoded(k, options).alias("value")) for k, (name, options) in enumerate(schema.items())])
    rows = ann.select("class_id", F.explode(cells).alias("c")).select("class_id", "c.*").where("value IS NOT NULL")
    return rows.groupBy(*(["class_id"] if by_class else []), "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


# --- crops and resizing --------------------------------------------------------------------------


def crop_rects(ann: DataFrame, padding: int | float = 0, min_size: int = 1) -> DataFrame:
    """Integer crop rectangles inside their images; padding in pixels, or as a share of the box."""
    x1, y1, x2, y2 = (F.col(c) * F.col(s) for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))
    rows = ann.withColumns({"bw": x2 - x1, "bh": y2 - y1}).where((F.col("bw") >= min_size) & (F.col("bh") >= min_size))
    px, py = (F.lit(padding), F.lit(padding)) if isinstance(padding, int) else (F.col("bw") * padding, F.col("bh") * padding)
    low, high = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int"), lambda v, m: F.least(m, F.ceil(v)).cast("int")
    return rows.select("image", "ord", "class_id", low(x1 - px).alias("left"), low(y1 - py).alias("top"), high(x2 + px, F.col("width")).alias("right"), high(y2 + py, F.col("height")).alias("bottom"))
