"""Queries of filters, edits, checks and statistics over the derived corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import dataset as ds
from ..operators import evaluation as ev
from ..operators import tables
from . import corpus
from .corpus import CLASSES, table

ATTRIBUTES = {"defect": ("no", "scratch", "dent"), "grade": ("a", "b", "c", "d")}
NAMES = ds.Classes(CLASSES)
_IDS = ["image", "line_no", "class_id"]


def _gt(spark, sf_dir):
    return corpus.ground_truth(spark, sf_dir)


def filter_geometry_or(spark, sf_dir):
    return ds.filter_geometry(_gt(spark, sf_dir), min_width=0.06, min_height=0.08).select(*_IDS)


def filter_geometry_and(spark, sf_dir):
    return ds.filter_geometry(_gt(spark, sf_dir), min_width=0.06, min_height=0.08, min_size_logic="and", max_area=0.03).select(*_IDS)


def filter_class_rules(spark, sf_dir):
    return ds.filter_geometry(_gt(spark, sf_dir), min_area=0.01, class_rules={1: {"width": 0.1, "height": 0.1, "logic": "and"}, 2: {"max_area": 0.02}}).select(*_IDS)


def filter_min_pixels(spark, sf_dir):
    return ds.filter_pixels(_gt(spark, sf_dir), 40).select(*_IDS)


def pseudo_labels(spark, sf_dir):
    return ds.pseudo_labels(corpus.predictions(spark, sf_dir), 0.8).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("with_confidence"))


def query_class(spark, sf_dir):
    return ds.query_class(_gt(spark, sf_dir), NAMES.ids(["car", "sign"])).select(*_IDS, ds.class_name(NAMES).alias("class_name"))


def query_attribute(spark, sf_dir):
    return ds.query_attribute(_gt(spark, sf_dir), 0, ATTRIBUTES["defect"], values=["dent"]).select(*_IDS)


def query_attribute_nonzero(spark, sf_dir):
    return ds.query_attribute(_gt(spark, sf_dir), 0, ATTRIBUTES["defect"], nonzero=True).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def select_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("val/img_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    return ds.select_images(corpus.images(spark, sf_dir), wanted).select("image", "file_name")


def delete_class(spark, sf_dir):
    out, _, _ = ds.delete_class(_gt(spark, sf_dir), NAMES, ["car", "bus"], compact=True)
    return out.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def replace_class(spark, sf_dir):
    out, _, _ = ds.replace_class(_gt(spark, sf_dir), NAMES, ["truck", "bus"], "vehicle")
    return out.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def merge_compact(spark, sf_dir):
    out, names, _ = ds.merge_classes(_gt(spark, sf_dir), NAMES, ["person", "truck"], "car")
    return out.groupBy("class_id", ds.class_name(names).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def edit_report(spark, sf_dir):
    return ds.merge_classes(_gt(spark, sf_dir), NAMES, ["person", "truck"], "car")[2]


def rename_class(spark, sf_dir):
    out, names, _ = ds.rename_class(_gt(spark, sf_dir), NAMES, "bike", "bicycle")
    return out.groupBy(ds.class_name(names).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def apply_map(spark, sf_dir):
    out, names, _ = ds.apply_class_map(_gt(spark, sf_dir), NAMES, rename={"bike": "cycle"}, merge={"vehicle": ["car", "truck", "bus"]}, drop=["dog"])
    return out.groupBy("class_id", ds.class_name(names).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def set_attribute(spark, sf_dir):
    out, _ = ds.set_attribute(_gt(spark, sf_dir), 2, 5, class_ids=[1, 2])
    out, _ = ds.set_attribute(out, 0, 2, where_value=1)
    return out.select(*_IDS, F.array_join(F.transform("attrs", lambda x: x.cast("int").cast("string")), ",").alias("attrs"))


def delete_attribute(spark, sf_dir):
    out, _ = ds.delete_by_attribute(_gt(spark, sf_dir), 1, values=[2, 3], class_ids=[0, 1, 2, 3])
    return out.select(*_IDS)


def merge_union(spark, sf_dir):
    parts = [(corpus.images(spark, sf_dir).where("image % 2 = 0"), _gt(spark, sf_dir).where("image % 2 = 0"), NAMES), (corpus.images(spark, sf_dir).where("image % 3 = 0"), _gt(spark, sf_dir).where("image % 3 = 0"), ds.Classes(reversed(CLASSES)))]
    _, ann, names = ds.merge_datasets(parts)
    return ann.groupBy(F.substring("image", 1, 2).alias("part"), ds.class_name(names).alias("class_name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image").alias("images"))


#: Two schemas of the corpus's attributes, in other orders and with other options.
_PART_SCHEMAS = ({"defect": ["no", "scratch", "dent"], "grade": ["a", "b", "c", "d"]}, {"grade": ["d", "c", "b", "a"], "age": None, "defect": ["dent", "no", "rust"]})


def merge_attributes(spark, sf_dir):
    """Two parts that follow other schemas, with their attributes at the places of the common one."""
    gt = _gt(spark, sf_dir)
    turned = F.array(F.get("attrs", F.lit(1)), F.col("class_id").cast("double"), F.get("attrs", F.lit(0)))
    parts = [gt.where("image % 2 = 0"), gt.where("image % 2 = 1").withColumn("attrs", turned)]
    merged = ds.merge_attributes(_PART_SCHEMAS, extend=True)
    rows = [ds.align_attributes(p, own, merged, CLASSES) for p, own in zip(parts, _PART_SCHEMAS, strict=True)]
    cells = [ds.decoded(k, o if isinstance(o, list) else None).alias(n) for k, (n, o) in enumerate(merged.items())]
    return rows[0].unionByName(rows[1]).select(*_IDS, *cells).groupBy("class_id", "defect", "grade", "age").agg(F.count(F.lit(1)).alias("n"), F.sum("image").alias("images"))


def split_counts(spark, sf_dir):
    parts = ds.split_images(corpus.images(spark, sf_dir), 0.7, 0.2, 0.1)
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("image").alias("images"))


def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.col("text").alias("content"))
    return ds.exact_duplicates(docs)


def orphan_labels(spark, sf_dir):
    return ds.orphan_labels(_gt(spark, sf_dir), corpus.images(spark, sf_dir).where("image % 5 <> 0")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def duplicate_lines(spark, sf_dir):
    """Boxes on a coarse lattice; what differs behind the sixth digit is not written."""
    coarse = F.floor(F.col("w") * 50) / 50 + F.col("line_no") * 1e-8
    rows = _gt(spark, sf_dir).withColumns({"cx": F.lit(0.5), "cy": F.lit(0.5), "w": coarse, "h": coarse, "attrs": F.array().cast("array<double>")})
    return ds.duplicate_lines(rows).select("image", "line_no")


def validate_issues(spark, sf_dir):
    ann = _gt(spark, sf_dir).select("image", "line_no", (F.col("class_id") - 1).alias("class_id"), (F.col("cx") * 1.2).alias("cx"), "cy", (F.col("w") - F.lit(0.045)).alias("w"), "h")
    return ds.validate(ann, len(CLASSES)).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


def class_counts(spark, sf_dir):
    """The last class has no annotation."""
    return ds.class_counts(_gt(spark, sf_dir), spark.createDataFrame(list(enumerate([*CLASSES, "boat"])), "class_id int, class_name string"))


def describe_boxes(spark, sf_dir):
    series = {"width": F.col("w"), "height": F.col("h"), "area": F.col("w") * F.col("h"), "aspect": F.col("w") / F.col("h")}
    rows = ds.describe(_gt(spark, sf_dir), series)
    return rows.select("series", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("mean", 6).alias("mean"))


def aspect_histogram(spark, sf_dir):
    return ds.histogram(_gt(spark, sf_dir), F.col("w") / F.col("h"))


def objects_per_image(spark, sf_dir):
    return ds.objects_per_image(_gt(spark, sf_dir), corpus.images(spark, sf_dir))


def empty_images(spark, sf_dir):
    return ds.empty_images(_gt(spark, sf_dir), corpus.images(spark, sf_dir)).select("image")


def size_buckets(spark, sf_dir):
    return _gt(spark, sf_dir).groupBy("size", "class_id").agg(F.count(F.lit(1)).alias("n"))


def attribute_counts(spark, sf_dir):
    return ds.attribute_counts(_gt(spark, sf_dir), ATTRIBUTES)


def class_attribute_counts(spark, sf_dir):
    return ds.attribute_counts(_gt(spark, sf_dir), ATTRIBUTES, by_class=True)


def polygon_boxes(spark, sf_dir):
    """Segmentation to detection, with the area of each polygon."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ann = _gt(spark, sf_dir).withColumn("polygon", F.array(point("cx", "y1"), point("x2", "cy"), point("cx", "y2"), point("x1", "cy")))
    area = geo.polygon_area("polygon")
    out = ds.seg_to_det(ann.withColumn("area", area).withColumns({c: F.lit(None).cast("double") for c in ("cx", "cy", "w", "h")}))
    return out.select(*_IDS, *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")], F.round(F.col("area") * 2, 6).alias("twice_area"))


def letterbox_boxes(spark, sf_dir):
    t = geo.letterbox(F.col("width"), F.col("height"), 640, 640)
    out = _gt(spark, sf_dir).withColumns(t).select(*_IDS, (F.col("cx") * F.col("sx") + F.col("ox")).alias("cx"), (F.col("cy") * F.col("sy") + F.col("oy")).alias("cy"), (F.col("w") * F.col("sx")).alias("w"), (F.col("h") * F.col("sy")).alias("h"))
    return out.select(*_IDS, *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


def crop_rects(spark, sf_dir):
    return ds.crop_rects(_gt(spark, sf_dir), padding=4, min_size=20)


def annotation_table(spark, sf_dir):
    return tables.annotation_table(_gt(spark, sf_dir), NAMES, ATTRIBUTES)


def attribute_table(spark, sf_dir):
    return tables.attribute_table(_gt(spark, sf_dir), NAMES, ATTRIBUTES)


def positive_attributes(spark, sf_dir):
    return tables.positive_attributes(_gt(spark, sf_dir), ATTRIBUTES)


def image_shapes(spark, sf_dir):
    return tables.image_shapes(corpus.images(spark, sf_dir)).withColumn("aspect", F.round("aspect", 6))


def subset_class_counts(spark, sf_dir):
    return tables.class_counts_for(_gt(spark, sf_dir), corpus.images(spark, sf_dir).where("image % 4 = 0"))


def draw_list(spark, sf_dir):
    return tables.draw_list(corpus.predictions(spark, sf_dir), NAMES, 0.7, True)


def filtered_counts(spark, sf_dir):
    """Counts by class after the filters of an evaluation."""
    gt, pred = tables.evaluation_filter(_gt(spark, sf_dir), corpus.predictions(spark, sf_dir), exclude=[7], min_confidence=0.6, min_pixels=30, min_area=0.005)
    return ev.counts_by_class(ev.reindex(gt), ev.reindex(pred))


QUERIES = (
    filter_geometry_or, filter_geometry_and, filter_class_rules, filter_min_pixels, pseudo_labels, query_class, query_attribute, query_attribute_nonzero, select_semi, delete_class, replace_class, merge_compact, edit_report, rename_class,
    apply_map, set_attribute, delete_attribute, merge_union, merge_attributes, split_counts, exact_duplicates, orphan_labels, duplicate_lines, validate_issues, class_counts, describe_boxes, aspect_histogram, objects_per_image, empty_images, size_buckets,
    attribute_counts, class_attribute_counts, polygon_boxes, letterbox_boxes, crop_rects, annotation_table, attribute_table, positive_attributes, image_shapes, subset_class_counts, draw_list, filtered_counts,
)


def _sql(select: str) -> str:
    return f"WITH {corpus.SQL}\n{select}"


_NAME = "list_element(['person', 'car', 'truck', 'bus', 'bike', 'sign', 'dog', 'cat'], class_id + 1)"
_DEFECT = "list_element(['no', 'scratch', 'dent'], defect::INT + 1)"
_GRADE = "list_element(['a', 'b', 'c', 'd'], grade::INT + 1)"
_EDGES = ", ".join(f"({n}, {lo}::DOUBLE, {hi}::DOUBLE)" for n, (lo, hi) in enumerate(zip(ds.ASPECT_EDGES, ds.ASPECT_EDGES[1:], strict=False)))

SQL = {
    "filter_geometry_or": _sql("SELECT image, line_no, class_id FROM gt WHERE w >= 0.06::DOUBLE AND h >= 0.08::DOUBLE"),
    "filter_geometry_and": _sql("SELECT image, line_no, class_id FROM gt WHERE (w >= 0.06::DOUBLE OR h >= 0.08::DOUBLE) AND w * h <= 0.03::DOUBLE"),
    "filter_class_rules": _sql("SELECT image, line_no, class_id FROM gt WHERE CASE class_id WHEN 1 THEN w >= 0.1::DOUBLE OR h >= 0.1::DOUBLE WHEN 2 THEN w * h <= 0.02::DOUBLE ELSE w * h >= 0.01::DOUBLE END"),
    "filter_min_pixels": _sql("SELECT image, line_no, class_id FROM gt WHERE w * width >= 40 AND h * height >= 40"),
    "pseudo_labels": _sql("SELECT class_id, count(*) AS n, 0::BIGINT AS with_confidence FROM pred WHERE confidence >= 0.8::DOUBLE GROUP BY class_id"),
    "query_class": _sql(f"SELECT image, line_no, class_id, {_NAME} AS class_name FROM gt WHERE class_id IN (1, 5)"),
    "query_attribute": _sql("SELECT image, line_no, class_id FROM gt WHERE defect = 2"),
    "query_attribute_nonzero": _sql("SELECT class_id, count(*) AS n FROM gt WHERE defect <> 0 GROUP BY class_id"),
    "select_semi": "SELECT DISTINCT o_orderkey AS image, 'img_' || o_orderkey || '.jpg' AS file_name FROM orders WHERE o_orderkey % 7 = 0",
    "delete_class": _sql("SELECT (class_id - (class_id > 1)::INT - (class_id > 3)::INT)::INT AS class_id, count(*) AS n FROM gt WHERE class_id NOT IN (1, 3) GROUP BY 1"),
    "replace_class": _sql("SELECT CASE WHEN class_id IN (2, 3) THEN 8 ELSE class_id END AS class_id, count(*) AS n FROM gt GROUP BY 1"),
    "merge_compact": _sql(f"SELECT CASE WHEN class_id <= 2 THEN 0 ELSE class_id - 2 END AS class_id, CASE WHEN class_id <= 2 THEN 'car' ELSE {_NAME} END AS class_name, count(*) AS n FROM gt GROUP BY 1, 2"),
    "edit_report": _sql("SELECT 'merge_class' AS operation, image, line_no, class_id AS old_class, 1 AS new_class FROM gt WHERE class_id IN (0, 2)"),
    "rename_class": _sql(f"SELECT CASE class_id WHEN 4 THEN 'bicycle' ELSE {_NAME} END AS class_name, count(*) AS n FROM gt GROUP BY 1"),
    "apply_map": _sql("SELECT CASE class_id WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 4 END AS class_id, CASE class_id WHEN 0 THEN 'person' WHEN 4 THEN 'cycle' WHEN 5 THEN 'sign' WHEN 7 THEN 'cat' ELSE 'vehicle' END AS class_name, count(*) AS n FROM gt WHERE class_id <> 6 GROUP BY 1, 2"),
    "set_attribute": _sql("SELECT image, line_no, class_id, concat_ws(',', CASE WHEN defect = 1 THEN 2 ELSE defect::INT END, grade::INT, CASE WHEN class_id IN (1, 2) THEN 5 END) AS attrs FROM gt"),
    "delete_attribute": _sql("SELECT image, line_no, class_id FROM gt WHERE NOT (grade IN (2, 3) AND class_id <= 3)"),
    "merge_union": _sql("SELECT part, list_element(['person', 'car', 'truck', 'bus', 'bike', 'sign', 'dog', 'cat'], CASE part WHEN 'd0' THEN class_id ELSE 7 - class_id END + 1) AS class_name, count(*) AS n, count(DISTINCT image) AS images FROM (SELECT 'd0' AS part, * FROM gt WHERE image % 2 = 0 UNION ALL SELECT 'd1', * FROM gt WHERE image % 3 = 0) GROUP BY 1, 2"),
    "merge_attributes": _sql("""SELECT class_id, defect, grade, age, count(*) AS n, sum(image)::BIGINT AS images FROM (
SELECT image, class_id, list_element(['no', 'scratch', 'dent'], defect::INT + 1) AS defect, list_element(['a', 'b', 'c', 'd'], grade::INT + 1) AS grade, '0.0' AS age FROM gt WHERE image % 2 = 0 UNION ALL
SELECT image, class_id, list_element(['dent', 'no', 'rust'], defect::INT + 1), list_element(['d', 'c', 'b', 'a'], grade::INT + 1), class_id::DOUBLE::VARCHAR FROM gt WHERE image % 2 = 1) GROUP BY ALL"""),
    "split_counts": """WITH i AS (SELECT DISTINCT o_orderkey AS image FROM orders),
r AS (SELECT image, row_number() OVER (ORDER BY ('0x' || substr(md5('233/' || image), 1, 13))::BIGINT, image) AS k, count(*) OVER () AS n FROM i),
s AS (SELECT *, floor(n * 0.7::DOUBLE / (0.7::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE)) AS a, floor(n * 0.2::DOUBLE / (0.7::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE)) AS b FROM r)
SELECT CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(image)::BIGINT AS images FROM s GROUP BY 1""",
    "exact_duplicates": "SELECT sha256(text) AS digest, doc_id AS image, n FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1 AND text IS NOT NULL",
    "orphan_labels": _sql("SELECT class_id, count(*) AS n FROM gt WHERE image NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY class_id"),
    "duplicate_lines": _sql("SELECT image, line_no FROM (SELECT *, row_number() OVER (PARTITION BY image, class_id, floor(w * 50) ORDER BY line_no) AS r FROM gt) WHERE r > 1"),
    "validate_issues": _sql("""SELECT level, code, count(*) AS n FROM (
SELECT 'warning' AS level, 'coord_out_of_range' AS code FROM gt WHERE NOT cx * 1.2::DOUBLE BETWEEN 0 AND 1 UNION ALL
SELECT 'warning', 'coord_out_of_range' FROM gt WHERE NOT w - 0.045::DOUBLE BETWEEN 0 AND 1 UNION ALL
SELECT 'error', 'invalid_box_size' FROM gt WHERE w - 0.045::DOUBLE <= 0 UNION ALL
SELECT 'warning', 'duplicate_annotation' FROM (SELECT row_number() OVER (PARTITION BY image, class_id, round(cx * 1.2::DOUBLE, 6), round(cy, 6), round(w - 0.045::DOUBLE, 6), round(h, 6) ORDER BY line_no) AS r FROM gt) WHERE r > 1 UNION ALL
SELECT 'error', 'class_out_of_range' FROM gt WHERE class_id = 0) GROUP BY ALL"""),
    "class_counts": _sql("SELECT k::INT AS class_id, list_element(['person', 'car', 'truck', 'bus', 'bike', 'sign', 'dog', 'cat', 'boat'], k + 1) AS class_name, coalesce(n, 0) AS objects, coalesce(i, 0) AS images FROM (SELECT unnest(range(9)) AS k) LEFT JOIN (SELECT class_id, count(*) AS n, count(DISTINCT image) AS i FROM gt GROUP BY class_id) ON k = class_id"),
    "describe_boxes": _sql("SELECT series, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM (SELECT 'width' AS series, w AS v FROM gt UNION ALL SELECT 'height', h FROM gt UNION ALL SELECT 'area', w * h FROM gt UNION ALL SELECT 'aspect', w / h FROM gt) GROUP BY series"),
    "aspect_histogram": _sql(f"SELECT bin, low, high, count(w) AS n FROM (VALUES {_EDGES}) AS e(bin, low, high) LEFT JOIN gt ON (w / h > low OR (bin = 0 AND w / h = low)) AND w / h <= high GROUP BY ALL"),
    "objects_per_image": _sql("SELECT objects, count(*) AS images FROM (SELECT o.image, count(g.image) AS objects FROM (SELECT DISTINCT o_orderkey AS image FROM orders) o LEFT JOIN gt g USING (image) GROUP BY o.image) GROUP BY objects"),
    "empty_images": _sql("SELECT DISTINCT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT image FROM gt)"),
    "size_buckets": _sql("SELECT size, class_id, count(*) AS n FROM gt GROUP BY ALL"),
    "attribute_counts": _sql(f"SELECT attribute, value, count(*) AS n FROM (SELECT 'defect' AS attribute, {_DEFECT} AS value FROM gt UNION ALL SELECT 'grade', {_GRADE} FROM gt) GROUP BY ALL"),
    "class_attribute_counts": _sql(f"SELECT class_id, attribute, value, count(*) AS n FROM (SELECT class_id, 'defect' AS attribute, {_DEFECT} AS value FROM gt UNION ALL SELECT class_id, 'grade', {_GRADE} FROM gt) GROUP BY ALL"),
    "polygon_boxes": _sql("SELECT image, line_no, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h, round(w * h, 6) AS twice_area FROM gt"),
    "letterbox_boxes": _sql("""SELECT image, line_no, class_id, round(cx * nw / 640 + floor((640 - nw) / 2) / 640, 6) AS cx, round(cy * nh / 640 + floor((640 - nh) / 2) / 640, 6) AS cy, round(w * nw / 640, 6) AS w, round(h * nh / 640, 6) AS h
FROM (SELECT *, greatest(1, round_even(width * s, 0)) AS nw, greatest(1, round_even(height * s, 0)) AS nh FROM (SELECT *, least(640 / width::DOUBLE, 640 / height::DOUBLE) AS s FROM gt))"""),
    "crop_rects": _sql("""SELECT image, ord, class_id, greatest(0, floor(a - 4))::INT AS left, greatest(0, floor(b - 4))::INT AS top, least(width, ceil(c + 4))::BIGINT AS right, least(height, ceil(d + 4))::BIGINT AS bottom
FROM (SELECT *, x1 * width AS a, y1 * height AS b, x2 * width AS c, y2 * height AS d FROM gt) WHERE c - a >= 20 AND d - b >= 20"""),
    "annotation_table": _sql(f"SELECT image, line_no, class_id, {_NAME} AS class_name, cx, cy, w, h, w * h AS area, {_DEFECT} AS attr_defect, {_GRADE} AS attr_grade FROM gt"),
    "attribute_table": _sql(f"SELECT image, line_no, {_NAME} AS class_name, 'defect' AS attribute, defect AS raw, {_DEFECT} AS value FROM gt UNION ALL SELECT image, line_no, {_NAME}, 'grade', grade, {_GRADE} FROM gt"),
    "positive_attributes": _sql("SELECT (defect <> 0)::INT + 1 AS positive, count(*) AS n FROM gt GROUP BY 1"),
    "image_shapes": "SELECT DISTINCT o_orderkey AS image, 320 + 64 * (o_orderkey % 10) AS width, 240 + 48 * (o_orderkey % 10) AS height, round((320 + 64 * (o_orderkey % 10)) / (240 + 48 * (o_orderkey % 10))::DOUBLE, 6) AS aspect FROM orders",
    "subset_class_counts": _sql("SELECT class_id, count(*) AS objects FROM gt WHERE image IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY class_id"),
    "draw_list": _sql(f"""SELECT image, ord, px1, py1, greatest(least(greatest(round_even(x2 * width, 0), 0), width), px1 + 1)::INT AS px2, greatest(least(greatest(round_even(y2 * height, 0), 0), height), py1 + 1)::INT AS py2,
class_id % 9 AS colour, {_NAME} || printf(' %.2f', confidence) AS label FROM (SELECT *, least(least(greatest(round_even(x1 * width, 0), 0), width), width - 1)::INT AS px1,
least(least(greatest(round_even(y1 * height, 0), 0), height), height - 1)::INT AS py1 FROM pred WHERE confidence >= 0.7::DOUBLE)"""),
    "filtered_counts": _sql(f"""SELECT class_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM (
WITH fg AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY image ORDER BY ord) - 1)::INT AS ord) FROM gt WHERE class_id <> 7 AND w * h >= 0.005::DOUBLE AND w * width >= 30 AND h * height >= 30),
fp AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY image ORDER BY ord) - 1)::INT AS ord) FROM pred WHERE class_id <> 7 AND confidence >= 0.6::DOUBLE AND w * h >= 0.005::DOUBLE AND w * width >= 30 AND h * height >= 30),
{corpus.PAIRS_SQL.format(gt="fg", pred="fp")}, {corpus.MATCH_SQL.format(thr="0.5::DOUBLE")}
SELECT * FROM (SELECT class_id, count(*) AS ng FROM fg GROUP BY class_id) FULL JOIN (SELECT class_id, count(*) AS np FROM fp GROUP BY class_id) USING (class_id)
LEFT JOIN (SELECT class_id, count(*) AS tp FROM mt GROUP BY class_id) USING (class_id))"""),
}
