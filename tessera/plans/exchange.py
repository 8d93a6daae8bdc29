"""Queries of label text, interchange tables, corrections, scenes and lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections, tables
from ..operators import dataset as ds
from ..operators import evaluation as ev
from ..sources import formats, images, labels, multimodal
from . import corpus
from .corpus import table
from .dataset import _DEFECT, _NAME, ATTRIBUTES, NAMES, _sql


def _gt(spark, sf_dir):
    return corpus.ground_truth(spark, sf_dir)


def _labelled(spark, sf_dir):
    return _gt(spark, sf_dir).withColumn("polygon", F.lit(None).cast(labels.POINT))


def label_lines(spark, sf_dir):
    return _labelled(spark, sf_dir).select("image", "ord", labels.to_line().alias("line"))


def label_round_trip(spark, sf_dir):
    """Annotations written as label texts, one for each image, and read again."""
    texts = labels.label_texts(_labelled(spark, sf_dir), corpus.images(spark, sf_dir))
    return labels.parse_lines(texts, attributes=True).select("image", "ord", "class_id", "cx", "cy", "w", "h")


def attribute_matrix(spark, sf_dir):
    return tables.attribute_matrix(_gt(spark, sf_dir), NAMES, ATTRIBUTES)


def repeated_names(spark, sf_dir):
    pics = corpus.images(spark, sf_dir).withColumn("file_name", F.concat(F.lit("img_"), (F.col("image") % 1000).cast("string"), F.lit(".jpg")))
    return tables.repeated_names(pics).select("image", "file_name")


def listed_images(spark, sf_dir):
    """Names of a split list: some exact, some with another suffix, some unknown."""
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("img_"), key, F.lit(".jpg"))).when(F.col("o_orderkey") % 11 == 1, F.concat(F.lit("old/img_"), key, F.lit(".png"))).otherwise(F.concat(F.lit("lost_"), key))
    listed = table(spark, sf_dir, "orders").where("o_orderkey % 11 <= 2").select(name.alias("name"))
    return tables.resolve_listed(corpus.images(spark, sf_dir), listed)


def merged_counts(spark, sf_dir):
    """True and false positives and misses after three classes become one."""
    gt, pred, _ = tables.merged_sides(_gt(spark, sf_dir), corpus.predictions(spark, sf_dir), NAMES, {"vehicle": ["car", "truck", "bus"]})
    return ev.counts_by_class(ev.reindex(gt), ev.reindex(pred))


def _coco(spark, sf_dir):
    return formats.coco_tables(corpus.images(spark, sf_dir), _gt(spark, sf_dir), corpus.classes(spark))


def coco_images(spark, sf_dir):
    return _coco(spark, sf_dir)[0]


def coco_annotations(spark, sf_dir):
    at = lambda k: F.round(F.get("bbox", F.lit(k)), 6)
    return _coco(spark, sf_dir)[1].select("id", "image_id", "category_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), F.round("area", 6).alias("area"))


def _corrected(spark, sf_dir):
    ann = _gt(spark, sf_dir).withColumn("image", F.col("image").cast("string"))
    crops = table(spark, sf_dir, "lineitem").where("l_suppkey % 13 = 0").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("crop")).distinct()
    return corrections.correct_from_crops(ann, crops, 2)


def crop_corrections(spark, sf_dir):
    return _corrected(spark, sf_dir)[1].select("crop", "outcome")


def corrected_counts(spark, sf_dir):
    return _corrected(spark, sf_dir)[0].groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def resize_targets(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    scaled, by_width = tables.resize_target(w, h, scale=0.37), tables.resize_target(w, h, to_width=500)
    return corpus.images(spark, sf_dir).select("image", scaled[0].alias("scaled_width"), scaled[1].alias("scaled_height"), by_width[1].alias("height_at_500"))


def _scenes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("n")).distinct()
    pics = lambda rows, suffix: rows.select(F.concat("key", F.lit(suffix)).alias("image"), F.concat(F.lit("d/"), "key", F.lit(suffix + ".png")).alias("path"))
    visible, thermal = pics(orders.where("n % 3 <> 0"), "_V"), pics(orders.where("n % 4 <> 0"), "_T")
    return multimodal.associate({"rgb": (visible, "_V"), "infrared": (thermal, "_T")}, pics(orders.where("n % 5 <> 0"), "_gt"), "_gt")


def scenes_complete(spark, sf_dir):
    return _scenes(spark, sf_dir)[0].where("complete").select("scene")


def scene_issues(spark, sf_dir):
    return _scenes(spark, sf_dir)[1].select("scene", "code", "level", "modality")


def stretched_pixels(spark, sf_dir):
    """Every vector of ``embeddings`` as a row of pixels, stretched over its own range."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))
    out = images.to_uint8(rows, preserve_zero=False)
    return out.select("image", F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("values").alias("most"))


def stretched_depth(spark, sf_dir):
    """Every vector of ``embeddings`` as a row of depths in eighths, of which zeros are no depth."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda v: F.rint(v.cast("double") * 8)).alias("values"))
    zeros = F.size(F.filter("values", lambda v: v == 0)).alias("zeros")
    total = lambda c, alias: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v).alias(alias)
    plain = images.to_uint8(rows, stretch=False).select("image", total("values", "clipped"))
    return images.to_uint8(rows).select("image", zeros, total("values", "total")).join(plain, "image")


def unique_file_names(spark, sf_dir):
    """File names of images that share few names, some with a number that another would get."""
    name = F.concat(F.lit("p"), (F.col("image") % 50).cast("string"), F.when(F.col("image") % 11 == 0, F.concat(F.lit("_"), (F.col("image") % 97).cast("string"))).otherwise(""), F.lit(".png"))
    return ds.unique_names(corpus.images(spark, sf_dir).select("image", name.alias("file_name")), "image")


QUERIES = (label_lines, label_round_trip, attribute_matrix, repeated_names, listed_images, merged_counts, coco_images, coco_annotations, crop_corrections, corrected_counts, resize_targets, scenes_complete, scene_issues, stretched_pixels, stretched_depth, unique_file_names)

_PICS = "pics AS (SELECT DISTINCT o_orderkey AS image, 320 + 64 * (o_orderkey % 10) AS width, 240 + 48 * (o_orderkey % 10) AS height FROM orders)"
_SCENES = """sc AS (SELECT DISTINCT o_orderkey::VARCHAR AS scene, o_orderkey % 3 <> 0 AS v, o_orderkey % 4 <> 0 AS t, o_orderkey % 5 <> 0 AS g FROM orders)"""
_CROPS = """crops AS (SELECT DISTINCT l_orderkey AS image, l_linenumber AS n FROM lineitem WHERE l_suppkey % 13 = 0)"""
_VEHICLE = "CASE class_id WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 ELSE 5 END"


def _number(value: str) -> str:
    return f"rtrim(rtrim(printf('%.6f', {value}), '0'), '.')"


SQL = {
    "label_lines": _sql(f"SELECT image, ord, concat_ws(' ', class_id, 2, {', '.join(_number(c) for c in ('defect', 'grade', 'cx', 'cy', 'w', 'h'))}) AS line FROM gt"),
    "label_round_trip": _sql("SELECT image, ord, class_id, cx, cy, w, h FROM gt_i"),
    "attribute_matrix": _sql(f"SELECT {_NAME} AS class_name, count(*) FILTER (WHERE {_DEFECT} <> 'no') AS defect, count(*) AS grade FROM gt GROUP BY 1 UNION ALL SELECT 'all', count(*) FILTER (WHERE {_DEFECT} <> 'no'), count(*) FROM gt"),
    "repeated_names": "SELECT image, file_name FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY image) AS r FROM (SELECT DISTINCT o_orderkey AS image, 'img_' || o_orderkey % 1000 || '.jpg' AS file_name FROM orders)) WHERE r > 1",
    "listed_images": "SELECT DISTINCT CASE o_orderkey % 11 WHEN 0 THEN 'img_' || o_orderkey || '.jpg' WHEN 1 THEN 'old/img_' || o_orderkey || '.png' ELSE 'lost_' || o_orderkey END AS name, (o_orderkey % 11 < 2)::BIGINT AS n_matches, CASE WHEN o_orderkey % 11 < 2 THEN o_orderkey END AS image FROM orders WHERE o_orderkey % 11 <= 2",
    "merged_counts": _sql(f"""SELECT class_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM (
WITH mg AS (SELECT * REPLACE ({_VEHICLE} AS class_id) FROM gt_i), mp AS (SELECT * REPLACE ({_VEHICLE} AS class_id) FROM pred_i),
{corpus.PAIRS_SQL.format(gt="mg", pred="mp")}, {corpus.MATCH_SQL.format(thr="0.5::DOUBLE")}
SELECT * FROM (SELECT class_id, count(*) AS ng FROM mg GROUP BY class_id) FULL JOIN (SELECT class_id, count(*) AS np FROM mp GROUP BY class_id) USING (class_id)
LEFT JOIN (SELECT class_id, count(*) AS tp FROM mt GROUP BY class_id) USING (class_id))"""),
    "coco_images": f"WITH {_PICS} SELECT row_number() OVER (ORDER BY 'img_' || image || '.jpg') AS id, 'img_' || image || '.jpg' AS file_name, width, height FROM pics",
    "coco_annotations": _sql(f"""SELECT row_number() OVER (ORDER BY image_id, ord) AS id, image_id, class_id AS category_id, round(cx * width - w * width / 2, 6) AS x, round(cy * height - h * height / 2, 6) AS y, round(w * width, 6) AS w, round(h * height, 6) AS h, round(w * width * (h * height), 6) AS area
FROM gt JOIN (SELECT image, row_number() OVER (ORDER BY 'img_' || image || '.jpg') AS image_id FROM (SELECT DISTINCT o_orderkey AS image FROM orders)) USING (image)"""),
    "crop_corrections": _sql("SELECT image || '_' || n AS crop, CASE WHEN image NOT IN (SELECT image FROM gt) THEN 'missing_image' WHEN class_id IS NULL THEN 'invalid_index' WHEN class_id = 2 THEN 'unchanged' ELSE 'updated' END AS outcome FROM crops LEFT JOIN (SELECT image, line_no AS n, class_id FROM gt) USING (image, n)").replace("WITH ", f"WITH {_CROPS},", 1),
    "corrected_counts": _sql("SELECT CASE WHEN n IS NULL THEN class_id ELSE 2 END AS class_id, count(*) AS n FROM gt LEFT JOIN crops ON crops.image = gt.image AND n = line_no GROUP BY 1").replace("WITH ", f"WITH {_CROPS},", 1),
    "resize_targets": f"WITH {_PICS} SELECT image, greatest(1, round_even(width * 0.37::DOUBLE, 0))::INT AS scaled_width, greatest(1, round_even(height * 0.37::DOUBLE, 0))::INT AS scaled_height, greatest(1, round_even(height * 500 / width, 0))::INT AS height_at_500 FROM pics",
    "scenes_complete": f"WITH {_SCENES} SELECT scene FROM sc WHERE v AND t AND g",
    "scene_issues": f"""WITH {_SCENES} SELECT scene, 'orphan_label' AS code, 'warning' AS level, 'label' AS modality FROM sc WHERE g AND NOT v AND NOT t
UNION ALL SELECT scene, 'orphan_image', 'warning', NULL FROM sc WHERE NOT g AND (v OR t)
UNION ALL SELECT scene, 'missing_modality', 'warning', CASE WHEN v THEN 'infrared' ELSE 'rgb' END FROM sc WHERE v <> t""",
    "stretched_pixels": """SELECT image, list_sum(p)::BIGINT AS total, list_max(p)::INT AS most FROM (SELECT vec_id AS image, CASE WHEN list_max(v) = list_min(v) THEN list_transform(v, lambda x: 255::DOUBLE) ELSE list_transform(v, lambda x: round_even((x - list_min(v)) / (list_max(v) - list_min(v)) * 255, 0)) END AS p
FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings))""",
    "stretched_depth": """WITH e AS (SELECT vec_id AS image, list_transform(embedding::DOUBLE[], lambda x: round_even(x * 8, 0)) AS v FROM embeddings),
r AS (SELECT image, v, list_filter(v, lambda x: x <> 0) AS z FROM e)
SELECT image, (len(v) - len(z))::INT AS zeros,
coalesce(list_sum(list_transform(z, lambda x: CASE WHEN list_max(z) = list_min(z) THEN 255 ELSE round_even(1 + (x - list_min(z)) / (list_max(z) - list_min(z)) * 254, 0) END)), 0)::BIGINT AS total,
coalesce(list_sum(list_transform(v, lambda x: round_even(least(greatest(x, 0), 255), 0))), 0)::BIGINT AS clipped FROM r""",
    "unique_file_names": """WITH i AS (SELECT DISTINCT o_orderkey AS image, 'p' || o_orderkey % 50 AS short, CASE WHEN o_orderkey % 11 = 0 THEN '_' || o_orderkey % 97 ELSE '' END AS tail FROM orders),
n AS (SELECT image, short || tail AS stem, row_number() OVER (PARTITION BY short || tail ORDER BY image) - 1 AS r FROM i),
t AS (SELECT short AS stem, list_distinct(list(substr(tail, 2)::BIGINT)) AS used FROM i WHERE tail <> '' GROUP BY 1),
f AS (SELECT n.stem, list_filter(range(1, max(r)::BIGINT + 100), lambda x: NOT list_contains(coalesce(any_value(used), []), x)) AS free FROM n LEFT JOIN t USING (stem) GROUP BY 1)
SELECT image, CASE WHEN r = 0 THEN stem ELSE stem || '_' || free[r] END || '.png' AS file_name FROM n JOIN f USING (stem)""",
}
