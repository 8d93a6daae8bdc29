"""An annotation corpus derived from the driver's ``lineitem`` table.

Every order is an image, every line a box on a lattice of thousandths, so that Spark and
DuckDB compute bit-identical geometry from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import corners, size_bucket

CLASSES = ("person", "car", "truck", "bus", "bike", "sign", "dog", "cat")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    order = Window.partitionBy("l_orderkey").orderBy(*columns[1:])
    rows = table(spark, sf_dir, "lineitem").select(*columns).withColumn("line_no", F.row_number().over(order))
    return rows.withColumn("q", F.col("l_quantity").cast("long"))


def _boxes(rows: DataFrame, dx, dy, class_id, confidence) -> DataFrame:
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("q")
    k = F.lit(1000.0)
    rows = rows.select(
        F.col("l_orderkey").alias("image"), "line_no", (F.col("line_no") - 1).alias("ord"), class_id.cast("int").alias("class_id"),
        ((100 + (part * 37) % 800 + dx) / k).alias("cx"), ((100 + (part * 61 + supp * 13) % 800 + dy) / k).alias("cy"), ((40 + (q * 7) % 160) / k).alias("w"), ((40 + (q * 11) % 160) / k).alias("h"),
        F.array((part % 3).cast("double"), (supp % 4).cast("double")).alias("attrs"), confidence.alias("confidence"),
        (320 + 64 * (F.col("l_orderkey") % 10)).alias("width"), (240 + 48 * (F.col("l_orderkey") % 10)).alias("height"),
    )
    return rows.withColumns(corners()).withColumn("size", size_bucket(F.col("w"), F.col("h"), F.col("width"), F.col("height")))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where("l_partkey % 10 <> 0")
    return _boxes(rows, F.lit(0), F.lit(0), F.col("l_suppkey") % 8, F.lit(None).cast("double"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where("l_suppkey % 9 <> 0")
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("q")
    own = supp % 8
    confidence = (50 + (part * 7 + supp * 3) % 50) / F.lit(100.0)
    return _boxes(rows, (q % 7 - 3) * 8, (part % 5 - 2) * 6, F.when(part % 11 == 0, (own + 1) % 8).otherwise(own), confidence)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")).distinct()
    return rows.withColumn("file_name", F.concat(F.lit("img_"), F.col("image").cast("string"), F.lit(".jpg"))).withColumn("width", 320 + 64 * (F.col("image") % 10)).withColumn("height", 240 + 48 * (F.col("image") % 10))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, class_name string")


#: The same corpus in DuckDB: tables gt and pred, to stand after WITH.
SQL = """
ln AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_no FROM lineitem),
raw AS (
  SELECT true AS is_gt, *, 0 AS dx, 0 AS dy, l_suppkey % 8 AS cls, NULL::DOUBLE AS confidence FROM ln WHERE l_partkey % 10 <> 0
  UNION ALL
  SELECT false, *, (q % 7 - 3) * 8, (l_partkey % 5 - 2) * 6, CASE WHEN l_partkey % 11 = 0 THEN (l_suppkey % 8 + 1) % 8 ELSE l_suppkey % 8 END,
         (50 + (l_partkey * 7 + l_suppkey * 3) % 50) / 100::DOUBLE FROM ln WHERE l_suppkey % 9 <> 0),
bx AS (SELECT is_gt, l_orderkey AS image, line_no::INT AS line_no, (line_no - 1)::INT AS ord, cls::INT AS class_id, confidence,
  (100 + (l_partkey * 37) % 800 + dx) / 1000::DOUBLE AS cx, (100 + (l_partkey * 61 + l_suppkey * 13) % 800 + dy) / 1000::DOUBLE AS cy,
  (40 + (q * 7) % 160) / 1000::DOUBLE AS w, (40 + (q * 11) % 160) / 1000::DOUBLE AS h,
  (l_partkey % 3)::DOUBLE AS defect, (l_suppkey % 4)::DOUBLE AS grade,
  320 + 64 * (l_orderkey % 10) AS width, 240 + 48 * (l_orderkey % 10) AS height FROM raw),
sz AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2,
  CASE WHEN w * width * h * height < 1024 THEN 'small' WHEN w * width * h * height < 9216 THEN 'medium' ELSE 'large' END AS size FROM bx),
gt AS (SELECT * EXCLUDE (is_gt) FROM sz WHERE is_gt), pred AS (SELECT * EXCLUDE (is_gt) FROM sz WHERE NOT is_gt),
gt_i AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY image ORDER BY ord) - 1)::INT AS ord) FROM gt),
pred_i AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY image ORDER BY ord) - 1)::INT AS ord) FROM pred)"""


def iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    return f"({inter} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter}))"


#: Pairs of boxes of an image; match at 0.5; suppressed predictions.
PAIRS_SQL = f"pr AS (SELECT g.image, g.ord AS g, g.class_id AS g_class, p.ord AS p, p.class_id AS p_class, {iou_sql('g', 'p')} AS iou FROM {{gt}} g JOIN {{pred}} p USING (image) WHERE {iou_sql('g', 'p')} > 0)"
MATCH_SQL = """
ths AS (SELECT unnest([{thr}]) AS thr),
cand AS (SELECT *, row_number() OVER (PARTITION BY image, thr, p ORDER BY iou DESC, g DESC) AS r1 FROM pr, ths WHERE g_class = p_class AND iou >= thr),
held AS (SELECT *, row_number() OVER (PARTITION BY image, thr, g ORDER BY p) AS r2 FROM cand WHERE r1 = 1),
mt AS (SELECT image, g_class AS class_id, thr, g, p, iou FROM held WHERE r2 = 1)"""
NMS_SQL = f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY confidence DESC, ord) AS k FROM pred),
sp AS (SELECT image, class_id, k, true AS ok, [{{{{x1: x1, y1: y1, x2: x2, y2: y2}}}}] AS kept FROM rk WHERE k = 1
  UNION ALL
  SELECT b.image, b.class_id, b.k, n.ok, CASE WHEN n.ok THEN list_append(s.kept, {{{{x1: b.x1, y1: b.y1, x2: b.x2, y2: b.y2}}}}) ELSE s.kept END
  FROM sp s JOIN rk b ON b.image = s.image AND b.class_id = s.class_id AND b.k = s.k + 1,
  LATERAL (SELECT coalesce(max({iou_sql('a', 'b')}), 0) < 0.5 AS ok FROM (SELECT unnest(s.kept, recursive := true)) a) n),
nms AS (SELECT rk.* EXCLUDE (k) FROM rk JOIN sp USING (image, class_id, k) WHERE ok),
nms_i AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY image ORDER BY ord) - 1)::INT AS ord) FROM nms)""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")
