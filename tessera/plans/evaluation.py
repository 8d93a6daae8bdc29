"""Evaluation queries over the derived corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from . import corpus
from .corpus import MATCH_SQL, NMS_SQL, PAIRS_SQL

THRS = ", ".join(f"{t!r}::DOUBLE" for t in ev.THRESHOLDS)


def _sides(spark, sf_dir):
    return ev.reindex(corpus.ground_truth(spark, sf_dir)), ev.reindex(corpus.predictions(spark, sf_dir))


def match_counts_by_class(spark, sf_dir):
    return ev.counts_by_class(*_sides(spark, sf_dir))


def iou_pairs(spark, sf_dir):
    return ev.pairs(*_sides(spark, sf_dir), same_class=False, least=0.1)


def nms_kept(spark, sf_dir):
    return ev.suppress(corpus.predictions(spark, sf_dir)).select("image", "class_id", "ord", "confidence")


def match_at_thresholds(spark, sf_dir):
    return ev.match(*_sides(spark, sf_dir), ev.THRESHOLDS).groupBy("class_id", "thr").agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg("iou"), 6).alias("mean_iou"))


def _labelled(spark, sf_dir, thresholds=ev.THRESHOLDS):
    columns = ["image", "ord", "class_id", *ev.BOX, "confidence"]
    gt, pred = corpus.ground_truth(spark, sf_dir).select(*columns), corpus.predictions(spark, sf_dir).select(*columns)
    labels = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_labels"))
    return ev.labelled(ev.reindex(gt), ev.reindex(ev.suppress(pred)), thresholds), labels


def pr_curve(spark, sf_dir):
    points = ev.curves(*_labelled(spark, sf_dir, (0.5,)), thresholds=(0.5,))
    return points.select("class_id", "image", "p", "n", "tp_c", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("envelope", 6).alias("envelope"))


def ap_per_class(spark, sf_dir):
    return ev.areas(*_labelled(spark, sf_dir)).select("class_id", "thr", F.round("ap", 6).alias("ap"))


def _rounded(df, keys):
    return df.select(*[c if c in keys else F.round(c, 6).alias(c) for c in df.columns])


def mean_average_precision(spark, sf_dir):
    rows = ev.areas(*_labelled(spark, sf_dir)).groupBy("class_id").agg(F.avg("ap").alias("ap"), F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"))
    return rows.agg(F.round(F.avg("ap50"), 6).alias("map50"), F.round(F.avg("ap"), 6).alias("map"), F.count(F.lit(1)).alias("classes"))


def class_metrics(spark, sf_dir):
    rows = ev.class_metrics(corpus.ground_truth(spark, sf_dir), corpus.predictions(spark, sf_dir))
    return _rounded(rows, ("class_id", "images", "labels", "predictions"))


def macro_metrics(spark, sf_dir):
    rows = ev.macro_metrics(ev.class_metrics(corpus.ground_truth(spark, sf_dir), corpus.predictions(spark, sf_dir)))
    return _rounded(rows, ("labels", "predictions"))


def size_metrics(spark, sf_dir):
    return _rounded(ev.size_metrics(corpus.ground_truth(spark, sf_dir), corpus.predictions(spark, sf_dir)), ("size", "images", "labels", "predictions"))


def _errors(spark, sf_dir):
    return ev.errors(corpus.ground_truth(spark, sf_dir), corpus.predictions(spark, sf_dir))


def error_taxonomy(spark, sf_dir):
    return _errors(spark, sf_dir).withColumn("iou", F.round("iou", 6))


def error_summary(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("status", "error_type").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(spark, sf_dir):
    return ev.confusion(_errors(spark, sf_dir))


def review_groups(spark, sf_dir):
    return ev.review_group(_errors(spark, sf_dir)).groupBy("review_group").agg(F.count(F.lit(1)).alias("n"))


def duplicate_gt(spark, sf_dir):
    return ev.duplicate_labels(ev.reindex(corpus.ground_truth(spark, sf_dir)), 0.5).withColumn("iou", F.round("iou", 6))


def compare_status(spark, sf_dir):
    return ev.compare(corpus.ground_truth(spark, sf_dir), corpus.predictions(spark, sf_dir), 0.5, 0.6)


def compare_summary(spark, sf_dir):
    return compare_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = (match_counts_by_class, iou_pairs, nms_kept, match_at_thresholds, pr_curve, ap_per_class, mean_average_precision, class_metrics, macro_metrics, size_metrics, error_taxonomy, error_summary, confusion_matrix, review_groups, duplicate_gt, compare_status, compare_summary)

_PLAIN = PAIRS_SQL.format(gt="gt_i", pred="pred_i")
_NMS = PAIRS_SQL.format(gt="gt_i", pred="nms_i")
_HALF, _ALL = MATCH_SQL.format(thr="0.5::DOUBLE"), MATCH_SQL.format(thr=THRS)
_TPS = """
lab AS (SELECT class_id, count(*) AS n_labels FROM gt GROUP BY class_id),
tps AS (SELECT n.class_id, t.thr, n.image, n.ord AS p, n.confidence, n_labels, CASE WHEN m.p IS NULL THEN 0 ELSE 1 END AS tp
  FROM nms_i n JOIN lab USING (class_id) CROSS JOIN ths t LEFT JOIN mt m ON m.image = n.image AND m.class_id = n.class_id AND m.p = n.ord AND m.thr = t.thr)"""
_POINTS = """
cum AS (SELECT *, row_number() OVER o AS n, sum(tp) OVER o AS tp_c FROM tps WINDOW o AS (PARTITION BY class_id, thr ORDER BY confidence DESC, image, p ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT *, tp_c / (n_labels + 1e-16::DOUBLE) AS recall, tp_c / n::DOUBLE AS precision FROM cum),
env AS (SELECT *, max(precision) OVER (PARTITION BY class_id, thr ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM pts)"""
_CURVE = f"{_TPS},{_POINTS}"
_AP = """
z AS (SELECT class_id, thr, n, recall AS r, envelope AS m FROM env UNION ALL
  SELECT DISTINCT class_id, thr, 0, 0::DOUBLE, 1::DOUBLE FROM env UNION ALL SELECT class_id, thr, max(n) + 1, 1::DOUBLE, 0::DOUBLE FROM env GROUP BY class_id, thr),
sg AS (SELECT *, lead(r) OVER o AS r2, lead(m) OVER o AS m2 FROM z WINDOW o AS (PARTITION BY class_id, thr ORDER BY n)),
gr AS (SELECT class_id, thr, k, m + (m2 - m) * (k * 0.01::DOUBLE - r) / (r2 - r) AS v FROM sg, range(100) AS s(k) WHERE r <= k * 0.01::DOUBLE AND k * 0.01::DOUBLE < r2),
ap AS (SELECT class_id, thr, 0.01::DOUBLE * (sum(v) - sum(CASE WHEN k = 0 THEN v ELSE 0 END) / 2) AS ap FROM gr GROUP BY class_id, thr)"""
_F1 = """
fc AS (SELECT class_id, floor(confidence * 999)::INT AS cell, arg_max({c: confidence, r: recall, p: precision}, n) AS hi, arg_min({c: confidence, r: recall, p: precision}, n) AS lo FROM pts WHERE thr = 0.5 GROUP BY ALL),
gd AS (SELECT class_id, k AS cell, k / 999::DOUBLE AS px FROM (SELECT DISTINCT class_id FROM fc), range(1000) AS s(k)),
near AS (SELECT g.*, h.hi AS a, l.lo AS b FROM gd g ASOF LEFT JOIN fc h ON g.class_id = h.class_id AND g.cell <= h.cell ASOF LEFT JOIN fc l ON g.class_id = l.class_id AND g.cell > l.cell),
pt AS (SELECT class_id, cell, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN a.r ELSE a.r + (b.r - a.r) * (a.c - px) / (a.c - b.c) END AS recall,
  CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN a.p ELSE a.p + (b.p - a.p) * (a.c - px) / (a.c - b.c) END AS precision FROM near),
f1 AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-16::DOUBLE) AS f1 FROM pt),
mf AS (SELECT cell, avg(f1) AS m FROM f1 GROUP BY cell),
sm AS (SELECT cell, (sum(m) OVER (ORDER BY cell ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) + greatest(0, 50 - cell) * (SELECT arg_min(m, cell) FROM mf)
  + greatest(0, cell - 949) * (SELECT arg_max(m, cell) FROM mf)) / 101 AS s FROM mf),
bf AS (SELECT f1.* FROM f1 JOIN (SELECT arg_max(cell, (s, -cell)) AS cell FROM sm) USING (cell))"""
_CLASS = f"""
cm AS (SELECT class_id, coalesce(images, 0) AS images, coalesce(labels, 0) AS labels, coalesce(predictions, 0) AS predictions, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall,
    coalesce(f1, 0) AS f1, coalesce(ap50, 0) AS ap50, coalesce(ap75, 0) AS ap75, coalesce(ap, 0) AS ap
  FROM (SELECT class_id, count(*) AS labels, count(DISTINCT image) AS images FROM gt_i GROUP BY class_id) FULL JOIN (SELECT class_id, count(*) AS predictions FROM nms_i GROUP BY class_id) USING (class_id)
  LEFT JOIN (SELECT class_id, avg(ap) AS ap, max(CASE WHEN thr = 0.5 THEN ap END) AS ap50, max(CASE WHEN thr = {ev.THRESHOLDS[5]!r}::DOUBLE THEN ap END) AS ap75 FROM ap GROUP BY class_id) USING (class_id)
  LEFT JOIN bf USING (class_id))"""
_SIZE_TPS = """
lab AS (SELECT size, class_id, count(*) AS n_labels FROM gt_i GROUP BY ALL),
took AS (SELECT m.image, m.p, arg_min(g.size, m.thr) AS size FROM mt m JOIN gt_i g ON g.image = m.image AND g.ord = m.g GROUP BY ALL),
ns AS (SELECT n.* REPLACE (coalesce(took.size, n.size) AS size) FROM nms_i n LEFT JOIN took ON took.image = n.image AND took.p = n.ord),
tps AS (SELECT n.size, n.class_id, t.thr, n.image, n.ord AS p, n.confidence, n_labels, CASE WHEN m.p IS NULL THEN 0 ELSE 1 END AS tp
  FROM ns n JOIN lab ON lab.size = n.size AND lab.class_id = n.class_id CROSS JOIN ths t LEFT JOIN mt m ON m.image = n.image AND m.class_id = n.class_id AND m.p = n.ord AND m.thr = t.thr)"""
_BY_SIZE = f"{_SIZE_TPS},{_POINTS},{_AP}".replace(_POINTS, _POINTS.replace("class_id", "size, class_id")).replace(_AP, _AP.replace("class_id", "size, class_id"))
_SIZE_F1 = """
fc AS (SELECT size, class_id, floor(confidence * 999)::INT AS cell, arg_max({c: confidence, r: recall, p: precision}, n) AS hi, arg_min({c: confidence, r: recall, p: precision}, n) AS lo FROM pts WHERE thr = 0.5 GROUP BY ALL),
gd AS (SELECT size, class_id, k AS cell, k / 999::DOUBLE AS px FROM (SELECT DISTINCT size, class_id FROM fc), range(1000) AS s(k)),
near AS (SELECT g.*, h.hi AS a, l.lo AS b FROM gd g ASOF LEFT JOIN fc h ON g.size = h.size AND g.class_id = h.class_id AND g.cell <= h.cell
  ASOF LEFT JOIN fc l ON g.size = l.size AND g.class_id = l.class_id AND g.cell > l.cell),
pt AS (SELECT size, class_id, cell, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN a.r ELSE a.r + (b.r - a.r) * (a.c - px) / (a.c - b.c) END AS recall,
  CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN a.p ELSE a.p + (b.p - a.p) * (a.c - px) / (a.c - b.c) END AS precision FROM near),
f1 AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-16::DOUBLE) AS f1 FROM pt),
mf AS (SELECT size, cell, avg(f1) AS m FROM f1 GROUP BY size, cell),
me AS (SELECT size, arg_min(m, cell) AS head, arg_max(m, cell) AS tail FROM mf GROUP BY size),
sm AS (SELECT size, cell, (sum(m) OVER (PARTITION BY size ORDER BY cell ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) + greatest(0, 50 - cell) * head + greatest(0, cell - 949) * tail) / 101 AS s
  FROM mf JOIN me USING (size)),
bf AS (SELECT f1.* FROM f1 JOIN (SELECT size, arg_max(cell, (s, -cell)) AS cell FROM sm GROUP BY size) USING (size, cell))"""
_ERR = """
best_p AS (SELECT image, p, arg_max(g, (iou, -g)) AS g, max(iou) AS iou FROM pr GROUP BY image, p),
best_g AS (SELECT image, g, arg_max(p, (iou, -p)) AS p, max(iou) AS iou FROM pr GROUP BY image, g),
g1 AS (SELECT image, min(ord) AS g FROM gt_i GROUP BY image),
fp0 AS (SELECT n.image, n.ord AS p, n.class_id AS p_class, coalesce(b.g, g1.g) AS g, coalesce(b.iou, 0) AS iou FROM nms_i n ANTI JOIN mt ON mt.image = n.image AND mt.p = n.ord
  LEFT JOIN best_p b ON b.image = n.image AND b.p = n.ord LEFT JOIN g1 ON g1.image = n.image),
fn0 AS (SELECT n.image, n.ord AS g, n.class_id AS g_class, b.p, coalesce(b.iou, 0) AS iou FROM gt_i n ANTI JOIN mt ON mt.image = n.image AND mt.g = n.ord
  LEFT JOIN best_g b ON b.image = n.image AND b.g = n.ord),
fp1 AS (SELECT f.*, o.class_id AS g_class, CASE WHEN f.iou >= 0.5 AND o.class_id <> f.p_class THEN 'class_error_pred' WHEN f.iou >= 0.5 AND m.g IS NOT NULL THEN 'duplicate_prediction'
  WHEN f.iou < 0.1 THEN 'background_fp' ELSE 'localisation_fp' END AS error_type FROM fp0 f LEFT JOIN gt_i o ON o.image = f.image AND o.ord = f.g LEFT JOIN mt m ON m.image = f.image AND m.g = f.g),
fn1 AS (SELECT f.*, o.class_id AS p_class, CASE WHEN f.iou >= 0.5 AND o.class_id <> f.g_class THEN 'fn_class_error' WHEN f.iou >= 0.1 THEN 'fn_low_iou' ELSE 'fn_no_pred' END AS error_type
  FROM fn0 f LEFT JOIN nms_i o ON o.image = f.image AND o.ord = f.p),
err AS (SELECT image, 'tp' AS status, 'tp' AS error_type, g, class_id AS g_class, p, class_id AS p_class, iou FROM mt
  UNION ALL SELECT image, 'fp', error_type, g, g_class, p, p_class, iou FROM fp1
  UNION ALL SELECT image, 'fn', error_type, g, g_class, CASE WHEN error_type <> 'fn_no_pred' THEN p END, CASE WHEN error_type <> 'fn_no_pred' THEN p_class END, iou FROM fn1)"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((corpus.SQL, *ctes)) + "\n" + select


SQL = {
    "match_counts_by_class": _sql(
        """SELECT class_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn
FROM (SELECT class_id, count(*) AS ng FROM gt GROUP BY class_id) FULL JOIN (SELECT class_id, count(*) AS np FROM pred GROUP BY class_id) USING (class_id)
LEFT JOIN (SELECT class_id, count(*) AS tp FROM mt GROUP BY class_id) USING (class_id)""", _PLAIN, _HALF),
    "iou_pairs": _sql("SELECT image, g, g_class, p, p_class, iou FROM pr WHERE iou >= 0.1", _PLAIN),
    "nms_kept": _sql("SELECT image, class_id, ord, confidence FROM nms", NMS_SQL),
    "match_at_thresholds": _sql("SELECT class_id, thr, count(*) AS matches, round(avg(iou), 6) AS mean_iou FROM mt GROUP BY class_id, thr", _PLAIN, _ALL),
    "pr_curve": _sql("SELECT class_id, image, p, n, tp_c::BIGINT AS tp_c, round(recall, 6) AS recall, round(precision, 6) AS precision, round(envelope, 6) AS envelope FROM env", NMS_SQL, _NMS, _HALF, _CURVE),
    "ap_per_class": _sql("SELECT class_id, thr, round(ap, 6) AS ap FROM ap", NMS_SQL, _NMS, _ALL, _CURVE, _AP),
    "mean_average_precision": _sql("SELECT round(avg(ap50), 6) AS map50, round(avg(ap), 6) AS map, count(*) AS classes FROM (SELECT class_id, avg(ap) AS ap, max(CASE WHEN thr = 0.5 THEN ap END) AS ap50 FROM ap GROUP BY class_id)", NMS_SQL, _NMS, _ALL, _CURVE, _AP),
    "class_metrics": _sql("SELECT class_id, images, labels, predictions, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap50, 6) AS ap50, round(ap75, 6) AS ap75, round(ap, 6) AS ap FROM cm", NMS_SQL, _NMS, _ALL, _CURVE, _AP, _F1, _CLASS),
    "macro_metrics": _sql(
        """SELECT sum(labels)::BIGINT AS labels, sum(predictions)::BIGINT AS predictions, round(avg(precision) FILTER (labels > 0), 6) AS precision, round(avg(recall) FILTER (labels > 0), 6) AS recall, round(avg(f1) FILTER (labels > 0), 6) AS f1,
round(avg(ap50) FILTER (labels > 0), 6) AS map50, round(avg(ap75) FILTER (labels > 0), 6) AS map75, round(avg(ap) FILTER (labels > 0), 6) AS map,
round(0.1::DOUBLE * avg(ap50) FILTER (labels > 0) + 0.9::DOUBLE * avg(ap) FILTER (labels > 0), 6) AS fitness FROM cm""", NMS_SQL, _NMS, _ALL, _CURVE, _AP, _F1, _CLASS),
    "size_metrics": _sql(
        f"""SELECT size, images, labels, predictions, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
round(map50, 6) AS map50, round(map75, 6) AS map75, round(map, 6) AS map, round(0.1::DOUBLE * map50 + 0.9::DOUBLE * map, 6) AS fitness
FROM (SELECT size, coalesce(images, 0) AS images, coalesce(labels, 0)::BIGINT AS labels, coalesce(predictions, 0) AS predictions, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('precision', 'recall', 'map50', 'map75', 'map'))}
FROM (VALUES ('small'), ('medium'), ('large')) AS s(size) LEFT JOIN (SELECT size, count(DISTINCT image) AS images FROM gt_i GROUP BY size) USING (size)
LEFT JOIN (SELECT size, sum(n_labels) AS labels FROM lab GROUP BY size) USING (size) LEFT JOIN (SELECT size, count(*) AS predictions FROM ns GROUP BY size) USING (size)
LEFT JOIN (SELECT size, avg(coalesce(precision, 0)) AS precision, avg(coalesce(recall, 0)) AS recall, avg(coalesce(ap50, 0)) AS map50, avg(coalesce(ap75, 0)) AS map75, avg(coalesce(ap, 0)) AS map
  FROM lab LEFT JOIN bf USING (size, class_id) LEFT JOIN (SELECT size, class_id, avg(ap) AS ap, max(CASE WHEN thr = 0.5 THEN ap END) AS ap50, max(CASE WHEN thr = {ev.THRESHOLDS[5]!r}::DOUBLE THEN ap END) AS ap75
  FROM ap GROUP BY ALL) USING (size, class_id) GROUP BY size) USING (size))""",
        NMS_SQL, _NMS, _ALL, _BY_SIZE, _SIZE_F1),
    "error_taxonomy": _sql("SELECT * REPLACE (round(iou, 6) AS iou) FROM err", NMS_SQL, _NMS, _HALF, _ERR),
    "error_summary": _sql("SELECT status, error_type, count(*) AS n FROM err GROUP BY ALL", NMS_SQL, _NMS, _HALF, _ERR),
    "confusion_matrix": _sql(
        """SELECT p_class, g_class, count(*) AS n FROM (
SELECT CASE WHEN status = 'fn' THEN -1 ELSE p_class END AS p_class, CASE WHEN status = 'fp' THEN -1 ELSE g_class END AS g_class FROM err
WHERE error_type NOT IN ('duplicate_prediction', 'class_error_pred', 'fn_class_error')
UNION ALL SELECT p_class, g_class FROM (SELECT DISTINCT image, g, p, p_class, g_class FROM err WHERE error_type IN ('class_error_pred', 'fn_class_error'))) GROUP BY ALL""", NMS_SQL, _NMS, _HALF, _ERR),
    "review_groups": _sql(
        """SELECT 'pred_' || CASE WHEN error_type = 'fn_no_pred' OR p_class IS NULL THEN 'background' ELSE p_class::VARCHAR END || '_gt_' ||
CASE WHEN error_type = 'background_fp' OR g_class IS NULL THEN 'background' ELSE g_class::VARCHAR END AS review_group, count(*) AS n FROM err WHERE status <> 'tp' GROUP BY ALL""", NMS_SQL, _NMS, _HALF, _ERR),
    "duplicate_gt": _sql("SELECT image, g AS first, p AS second, round(iou, 6) AS iou, CASE WHEN g_class = p_class THEN 'same_class_duplicate' ELSE 'different_class_overlap' END AS kind FROM pr WHERE iou >= 0.5 AND g < p", PAIRS_SQL.format(gt="gt_i", pred="gt_i")),
    "compare_status": _sql(
        f"""SELECT image, class_id, status, iou, g, p, confidence FROM gres UNION ALL
SELECT q.image, q.class_id, 'fp', 0, NULL, q.ord, q.confidence FROM cp q ANTI JOIN (SELECT image, class_id, p FROM gres WHERE status = 'tp') t ON t.image = q.image AND t.class_id = q.class_id AND t.p = q.ord""",
        "cp AS (SELECT * FROM pred WHERE confidence >= 0.6::DOUBLE)",
        "gk AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY ord) AS k FROM gt)",
        f"""cs AS (SELECT image, class_id, 0::BIGINT AS k, NULL::INT AS g, NULL::INT AS p, 0::DOUBLE AS iou, []::INT[] AS used FROM gk WHERE k = 1
UNION ALL SELECT b.image, b.class_id, b.k, b.ord, CASE WHEN m.iou >= 0.5 THEN m.p END, coalesce(m.iou, 0), CASE WHEN m.iou >= 0.5 THEN list_append(s.used, m.p) ELSE s.used END
FROM cs s JOIN gk b ON b.image = s.image AND b.class_id = s.class_id AND b.k = s.k + 1,
LATERAL (SELECT max(v) AS iou, arg_max(o, (v, -o)) AS p FROM (SELECT q.ord AS o, {corpus.iou_sql('b', 'q')} AS v FROM cp q WHERE q.image = b.image AND q.class_id = b.class_id AND NOT list_contains(s.used, q.ord)) WHERE v > 0) m)""",
        "gres AS (SELECT c.image, c.class_id, CASE WHEN c.p IS NULL THEN 'fn' ELSE 'tp' END AS status, round(c.iou, 6) AS iou, c.g, c.p, q.confidence FROM cs c LEFT JOIN cp q ON q.image = c.image AND q.class_id = c.class_id AND q.ord = c.p WHERE c.k > 0)"),
}
SQL["compare_summary"] = SQL["compare_status"].replace("SELECT image, class_id, status, iou, g, p, confidence FROM gres UNION ALL", "SELECT status, count(*) AS n FROM (SELECT image, class_id, status, iou, g, p, confidence FROM gres UNION ALL") + ") GROUP BY status"
