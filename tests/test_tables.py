from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import tables
from tests.test_dataset import boxed
from tests.test_evaluation import BASE, boxes


def test_resize_targets(spark):
    row = spark.range(1).select(F.lit(100).alias("w"), F.lit(50).alias("h"))
    w, h = F.col("w"), F.col("h")
    got = [tuple(row.select(*tables.resize_target(w, h, *a)).first()) for a in ((40, None, None), (None, 20, None), (30, 30, None), (None, None, 0.005))]
    assert got == [(40, 20), (40, 20), (30, 30), (1, 1)]


def test_find_image(spark):
    pics = spark.createDataFrame([("/d/a/x.jpg", "x.jpg"), ("/d/b/x.jpg", "x.jpg"), ("/d/b/y.jpg", "y.jpg")], "path string, file_name string")
    assert tables.find_image(pics, "/d/a/x.jpg").count() == 1 and tables.find_image(pics, "b/x.jpg").count() == 1
    assert tables.find_image(pics, "x.jpg").count() == 2 and tables.find_image(pics, "y").first().path == "/d/b/y.jpg"


def test_review_names_and_groups(spark):
    found = ev.errors(boxes(spark, BASE), boxes(spark, [("a", 0, 0.9, 0.9, 0.05, 0.05, 0.9)]))
    names = {(r.error_type, r.crop) for r in tables.review_crop_name(found).collect()}
    assert ("background_fp", "a_pred1_gtnone") in names and ("fn_no_pred", "b_prednone_gt1") in names
    groups = {r.review_group for r in ev.review_group(found).collect()}
    assert groups == {"pred_0_gt_background", "pred_background_gt_0", "pred_background_gt_1"}


def test_small_pixels_go_on_both_sides(spark):
    gt = boxes(spark, [("a", 0, 0.5, 0.5, 0.3, 0.3), ("a", 0, 0.2, 0.2, 0.02, 0.02)], (100, 100))
    pred = boxes(spark, [("a", 0, 0.5, 0.5, 0.3, 0.3, 0.9), ("a", 0, 0.8, 0.8, 0.02, 0.02, 0.9)], (None, None))
    g, p = tables.evaluation_filter(gt, pred, min_pixels=5)
    row = ev.class_metrics(g, p).first()
    assert (row.labels, row.predictions) == (1, 1) and row.precision == row.recall == 1.0


def test_draw_list(spark):
    ann = boxes(spark, [("a", 10, 0.5, 0.5, 0.2, 0.5, 0.5), ("a", 0, 0.5, 0.5, 0.001, 0.001, 0.2)])
    rows = tables.draw_list(ann, ["person"], 0.3, True).collect()
    assert [(r.px1, r.py1, r.px2, r.py2, r.colour, r.label) for r in rows] == [(40, 20, 60, 60, 1, "10 0.50")]
    assert tables.safe_name(F.lit("a b/ä-_")) is not None and boxed(spark, []).count() == 0
