import csv

import pytest
from pyspark.sql import functions as F

from tessera.manager import TASKS, Manager, run_task
from tessera.operators import corrections
from tessera.sources import layout
from tests.test_dataset import boxed, png


@pytest.fixture()
def root(tmp_path):
    for d in ("images", "labels"):
        (tmp_path / d).mkdir()
    for name, text in (("a", "0 .5 .5 .2 .3\n1 .4 .4 .2 .2\n"), ("b", "1 .1 .1 .2 .1\n")):
        png(tmp_path / "images" / f"{name}.png", 100, 80)
        (tmp_path / "labels" / f"{name}.txt").write_text(text)
    (tmp_path / "labels" / "lost.txt").write_text("0 .5 .5 .2 .3\n")
    (tmp_path / "class.txt").write_text("person\ncar\n")
    return tmp_path


def test_dataset_tasks(spark, root, tmp_path):
    m = Manager(spark, str(root))
    assert m.layout_detect() == "flat" and m.data.images.count() == 2 and m.data.annotations.count() == 3
    assert [r.code for r in m.check().collect()] == ["orphan_label"]
    assert {r.image for r in m.query_class(["car"]).collect()} == {"a", "b"}
    assert {(r.class_name, r.objects) for r in m.stats()["classes"].collect()} == {("person", 1), ("car", 2)}
    assert m.bad_images().count() == 0 and m.duplicates().count() == 2
    out, names, _ = m.merge_class(["person"], "car")
    m.write(f"{tmp_path}/out", out, names)
    assert (tmp_path / "out/labels/a.txt").read_text().splitlines() == ["0 0.5 0.5 0.2 0.3", "0 0.4 0.4 0.2 0.2"]
    assert layout.find_class_names(f"{tmp_path}/out") == ["car"]
    assert len(TASKS) > 20


def test_evaluation_from_a_bare_folder(spark, root, tmp_path):
    pred = tmp_path / "pred"
    pred.mkdir()
    (pred / "a.txt").write_text("0 .5 .5 .2 .3 .9\n1 .9 .9 .1 .1 .8\n")
    m = Manager(spark, str(root))
    got = {r.status: r["count"] for r in m.eval_compare(str(pred)).groupBy("status").count().collect()}
    assert got == {"tp": 1, "fp": 1, "fn": 2}
    assert m.eval_error_analysis(str(pred)).where("status = 'tp'").count() == 1


def test_image_lists_and_names(spark, root, tmp_path):
    (root / "val.txt").write_text("images/b.png\n")
    assert layout.detect(str(root)) == "image_list" and [r.image for r in layout.load(spark, str(root)).images.collect()] == ["b"]
    (tmp_path / "n.yaml").write_text("names: {1: car, 0: person}\n")
    assert layout.class_names(str(tmp_path / "n.yaml")) == ["person", "car"]
    (tmp_path / "ids.txt").write_text("0 person\n2 car\n")
    assert layout.eval_class_names(str(tmp_path / "ids.txt")) == ["person", "1", "car"]
    (tmp_path / "attr.yaml").write_text("defect: [no, yes]\n")
    assert layout.attribute_schema(str(tmp_path / "attr.yaml")) == {"defect": ["no", "yes"]}


def test_crop_corrections(spark):
    ann = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, []), ("a", 1, 0.4, 0.4, 0.2, 0.2, [])])
    crops = spark.createDataFrame([("a_2",), ("a_9",), ("x_1",), ("bad",)], "crop string")
    out, report = corrections.correct_from_crops(ann, crops, 0)
    assert sorted(r.class_id for r in out.collect()) == [0, 0]
    assert {r.crop: r.outcome for r in report.collect()} == {"a_2": "updated", "a_9": "invalid_index", "x_1": "missing_image", "bad": "invalid_name"}
    assert corrections.correct_from_crops(ann, crops, None)[0].count() == 1


def test_error_crop_corrections(spark):
    gt = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, []), ("a", 1, 0.4, 0.4, 0.2, 0.2, [])])
    pred = boxed(spark, [("a", 1, 0.52, 0.5, 0.2, 0.3, []), ("a", 1, 0.9, 0.9, 0.1, 0.1, []), ("a", 1, 0.9, 0.9, 0.1, 0.1, [])]).withColumn("confidence", F.lit(0.5) + F.col("ord") * 0.1)
    crops = spark.createDataFrame([("a_pred1_gt1",), ("a_pred2_gtnone",), ("a_pred3_gtnone",)], "crop string")
    out, report = corrections.correct_from_error_crops(gt, pred, crops, 3, replace=True)
    rows = {r.ord: r for r in out.collect()}
    assert rows[0].class_id == 3 and rows[0].cx == 0.52 and rows[1].class_id == 1 and len(rows) == 3 and rows[2].class_id == 3
    assert {r.outcome for r in report.collect()} == {"update", "append"}
    # Both boxes become predictions that coincide; the better one stays, as it was predicted.
    both = spark.createDataFrame([("a_pred2_gt1",), ("a_pred3_gt2",)], "crop string")
    shaped = pred.withColumn("attrs", F.array(F.lit(7.0)))
    rows = {r.ord: r for r in corrections.correct_from_error_crops(gt, shaped, both, None, replace=True)[0].collect()}
    assert set(rows) == {1} and (rows[1].cx, rows[1].class_id, rows[1].attrs) == (0.9, 1, [7.0])
    assert len(corrections.correct_from_error_crops(gt, pred, both, None, replace=True, dedup_iou=None)[0].collect()) == 2


def test_resize_moves_labels_into_the_letterbox(spark, tmp_path):
    for d in ("images", "labels"):
        (tmp_path / d).mkdir()
    png(tmp_path / "images/a.png", 100, 50)
    (tmp_path / "labels/a.txt").write_text("0 .5 .5 .2 .4\n1 .1 0 .9 0 .9 1\n")
    (tmp_path / "class.txt").write_text("person\ncar\n")
    m = Manager(spark, str(tmp_path))
    assert tuple(m.resize(200, 200, out=f"{tmp_path}/fit").first())[1:] == (100, 50, 200, 200)
    m.resize(200, 200, keep_ratio=False, out=f"{tmp_path}/stretch")
    lines = {d: [[float(x) for x in line.split()] for line in (tmp_path / d / "labels/a.txt").read_text().splitlines()] for d in ("fit", "stretch")}
    assert lines["fit"] == [[0, 0.5, 0.5, 0.2, 0.2], [1, 0.1, 0.25, 0.9, 0.25, 0.9, 0.75]]
    assert lines["stretch"] == [[0, 0.5, 0.5, 0.2, 0.4], [1, 0.1, 0, 0.9, 0, 0.9, 1]]


def test_mixed_layout(spark, tmp_path):
    """Pictures and texts in one folder: three images, two labels, one image without; class and
    split files are no labels, other texts without a picture are orphans."""
    for n in ("a", "b", "_c"):
        png(tmp_path / f"{n}.png", 100, 80)
    (tmp_path / "a.txt").write_text("0 .5 .5 .2 .3\n")
    (tmp_path / "_c.txt").write_text("1 .4 .4 .2 .2\n")
    (tmp_path / "class.txt").write_text("x\ny\n")
    (tmp_path / "notes.txt").write_text("some words\n")
    m = Manager(spark, str(tmp_path))
    assert m.layout_detect() == "mixed" and sorted(r.image for r in m.data.images.collect()) == ["_c", "a", "b"]
    assert sorted((r.image, r.class_id) for r in m.data.annotations.collect()) == [("_c", 1), ("a", 0)]
    issues = sorted((r.image, r.code) for r in m.check().collect())
    assert issues == [("b", "missing_label"), ("notes", "orphan_label")]
    assert m.draw().count() == 2 and m.bad_images().count() == 0 and m.stats()["images"].count() == 2
    assert m.fill_missing_labels() == 1 and (tmp_path / "b.txt").read_text() == ""
    run_task(spark, "dataset.normalize", str(tmp_path), out=str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out/images").iterdir()) == ["_c.png", "a.png", "b.png"]
    assert (tmp_path / "out/labels/_c.txt").read_text() == "1 0.4 0.4 0.2 0.2\n"
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "_p.txt").write_text("0 .5 .5 .2 .3\n")
    assert [r.file_name for r in Manager(spark, str(bare)).data.images.collect()] == ["_p.jpg"]


def test_image_lists_keep_their_order(spark, tmp_path):
    (tmp_path / "one.txt").write_text("images/b.png\n\n/abs/a.png\nimages/b.png\n")
    (tmp_path / "two.txt").write_text("  ./images/c.png \n")
    got = layout.read_image_list(spark, str(tmp_path / "one.txt"), str(tmp_path / "two.txt"), root="/data").orderBy("file_no", "line_no").collect()
    assert [r.path for r in got] == ["/data/images/b.png", "/abs/a.png", "/data/images/b.png", "/data/images/c.png"] and [r.line_no for r in got] == [0, 2, 3, 0]


def test_reports_of_queries_and_pictures(spark, root):  # noqa: F811
    """Attributes by name, boxes of polygons, pictures of equal content and damaged ones."""
    (root / "attr.yaml").write_text("attributes: {defect: [no, yes], age: null}\n")
    (root / "labels/a.txt").write_text("1 2 1 7.5 .5 .5 .2 .3\n1 .1 .1 .5 .1 .3 .5\n0 1 0 .4 .4 .2 .2\n")
    (root / "images/b.png").write_bytes((root / "images/a.png").read_bytes()[:-4])
    (root / "images/c.png").write_bytes((root / "images/a.png").read_bytes())
    m = Manager(spark, str(root), attribute_file=str(root / "attr.yaml"))
    m.query_class(["car"], out=str(root / "q/query.csv"))
    m.duplicates(out=str(root / "q/same.csv"))
    m.bad_images(out=str(root / "q/bad.csv"))
    read = lambda name: list(csv.DictReader(open(root / "q" / name, newline="")))  # noqa: E731, SIM115
    rows = [r for r in read("query.csv") if r["image"] == "a"]
    assert [(r["line_no"], r["task"], r["points"], r["attributes"]) for r in rows] == [("1", "detect", "", '{"defect":"yes","age":"7.5"}'), ("2", "segment", "3", "{}")]
    assert (float(rows[1]["cx"]), float(rows[1]["height"])) == pytest.approx((0.3, 0.4)) and rows[0]["label_path"].endswith("labels/a.txt")
    assert [r["image"].rsplit("/", 1)[1] for r in read("same.csv")] == ["a.png", "c.png"]
    assert [(r["image"], r["code"]) for r in read("bad.csv")] == [("b.png", "bad_image")]


def test_a_yaml_file_stands_for_a_dataset(spark, root, monkeypatch):  # noqa: F811
    """Its root with variables in it, its names, and its validation part as a list or a folder."""
    monkeypatch.setenv("WHERE", str(root))
    (root / "class.txt").unlink()
    (root / "sets").mkdir()
    (root / "held.txt").write_text("images/b.png\n")
    file = root / "sets/own.yaml"
    for val, want in (("held.txt", ["b"]), (["images", "other"], ["a", "b"]), (None, None)):
        file.write_text(f"path: $WHERE\nval: {val if val is not None else 'null'}\nnames: {{0: p, 1: q}}\n")
        if want is None:
            with pytest.raises(FileNotFoundError):
                layout.load(spark, str(file), only_val=True)
            continue
        data = layout.load(spark, str(file), only_val=True)
        assert sorted(r.image for r in data.images.collect()) == want and data.classes == ["p", "q"] and data.root == str(root)
    assert layout.read_dataset_yaml(str(file))["names"] == {0: "p", 1: "q"} and layout.dataset_part(str(file), "test") is None


def test_outcomes_of_crop_corrections(spark):
    ann = boxed(spark, [("a", 1, 0.3, 0.5, 0.4, 0.5, []), ("a", 2, 0.3, 0.5, 0.1, 0.1, []), ("two", 1, 0.3, 0.5, 0.4, 0.5, [])])
    crops = spark.createDataFrame([(c,) for c in ("a_1", "a_2", "a_3", "two_1", "bare_1", "none_1", "odd", "a_1")], "crop string")
    pics = spark.createDataFrame([("a",), ("two",), ("two",), ("bare",)], "image string")
    out, found = corrections.correct_from_crops(ann, crops, 2, pics, pics.where("image <> 'bare'"))
    got = {r.crop: r.outcome for r in found.collect()}
    assert got == {"a_1": "updated", "a_2": "unchanged", "a_3": "invalid_index", "two_1": "ambiguous_image", "bare_1": "missing_label", "none_1": "missing_image", "odd": "invalid_name"}
    assert sorted((r.image, r.class_id) for r in out.collect()) == [("a", 2), ("a", 2), ("two", 1)]
    assert {r.outcome: r.targets for r in corrections.correction_summary(found).collect()}["updated"] == 1
