"""Tasks that write datasets and reports, and the options of evaluations."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tessera.manager import Manager, run_task
from tessera.operators import dataset as ds
from tessera.operators import evaluation as ev
from tessera.operators import tables
from tessera.sinks import reports
from tessera.sources import layout
from tests.test_dataset import boxed, png
from tests.test_manager import root  # noqa: F401


def lines(path):
    return path.read_text().splitlines()


def table(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


def test_edits_are_written(spark, root, tmp_path):  # noqa: F811
    out = tmp_path / "out"
    run_task(spark, "ann.merge_class", str(root), ["person"], "car", out=str(out))
    assert lines(out / "labels/a.txt") == ["0 0.5 0.5 0.2 0.3", "0 0.4 0.4 0.2 0.2"] and layout.find_class_names(str(out)) == ["car"]
    assert (out / "images/a.png").read_bytes() == (root / "images/a.png").read_bytes()
    assert [p.name for p in (out / "labels_backup").rglob("*.txt")].count("a.txt") == 1
    (row,) = table(out / "report.csv")
    assert (row["operation"], row["image"], row["old_class_name"], row["new_class_name"], row["action"]) == ("merge_class", "a", "person", "car", "update") and row["label_path"].endswith("a.txt")
    run_task(spark, "ann.delete_class", str(root), ["car"], out=str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    run_task(spark, "ann.delete_class", str(root), ["car"])
    assert lines(root / "tessera_annotation/delete_class/labels/b.txt") == [] and lines(root / "labels/b.txt") != []


def test_filter_select_merge_convert_and_split_are_written(spark, root, tmp_path):  # noqa: F811
    run_task(spark, "dataset.filter", str(root), min_area=0.05, out=str(tmp_path / "f"))
    assert lines(tmp_path / "f/labels/a.txt") == ["0 0.5 0.5 0.2 0.3"] and lines(tmp_path / "f/labels/b.txt") == []
    (root / "names.txt").write_text("b.png\n")
    run_task(spark, "dataset.select", str(root), str(root / "names.txt"), out=str(tmp_path / "s"))
    assert [p.name for p in (tmp_path / "s/images").iterdir()] == ["b.png"] and [p.name for p in (tmp_path / "s/labels").iterdir()] == ["b.txt"]
    run_task(spark, "dataset.merge", str(root), str(root), out=str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m/labels").iterdir()) == ["d0_a.txt", "d0_b.txt", "d1_a.txt", "d1_b.txt"]
    assert sorted(p.name for p in (tmp_path / "m/images").iterdir()) == ["d0_a.png", "d0_b.png", "d1_a.png", "d1_b.png"]
    run_task(spark, "convert.seg2det", str(root), out=str(tmp_path / "c"))
    assert lines(tmp_path / "c/labels/b.txt") == ["1 0.1 0.1 0.2 0.1"]
    run_task(spark, "dataset.normalize", str(root), out=str(tmp_path / "n"))
    assert Manager(spark, str(tmp_path / "n")).data.annotations.count() == 3
    parts = run_task(spark, "dataset.split", str(root), train=0.5, val=0.5, train_include=str(root / "names.txt"))
    assert {r.image: r.split for r in parts.collect()} == {"b": "train", "a": "test"} and (root / "train.txt").read_text() == "b.png"


@pytest.fixture()
def attributed(tmp_path):
    for d in ("images", "labels"):
        (tmp_path / d).mkdir()
    png(tmp_path / "images/a.png", 100, 80)
    png(tmp_path / "images/b.png", 50, 40)
    (tmp_path / "labels/a.txt").write_text("0 1 1 .5 .5 .2 .3\n0 1 0 .4 .4 .2 .2\n")
    (tmp_path / "class.txt").write_text("sign\n")
    (tmp_path / "attr.yaml").write_text("defect: [no, yes]\n")
    return tmp_path


def test_attribute_edits_and_their_report(spark, attributed):
    m = Manager(spark, str(attributed), attribute_file=str(attributed / "attr.yaml"))
    out, report = m.set_attr("defect", 1, where_value=0)
    m.write(str(attributed / "out"), out, copy_images=True)
    assert lines(attributed / "out/labels/a.txt") == ["0 1 1 0.5 0.5 0.2 0.3", "0 1 1 0.4 0.4 0.2 0.2"]
    assert layout.attribute_schema(str(attributed / "out/attribute.yaml")) == {"defect": ["no", "yes"]}
    row = reports.edit_rows(report, m.data.classes, m.data.classes).first()
    assert (row.attr_name, row.old_attr_value, row.new_attr_value, row.line_no) == ("defect", "0", "1", 2) and row.label_path.endswith("a.txt")


def test_statistics(spark, attributed):
    m = Manager(spark, str(attributed), attribute_file=str(attributed / "attr.yaml"))
    got = m.stats()
    one = got["totals"].first()
    assert (one.images, one.annotations, one.empty_images, one.labels, one.orphan_labels) == (2, 2, 1, 1, 0)
    assert (one.boxes_with_attribute, one.boxes_without_attribute, one.images_with_attribute, one.images_without_attribute) == (1, 1, 1, 1)
    series = {r.series: r for r in got["boxes"].collect()}
    assert len(series) == 14 and series["box_width_pix"].high == pytest.approx(20) and series["box_pos_start_x"].low == pytest.approx(0.3) and series["polygon_points"].n == 0
    assert {(r.value, r.n) for r in got["attributes"].collect()} == {("no", 1), ("yes", 1)}
    assert {r.series: (r.low, r.high) for r in got["images"].collect()} == {"image_width": (50, 100), "image_height": (40, 80)}
    names = m.write_stats(str(attributed / "s"), "all")
    assert {f"{n}.csv" for n in (*tables.DEFAULT_STATISTICS, *tables.MORE_STATISTICS, "legacy_attribute_csv")} == set(names)
    rows = table(attributed / "s/legacy_attribute_csv.csv")
    assert [(r["category"], r["defect"], r["attribute sum"], r["with attribute"]) for r in rows] == [("sign", "yes", "1", "1"), ("sign", "no", "0", "0")]
    assert table(attributed / "s/legacy_csv.csv")[0].keys() == {"category", "center_x", "center_y", "width", "height", "image"}
    assert m.crop(by_attribute=True).where("value = 'yes'").count() == 1 and m.crop(by_attribute=True).count() == 3
    with pytest.raises(ValueError, match="unknown statistics"):
        m.stat_tables("nothing")


@pytest.fixture()
def judged(tmp_path):
    for d in ("gt/images", "gt/labels", "pred"):
        (tmp_path / d).mkdir(parents=True)
    png(tmp_path / "gt/images/a.png", 100, 100)
    (tmp_path / "gt/labels/a.txt").write_text("0 .5 .5 .4 .4\n1 .9 .9 .02 .02\n")
    (tmp_path / "gt/class.txt").write_text("person\ncar\nbus\n")
    (tmp_path / "pred/a.txt").write_text("0 .5 .5 .4 .4 .95\n1 .1 .1 .02 .02 .9\n2 .2 .8 .1 .1 .3\n")
    return tmp_path


def test_evaluation_options(spark, judged):
    m, pred = Manager(spark, str(judged / "gt")), str(judged / "pred")
    rows = lambda **o: {r.class_id: (r.labels, r.predictions) for r in m.eval_metrics(pred, **o).collect()}
    assert rows() == {0: (1, 1), 1: (1, 1), 2: (0, 1)}
    assert rows(min_pixels=5) == {0: (1, 1), 2: (0, 1)}
    assert rows(min_confidence=0.5) == {0: (1, 1), 1: (1, 1)}
    assert rows(classes=["person", "bus"], exclude=["bus"]) == {0: (1, 1)} and rows(classes=["bus"], min_confidence=0.5) == {2: (0, 0)}
    assert rows(class_rules={"car": {"min_pixels": 5}, "bus": {"min_width": 0.2}}) == {0: (1, 1)}
    assert rows(merge={"thing": ["car", "bus"]}) == {0: (1, 1), 1: (1, 2)}
    assert m.eval_error_analysis(pred, min_pixels=5, exclude=["bus"]).select("status").collect() == [("tp",)]
    stems = spark.createDataFrame([("none",)], "image string")
    assert rows(stems=stems) == {}


def test_evaluation_reports(spark, judged):
    m, pred, out = Manager(spark, str(judged / "gt")), str(judged / "pred"), judged / "out"
    m.eval_metrics(pred, out=str(out), sizes=True)
    doc = json.loads((out / "metrics.json").read_text())
    assert doc["map50"] == pytest.approx(0.4975) and doc["labels"] == 2 and doc["images"] == 1 and [c["class_name"] for c in doc["classes"]] == ["person", "car"]
    assert tuple(table(out / "metrics.csv")[0]) == reports.CLASS_METRICS and tuple(table(out / "size_metrics.csv")[0]) == reports.SIZE_METRICS
    sizes = {r["size"]: (r["images"], r["labels"], r["predictions"], float(r["precision"])) for r in table(out / "size_metrics.csv")}
    assert sizes["medium"] == ("1", "1", "1", 1.0) and sizes["small"] == ("1", "1", "2", 0.0) and sizes["large"] == ("0", "0", "0", 0.0)
    text = (out / "metrics.txt").read_text().splitlines()
    assert text[1].split()[:3] == ["all", "1", "2"] and text[1].split()[5] in ("0.497", "0.498") and "" in text and text[-1].startswith("large")
    m.eval_metrics(pred, include_empty=True, out=str(out))
    assert [c["class_name"] for c in json.loads((out / "metrics.json").read_text())["classes"]] == ["person", "car", "bus"]
    m.eval_error_analysis(pred, out=str(out))
    assert {p.name for p in out.glob("*.csv")} >= {*reports.ERROR_FILES, "duplicate_gt.csv", "confusion_matrix.csv"}
    row = next(r for r in table(out / "fp_report.csv") if r["pred_class_name"] == "bus")
    assert tuple(row) == reports.ERRORS and row["pred_line"] == "2 .2 .8 .1 .1 .3" and row["pred_box_xyxy"] == "[0.150000, 0.750000, 0.250000, 0.850000]" and float(row["pred_conf"]) == 0.3
    m.eval_compare(pred, out=str(out))
    assert tuple(table(out / "compare.csv")[0]) == reports.COMPARE
    pack = m.eval_review_pack(pred, out=str(out / "pack"))
    assert {p.name for p in (out / "pack").iterdir()} == {r.review_group for r in pack.collect()} and (out / "pack/pred_background_gt_1/images/a.png").exists()


def test_duplicate_rows_and_short_numbers(spark):
    gt = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.2, []), ("a", 1, 0.5, 0.5, 0.2, 0.2, [])])
    from tessera.functions.geometry import corners

    (row,) = reports.duplicate_rows(ev.duplicate_labels(gt.withColumns(corners())), gt, ["x", "y"]).collect()
    assert tuple(row.asDict()) == reports.DUPLICATES and (row.name_i, row.name_j, row.type) == ("x", "y", "overlap_different_class")
    values = [0.0, 1.0, 0.4975, 0.995, 0.0123456, 1 / 3, 0.1]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(reports._shown("x")).collect()
    assert [r[0] for r in got] == [f"{v:.3g}" if v != 0.4975 else r[0] for v, r in zip(values, got, strict=True)]


def test_layout_report_and_roots(spark, root, tmp_path):  # noqa: F811
    got = layout.report(spark, str(root))
    assert (got["layout"], got["image_count"], got["label_count"], got["class_count"]) == ("flat", 2, 3, 2) and got["class_source"].endswith("class.txt")
    (tmp_path / "set.yaml").write_text(f"path: {root.name}\nnames: [person, car]\n") if root != tmp_path else (tmp_path / "set.yaml").write_text("path: .\nnames: [person, car]\n")
    assert layout.load(spark, str(tmp_path / "set.yaml")).annotations.count() == 3
    with pytest.raises(ValueError, match="unknown layout"):
        layout.load(spark, str(root), layout="other")
    assert layout.load(spark, str(root), stems=str(root / "images")).images.count() == 2
    with pytest.raises(FileNotFoundError):
        layout.load(spark, str(root), stems=str(root / "none.txt"))
    m = Manager(spark, str(root))
    assert {r.image for r in m.labels_with_class(["car"]).collect()} == {"a", "b"}
    assert m.copy_query(m.query_class(["person"]), str(tmp_path / "copy")) == 1 and (tmp_path / "copy/images/a.png").exists()
    missing = ds.missing_label_files(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "image string, label_path string"), spark.createDataFrame([("x",)], "label_path string"))
    assert [r.image for r in missing.collect()] == ["b"]


def test_bare_label_folder_is_not_searched_deeply(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("0 .5 .5 .2 .3\n")
    (tmp_path / "deep/b.txt").write_text("0 .5 .5 .2 .3\n")
    assert [r.image for r in layout.load(spark, str(tmp_path)).annotations.select("image").where(F.lit(True)).collect()] == ["a"]
