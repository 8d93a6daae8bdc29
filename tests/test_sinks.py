import csv
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.manager import TASKS, Manager, run_task
from tessera.operators import evaluation as ev
from tessera.operators import tables
from tessera.sinks import files, keyed, reports, rewrite
from tessera.sources import formats, layout, masks
from tests.test_dataset import boxed, png
from tests.test_evaluation import BASE, boxes
from tests.test_manager import root  # noqa: F401


def table(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


def test_numbers_follow_the_order_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = tables.numbered(rows, "k").collect()
    assert len(got) == 5000 and all(r.id == r.k + 1 for r in got)
    assert tables.numbered(rows.where("k < 0"), "k").count() == 0


def test_lines_and_csv(spark, tmp_path):
    path = f"{tmp_path}/d/a.txt"
    files.write_lines(spark.range(0, 1000, 1, 5).orderBy("id").select(F.col("id").cast("string")), path)
    assert open(path).read().split("\n") == [str(k) for k in sorted(range(1000))]
    files.write_lines(spark.range(0).select(F.col("id").cast("string")), path, "[", ",", "]")
    assert open(path).read() == "[]"
    rows = spark.createDataFrame([('a,"b', None), ("c\nd", 2)], "x string, y int").coalesce(1)
    reports.write_csv(rows, f"{tmp_path}/r.csv", bom=True)
    assert open(f"{tmp_path}/r.csv", "rb").read().decode("utf-8-sig") == 'x,y\r\n"a,""b",\r\n"c\nd",2\r\n'


def test_backups(spark, root, tmp_path_factory):  # noqa: F811
    other = tmp_path_factory.mktemp("other")
    for d in ("p", "q"):
        (other / d).mkdir()
        (other / d / "z.txt").write_text(d)
    paths = [str(root / "labels/a.txt"), f"file://{root}/labels/a.txt", str(other / "p/z.txt"), str(other / "q/z.txt"), str(root / "labels/none.txt"), None]
    plan = files.backup_plan(spark.createDataFrame([(p,) for p in paths], "label_path string"), str(root), stamp="t")
    files.copy_files(plan)
    base = root / "labels_backup/t"
    assert sorted(str(p.relative_to(base)) for p in base.rglob("*.txt")) == ["external/z.txt", "external/z_1.txt", "labels/a.txt"]
    assert (base / "labels/a.txt").read_text() == (root / "labels/a.txt").read_text() and not list(base.rglob("*.part"))
    (root / "val.txt").write_text("a\n")
    assert files.backup_splits(str(root), str(root / "old")) == [str(root / "val.txt")] and not (root / "val.txt").exists()
    assert files.backup_splits(str(root), str(root / "old")) == []
    assert files.operation_dir("r", "stats", "plots") == "r/tessera_stats/plots"
    with pytest.raises(ValueError, match="group"):
        files.operation_dir("r", "other", "x")


def test_reports(spark, tmp_path):
    gt, pred = boxes(spark, BASE), boxes(spark, [("a", 0, 0.9, 0.9, 0.05, 0.05, 0.9)])
    reports.write_errors(ev.errors(gt, pred), str(tmp_path))
    head, *rows = open(f"{tmp_path}/fn_report.csv", encoding="utf-8-sig").read().splitlines()
    assert "error_type" in head.split(",") and rows and len(open(f"{tmp_path}/tp_report.csv").read().splitlines()) == 1
    metrics = ev.class_metrics(gt, gt.withColumn("confidence", F.lit(0.9)))
    text = reports.metrics_text(metrics, ev.macro_metrics(metrics), ["person"]).splitlines()
    assert text[0].split() == list(reports.METRICS) and text[1].startswith("all") and text[2].startswith("person") and len({len(t) for t in text}) == 1
    assert reports.compare_rows(ev.compare(gt, pred), ["person"]).columns == list(reports.COMPARE)
    ann = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, [1.0])])
    row = reports.query_rows(ann, spark.createDataFrame([("a", "/i/a.png")], "image string, path string"), ["person"]).first()
    assert row.asDict().keys() == set(reports.QUERY) and (row.class_name, row.task, row.image_path, row.width) == ("person", "detect", "/i/a.png", 0.2)


def test_listed_and_repeated_images(spark):
    pics = spark.createDataFrame([("a", "/d/a.png", "a.png"), ("a2", "/e/a.png", "a.png"), ("b", "/d/b.png", "b.png")], "image string, path string, file_name string")
    listed = spark.createDataFrame([("/d/a.png",), ("a.png",), ("x/b.jpg",), ("c",), (" ",)], "name string")
    assert {r.name: r.n_matches for r in tables.resolve_listed(pics, listed).collect()} == {"/d/a.png": 1, "a.png": 2, "x/b.jpg": 1, "c": 0}
    assert [r.image for r in tables.repeated_names(pics).collect()] == ["a2"]


def test_every_task_is_registered():
    assert len(TASKS) == 41


def test_tasks_on_a_folder(spark, root, tmp_path):  # noqa: F811
    m = Manager(spark, str(root))
    assert m.fill_missing_labels() == 0
    (tmp_path / "crops").mkdir()
    (tmp_path / "crops/a_1.png").write_bytes(b"")
    out, report = run_task(spark, "ann.correct_from_crops", str(root), str(tmp_path / "crops"), "car")
    assert [r.outcome for r in report.collect()] == ["updated"] and out.where("class_id = 1").count() == 3
    assert run_task(spark, "ann.correct_from_crops", str(root), str(tmp_path / "crops"), "none")[0].count() == 2
    assert run_task(spark, "convert.resize", str(root), scale=0.5).first().to_width == 50
    assert run_task(spark, "vis.draw", str(root)).count() == 3
    assert run_task(spark, "vis.crop", str(root), min_size=15).count() == 2  # the box of b is 8 pixels high
    assert [r.line for r in run_task(spark, "vis.manual_box", str(root), "b").collect()] == ["1 0.1 0.1 0.2 0.1"]
    m.write_splits(train=1.0, val=0.0)
    assert (root / "train.txt").read_text() == "a.png\nb.png" and (root / "val.txt").read_text() == ""
    assert m.backup_labels() == 2
    images, ann, names, _ = m.merge(m)
    assert images.count() == 4 and ann.count() == 6 and names == ["person", "car"]
    with pytest.raises(KeyError, match="unknown task"):
        run_task(spark, "eval.nothing", str(root))


def test_coco_document_round_trip(spark, root, tmp_path):  # noqa: F811
    run_task(spark, "export.coco", str(root), f"{tmp_path}/out.json")
    doc = json.load(open(f"{tmp_path}/out.json"))
    assert [i["id"] for i in doc["images"]] == [1, 2] and [a["id"] for a in doc["annotations"]] == [1, 2, 3] and len(doc["categories"]) == 2
    _, ann, _ = run_task(spark, "import.coco", f"{tmp_path}/out.json", out=f"{tmp_path}/back")
    assert ann.count() == 3 and layout.find_class_names(f"{tmp_path}/back") == ["person", "car"]
    assert (tmp_path / "back/labels/b.txt").read_text() == "1 0.1 0.1 0.2 0.1\n"


def grey(pixels, how):
    """A PNG whose rows all use one filter, computed naively."""
    p = np.asarray(pixels, int)
    rows = b""
    for y, row in enumerate(p):
        up = p[y - 1] if y else np.zeros_like(row)
        line = []
        for x, v in enumerate(row):
            a, b, c = (int(row[x - 1]) if x else 0), int(up[x]), (int(up[x - 1]) if x else 0)
            near = a + b - c
            paeth = a if abs(near - a) <= abs(near - b) and abs(near - a) <= abs(near - c) else b if abs(near - b) <= abs(near - c) else c
            line.append((int(v) - (0, a, b, (a + b) // 2, paeth)[how]) & 255)
        rows += bytes([how, *line])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    pixels = np.random.default_rng(how).integers(0, 256, (9, 13))
    assert (masks.png_pixels(grey(pixels, how))[:, :, 0] == pixels).all()


def flooded(grid):
    """Areas by spreading sets of pixels."""
    left, out = {(y, x) for y, x in np.ndindex(*grid.shape) if grid[y, x]}, []
    for at in sorted(left):
        if at in left:
            own, edge = {at}, {at}
            while edge:
                edge = {q for y, x in edge for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if q in left - own and grid[q] == grid[at]}
                own |= edge
            left -= own
            ys, xs = zip(*own, strict=True)
            out.append((grid[at], len(own), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return out


def sides(grid):
    """value, area, left, top, right, bottom of the areas that are traced."""
    return [(a["value"], a["area"], *(pick(a["outline"][k::2]) for pick in (min, max) for k in (0, 1))) for a in masks.traced(grid)]


def test_masks(spark, tmp_path):
    (tmp_path / "m.png").write_bytes(grey([[0, 3, 3, 0], [0, 3, 0, 7]], 4))
    _, ann, classes = run_task(spark, "import.mask", str(tmp_path), out=f"{tmp_path}/out")
    assert [(r.class_id, r.area) for r in ann.orderBy("ord").collect()] == [(0, 3), (1, 1)] and {r.class_name for r in classes.collect()} == {"3", "7"}
    assert (tmp_path / "out/labels/m.txt").read_text().splitlines()[1] == "1 0.75 0.5 1 0.5 1 1 0.75 1"
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 9), (7, 1), (12, 15), (30, 30)):
        grid = rng.integers(0, 3, shape)
        assert sides(grid) == flooded(grid)
    ring = np.ones((40, 40), int)
    ring[1::2, 1:] = 0
    ring[3::4, 0], ring[3::4, -1] = 0, 1
    assert sides(ring) == flooded(ring) and not masks.traced(np.zeros((0, 0), int))
    with pytest.raises(ValueError, match="PNG"):
        masks.png_pixels(b"\x89PNG\r\n\x1a\n")


def test_very_many_groups_are_written_together(spark, tmp_path):
    """25,000 files and one of very many lines, which several tasks write; failed attempts' parts go."""
    rows = spark.range(25_000).select(F.concat(F.lit("g"), F.col("id") % 50, F.lit("/f"), "id").alias("f"), F.lit(0).alias("k"))
    hot = spark.range(60_000).select(F.lit("hot/all").alias("f"), F.col("id").alias("k"))
    every = rows.withColumn("k", F.col("k").cast("long")).union(hot).repartition(7)
    got = keyed.write_groups(every, f"{tmp_path}/out", F.concat("f", F.lit("/x.csv")), ["k"], F.col("k").cast("string"), "head\r\n", "\r\n")
    assert got.count() == 25_001 and got.agg(F.sum("lines")).first()[0] == 85_000
    found = list((tmp_path / "out").rglob("*"))
    assert sum(p.is_file() for p in found) == 25_001 and all(p.name == "x.csv" for p in found if p.is_file()) and not list((tmp_path / "out").glob(".parts*"))
    assert (tmp_path / "out/g7/f24957/x.csv").read_bytes() == b"head\r\n0\r\n"
    assert (tmp_path / "out/hot/all/x.csv").read_text().split() == ["head", *map(str, range(60_000))]
    assert keyed.write_groups(every.where("k < 0"), f"{tmp_path}/none", F.col("f"), ["k"], F.col("f")).count() == 0


def test_review_packs(spark, root):  # noqa: F811
    """Packs of errors and of comparisons hold all rows, the images and the predictions' texts."""
    pred = root / "pred/labels"
    pred.mkdir(parents=True)
    (pred / "a.txt").write_text("1 .5 .5 .2 .3 .9\n0 .9 .9 .1 .1 .8\n")
    (pred / "b.txt").write_text("1 .1 .1 .2 .1 .7\n")
    rows = run_task(spark, "eval.review_pack", str(root), str(pred), out=str(root / "pack"), copy_texts=True)
    written = [r for p in (root / "pack").rglob("review.csv") for r in table(p)]
    assert len(written) == rows.count() > 0 and {r["review_group"] for r in written} == {p.parent.name for p in (root / "pack").rglob("review.csv")}
    assert {p.name for p in (root / "pack").rglob("images/*")} == {"a.png"} and [p.name for p in (root / "pack/pred_txt").iterdir()] == ["a.txt"]
    counts = run_task(spark, "eval.compare_pack", str(root), str(pred), str(root / "compared"))
    both = {s: table(root / f"compared/{s}/review.csv") for s in ("fp", "fn")}
    assert counts == {s: len(r) for s, r in both.items()} and all(r["status"] == s for s, x in both.items() for r in x) and [*both["fp"][0]] == list(reports.COMPARE)
    assert {p.name for p in (root / "compared/fn/images").iterdir()} == {"a.png"}


def snapshot(folder):
    return {p.name: p.read_bytes() for p in sorted(folder.iterdir())}


@pytest.fixture()
def labelled(tmp_path):
    """Files with blanks, tabs, all line ends, comments of numbers, and names that begin with _."""
    for d in ("images", "labels"):
        (tmp_path / d).mkdir()
    for name, data in (("a", b"  0\t.50 .5 0.20 .30  \r\n\r\n1 .4 .4 .2 .2 0.900\n2 .1 .1 .1 .1"), ("_b", b"2 .1 .1 .2 .1\r1 .2 .2 .2 .2\n"), ("c", b"")):
        png(tmp_path / f"images/{name}.png", 100, 80)
        (tmp_path / f"labels/{name}.txt").write_bytes(data)
    (tmp_path / "class.txt").write_text("x\ny\nz\n")
    return tmp_path


def test_edits_in_place_touch_tokens_alone(spark, labelled):
    count, report = run_task(spark, "ann.merge_class", str(labelled), ["x"], "y", in_place=True, backup_dir=str(labelled / "old"))
    assert count == 2 and report.count() == 1 and (labelled / "class.txt").read_text() == "y\nz\n"
    assert snapshot(labelled / "labels") == {"_b.txt": b"1 .1 .1 .2 .1\r0 .2 .2 .2 .2\n", "a.txt": b"  0\t.50 .5 0.20 .30  \r\n\r\n0 .4 .4 .2 .2 0.900\n1 .1 .1 .1 .1", "c.txt": b""}
    assert len(list((labelled / "old").rglob("*.txt"))) == 2 and not rewrite.unfinished(str(labelled))
    run_task(spark, "ann.delete_class", str(labelled), ["y"], in_place=True)
    assert snapshot(labelled / "labels") == {"_b.txt": b"1 .1 .1 .2 .1\r", "a.txt": b"\r\n1 .1 .1 .1 .1", "c.txt": b""}
    with pytest.raises(ValueError, match="in_place"):
        run_task(spark, "dataset.filter", str(labelled), in_place=True)


def test_attributes_in_place(spark, labelled):
    (labelled / "attr.yaml").write_text("attributes: {defect: [no, yes], age: null}\n")
    (labelled / "labels/a.txt").write_bytes(b"0 2 1 7 .5 .5 .2 .3\n1 1 0 .4 .4 .2 .2 \n2  .1 .1 .1 .1\n2 0 .1 .1 .1 .1\n")
    run_task(spark, "ann.set_attr", str(labelled), "age", 3, in_place=True, attribute_file=str(labelled / "attr.yaml"))
    assert snapshot(labelled / "labels")["a.txt"] == b"0 2 1 3 .5 .5 .2 .3\n1 2 0 3 .4 .4 .2 .2 \n2  2 0 3 .1 .1 .1 .1\n2 2 0 3 .1 .1 .1 .1\n"


def test_rewrites_that_were_cut_short(spark, labelled, monkeypatch):
    """Before the commit nothing has changed and all goes; after it, what is left is put in place."""
    before = snapshot(labelled / "labels")
    m = Manager(spark, str(labelled))
    after, _, _ = m.replace_class(["x", "z"], "y")

    def killed(self):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(rewrite.Rewrite, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            m.rewrite(after)
    assert len(list((labelled / "labels").glob("*.new"))) == 2 and {k: v for k, v in snapshot(labelled / "labels").items() if k in before} == before
    with pytest.raises(RuntimeError, match="recover"):
        m.rewrite(after)
    assert [*m.recover().values()] == ["undone"] and snapshot(labelled / "labels") == before and m.recover() == {}
    with monkeypatch.context() as patch:
        patch.setattr(rewrite.Rewrite, "replace", killed)
        with pytest.raises(KeyboardInterrupt):
            m.rewrite(after)
    # One file was put in place before the end came.
    (fresh,) = (labelled / "labels").glob("a.txt.*.new")
    fresh.replace(labelled / "labels/a.txt")
    assert [*run_task(spark, "ann.recover", str(labelled)).values()] == ["completed"]
    assert snapshot(labelled / "labels") == {"_b.txt": b"1 .1 .1 .2 .1\r1 .2 .2 .2 .2\n", "a.txt": b"  1\t.50 .5 0.20 .30  \r\n\r\n1 .4 .4 .2 .2 0.900\n1 .1 .1 .1 .1", "c.txt": b""}
    with monkeypatch.context() as patch:
        patch.setattr(rewrite.Rewrite, "replace", killed)
        with pytest.raises(KeyboardInterrupt):
            m.rewrite(Manager(spark, str(labelled)).replace_class(["y"], "z")[0])
    (labelled / "labels/a.txt").write_bytes(b"0 .5 .5 .1 .1\n")
    with pytest.raises(Exception, match="has changed"):
        m.recover()
    assert (labelled / "labels/a.txt").read_bytes() == b"0 .5 .5 .1 .1\n"


def test_tokens_of_lines():
    data = b" 1  2\t3\r\nx y\n"
    assert rewrite.edited(data, [(1, 0, 1, "7"), (1, 2, 3, "30 31"), (2, 1, 1, "new")]) == b" 7  2\t30 31\r\nx new y\n"
    assert rewrite.edited(data, [(2, 2, 2, "z"), (1, 0, 1, None)]) == b"x y z\n"
    for bad in ([(3, 0, 1, "a")], [(2, 0, 3, "a")]):
        with pytest.raises(ValueError):
            rewrite.edited(data, bad)


def test_merged_datasets_share_their_attributes(spark, labelled, tmp_path):
    other = tmp_path / "other"
    for d in ("images", "labels"):
        (other / d).mkdir(parents=True)
    png(other / "images/o.png", 100, 80)
    (other / "labels/o.txt").write_text("0 2 1 0 .5 .5 .2 .3\n")
    (other / "class.txt").write_text("y\n")
    (other / "attribute.yaml").write_text("attributes: {grade: [a, b], defect: [yes, no, bent]}\n")
    (labelled / "attribute.yaml").write_text("attributes: {defect: [no, yes]}\n")
    run_task(spark, "dataset.merge", str(labelled), str(other), out=str(tmp_path / "m"), attribute_file=str(labelled / "attribute.yaml"))
    assert layout.attribute_schema(str(tmp_path / "m/attribute.yaml")) == {"defect": ["no", "yes", "bent"], "grade": ["a", "b"]}
    assert (tmp_path / "m/labels/d1_o.txt").read_text() == "1 2 1 1 0.5 0.5 0.2 0.3\n"
