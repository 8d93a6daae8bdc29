import io
import json
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.manager import Manager
from tessera.operators import dataset as ds
from tessera.sinks import pictures
from tessera.sources import formats, images, labels, masks, multimodal, places

NAMES = ds.Classes(["person", "car"])


def png(path, width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * ((width * 3 + 1) * height))) + chunk(b"IEND", b""))


def parsed(spark, text, **options):
    return labels.parse_lines(spark.createDataFrame([("a", text)], "image string, value string"), **options)


def test_label_lines(spark):
    rows = parsed(spark, "0 .5 .5 .2 .3\n\n1.9 0.4 0.4 2e-1 .2 0.75\r\n2 .1 .1 .2 .1 .2 .2\n3 .1 .1 .2 .1 .2 .2 .9\n").collect()
    assert [(r.line_no, r.ord, r.class_id, r.confidence) for r in rows] == [(1, 0, 0, None), (3, 1, 1, 0.75), (4, 2, 2, None), (5, 3, 3, 0.9)]
    assert rows[0].cx == 0.5 and rows[0].polygon is None and len(rows[2].polygon) == 3 and rows[2].cx is None
    row = parsed(spark, "0 1 1 .5 .5 .2 .2", attributes=True).first()
    assert row.attrs == [1.0] and row.cx == 0.5 and row.polygon is None
    bad = parsed(spark, "0 1 2\n1f .5 .5 .2 .2\nx 1 1 1 1", strict=False).collect()
    assert [r.problem for r in bad] == ["too few values", "not a number", "not a number"]
    with pytest.raises(Exception, match="too few"):
        parsed(spark, "0 1 2").collect()


def test_labels_round_trip(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text("1 0.5 0.5 0.2 0.3\n0 0.4 0.4 0.2 0.2\n")
    (tmp_path / "labels/b.txt").write_text("1 0.1 0.1 0.2 0.1 0.2 0.2\n")
    ann = labels.read_labels(spark, f"{tmp_path}/labels")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "image string")
    labels.write_texts(labels.label_texts(ann, listed), f"{tmp_path}/out")
    assert (tmp_path / "out/a.txt").read_text() == (tmp_path / "labels/a.txt").read_text()
    assert (tmp_path / "out/b.txt").read_text() == (tmp_path / "labels/b.txt").read_text() and (tmp_path / "out/c.txt").read_text() == ""
    assert labels.read_labels(spark, f"{tmp_path}/labels", stems=listed.where("image = 'a'")).count() == 2


def test_paths(spark):
    rows = spark.createDataFrame([("d/images/x/images/a.b.PNG",), ("image/q.jpg",), ("z/k.webp",), ("z/k.txt",)], "p string")
    got = rows.select(labels.label_path_of(F.col("p")).alias("l"), labels.stem(F.col("p")).alias("s"), labels.is_image(F.col("p")).alias("i")).collect()
    assert [r.l for r in got] == ["d/labels/x/images/a.b.txt", "label/q.txt", "z/k.txt", "z/k.txt"] and got[0].s == "a.b" and [r.i for r in got] == [True, True, True, False]


def boxed(spark, rows):
    kind = "image string, ord int, line_no int, class_id int, cx double, cy double, w double, h double, attrs array<double>, confidence double"
    return spark.createDataFrame([(i, n, n + 1, k, cx, cy, w, h, a, None) for n, (i, k, cx, cy, w, h, a) in enumerate(rows)], kind)


def test_filters(spark):
    ann = boxed(spark, [("a", 0, 0.5, 0.5, w, h, []) for w, h in ((0.005, 0.02), (0.02, 0.005), (0.005, 0.005))])
    rule = {"min_width": 0.01, "min_height": 0.01}
    assert ds.filter_geometry(ann, **rule).count() == 0 and ds.filter_geometry(ann, **rule, min_size_logic="and").count() == 2
    two = boxed(spark, [("a", k, 0.5, 0.5, 0.006, 0.006, []) for k in (0, 1)])
    rules = {0: {"width": 0.01, "height": 0.01, "logic": "and"}, 1: {"min_width": 0.005, "min_height": 0.005}}
    assert [r.class_id for r in ds.filter_geometry(two, class_rules=rules).collect()] == [1]


def test_edits(spark):
    ann = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, [1.0]), ("a", 1, 0.4, 0.4, 0.2, 0.2, []), ("b", 1, 0.1, 0.1, 0.2, 0.1, [2.0])])
    out, names, report = ds.merge_classes(ann, NAMES, ["person"], "car")
    assert list(names) == ["car"] and {r.class_id for r in out.collect()} == {0} and report.count() == 1
    _, names, _ = ds.merge_classes(ann, ds.Classes(["person", "car", "truck", "bike"]), ["car", "truck"], "vehicle", compact=False)
    assert list(names) == ["person", "car", "truck", "bike", "vehicle"]
    with pytest.raises(ds.UnknownClass):
        ds.delete_class(ann, NAMES, ["boat"])
    out, report = ds.set_attribute(ann, 1, 3, where_value=0)
    assert [r.attrs for r in out.orderBy("ord").collect()] == [[1.0, 3.0], [0.0, 3.0], [2.0, 3.0]] and report.count() == 3
    out, _ = ds.delete_by_attribute(ann, 0, nonzero=True)
    assert [r.class_id for r in out.collect()] == [1]
    names, moves = ds.class_map(ds.Classes(["a", "b", "c"]), rename={"a": "x"}, merge={"x": ["b"]}, drop=["c"])
    assert list(names) == ["x"] and moves == {0: 0, 1: 0, 2: None}


def test_union_and_splits(spark):
    pics = spark.createDataFrame([("a", "a.jpg"), ("b", "b.jpg")], "image string, file_name string")
    ann = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, []), ("b", 1, 0.1, 0.1, 0.2, 0.1, [])])
    got, rows, names = ds.merge_datasets([(pics, ann, NAMES), (pics, ann, ds.Classes(["car", "bus"]))])
    assert {r.file_name for r in got.collect()} == {"d0_a.jpg", "d0_b.jpg", "d1_a.jpg", "d1_b.jpg"} and list(names) == ["person", "car", "bus"]
    assert sorted(r.class_id for r in rows.collect()) == [0, 1, 1, 2]
    flat, _, _ = ds.merge_datasets([(pics, ann, NAMES), (pics, ann, NAMES)], source_prefix=False)
    assert {r.file_name for r in flat.collect()} == {"a.jpg", "b.jpg", "a_1.jpg", "b_1.jpg"}
    parts = ds.split_exact([f"i{k}" for k in range(10)], train_include=["i3"], val_include=["i4"])
    assert "i3" in parts["train"] and "i4" in parts["val"] and sorted(sum(parts.values(), [])) == sorted(f"i{k}" for k in range(10))
    with pytest.raises(ValueError):
        ds.split_exact(["a"], train_include=["a"], val_include=["a"])
    many = spark.range(2000).withColumnRenamed("id", "image")
    assert ds.split_images(many, exact=False).where("split = 'train'").count() == pytest.approx(1600, abs=80)
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(ds.split_images(many.where("image < 13"), 0.7, 0.3)) == {"train": 9, "val": 3, "test": 1}
    assert ds.split_exact([str(k) for k in range(13)], 0.7, 0.3)["test"] != []
    again = [ds.split_images(many.repartition(n)).where("split = 'val'").agg(F.sum("image")).first()[0] for n in (1, 7)]
    assert again[0] == again[1]


def test_names_stay_unique(spark):
    """A number is not given to a name that is there already, in either dataset."""
    pics = lambda *names: spark.createDataFrame([(n.rsplit(".", 1)[0], n) for n in names], "image string, file_name string")
    ann = boxed(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, [])])
    got, _, _ = ds.merge_datasets([(pics("a.jpg", "b"), ann, NAMES), (pics("a.jpg", "a_1.jpg", "a_03.jpg", "b"), ann, NAMES), (pics("a.jpg", "a_3.jpg"), ann, NAMES)], source_prefix=False)
    names = {r.image: r.file_name for r in got.collect()}
    assert names == {"d0_a": "a.jpg", "d0_b": "b", "d1_a": "a_2.jpg", "d1_a_1": "a_1.jpg", "d1_a_03": "a_03.jpg", "d1_b": "b_1", "d2_a": "a_4.jpg", "d2_a_3": "a_3.jpg"}
    assert ds.merge_attributes([{"x": [1]}, None, {"x": [2], "y": [3]}]) == {"x": [1], "y": [3]}
    same = [(pics("a.jpg"), ann, NAMES), (pics("a.jpg"), ann, NAMES)]
    with pytest.raises(ValueError, match="several images are named a.jpg"):
        ds.merge_datasets(same, source_prefix=False, rename_duplicates=False)
    assert ds.merge_datasets(same, rename_duplicates=False)[0].count() == 2


def test_numbers_of_a_common_name(spark):
    """One name has nearly all images; numbers are those of a plain loop."""
    taken = ["x_2.png", "x_3.png", "x_7.png", "x_999.png", "x_03.png", "x_0.png", "x_5", "y.png"]
    rows = [(k, n) for k, n in enumerate(["x.png"] * 40 + taken + ["x.png"] * 960 + ["y.png", "y.png", None, None])]
    got = dict(ds.unique_names(spark.createDataFrame(rows, "image long, file_name string").repartition(5), "image").collect())
    used, want = {n for _, n in rows}, {}
    seen, numbers = set(), {}
    for k, n in rows:
        if n is None or n not in seen:
            seen.add(n)
            want[k] = n
            continue
        number = numbers.get(n, 0) + 1
        while (name := n.replace(".", f"_{number}.")) in used:
            number += 1
        numbers[n], want[k] = number, name
    assert got == want and len({*got.values()}) == len(rows) - 1
    few = spark.createDataFrame([(1, "a"), (2, "b")], "image long, file_name string")
    assert sorted(ds.unique_names(few, "image").collect()) == [(1, "a"), (2, "b")] and ds.unique_names(few.limit(0), "image").count() == 0


def test_splits_with_forced_names(spark):
    pics = spark.createDataFrame([(f"i{k}", f"i{k}.jpg") for k in range(10)], "image string, file_name string")
    listed = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r.image: r.split for r in ds.split_with_lists(pics, listed("i3.jpg"), listed("x/i4"), train=0.5, val=0.25, test=0.25).collect()}
    assert got["i3"] == "train" and got["i4"] == "val" and len(got) == 10 and sorted(got.values()).count("train") == 5
    for a, b in ((["i3"], ["i3.jpg"]), (["nothing"], [])):
        with pytest.raises(ValueError):
            ds.split_with_lists(pics, listed(*a), listed(*b) if b else None)


def test_polygons(spark):
    rows = parsed(spark, "0 .1 .1 .9 .9 .1 .9 .9 .1\n0 .1 .1 .3 .1 .3 .4 .1 .4").withColumn("image", F.lit("a"))
    issues = {r.code for r in ds.validate(rows.drop("source_line").where("ord = 0")).collect()}
    assert issues == {"polygon_self_intersection"}
    outside = parsed(spark, "0 -.1 .1 1.5 .1 .3 2 .1 .4").withColumn("image", F.lit("a"))
    assert [r.code for r in ds.validate(outside).collect()].count("coord_out_of_range") == 3
    r = ds.seg_to_det(rows.where("ord = 1")).select(*[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")]).first()
    assert (r.cx, r.cy, r.w, r.h) == (0.2, 0.25, 0.2, 0.3)
    assert rows.where("ord = 1").select(F.round(geo.polygon_area("polygon"), 6).alias("a")).first().a == 0.06


def test_duplicate_lines_and_attributes(spark):
    rows = parsed(spark, "0 1 1 .5 .5 .2 .2\n0 1 1 .5 .5 .2 .2", attributes=True)
    assert [r.code for r in ds.validate(rows).collect()] == ["duplicate_annotation"]
    other = parsed(spark, "0 .5 .5 .2 .2\n0 0.5 0.50 0.2000000001 .2\n0 .5 .5 .2 .2 .9\n1 .5 .5 .2 .2")
    assert [r.line_no for r in ds.duplicate_lines(other).collect()] == [2]
    assert ds.query_attribute(rows, 0, ["no", "yes"], values=["yes"]).count() == 2 and ds.query_attribute(rows, 0, ["no", "yes"], nonzero=True).count() == 2
    assert {(r.value, r.n) for r in ds.attribute_counts(rows, {"defect": ["no", "yes"]}).collect()} == {("yes", 2)}


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "p.jpg", "width": 100, "height": 100}], "categories": [{"id": 7, "name": "sign"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 20, 40, 30]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [1, 1, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    pics, ann, classes = formats.read_coco(spark, f"{tmp_path}/c.json")
    lines = ann.withColumn("attrs", F.array().cast("array<double>")).select(labels.to_line().alias("l")).collect()
    assert [r.l for r in lines] == ["0 0.3 0.35 0.4 0.3"] and classes.first().class_name == "sign"
    _, rows, cats = formats.coco_tables(pics, ann, classes)
    assert rows.first().bbox == pytest.approx([10, 20, 40, 30]) and cats.first().name == "sign"


def test_voc(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>100</width><height>80</height></size><object><name>car</name><difficult>0</difficult><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>50</xmax><ymax>60</ymax></bndbox></object></annotation>")
    _, ann, classes = formats.read_voc(spark, f"{tmp_path}/a.xml")
    r = ann.first()
    assert (r.cx, r.cy, r.w, r.h) == pytest.approx((0.3, 0.5, 0.4, 0.5)) and classes.first().class_name == "car"


def test_labelme(spark, tmp_path):
    shapes = [{"label": "surface", "shape_type": "rectangle", "points": [[10, 20], [50, 60]], "attributes": {"defect": "yes"}}, {"label": "surface", "shape_type": "circle", "points": [[50, 40], [60, 40]]}]
    (tmp_path / "a.json").write_text(json.dumps({"imagePath": "a.jpg", "imageWidth": 100, "imageHeight": 80, "shapes": shapes}))
    _, ann = formats.read_labelme(spark, str(tmp_path), ["surface"], attributes=[("defect", ["no", "yes"])])
    lines = [r.l for r in ann.orderBy("ord").select(labels.to_line().alias("l")).collect()]
    assert lines[0].startswith("0 1 1 0.3 0.5 ") and len(lines[1].split()) == 3 + 48


def test_tt100k(spark, tmp_path):
    boxes = [({"xmin": 10, "ymin": 20, "xmax": 60, "ymax": 70}, "a"), ({"xmin": -2, "ymin": 0, "xmax": 100, "ymax": 80}, "b")]
    doc = {"types": ["a", "b"], "imgs": {"1": {"path": "train/1.jpg", "objects": [{"category": c, "bbox": b} for b, c in boxes]}}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    ann, _ = formats.read_tt100k(spark, f"{tmp_path}/t.json", spark.createDataFrame([("1", 100, 80)], "image string, width int, height int"))
    rows = ann.orderBy("ord").collect()
    assert [(r.class_id, r.cx, r.cy, r.w, r.h, r.clipped, r.split) for r in rows] == [(0, 0.35, 0.5625, 0.5, 0.625, False, "train"), (1, 0.5, 0.5, 1.0, 1.0, True, "train")]


def test_xany(spark):
    pics = spark.createDataFrame([("a", "a.jpg", 100, 80), ("b", "b.jpg", 10, 10)], "image string, file_name string, width int, height int")
    docs = {r.image: json.loads(r.value) for r in formats.xany_documents(pics, boxed(spark, [("a", 1, 0.3, 0.5, 0.4, 0.5, [])]), spark.createDataFrame([(1, "car")], "class_id int, class_name string")).collect()}
    assert docs["a"]["shapes"][0]["label"] == "car" and docs["a"]["shapes"][0]["points"][0] == pytest.approx([10, 20]) and docs["b"]["shapes"] == []


def test_masks(spark):
    grid = [[0] * 10 for _ in range(10)]
    for y in range(2, 5):
        for x in range(1, 6):
            grid[y][x] = 1
    grid[9][9] = 2
    got = formats.mask_components(spark.createDataFrame([("m", grid)], "image string, pixels array<array<int>>"), min_area=2).collect()
    assert [(r.value, r.area) for r in got] == [(1, 15)] and got[0].polygon[2] == (0.6, 0.5)


def test_headers_and_bad_images(spark, tmp_path):
    png(tmp_path / "a.png", 10, 20)
    (tmp_path / "b.jpg").write_bytes(b"no image")
    heads = images.read_headers(spark, str(tmp_path))
    assert {(r.image, r.width, r.height, r.channels) for r in heads.collect()} == {("a", 10, 20, 3), ("b", None, None, None)}
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "image string")
    assert {tuple(r) for r in images.bad_images(heads, wanted).collect()} == {("c", "missing_image"), ("b", "bad_image")}
    assert labels.list_images(spark, str(tmp_path)).count() == 2


def whole_images():
    """Small whole pictures of each format by name, and their sizes."""
    segment = b"\xff\xe1\xff\xff" + b"\0" * 65533
    frame = b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\x03" + b"\0" * 9
    scan = b"\xff\xda\0\x08\x01\0\0\0\0\0" + b"\x12\xff\0\xff\xd0" * 400
    out = {"late.jpg": (b"\xff\xd8" + segment * 3 + frame + scan + b"\xff\xd9", (9, 7)), "two_scans.jpeg": (b"\xff\xd8" + frame + scan + b"\xff\xc4\0\x04\0\0" + scan + b"\xff\xd9tail", (9, 7))}
    for name, order, magic in (("little.tif", "<", b"II*\0"), ("big.tiff", ">", b"MM\0*")):
        tags = ((256, 4, 1, 30), (257, 3, 1, 40), (258, 3, 3, 0), (273, 4, 1, 100), (277, 3, 1, 3), (279, 4, 1, 3600))
        entries = b"".join(struct.pack(order + ("HHII" if kind == 4 or n > 1 else "HHIHxx"), tag, kind, n, 8 if n > 1 else value) for tag, kind, n, value in tags)
        data = magic + struct.pack(order + "I", 14) + struct.pack(order + "HHH", 8, 8, 8) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4
        out[name] = (data.ljust(100, b"\0") + b"x" * 3600, (30, 40))
    riff = lambda chunk: b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk
    out["lossy.webp"] = (riff(b"VP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 50, 60)), (50, 60))
    out["lossless.webp"] = (riff(b"VP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", 69 | 79 << 14) + b"\0" * 5), (70, 80))
    out["extended.webp"] = (riff(b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + (89).to_bytes(3, "little") + (99).to_bytes(3, "little")), (90, 100))
    picture = b"\x2c\0\0\0\0\x05\0\x04\0\0\x02" + b"\xff" + b"d" * 255 + b"\x03abc\0"
    out["moving.webp"] = (riff(b"VP8X" + struct.pack("<I", 10) + b"\x10" + b"\0" * 3 + (4).to_bytes(3, "little") + (3).to_bytes(3, "little") + b"ODD " + struct.pack("<I", 3) + b"abc\0"), (5, 4))
    out["plain.gif"] = (b"GIF89a\x05\0\x04\0\x80\0\0" + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + picture * 2 + b"\x3b", (5, 4))
    out["rows.bmp"] = (b"BM" + struct.pack("<IHHI", 54 + 3200, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 33, -32, 1, 24, 0, 0, 0, 0, 0, 0) + b"\0" * 3200, (33, 32))
    return out


def test_whole_files_and_files_cut_short(spark, tmp_path):
    """Each format is good as a whole and bad where half of it, or its end, is missing."""
    (tmp_path / "whole").mkdir(), (tmp_path / "cut").mkdir()
    good = whole_images()
    for name, (data, _) in good.items():
        (tmp_path / "whole" / name).write_bytes(data)
        ends = (0, 5, 12, 13, 26, len(data) // 2, len(data) - (5 if name == "two_scans.jpeg" else 1))
        for k, end in enumerate(ends):
            stem, suffix = name.rsplit(".", 1)
            (tmp_path / "cut" / f"{stem}{k}.{suffix}").write_bytes(data[:end])
    png(tmp_path / "whole/good.png", 10, 20)
    whole = (tmp_path / "whole/good.png").read_bytes()
    (tmp_path / "cut/torn.png").write_bytes(whole[:-12])
    (tmp_path / "cut/bent.png").write_bytes(whole[:45] + bytes([whole[45] ^ 1]) + whole[46:])
    (tmp_path / "cut/empty.jpg").write_bytes(b"")
    heads = images.read_headers(spark, str(tmp_path / "whole"), whole=True)
    rows = {r.path.rsplit("/", 1)[1]: r for r in heads.collect()}
    assert {n: (r.width, r.height) for n, r in rows.items() if n != "plain.gif"} == {n: size for n, (_, size) in good.items() if n != "plain.gif"} | {"good.png": (10, 20)}
    assert all(r.intact for r in rows.values()) and "plain.gif" not in rows  # no picture suffix
    cut = images.read_headers(spark, str(tmp_path / "cut"), whole=True).collect()
    assert len(cut) == 7 * (len(good) - 1) + 3 and not any(r.intact for r in cut)
    (tmp_path / "cut/gone.jpg").symlink_to(tmp_path / "none")
    wanted = spark.createDataFrame([("gone",), ("torn0",), ("empty",)], "image string")
    assert {tuple(r) for r in images.bad_images(images.read_headers(spark, str(tmp_path / "cut"), True), wanted).where("image IN ('gone', 'torn0', 'empty')").collect()} == {("gone", "missing_image"), ("torn0", "missing_image"), ("empty", "bad_image")}
    gif = good["plain.gif"][0]
    for data, fits in ((gif, True), (gif[: len(gif) // 2], False), (gif[:-1], False)):
        (tmp_path / "g").write_bytes(data)
        with places.Source(str(tmp_path / "g")) as source:
            assert images.examined(source)[-1] is fits and images.header(source)[-2:] == (5, 4)


def test_all_names_are_found(spark, tmp_path):
    """Names that begin with _ or ., names with escapes, links, and folders below folders."""
    for d in ("", "/_x", "/_x/.y", "/_x/.y/z", "/empty"):
        (tmp_path / f"d{d}").mkdir()
    names = ["_DSC0001.JPG", "a%20b.jpg", "c d+e.png", ".h.png", "_x/_1.png", "_x/.y/2.png", "_x/.y/z/é.png"]
    for n in names:
        (tmp_path / "d" / n).write_bytes(b"x")
    (tmp_path / "d/other.txt").write_text("")
    (tmp_path / "d/link.png").symlink_to(tmp_path / "d/.h.png")
    (tmp_path / "d/loop").symlink_to(tmp_path / "d")
    got = sorted(r.path for r in labels.list_images(spark, str(tmp_path / "d")).collect())
    assert got == sorted(f"{tmp_path}/d/{n}" for n in [*names, "link.png"])
    assert labels.count_files(spark, str(tmp_path / "d")) == 9 and labels.list_files(spark, str(tmp_path / "d"), recursive=False).count() == 6
    assert {r.image: r.bytes for r in images.read_headers(spark, str(tmp_path / "d")).collect()}["a%20b"] == 1
    assert labels.list_files(spark, str(tmp_path / "none")).count() == 0


def test_a_flat_folder_is_listed_in_bounded_memory(monkeypatch):
    class Entry:
        def __init__(self, k):
            self.path = f"/flat/{k:07d}.png"

        def is_dir(self, follow_symlinks=True):
            return False

    class Found:
        def __enter__(self):
            return map(Entry, range(1_000_000))

        def __exit__(self, *_):
            pass

    monkeypatch.setattr(places.os, "scandir", lambda _: Found())
    tracemalloc.start()
    count = sum(b.num_rows for b in places._listed(iter([pa.RecordBatch.from_pydict({"path": ["/flat"]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 1_000_000 and peak < 20 << 20


def test_digests_of_files_of_one_size(spark, tmp_path, monkeypatch):
    (tmp_path / "images").mkdir()
    for name, data in (("a", b"x" * 10), ("b", b"x" * 10), ("c", b"y" * 10), ("d", b"x" * 11), ("_e", b"x" * 10)):
        (tmp_path / f"images/{name}.png").write_bytes(data)
    (tmp_path / "labels").mkdir()
    got = Manager(spark, str(tmp_path)).duplicates().collect()
    assert sorted(r.image.rsplit("/", 1)[1] for r in got) == ["_e.png", "a.png", "b.png"] and {r.n for r in got} == {3}


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.count = 0

    def read(self, n=-1):
        part = super().read(n)
        self.count += len(part)
        return part


def test_headers_are_read_from_few_bytes():
    """Bytes read for a header: the first 64 KB, and a block for each mark beyond them."""
    padding = b"\0" * (20 << 20)
    for name, (data, size) in whole_images().items():
        file = Counting(data + padding)
        source = places.Source(name, lambda _: file)  # noqa: B023
        assert images.header(source)[-2:] == size
        assert file.count <= places.HEAD + (3 * places.BLOCK if name == "late.jpg" else 0)
        if name == "late.jpg":
            assert file.count < 100_000 < len(data)
    far = bytearray(whole_images()["little.tif"][0])
    at = len(far) + (1 << 20)
    far[4:8] = struct.pack("<I", at)  # the directory stands at the end
    file = Counting(bytes(far) + b"\0" * (1 << 20) + bytes(far[14:92]))
    assert images.header(places.Source("far.tif", lambda _: file))[-2:] == (30, 40) and file.count <= places.HEAD + 2 * places.BLOCK


def test_modes(tmp_path):
    def png_of(kind, depth):
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 3, 2, depth, kind, 0, 0, 0)

    head = lambda data: images.header(places.Source("x", lambda _: io.BytesIO(data)))
    want = {(0, 8): ("L", "uint8", 8, 1), (0, 1): ("1", "bool", 1, 1), (0, 16): ("I;16", "uint16", 16, 1), (2, 8): ("RGB", "uint8", 8, 3), (3, 8): ("P", "uint8", 8, 1), (6, 8): ("RGBA", "uint8", 8, 4)}
    assert {k: head(png_of(*k))[1:5] for k in want} == want
    assert head(b"no picture") == (None,) * 7 and head(b"") == (None,) * 7
    assert head(whole_images()["little.tif"][0])[:5] == ("TIFF", "RGB", "uint8", 8, 3)


def test_uint8(spark):
    pixels = spark.createDataFrame([("a", [0.0, 5000.0, 10000.0, 20000.0])], "image string, values array<double>")
    values = images.to_uint8(pixels, 0, 20000).first()["values"]
    assert values[0] == 0 and values[3] == 255
    assert images.to_uint8(spark.createDataFrame([("a", [7.0, 7.0])], "image string, values array<double>")).first()["values"] == [255, 255]
    # The least value stays apart from zero, and what is not finite is nothing.
    odd = spark.createDataFrame([("a", [0.0, 10.0, 20.0, 30.0, float("inf"), float("nan"), None]), ("b", [0.0, -0.0]), ("c", []), ("d", None)], "image string, values array<double>")
    got = lambda **options: {r.image: r["values"] for r in images.to_uint8(odd, **options).collect()}
    assert got() == {"a": [0, 1, 128, 255, 0, 0, 0], "b": [0, 0], "c": [], "d": None}
    assert got(preserve_zero=False)["a"] == [0, 85, 170, 255, 0, 0, 0]
    assert got(low=10.0, high=20.0)["a"] == [0, 1, 255, 255, 0, 0, 0]
    assert got(stretch=False)["a"] == [0, 10, 20, 30, 0, 0, 0]
    for low, high in ((1.0, None), (2.0, 2.0), (0.0, float("inf"))):
        with pytest.raises(ValueError, match="range"):
            images.to_uint8(odd, low, high)


@pytest.mark.parametrize("options", [{}, {"preserve_zero": False}, {"value_range": (3.0, 900.0)}, {"stretch": False}])
def test_pixels_of_a_task_are_those_of_the_table(spark, options):
    values = np.random.default_rng(7).integers(0, 1000, 400).astype(np.uint16) * (np.arange(400) % 5 > 0)
    named = {k: v for k, v in options.items() if k != "value_range"} | dict(zip(("low", "high"), options.get("value_range", ()), strict=False))
    table = spark.createDataFrame([("a", values.astype(float).tolist())], "image string, values array<double>")
    assert pictures.stretched(values.reshape(20, 20), **options).ravel().tolist() == images.to_uint8(table, **named).first()["values"]


def small_tiff(grid, big=False, packing=1, rows=2):
    """A grey TIFF in strips of ``rows`` lines."""
    order, grid = ">" if big else "<", np.array(grid)
    kind = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    strips = [grid[y : y + rows].astype(grid.dtype.newbyteorder(order)).tobytes() for y in range(0, len(grid), rows)]
    strips = [zlib.compress(x) for x in strips] if packing != 1 else strips
    places = np.cumsum([8] + [len(x) for x in strips])
    lists, after = int(places[-1]), int(places[-1]) + 8 * len(strips)
    numbers = lambda tag, values, at: (tag, 4, len(values), at if len(values) > 1 else values[0])
    tags = [(256, 4, 1, grid.shape[1]), (257, 4, 1, grid.shape[0]), (258, 4, 1, grid.dtype.itemsize * 8), (259, 4, 1, packing), (262, 4, 1, 1)]
    tags += [numbers(273, [int(p) for p in places[:-1]], lists), (277, 4, 1, 1), (278, 4, 1, rows), numbers(279, [len(x) for x in strips], lists + 4 * len(strips)), (339, 4, 1, kind)]
    body = b"".join(strips) + struct.pack(f"{order}{2 * len(strips)}I", *(int(p) for p in places[:-1]), *(len(x) for x in strips))
    head = (b"MM\0*" if big else b"II*\0") + struct.pack(order + "I", after)
    return head + body + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", *t) for t in tags) + bytes(4)


@pytest.mark.parametrize("kind", ["u2", "i2", "u4", "i4", "f4"])
def test_tiff_pixels(kind):
    grid = (np.arange(35).reshape(5, 7) * 1.5).astype(kind)
    for big in (False, True):
        for packing in (1, 8, 32946):
            data = small_tiff(grid, big, packing)
            assert (pictures.pixels(places.Source("x", lambda _, d=data: io.BytesIO(d)))[:, :, 0] == grid).all()
    lzw = small_tiff(grid, packing=5)
    with pytest.raises(ValueError, match="not read"):
        pictures.pixels(places.Source("x", lambda _: io.BytesIO(lzw)))


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_round_trip(samples):
    grid = np.random.default_rng(samples).integers(0, 256, (5, 9, samples)).astype(np.uint8)
    data = pictures.png(grid)
    assert (masks.png_pixels(data) == grid).all() and images.whole_png(places.Source("x", lambda _: io.BytesIO(data)))


def test_multimodal(spark):
    files = lambda *names: spark.createDataFrame([(n, f"/{n}.png") for n in names], "image string, path string")
    scenes, issues = multimodal.associate({"rgb": (files("a_V", "b_V"), "_V"), "infrared": (files("a_T"), "_T")}, files("a_gt", "b_gt"), "_gt")
    assert {r.scene for r in scenes.collect()} == {"a", "b"} and [r.scene for r in scenes.where("complete").collect()] == ["a"]
    assert [(r.scene, r.code, r.modality) for r in issues.collect()] == [("b", "missing_modality", "infrared")]
    twice = files("scene_V").union(files("scene_V"))
    scenes, issues = multimodal.associate({"rgb": (twice, "_V")}, files("scene"))
    assert scenes.where("complete").count() == 0 and issues.where("code = 'duplicate_scene_image' AND level = 'error'").count() == 1
    assert multimodal.one_modality(scenes, "rgb", False).count() == 1


def test_letterbox(spark):
    row = spark.range(1).select(F.lit(100).alias("width"), F.lit(50).alias("height"))
    t = row.withColumns(geo.letterbox(F.col("width"), F.col("height"), 200, 200)).first()
    assert (0.5 * t.sx + t.ox, 0.5 * t.sy + t.oy, 0.2 * t.sx, 0.4 * t.sy) == pytest.approx((0.5, 0.5, 0.2, 0.2))


def colour_png(grid, depth=8, alpha=False, how=0):
    """A PNG of rows of grey values, or of (r, g, b), every line filtered in one way."""
    grid = np.array(grid)
    if alpha:
        grid = np.concatenate([grid, np.full((*grid.shape[:2], 1), 200)], axis=2)
    samples = 1 if grid.ndim == 2 else grid.shape[2]
    lines = grid.reshape(len(grid), -1).astype(">u2" if depth == 16 else np.uint8)
    if depth < 8:
        bits = np.unpackbits(lines[:, :, None].astype(np.uint8), axis=2)[:, :, 8 - depth :].reshape(len(lines), -1)
        lines = np.packbits(bits, axis=1)
    rows, step, packed = lines.view(np.uint8).reshape(len(grid), -1).astype(int), max(1, samples * depth // 8), b""
    above = np.zeros(rows.shape[1], int)
    for row in rows:
        left, corner = np.r_[[0] * step, row[:-step]], np.r_[[0] * step, above[:-step]]
        guess = left + above - corner
        near = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        packed += bytes([how]) + ((row - [0, left, above, (left + above) // 2, paeth][how]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], depth, {1: 0, 3: 2, 4: 6}[samples], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters_depths_and_colours(how):
    rng = np.random.default_rng(how)
    for depth in (1, 2, 4, 8, 16):
        grid = rng.integers(0, 1 << depth, (7, 13))
        assert (masks.png_pixels(colour_png(grid, depth, how=how))[:, :, 0] == grid).all(), depth
    colours = rng.integers(0, 256, (9, 5, 3))
    for alpha in (False, True):
        got = masks.values_of(masks.png_pixels(colour_png(colours, alpha=alpha, how=how)))
        assert (got == masks.COLOUR + (colours << [16, 8, 0]).sum(axis=2)).all()
    with pytest.raises(ValueError, match="PNG"):
        masks.png_pixels(b"no picture")


def polygon_area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def points_of(flat):
    return list(zip(flat[::2], flat[1::2], strict=True))


def test_outlines_follow_borders():
    ell = np.zeros((8, 9), int)
    ell[1:6, 2:4] = 1
    ell[4:6, 4:8] = 1
    (got,) = masks.traced(ell)
    assert points_of(got["outline"]) == [(2, 1), (4, 1), (4, 4), (8, 4), (8, 6), (2, 6)] and got["area"] == polygon_area(points_of(got["outline"])) == 18
    ring = np.ones((5, 5), int)
    ring[1:4, 1:4] = 0
    (got,) = masks.traced(ring)
    assert points_of(got["outline"]) == [(0, 0), (5, 0), (5, 5), (0, 5)] and got["area"] == 16
    corner = np.array([[1, 0, 1], [1, 1, 1], [0, 1, 0]])  # touches itself at no corner
    diagonal = np.array([[1, 0], [0, 1]])
    assert [points_of(a["outline"]) for a in masks.traced(diagonal)] == [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]
    assert polygon_area(points_of(masks.traced(corner)[0]["outline"])) == 6
    pinch = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]])  # two of its pixels meet at a corner alone
    assert polygon_area(points_of(masks.traced(pinch)[0]["outline"])) == 7


@given(st.lists(st.lists(st.integers(0, 2), min_size=6, max_size=6), min_size=1, max_size=7))
def test_outlines_of_any_areas(rows):
    """Areas are those of a plain fill; an outline encloses the area's pixels and its holes."""
    grid, seen, want = np.array(rows), set(), []
    for y, x in np.ndindex(*grid.shape):
        if grid[y, x] and (y, x) not in seen:
            stack, own = [(y, x)], {(y, x)}
            while stack:
                b, a = stack.pop()
                for n in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                    if n not in own and 0 <= n[0] < grid.shape[0] and 0 <= n[1] < grid.shape[1] and grid[n] == grid[y, x]:
                        own.add(n), stack.append(n)
            seen |= own
            outside, stack = {(-1, -1)}, [(-1, -1)]
            while stack:  # holes are what cannot be reached from outside, corners included
                b, a = stack.pop()
                for n in [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n not in own and n not in outside and -1 <= n[0] <= grid.shape[0] and -1 <= n[1] <= grid.shape[1]:
                        outside.add(n), stack.append(n)
            holes = (grid.shape[0] + 2) * (grid.shape[1] + 2) - len(outside) - len(own)
            want.append((int(grid[y, x]), len(own), len(own) + holes))
    got = masks.traced(grid)
    assert [(a["value"], a["area"]) for a in got] == [w[:2] for w in want]
    for a, (_, area, filled) in zip(got, want, strict=True):
        assert area <= polygon_area(points_of(a["outline"])) and polygon_area(points_of(a["outline"])) >= filled


def test_colour_masks(spark, tmp_path):
    """RGB and RGBA masks with a colour map equal a plain count; palettes of all masks are one."""
    rng = np.random.default_rng(1)
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 128, 255], [9, 9, 9]])
    (tmp_path / "m").mkdir()
    grids = {f"_m{k}": rng.integers(0, 3 + k % 2, (12, 10)) for k in range(4)}
    for k, (name, grid) in enumerate(grids.items()):
        (tmp_path / f"m/{name}.png").write_bytes(colour_png(palette[grid], alpha=k % 2 == 1, how=k))
    pics, ann, classes = formats.read_masks(spark, str(tmp_path / "m"), class_map={"#ff0000": "red", "0,128,255": "other", (9, 9, 9): "red", 0: "none"})
    assert {(r.class_id, r.class_name) for r in classes.collect()} == {(0, "red"), (1, "other")} and pics.count() == 4
    area = {(r.image, r.class_id): r.n for r in ann.groupBy("image", "class_id").agg(F.sum("area").alias("n")).collect()}
    assert area == {(n, c): int(np.isin(g, v).sum()) for n, g in grids.items() for c, v in ((0, (1, 3)), (1, (2,)))}
    _, _, found = formats.read_masks(spark, str(tmp_path / "m"))
    assert [r.class_name for r in found.orderBy("class_id").collect()] == ["0,128,255", "255,0,0", "9,9,9"]
    (tmp_path / "m/_m0.png").write_bytes(colour_png(np.array([[0, 300], [300, 7]]), 16))
    _, ann, found = formats.read_masks(spark, str(tmp_path / "m"))
    assert [r.class_name for r in found.orderBy("class_id").collect()] == ["0,128,255", "255,0,0", "300", "7", "9,9,9"] and ann.where("image = '_m0'").count() == 3


def test_merged_attributes_stand_at_common_places(spark):
    a, b = {"defect": ["no", "dent"], "age": None}, {"grade": ["x", "y"], "defect": ["dent", "rust", "no"], "age": None}
    merged = ds.merge_attributes([a, b], extend=True)
    assert merged == {"defect": ["no", "dent", "rust"], "age": None, "grade": ["x", "y"]}
    rows = spark.createDataFrame([(0, [1.0, 0.0, 5.0]), (1, [0.0, 1.0]), (2, []), (3, [1.0, 2.0, 7.5]), (4, [1.0, 9.0, 0.0])], "class_id int, attrs array<double>")
    got = {r.class_id: r.attrs for r in ds.align_attributes(rows, b, merged, ["c"]).collect()}
    assert got == {0: [1.0, 5.0, 1.0], 1: [2.0, 0.0, 0.0], 2: [], 3: [0.0, 7.5, 1.0], 4: [9.0, 0.0, 1.0]}
    assert ds.align_attributes(rows, merged, merged, ["c"]) is rows
    scoped = {"p": {"u": ["1", "2"]}, "q": {"v": None}}
    both = ds.merge_attributes([{"p": {"w": None, "u": ["2"]}}, scoped], extend=True)
    assert both == {"p": {"w": None, "u": ["2", "1"]}, "q": {"v": None}}
    got = {r.class_id: r.attrs for r in ds.align_attributes(rows.where("class_id < 2"), scoped, both, ["p", "q"]).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.0, 1.0]}
