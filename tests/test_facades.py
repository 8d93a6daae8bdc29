import numpy as np
from pyspark.sql import functions as F
import pytest

from tessera.__main__ import arguments, main
from tessera.manager import Manager
from tessera.scenes import Scenes
from tessera.sources import labels, layout, masks
from tests.test_dataset import colour_png, png, small_tiff
from tests.test_manager import root  # noqa: F401


def test_empty_files_are_listed(spark, root):  # noqa: F811
    (root / "labels/b.txt").write_text("")
    (root / "images/c d+e.png").write_bytes(b"")
    assert {r.image for r in labels.list_images(spark, str(root / "images")).collect()} == {"a", "b", "c d+e"}
    m = Manager(spark, str(root))
    assert {(r.image, r.code) for r in m.check().collect()} == {("lost", "orphan_label"), ("c d+e", "missing_label")}
    assert {(r.image, r.issue) for r in m.bad_images().collect()} == {("c d+e", "bad_image")}
    assert m.fill_missing_labels() == 1 and (root / "labels/c d+e.txt").read_text() == ""


def test_rules_and_conditions(spark, root, tmp_path):  # noqa: F811
    (tmp_path / "rules.yaml").write_text("car: {width: 0.15, height: 0.15, logic: and}\n")
    m = Manager(spark, str(root))
    assert m.filter(class_rules=str(tmp_path / "rules.yaml"), min_width=0.5).count() == 2
    assert m.filter(F.col("cx") < 0.3).count() == 1
    with pytest.raises(ValueError):
        layout.read_mapping("[1]")
    with pytest.raises(FileNotFoundError):
        layout.load(spark, str(root), only_val=True)
    (root / "val.txt").write_text("b\n")
    assert [r.image for r in layout.load(spark, str(root), only_val=True).images.collect()] == ["b"]


def test_command_line(spark, root, tmp_path, capsys):  # noqa: F811
    assert arguments(["car,2", "--min-area=0.5", "--class-rules", "{car: {width: 1}}"]) == ([["car", 2]], {"min_area": 0.5, "class_rules": {"car": {"width": 1}}})
    assert main(["query.class", str(root), "car,", "--report", f"{tmp_path}/q.csv"], spark) == 0
    assert len((tmp_path / "q.csv").read_bytes().split(b"\r\n")) == 4
    assert main(["check", str(root)], spark) == 0 and "orphan_label" in capsys.readouterr().out
    (root / "labels/b.txt").write_text("9 .1 .1 .2 .1\n")
    assert main(["check", str(root)], spark) == 2 and main(["nothing"], spark) == 1


def test_scenes(spark, tmp_path):
    for d in ("rgb", "ir", "labels"):
        (tmp_path / d).mkdir()
    for name in ("rgb/a_V", "rgb/b_V", "ir/a_T"):
        png(tmp_path / f"{name}.png", 100, 80)
    for name in "ab":
        (tmp_path / f"labels/{name}_gt.txt").write_text("0 .5 .5 .2 .3\n")
    (tmp_path / "class.txt").write_text("person\n")
    s = Scenes(spark, str(tmp_path), {"rgb": "rgb", "infrared": "ir"}, {"rgb": "_V", "infrared": "_T", "label": "_gt"})
    assert [r.scene for r in s.complete().collect()] == ["a"]
    assert {(r.scene, r.code) for r in s.check().collect()} == {("b", "missing_modality")}
    assert s.view("rgb").annotations.count() == 1 and s.view("rgb", False).annotations.count() == 2
    assert {(r.modality, r.width, r.n) for r in s.types().collect()} == {("rgb", 100, 2), ("infrared", 100, 1)}
    assert s.stats()["classes"].first().objects == 2
    assert s.draw("rgb", complete_only=False).count() == 2 and s.crop("infrared").count() == 1
    (tmp_path / "rgb/a_V.bmp").write_bytes(b"")
    s.reload()
    assert s.complete().count() == 0 and "duplicate_scene_image" in {r.code for r in s.check().collect()}
    with pytest.raises(ValueError, match="unknown"):
        Scenes(spark, str(tmp_path), {"rgb": "rgb"}, {"depth": "_D"})


def test_scenes_in_eight_bits(spark, tmp_path):
    for d in ("rgb/day", "depth", "labels"):
        (tmp_path / d).mkdir(parents=True)
    png(tmp_path / "rgb/day/a.png", 10, 8)
    deep = np.array([[0, 5000], [10000, 20000]])
    (tmp_path / "depth/a.png").write_bytes(colour_png(deep, 16, how=4))
    (tmp_path / "depth/b.tif").write_bytes(small_tiff(deep.astype("f4") / 100))
    (tmp_path / "depth/c.png").write_bytes(colour_png(np.array([[0, 1], [1, 0]]), 1))
    (tmp_path / "labels/a.txt").write_text("0 .5 .5 .2 .3\n")
    (tmp_path / "class.txt").write_text("person\n")
    s = Scenes(spark, str(tmp_path), {"rgb": "rgb", "depth": "depth"})
    out = tmp_path / "out"
    got = {r.modality: (r.image_count, r.converted_count, r.copied_uint8_count, r.out_dir) for r in s.convert_to_uint8(str(out), value_range=(0, 20000)).collect()}
    assert got == {"rgb": (1, 0, 1, f"{out}/rgb"), "depth": (3, 3, 0, f"{out}/depth")}
    read = lambda p: masks.png_pixels(p.read_bytes())[:, :, 0].tolist()
    assert (out / "rgb/day/a.png").read_bytes() == (tmp_path / "rgb/day/a.png").read_bytes()
    assert read(out / "depth/a.png") == [[0, 64], [128, 255]] and read(out / "depth/b.png") == [[0, 2], [2, 4]] and read(out / "depth/c.png") == [[0, 1], [1, 0]]
    assert sorted(p.name for p in (out / "depth").iterdir()) == ["a.png", "b.png", "c.png"]
    with pytest.raises(FileExistsError, match="there already"):
        s.convert_to_uint8(str(out), ["depth"])
    s.convert_to_uint8(str(out), ["depth"], overwrite=True)
    assert read(out / "depth/b.png") == [[0, 1], [86, 255]] and read(out / "depth/c.png") == [[0, 255], [255, 0]]
    (tmp_path / "depth/B.png").write_bytes(colour_png(deep, 16))
    with pytest.raises(ValueError, match="several pictures"):
        s.convert_to_uint8(str(tmp_path / "other"), ["depth"])
    (tmp_path / "depth/B.png").write_bytes(b"no picture")
    with pytest.raises(ValueError, match="no header"):
        s.convert_to_uint8(str(tmp_path / "other"), ["depth"])
    assert not (tmp_path / "other").exists()
    for options in ({"modalities": ["x"]}, {"value_range": (3, 3)}):
        with pytest.raises(ValueError):
            s.convert_to_uint8(str(out), **options)


def test_statistics_by_modality(spark, tmp_path):
    for d in ("rgb", "depth", "labels"):
        (tmp_path / d).mkdir()
    for name in ("rgb/a", "rgb/b", "depth/a"):
        png(tmp_path / f"{name}.png", 100, 80 if name[0] == "r" else 40)
    for name in "ab":
        (tmp_path / f"labels/{name}.txt").write_text("0 .5 .5 .2 .3\n1 .5 .5 .2 .3\n")
    (tmp_path / "class.txt").write_text("person\ncar\n")
    s = Scenes(spark, str(tmp_path), {"rgb": "rgb", "depth": "depth"}, required=["rgb"])
    assert {tuple(r) for r in s.stats()["modalities"].collect()} == {("rgb", 2, 0), ("depth", 1, 1)}
    shapes = lambda m: [(r.width, r.height) for r in s.stat_tables(m, "box_shape_pix")["box_shape_pix"].collect()]
    assert shapes("rgb") == [(20.0, 24.0)] * 4 and shapes("depth") == [(20.0, 12.0)] * 2
    assert s.modality_stats("depth")["totals"].first().annotations == 2
    folders = s.write_stats(str(tmp_path / "out"), ["class_counts", "image_shape"])
    assert folders == {m: f"{tmp_path}/out/{m}" for m in ("rgb", "depth")}
    assert sorted(p.name for p in (tmp_path / "out/depth").iterdir()) == ["class_counts.csv", "image_shape.csv"]
    assert Scenes(spark, str(tmp_path), {"rgb": "rgb", "depth": "depth"}).stats()["modalities"].where("missing_scene_count > 0").count() == 0
