"""Documents that are read in ranges hold the same elements as when they are read at once."""

import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.manager import run_task
from tessera.sources import bigjson, formats
from tessera.sources.places import Source
from tests.test_dataset import png

TEXTS = st.text('a"\\[]{}:, é', max_size=8)
LEAVES = st.one_of(st.none(), st.integers(-5, 5), TEXTS)
ELEMENTS = st.recursive(st.dictionaries(TEXTS, LEAVES, max_size=3), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(TEXTS, x, max_size=3)), max_leaves=6)
CONTAINERS = st.one_of(st.lists(ELEMENTS, max_size=4), st.dictionaries(TEXTS, ELEMENTS, max_size=4))


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(TEXTS, st.one_of(CONTAINERS, LEAVES), max_size=3), st.sampled_from([1, 2, 3, 7, 40, 1000]), st.sampled_from([None, 1]), st.booleans())
def test_elements_of_any_document(doc, width, indent, ascii_only):
    data = json.dumps(doc, indent=indent, ensure_ascii=ascii_only).encode()
    source = Source("", lambda _: io.BytesIO(data))
    ranges = [(k, a, min(a + width, len(data))) for k, a in enumerate(range(0, len(data), width))]
    begins, whole = bigjson.beginnings([(k, *bigjson.measured_range(source, a, b)) for k, a, b in ranges])
    assert whole
    rows = sorted(r for k, a, b in ranges for r in bigjson._found(source, a, b, *begins[k]))
    got = [(r[2], json.loads(r[3])) for r in rows if r[1] == 2]
    want = [(None if isinstance(c, list) else n, e) for c in doc.values() if isinstance(c, (list, dict)) for n, e in ([(None, e) for e in c] if isinstance(c, list) else c.items())]
    assert got == want
    marks = [r for r in rows if r[1] == 1]
    spans = [(a[2], json.loads(data[a[0] : b[4]])) for a, b in zip(marks[::2], marks[1::2], strict=True)]
    assert spans == [(n, c) for n, c in doc.items() if isinstance(c, (list, dict))]


def test_coco_in_ranges(spark, tmp_path):
    """The same rows as the one-task reader, with brackets and quotes inside strings."""
    odd = 'a "[{]}" \\ é'
    doc = {
        "info": {"about": [odd]}, "licenses": [], "categories": [{"id": 7, "name": odd}, {"name": "x", "id": 3, "more": {"y": [1, {"z": "]"}]}}],
        "images": [{"id": k, "file_name": f"{odd.replace('/', '')}{k}.jpg", "width": 100 + k, "height": 80} for k in range(40)],
        "annotations": [{"id": k, "image_id": k % 40, "category_id": (7, 3, 9)[k % 3], "bbox": [1, 2, 10 + k, 20], "segmentation": [[1, 1, 9, 1, 9, 9 + k]] if k % 2 else {"counts": "x}]"}} for k in range(200)],
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc, indent=2))
    for task in ("detect", "segment"):
        plain, *ranged = [[sorted(map(str, t.collect())) for t in formats.read_coco(spark, str(path), task, **o)] for o in ({}, {"parallel_bytes": 0, "width": 777}, {"parallel_bytes": 0})]
        assert all(r == plain for r in ranged) and len(plain[1]) == 134
    path.write_text(path.read_text()[:-40])
    with pytest.raises(ValueError, match="whole JSON"):
        bigjson.members(spark, str(path), 500)


def test_tt100k(spark, tmp_path):
    """Boxes are clipped, and paths that no dataset could hold are errors or left out."""
    (tmp_path / "train").mkdir(), (tmp_path / "test").mkdir()
    for n in ("train/1", "train/2", "test/_3", "test/2"):
        png(tmp_path / f"{n}.png", 100, 50)
    box = lambda *b: dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, b), strict=True))
    imgs = {
        "1": {"id": 1, "path": "train/1.png", "objects": [{"category": "b", "bbox": box(10, 10, 30, 20)}, {"category": "a", "bbox": box(90, 40, 120, 60)}, {"category": "a", "bbox": box(100, 0, 130, 9)}]},
        "3": {"path": "test/_3.png", "objects": [{"category": "zz", "bbox": box(1, 1, 2, 2)}]}, "9": {"path": "train/9.png", "objects": []}, "x": {"path": "../x.png", "objects": []},
        "2": {"path": "train/2.png", "objects": []}, "4": {"path": "test/2.png", "objects": []},
    }
    path = tmp_path / "annotations.json"
    path.write_text(json.dumps({"types": ["a", "b"], "imgs": imgs}))
    rows, _ = formats.tt100k_images(spark, str(path))
    present = spark.createDataFrame([(f"{tmp_path}/{p}",) for p in ("train/1.png", "train/2.png", "test/_3.png", "test/2.png")], "path string")
    issues = {tuple(r) for r in formats.tt100k_issues(rows, str(tmp_path), present).collect()}
    assert issues == {("../x.png", "unsafe_path"), ("train/9.png", "missing_image"), ("train/2.png", "name_collision"), ("test/2.png", "name_collision")}
    with pytest.raises(ValueError, match="missing_image: train/9.png"):
        run_task(spark, "import.tt100k", str(path))
    for options in ({}, {"parallel_bytes": 0, "width": 50}):
        pics, ann, classes = run_task(spark, "import.tt100k", str(path), strict=False, out=str(tmp_path / "out"), **options)
        assert sorted((r.image, r.width) for r in pics.collect()) == [("1", 100), ("_3", 100)] and [r.class_name for r in classes.orderBy("class_id").collect()] == ["a", "b"]
        got = [(r.image, r.class_id, round(r.cx, 3), r.clipped) for r in ann.orderBy("ord").collect()]
        assert got == [("1", 1, 0.2, False), ("1", 0, 0.95, True)]
    assert (tmp_path / "out/labels/_3.txt").read_text() == "" and len((tmp_path / "out/labels/1.txt").read_text().splitlines()) == 2
