import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import corners, size_bucket
from tessera.operators import evaluation as ev

KIND = "image string, ord int, class_id int, cx double, cy double, w double, h double, confidence double, width int, height int"


def boxes(spark, rows, size=(100, 80)):
    """rows: image, class_id, cx, cy, w, h[, confidence]; places follow the order given."""
    at: dict = {}
    out = []
    for image, k, cx, cy, w, h, *conf in rows:
        out.append((image, at.get(image, 0), k, cx, cy, w, h, conf[0] if conf else None, *size))
        at[image] = at.get(image, 0) + 1
    df = spark.createDataFrame(out, KIND).withColumns(corners())
    return df.withColumn("size", size_bucket(F.col("w"), F.col("h"), F.col("width"), F.col("height")))


BASE = [("a", 0, 0.5, 0.5, 0.2, 0.3), ("a", 1, 0.4, 0.4, 0.2, 0.2), ("b", 1, 0.1, 0.1, 0.2, 0.1)]


def test_compare(spark):
    pred = boxes(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3, 0.9), ("a", 1, 0.9, 0.9, 0.1, 0.1, 0.8)])
    rows = ev.compare(boxes(spark, BASE), pred).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in rows} == {"tp": 1, "fp": 1, "fn": 2}


def test_compare_takes_boxes_in_file_order(spark):
    gt = boxes(spark, [("a", 0, 0.5, 0.5, 0.2, 0.2), ("a", 0, 0.51, 0.5, 0.2, 0.2)])
    pred = boxes(spark, [("a", 0, 0.51, 0.5, 0.2, 0.2, 0.5), ("a", 0, 0.8, 0.8, 0.1, 0.1, 0.5)])
    got = {(r.g, r.status): r.p for r in ev.compare(gt, pred).where("g IS NOT NULL").collect()}
    assert got == {(0, "tp"): 0, (1, "fn"): None}


def test_perfect_and_missing_class(spark):
    gt = boxes(spark, [("a", 0, 0.5, 0.5, 0.2, 0.3), ("a", 1, 0.4, 0.4, 0.2, 0.2)])
    pred = boxes(spark, [("a", 1, 0.4, 0.4, 0.2, 0.2, 0.9)])
    rows = {r.class_id: r for r in ev.class_metrics(gt, pred).collect()}
    assert rows[1].ap50 == pytest.approx(0.995) and rows[1].precision == pytest.approx(1) and rows[1].recall == pytest.approx(1)
    macro = ev.macro_metrics(ev.class_metrics(gt, pred)).first()
    assert (macro.map50, macro.map) == (pytest.approx(0.4975), pytest.approx(0.4975))


def test_class_without_labels(spark):
    gt, pred = boxes(spark, [("a", 1, 0.5, 0.5, 0.2, 0.2)]), boxes(spark, [("a", 1, 0.5, 0.5, 0.2, 0.2, 0.95), ("a", 2, 0.2, 0.2, 0.1, 0.1, 0.9)])
    rows = ev.class_metrics(gt, pred)
    assert ev.macro_metrics(rows).first().map50 == pytest.approx(0.995) and ev.macro_metrics(rows).first().predictions == 2
    assert ev.macro_metrics(rows, ignore_empty=False).first().map50 == pytest.approx(0.4975)


def test_sizes(spark):
    rows = [("a", 0, 0.1, 0.1, 0.1, 0.1), ("a", 0, 0.4, 0.4, 0.3, 0.3), ("a", 0, 0.5, 0.5, 0.8, 0.8)]
    got = {r["size"]: r for r in ev.size_metrics(boxes(spark, rows, (200, 200)), boxes(spark, [(*r, 0.9) for r in rows], (200, 200))).collect()}
    assert set(got) == {"small", "medium", "large"} and all((r.labels, r.predictions) == (1, 1) and r.map50 == pytest.approx(0.995) for r in got.values())


def test_suppression(spark):
    pred = boxes(spark, [("a", 0, 0.5, 0.5, 0.2, 0.2, 0.8), ("a", 0, 0.5, 0.5, 0.2, 0.2, 0.9), ("a", 1, 0.5, 0.5, 0.2, 0.2, 0.7)])
    assert {(r.class_id, r.confidence) for r in ev.suppress(pred).collect()} == {(0, 0.9), (1, 0.7)}
    assert ev.suppress(pred, None).count() == 3
    with pytest.raises(ValueError):
        ev.suppress(pred, 0)


def plain_iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_matcher_against_restatement(spark):
    """Each prediction picks its best box, then each box keeps its first prediction."""
    rng = random.Random(1)
    gt, pred = [], []
    for n in range(120):
        for side, conf in ((gt, ()), (pred, (0.5,))):
            for _ in range(rng.randrange(4)):
                side.append((f"i{n}", rng.randrange(2), 0.5 + rng.random() * 0.1, 0.5 + rng.random() * 0.1, 0.2 + rng.random() * 0.1, 0.2 + rng.random() * 0.1, *conf))
    got = {(r.image, r.g, r.p) for r in ev.match(boxes(spark, gt), boxes(spark, pred), (0.5,)).collect()}
    want = set()
    corner = lambda r: (r[2] - r[4] / 2, r[3] - r[5] / 2, r[2] + r[4] / 2, r[3] + r[5] / 2)
    for n in range(120):
        g, p = ([r for r in side if r[0] == f"i{n}"] for side in (gt, pred))
        taken = set()
        for j, q in enumerate(p):
            near = [(plain_iou(corner(b), corner(q)), i) for i, b in enumerate(g) if b[1] == q[1]]
            best = max((x for x in near if x[0] >= 0.5), default=None)
            if best and best[1] not in taken:
                taken.add(best[1])
                want.add((f"i{n}", best[1], j))
    assert got == want and got


def test_average_precision_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(12):
        n, labels = int(rng.integers(1, 60)), int(rng.integers(1, 40))
        tp = (rng.random(n) < 0.6).astype(int)
        tp[np.cumsum(tp) > labels] = 0
        conf = np.sort(rng.random(n))[::-1]
        rows += [(k, 0.5, "i", i, float(conf[i]), int(tp[i]), labels) for i in range(n)]
        c = np.cumsum(tp)
        r, p = np.concatenate(([0], c / labels, [1])), np.concatenate(([1], c / np.arange(1, n + 1), [0]))
        x = np.linspace(0, 1, 101)
        y = np.interp(x, r, np.maximum.accumulate(p[::-1])[::-1])
        want[k] = float(((y[1:] + y[:-1]) / 2 * 0.01).sum())
    df = spark.createDataFrame(rows, "class_id int, thr double, image string, p int, confidence double, hits long, n_labels int")
    labels = df.select("class_id", "n_labels").distinct()
    got = {r.class_id: r.ap for r in ev.average_precision(ev.curves(df.drop("n_labels", "thr"), labels, thresholds=(0.5,))).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_error_taxonomy_invariants(spark):
    rng = random.Random(3)
    gt, pred = [], []
    for n in range(60):
        for _ in range(rng.randrange(5)):
            gt.append((f"i{n}", rng.randrange(3), rng.random(), rng.random(), 0.2, 0.2))
            if rng.random() < 0.8:
                pred.append((f"i{n}", rng.randrange(3) if rng.random() < 0.3 else gt[-1][1], gt[-1][2] + rng.choice([0, 0.02, 0.1]), gt[-1][3], 0.2, 0.2, rng.random()))
    g, p = boxes(spark, gt), boxes(spark, pred)
    found = ev.errors(g, p).groupBy("status").count().collect()
    n = {r.status: r["count"] for r in found}
    assert n["tp"] + n["fn"] == len(gt) and n["tp"] + n["fp"] == ev.suppress(p).count()
    kinds = {r.error_type for r in ev.errors(g, p).select("error_type").distinct().collect()}
    assert kinds <= {"tp", "class_error_pred", "duplicate_prediction", "background_fp", "localisation_fp", "fn_class_error", "fn_low_iou", "fn_no_pred"}


def test_streaming_counts(spark, tmp_path):
    from tessera.streaming import incremental

    gt, place = boxes(spark, BASE), f"{tmp_path}/place"
    first, second = boxes(spark, [(*BASE[0], 0.9), (*BASE[1], 0.9)]), boxes(spark, [(*BASE[2], 0.9)])
    for part in (first, second):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        incremental.maintain_counts(spark, f"{tmp_path}/in", part.schema, gt, place)
    got = {r.class_id: (r.tp, r.fp, r.fn) for r in incremental.current_counts(spark, place).collect()}
    assert got == {0: (1, 0, 0), 1: (2, 0, 0)}


def crowd(seed, images=40, most=7, classes=3):
    """Boxes and predictions that crowd each other, with equal confidences."""
    rng = random.Random(seed)
    gt, pred = [], []
    for n in range(images):
        for _ in range(rng.randrange(most)):
            gt.append((f"i{n}", rng.randrange(classes), 0.5 + rng.randrange(12) * 0.01, 0.5, 0.2, 0.2 + rng.randrange(3) * 0.05))
            for _ in range(rng.randrange(3)):
                pred.append((f"i{n}", gt[-1][1] if rng.random() < 0.8 else rng.randrange(classes), gt[-1][2] + rng.choice([0, 0.005, 0.02, 0.05]), 0.5, 0.2, gt[-1][5], rng.randrange(1, 20) / 20))
    return gt, pred


def watch(monkeypatch):
    """Columns of the tables that evaluation writes in between, by name."""
    seen, plain = {}, ev.stored

    def stored(df, name):
        seen[name] = df.columns
        return plain(df, name)

    monkeypatch.setattr(ev, "stored", stored)
    return seen


def test_hits_of_all_thresholds_against_matches_of_each(spark):
    """One pass over the picks says the same as a matching for each threshold."""
    gt, pred = (boxes(spark, rows) for rows in crowd(4))
    got = {(r.image, r.p): r.hits for r in ev.labelled(gt, pred).collect()}
    want = dict.fromkeys(got, 0)
    for i, t in enumerate(ev.THRESHOLDS):
        alone = {(r.image, r.g, r.p) for r in ev.match(gt, pred, (t,)).collect()}
        assert alone == {(r.image, r.g, r.p) for r in ev.match(gt, pred, ev.THRESHOLDS).where(F.col("thr") == t).collect()}
        for image, _, p in alone:
            want[image, p] |= 1 << i
    assert got == want and len(set(got.values())) > 3 and len(got) == pred.count()


def test_areas_and_f1_in_one_pass_equal_those_of_the_points(spark):
    """Also where a range lies in many batches."""
    gt, pred = (boxes(spark, rows) for rows in crowd(5))
    labels = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_labels"))
    tp = ev.labelled(gt, ev.reindex(ev.suppress(pred)))
    points = ev.curves(tp, labels)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        ap, f1 = ev.summaries(tp, labels)
        got_ap, got_f1 = {(r.class_id, r.thr): r.ap for r in ap.collect()}, {r.class_id: r[1:] for r in f1.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got_ap == pytest.approx({(r.class_id, r.thr): r.ap for r in ev.average_precision(points).collect()}, abs=1e-12) and len(got_ap) == 30
    want = {r.class_id: r[1:] for r in ev.best_f1(points).collect()}
    assert got_f1.keys() == want.keys() and all(got_f1[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("metrics", [ev.class_metrics, ev.size_metrics])
def test_metrics_write_few_columns(spark, monkeypatch, metrics):
    """Tables with a row for each box hold no geometry and no column for each threshold."""
    seen = watch(monkeypatch)
    gt, pred = (boxes(spark, rows) for rows in crowd(6))
    assert metrics(gt, pred).count() == 3
    large = {k: v for k, v in seen.items() if k in ("gt", "pred", "matches", "labelled", "sized", "curve-rows", "curve-ranges", "curve-counts")}
    assert large and all(len(v) <= 7 and not {"x1", "cx", "t_1", "p_1"} & {*v} for v in large.values())


def test_curves_keep_no_counts_of_all_points(spark, monkeypatch):
    seen = watch(monkeypatch)
    gt, pred = (boxes(spark, rows) for rows in crowd(7))
    points = ev.curves(ev.labelled(gt, pred, (0.5,)), gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_labels")), thresholds=(0.5,))
    assert points.count() == pred.count() and "curve-counts" not in seen


def plain_errors(gt, pred):
    """status, error_type, g, p by image, from loops over suppressed predictions."""
    corner = lambda r: (r[2] - r[4] / 2, r[3] - r[5] / 2, r[2] + r[4] / 2, r[3] + r[5] / 2)
    out = set()
    for image in {r[0] for r in (*gt, *pred)}:
        g, p = ([r for r in side if r[0] == image] for side in (gt, pred))
        near = {(i, j): plain_iou(corner(b), corner(q)) for i, b in enumerate(g) for j, q in enumerate(p)}
        held = {}
        for j, q in enumerate(p):
            best = max(((near[i, j], i) for i, b in enumerate(g) if b[1] == q[1] and near[i, j] >= 0.5), default=None)
            if best:
                held.setdefault(best[1], j)
        for j, q in enumerate(p):
            if j in held.values():
                out.add((image, "tp", "tp", next(i for i in held if held[i] == j), j))
                continue
            v, i = max(((near[i, j], -i) for i in range(len(g)) if near[i, j] > 0), default=(0, 0))
            i = -i if g else None
            kind = "class_error_pred" if v >= 0.5 and g[i][1] != q[1] else "duplicate_prediction" if v >= 0.5 and i in held else "background_fp" if v < 0.1 else "localisation_fp"
            out.add((image, "fp", kind, i, j))
        for i, b in enumerate(g):
            if i not in held:
                v, j = max(((near[i, j], -j) for j in range(len(p)) if near[i, j] > 0), default=(0, None))
                kind = "fn_class_error" if v >= 0.5 and p[-j][1] != b[1] else "fn_low_iou" if v >= 0.1 else "fn_no_pred"
                out.add((image, "fn", kind, i, None if kind == "fn_no_pred" else -j))
    return out


def test_errors_against_loops_without_tables_in_between(spark, monkeypatch):
    seen = watch(monkeypatch)
    gt, pred = crowd(8)
    pred += [("only", 0, 0.5, 0.5, 0.1, 0.1, 0.5), ("i1", 0, 0.1, 0.1, 0.05, 0.05, 0.5)]
    rows = ev.errors(boxes(spark, gt), boxes(spark, pred), nms_iou=None)
    got = [(r.image, r.status, r.error_type, r.g, r.p) for r in rows.collect()]
    assert {*got} == plain_errors(gt, pred) and len({*got}) == len(got) and not seen
    assert rows.dtypes == [("image", "string"), ("status", "string"), ("error_type", "string"), ("g", "int"), ("g_class", "int"), ("p", "int"), ("p_class", "int"), ("iou", "double")]


def test_confusion_reads_errors_once(spark, tmp_path):
    gt, pred = (boxes(spark, rows) for rows in crowd(9))
    ev.errors(gt, pred).write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    table = ev.confusion(found)
    rows = found.where("error_type <> 'duplicate_prediction'").collect()
    twice = {(r.image, r.g, r.p): (r.p_class, r.g_class) for r in rows if r.error_type in ("class_error_pred", "fn_class_error")}
    rest = [(-1 if r.status == "fn" else r.p_class, -1 if r.status == "fp" else r.g_class) for r in rows if r.error_type not in ("class_error_pred", "fn_class_error")]
    want = {k: [*twice.values(), *rest].count(k) for k in {*twice.values(), *rest}}
    assert {(r.p_class, r.g_class): r.n for r in table.collect()} == want and twice
    assert table._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_compare_looks_for_each_best_once(spark):
    gt, pred = crowd(10, classes=2)
    rows = ev.compare(boxes(spark, gt), boxes(spark, pred), 0.5)
    corner = lambda r: (r[2] - r[4] / 2, r[3] - r[5] / 2, r[2] + r[4] / 2, r[3] + r[5] / 2)
    want = set()
    for image in {r[0] for r in (*gt, *pred)}:
        g, p = ([r for r in side if r[0] == image] for side in (gt, pred))
        used = set()
        for i, b in enumerate(g):
            v, j = max(((plain_iou(corner(b), corner(q)), -j) for j, q in enumerate(p) if q[1] == b[1] and j not in used), default=(0, 0))
            used |= {-j} if v >= 0.5 else set()
            want.add((image, "tp", i, -j) if v >= 0.5 else (image, "fn", i, None))
        want |= {(image, "fp", None, j) for j in range(len(p)) if j not in used}
    assert {(r.image, r.status, r.g, r.p) for r in rows.collect()} == want
    # Nested searches are interpreted: what stands in the plan several times is done several times.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1
