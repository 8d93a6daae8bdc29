"""Prediction evaluation: overlap joins, suppression, matching, curves, metrics, errors.

Boxes are rows (image, ord, class_id, x1, y1, x2, y2, confidence); ``ord`` is the place in
the file after filtering.  Ties are broken in a defined way: equal overlaps prefer the later
ground-truth box, equal confidences go by image and place.

Scale: overlap joins are equi-joins on the image (and class), so work per image stays with the
image.  Suppression, matching and error types follow each other in one plan, without tables in
between: boxes that are dealt out by image once need no other shuffle.  Running counts over a
class are taken in two levels (ranges of class, confidence, image and place, then inside a range),
so that a class with a third of all predictions is no single task's window, also where all of its
confidences are equal.  What is read several times after that is written to the shared folder, in
few columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_of, iou, may_overlap
from ..store import release, stored

#: Ten thresholds, as evenly spaced doubles (the ninth is just under 0.9).
THRESHOLDS = tuple(0.5 + k * ((0.95 - 0.5) / 9) for k in range(9)) + (0.95,)
BOX = ["x1", "y1", "x2", "y2"]
EPS = 1e-16
GRID = 1000
SIZES = ("small", "medium", "large")  # fixed values


def check_iou(t: float | None) -> None:
    if t is not None and not 0 < t <= 1:
        raise ValueError("an IoU threshold must be above 0 and at most 1")


def pairs(gt: DataFrame, pred: DataFrame, same_class: bool = True, least: float = 0.0) -> DataFrame:
    """image, g, g_class, p, p_class, iou of all overlapping boxes of an image."""
    g = gt.select("image", F.col("ord").alias("g"), F.col("class_id").alias("g_class"), *[F.col(c).alias(f"g_{c}") for c in BOX])
    p = pred.select("image", F.col("ord").alias("p"), F.col("class_id").alias("p_class"), *[F.col(c).alias(f"p_{c}") for c in BOX])
    on = [g.image == p.image] + ([F.col("g_class") == F.col("p_class")] if same_class else [])
    both = g.join(p, on).select(g.image, "g", "g_class", "p", "p_class", iou(box_of("g_"), box_of("p_")).alias("iou"))
    return both.where((F.col("iou") >= least) & (F.col("iou") > 0))


def _narrow(boxes: DataFrame, *more: str) -> DataFrame:
    """Only what evaluation reads."""
    return boxes.select("image", "ord", "class_id", *BOX, *more)


def suppress(pred: DataFrame, nms_iou: float | None = 0.5) -> DataFrame:
    """Class-aware non-maximum suppression: by falling confidence (null counts as 1), a box
    goes if it overlaps one that stays by the threshold or more."""
    check_iou(nms_iou)
    if nms_iou is None:
        return pred
    rest = [c for c in pred.columns if c not in ("image", "class_id", "ord", *BOX)]
    rank = (-F.coalesce(F.col("confidence"), F.lit(1.0))).alias("rank")
    boxes = pred.groupBy("image", "class_id").agg(F.array_sort(F.collect_list(F.struct(rank, "ord", *BOX, *rest))).alias("boxes"))
    keep = lambda kept, b: F.when(F.exists(kept, lambda a: may_overlap(box_of(a), box_of(b)) & (iou(box_of(a), box_of(b)) >= nms_iou)), kept).otherwise(F.array_append(kept, b))
    kept = boxes.select("image", "class_id", F.explode(F.aggregate("boxes", F.slice("boxes", 1, 0), keep)).alias("b"))
    return kept.select("image", "class_id", "b.ord", *[f"b.{c}" for c in (*BOX, *rest)]).select(*pred.columns)


def reindex(boxes: DataFrame) -> DataFrame:
    """``ord`` becomes the place among the rows that are left."""
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy("image").orderBy("ord")) - 1)


def _picked(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """All predictions with the box of their class that they pick (g, iou, and its ``g_`` columns;
    null if none overlaps by ``least``) and ``before``, the largest overlap among earlier
    predictions that picked the same box.  A prediction holds its box at a threshold exactly if
    that is above ``before`` and at most ``iou``, so that one pass serves all thresholds."""
    more = [c for c in gt.columns if c not in ("image", "ord", "class_id")]
    g = gt.select(F.col("image").alias("g_image"), F.col("ord").alias("g"), F.col("class_id").alias("g_class"), *[F.col(c).alias(f"g_{c}") for c in more])
    p = pred.withColumnRenamed("ord", "p")
    overlap = iou(box_of("g_"), box_of(""))
    each = p.join(g, (F.col("image") == F.col("g_image")) & (F.col("class_id") == F.col("g_class")) & (overlap >= least) & (overlap > 0), "left")
    each = each.withColumn("iou", F.when(F.col("g").isNotNull(), overlap)).drop("g_image", "g_class", *BOX, *[f"g_{c}" for c in BOX])
    # With image and class among the keys both windows find the join's partitioning in place.
    pick = Window.partitionBy("image", "class_id", "p").orderBy(F.desc("iou"), F.desc("g"))
    hold = Window.partitionBy("image", "class_id", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    best = each.withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r")
    return best.withColumn("before", F.max("iou").over(hold))


def _holds(t: Column | float) -> Column:
    return (F.col("iou") >= t) & F.coalesce(F.col("before") < t, F.lit(True))


def match(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """One-to-one matches (image, class_id, thr, g, p, iou) at each threshold.

    Every prediction picks its best box of its class; every box keeps the first prediction
    that picked it; there is no second choice."""
    for t in thresholds:
        check_iou(t)
    best = _picked(_narrow(gt), _narrow(pred), min(thresholds)).where("g IS NOT NULL")
    return best.withColumn("thr", F.explode(F.filter(F.array(*map(F.lit, thresholds)), _holds))).select("image", "class_id", "thr", "g", "p", "iou")


def labelled(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, sizes: bool = False) -> DataFrame:
    """image, p, class_id, confidence, hits for each prediction: bit ``i`` of ``hits`` says
    whether it is a true positive at the threshold of that place.  ``sizes`` adds ``size``: that
    of the box which the prediction holds at any threshold, else its own."""
    for t in thresholds:
        check_iou(t)
    more = ["size"] if sizes else []
    best = _picked(_narrow(gt, *more), _narrow(pred, "confidence", *more), min(thresholds))
    hits = reduce(add, [F.when(_holds(t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds)])
    best = best.withColumn("hits", F.coalesce(hits, F.lit(0)).cast("long"))
    size = [F.coalesce(F.when(F.col("hits") > 0, F.col("g_size")), "size").alias("size")] if sizes else []
    return best.select("image", "p", "class_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "hits", *size)


def _ranges(tp: DataFrame, labels: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """The predictions whose class has labels, dealt out by ranges of their order (``slice``), and
    what each range ends with: b_n rows and b_i true positives so far, and n_labels."""
    by, index = [*by], range(len(thresholds))
    labels = stored(labels.select(*by, "n_labels"), "curve-labels")
    # Written, so that overlap joins and matching run once, and with the numbers of the ranges,
    # whose bounds would be drawn anew otherwise.
    given = tp if getattr(tp, "stored_at", None) else stored(tp, "curve-rows")
    parts = int(tp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = given.join(labels, by, "left_semi").select(*by, "image", "p", "confidence", "hits")
    rows = stored(rows.repartitionByRange(parts, *by, F.desc("confidence"), "image", "p").withColumn("slice", F.spark_partition_id()), "curve-ranges")
    if given is not tp:
        release(given)
    # A row for each range and group: no more than there are of both together.
    sums = rows.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("b_n"), *[F.sum(_bit(i)).alias(f"b_{i}") for i in index])
    upto = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    return rows, stored(sums.select(*by, "slice", *[F.sum(c).over(upto).alias(c) for c in ("b_n", *(f"b_{i}" for i in index))]).join(labels, by), "curve-ends")


def _bit(i: int) -> Column:
    return F.getbit("hits", F.lit(i)).cast("long")


def _counted(tp: DataFrame, labels: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Each row with n, n_labels and, for each place ``i`` of thresholds, t_i (true positives so
    far), p_i (precision) and e_i (largest precision from here on)."""
    by, index = [*by], range(len(thresholds))
    rows, ends = _ranges(tp, labels, by, thresholds)
    # From the last row of a range to its first: counts are what the range ends with less what
    # has been passed, and the largest precision still to come runs in the same order.
    back = Window.partitionBy(*by, "slice").orderBy("confidence", F.desc("image"), F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(ends), [*by, "slice"])
    rows = rows.withColumns({"n": F.col("b_n") + 1 - F.count(F.lit(1)).over(back)} | {f"t_{i}": F.col(f"b_{i}") + _bit(i) - F.sum(_bit(i)).over(back) for i in index})
    rows = rows.drop("b_n", *[f"b_{i}" for i in index]).withColumns({f"p_{i}": F.col(f"t_{i}") / F.col("n") for i in index})
    tops = rows.groupBy(*by, "slice").agg(*[F.max(f"p_{i}").alias(f"l_{i}") for i in index])
    after = Window.partitionBy(*by).orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    tops = stored(tops.select(*by, "slice", *[F.coalesce(F.max(f"l_{i}").over(after), F.lit(0.0)).alias(f"l_{i}") for i in index]), "curve-tops")
    rows = rows.join(F.broadcast(tops), [*by, "slice"])
    return rows.withColumns({f"e_{i}": F.greatest(F.max(f"p_{i}").over(back), F.col(f"l_{i}")) for i in index}).drop("slice", *[f"l_{i}" for i in index])


def curves(tp: DataFrame, labels: DataFrame, by: Sequence[str] = ("class_id",), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision-recall points in the order of falling confidence, for each ``by`` and thr:
    n, tp_c, fp_c, recall, precision, envelope.  ``labels``: by, n_labels (above 0).

    All thresholds share the order, so one sort serves all; rows are multiplied only at the end."""
    rows, by = _counted(tp, labels, by, thresholds), [*by]
    point = lambda i, t: F.struct(F.lit(t).alias("thr"), F.getbit("hits", F.lit(i)).cast("int").alias("tp"), F.col(f"t_{i}").alias("tp_c"), F.col(f"p_{i}").alias("precision"), F.col(f"e_{i}").alias("envelope"))
    out = rows.select(*by, "image", "p", "confidence", "n", "n_labels", F.explode(F.array(*[point(i, t) for i, t in enumerate(thresholds)])).alias("q")).select(*by, "image", "p", "confidence", "n", "n_labels", "q.*")
    return out.withColumn("fp_c", F.col("n") - F.col("tp_c")).withColumn("recall", F.col("tp_c") / (F.col("n_labels") + EPS))


#: Columns of points that rise (True) or fall with ``n``.
MONOTONE = {"recall": True, "envelope": False, "confidence": False, "tp_c": True, "n": True}


def _ends(points: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last (hi) and first (lo) point of each ``cell``.  Columns are monotone, so that the
    values at a cell's ends are its extremes, which hash aggregation finds before the shuffle."""
    up = {c: MONOTONE[c] for c in columns}
    held = points.groupBy(*key, "cell").agg(*[e for c in columns for e in ((F.max if up[c] else F.min)(c).alias(f"hi_{c}"), (F.min if up[c] else F.max)(c).alias(f"lo_{c}"))])
    pack = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in columns])
    return held.select(*key, "cell", pack("hi").alias("hi"), pack("lo").alias("lo"))


def _steps(held: DataFrame, key: Sequence[str], cells: int, forward: bool) -> DataFrame:
    """For each cell the last point up to it and the first beyond: ends of the segment that a
    grid line cuts."""
    lines = F.array(*[F.lit(k) for k in range(cells + 1)]) if cells < 200 else F.sequence(F.lit(0), F.lit(cells))
    grid = held.select(*key).distinct().withColumn("cell", F.explode(lines)).join(held, [*key, "cell"], "left")
    order = "cell" if forward else F.desc("cell")
    upto, beyond = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    grid = grid.withColumn("left", F.last("hi", True).over(upto)).withColumn("right", F.first("lo", True).over(beyond))
    return grid.where(F.col("cell") < cells)


def average_precision(points: DataFrame, by: Sequence[str] = ("class_id",)) -> DataFrame:
    """by, thr, ap: area under the envelope at 100 evenly spaced recalls, straight between
    points, from (0, 1) to (1, 0)."""
    k = F.ceil(F.col("recall") * 100).cast("int")
    # The first cell at or after the recall, in the grid's own doubles.
    cell = F.when((k - 1) * F.lit(0.01) >= F.col("recall"), k - 1).when(k * F.lit(0.01) < F.col("recall"), k + 1).otherwise(k)
    return _area(_ends(points.withColumn("cell", F.least(cell, F.lit(100))), [*by, "thr"], ["recall", "envelope"]), by)


def _area(held: DataFrame, by: Sequence[str]) -> DataFrame:
    key = [*by, "thr"]
    grid = _steps(held, key, 100, True)
    x = F.col("cell") * F.lit(0.01)
    left_r, left_m = F.coalesce("left.recall", F.lit(0.0)), F.coalesce("left.envelope", F.lit(1.0))
    right_r, right_m = F.coalesce("right.recall", F.lit(1.0)), F.coalesce("right.envelope", F.lit(0.0))
    value = left_m + (right_m - left_m) * (x - left_r) / (right_r - left_r)
    return grid.withColumn("v", value).groupBy(*key).agg((F.lit(0.01) * (F.sum("v") - F.sum(F.when(F.col("cell") == 0, F.col("v"))) / 2)).alias("ap"))


def best_f1(points: DataFrame, by: Sequence[str] = ("class_id",), within: Sequence[str] = ()) -> DataFrame:
    """by, precision, recall, f1 at the one confidence whose smoothed mean F1 is highest; the
    mean is that of all curves, or of those that share ``within`` (some of ``by``)."""
    first = points.where(F.col("thr") == THRESHOLDS[0]).withColumn("cell", F.least(F.floor(F.col("confidence") * (GRID - 1)).cast("int"), F.lit(GRID)))
    return _peak(_ends(first, by, ["confidence", "recall", "tp_c", "n"]), by, within)


def _peak(held: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    key, within = [*by], [*within]
    grid = _steps(held, key, GRID, False)
    px = F.col("cell") / F.lit(GRID - 1)

    def at(value, none: float) -> Column:
        left, right = value("left"), value("right")
        share = (F.col("left.confidence") - px) / (F.col("left.confidence") - F.col("right.confidence"))
        return F.when(F.col("left").isNull(), F.lit(none)).when(F.col("right").isNull(), left).otherwise(left + (right - left) * share)

    recall, precision = at(lambda side: F.col(f"{side}.recall"), 0.0), at(lambda side: F.col(f"{side}.tp_c") / F.col(f"{side}.n"), 1.0)
    grid = grid.select(*key, "cell", recall.alias("recall"), precision.alias("precision"))
    grid = grid.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))
    grid = stored(grid, "f1-grid")
    mean = grid.groupBy(*within, "cell").agg(F.avg("f1").alias("mean"))  # GRID rows at any scale
    line = Window.partitionBy(*within).orderBy("cell")
    near, whole = line.rowsBetween(-50, 50), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = mean.withColumns({"head": F.first("mean").over(whole), "tail": F.last("mean").over(whole)})
    smooth = mean.withColumn("smooth", (F.sum("mean").over(near) + F.greatest(F.lit(0), 50 - F.col("cell")) * F.col("head") + F.greatest(F.lit(0), F.col("cell") - (GRID - 51)) * F.col("tail")) / 101)
    best = smooth.groupBy(*within).agg(F.max_by("cell", F.struct("smooth", -F.col("cell"))).alias("cell"))
    return grid.join(best, [*within, "cell"]).select(*key, "precision", "recall", "f1")


def _in_cells(n_thresholds: int, f1_at: int | None, names: Sequence[str]):
    """For ``mapInArrow``: rows of ranges from their last to their first, each range behind a row
    that has its ``ends``.  Returns those points that are first or last of a cell within a batch;
    what lies between them is no extreme of any column.  State is a range's running counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits, state = np.arange(n_thresholds), {}

        def points(key, hits, confidence):
            if not len(hits):
                return
            one = (hits[:, None] >> bits) & 1
            passed = state["t"] + one.cumsum(axis=0)
            t, n = state["ends"][1:-1] - passed + one, state["ends"][0] - state["n"] - np.arange(len(hits))
            envelope = np.maximum(np.maximum.accumulate(t / n[:, None]), state["top"])
            state.update(t=passed[-1], n=state["n"] + len(hits), top=envelope[-1])
            recall = t / (state["ends"][-1] + EPS)
            k = np.ceil(recall * 100)
            k = np.minimum(np.where((k - 1) * 0.01 >= recall, k - 1, np.where(k * 0.01 < recall, k + 1, k)), 100).astype("int32")
            lines = [(i, i, k[:, i]) for i in range(n_thresholds)]
            if f1_at is not None:
                lines.append((None, f1_at, np.minimum(np.floor(confidence * (GRID - 1)), GRID).astype("int32")))
            for name, i, cell in lines:
                turn = np.flatnonzero(cell[1:] != cell[:-1])
                at = np.unique(np.concatenate(([0, len(cell) - 1], turn, turn + 1)))
                held = [pa.array([name] * len(at), "int32"), *map(pa.array, (cell[at], recall[at, i], envelope[at, i], confidence[at], t[at, i], n[at]))]
                yield pa.record_batch([*[pa.repeat(v, len(at)) for v in key], *held], [*names, "place", "cell", "recall", "envelope", "confidence", "tp_c", "n"])

        for batch in batches:
            ends = batch.column("ends")
            heads = np.flatnonzero(ends.is_valid().to_numpy(zero_copy_only=False))
            hits, confidence = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hits", "confidence"))
            if len(state):
                yield from points(state["key"], hits[: heads[0] if len(heads) else None], confidence[: heads[0] if len(heads) else None])
            for a, b in pairwise([*heads, len(hits)]):
                state.update(key=[batch.column(c)[int(a)] for c in names], ends=np.array(ends[int(a)].as_py().split(","), "int64"), n=0, t=np.zeros(n_thresholds, "int64"), top=np.zeros(n_thresholds))
                yield from points(state["key"], hits[a + 1 : b].astype("int64"), confidence[a + 1 : b])

    return run


def _cells(tp: DataFrame, labels: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """The ``_ends`` of all curves by thr and of the F1 grid (thr is null), from one pass over
    the ranges of ``curves``, without a row for each point and threshold."""
    by, index = [*by], range(len(thresholds))
    rows, ends = _ranges(tp, labels, by, thresholds)
    kinds = dict(rows.dtypes)
    heads = ends.select(*by, "slice", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("image", "p", "confidence")], F.lit(0).cast("long").alias("hits"), F.concat_ws(",", "b_n", *[f"b_{i}" for i in index], "n_labels").alias("ends"))
    # As text: a column of arrays that are almost all null is slow on its way to Python.
    both = rows.withColumn("ends", F.lit(None).cast("string")).unionByName(heads).withColumn("body", F.col("ends").isNull())
    both = both.repartition(*by, "slice").sortWithinPartitions(*by, "slice", "body", "confidence", F.desc("image"), F.desc("p")).select(*by, "slice", "confidence", F.col("hits").cast("long").alias("hits"), "ends")
    names = [*by, "slice"]
    kind = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", place int, cell int, recall double, envelope double, confidence double, tp_c bigint, n bigint"
    f1_at = next((i for i in index if thresholds[i] == THRESHOLDS[0]), None)
    points = stored(both.mapInArrow(_in_cells(len(thresholds), f1_at, names), kind), "curve-points")
    # The largest precision of the ranges behind.
    tops = points.where("place IS NOT NULL").groupBy(*by, "place", "slice").agg(F.max("envelope").alias("top"))
    after = Window.partitionBy(*by, "place").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    tops = tops.withColumn("top", F.max("top").over(after))
    points = points.join(tops, [*by, "place", "slice"], "left").withColumn("envelope", F.greatest("envelope", "top"))
    thr = F.get(F.array(*map(F.lit, thresholds)), F.col("place")).alias("thr")
    return stored(_ends(points.select(*by, thr, "cell", *MONOTONE), [*by, "thr"], [*MONOTONE]), "curve-cells")


def areas(tp: DataFrame, labels: DataFrame, by: Sequence[str] = ("class_id",), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``average_precision`` of the curves."""
    return _area(_cells(tp, labels, by, thresholds).where("thr IS NOT NULL"), by)


def summaries(tp: DataFrame, labels: DataFrame, by: Sequence[str] = ("class_id",), thresholds: Sequence[float] = THRESHOLDS, within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``average_precision`` and ``best_f1`` of the curves, in one pass over their points."""
    held = _cells(tp, labels, by, thresholds)
    return _area(held.where("thr IS NOT NULL"), by), _peak(held.where("thr IS NULL"), by, within)


def class_metrics(gt: DataFrame, pred: DataFrame, nms_iou: float | None = 0.5, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """class_id, images, labels, predictions, precision, recall, f1, ap50, ap75, ap.

    Classes that have no label have zero everywhere but in ``predictions``."""
    gt, pred = _narrow(gt), _narrow(pred, "confidence")
    labels = stored(gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("image").alias("images")), "labels")
    tp = stored(labelled(reindex(gt), reindex(suppress(pred, nms_iou)), thresholds), "labelled")
    ap, f1 = summaries(tp, labels, thresholds=thresholds)
    ap = ap.groupBy("class_id").agg(F.avg("ap").alias("ap"), *[F.max(F.when(F.col("thr") == thresholds[i], F.col("ap"))).alias(n) for i, n in ((0, "ap50"), (5, "ap75")) if i < len(thresholds)])
    if "ap75" not in ap.columns:
        ap = ap.withColumn("ap75", F.lit(0.0))
    count = tp.groupBy("class_id").agg(F.count(F.lit(1)).alias("predictions"))
    rows = labels.join(count, "class_id", "full").join(ap, "class_id", "left").join(f1, "class_id", "left")
    return rows.select("class_id", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("n_labels", F.lit(0)).alias("labels"), F.coalesce("predictions", F.lit(0)).alias("predictions"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "ap50", "ap75", "ap")])


def macro_metrics(classes: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """One row: means over classes with labels (or also those with predictions alone)."""
    used = classes.where("labels > 0" if ignore_empty else "labels > 0 OR predictions > 0")
    totals = classes.agg(F.sum("labels").alias("labels"), F.sum("predictions").alias("predictions"))
    means = used.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("ap50", "map50"), ("ap75", "map75"), ("ap", "map"))])
    return totals.join(F.broadcast(means)).withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def size_metrics(gt: DataFrame, pred: DataFrame, nms_iou: float | None = 0.5, thresholds: Sequence[float] = THRESHOLDS, ignore_empty: bool = True) -> DataFrame:
    """size, images, labels, predictions, precision, recall, f1, map50, map75, map, fitness for
    each size: boxes carry ``size`` (null is left out); a prediction takes the size of the box it
    matched at the lowest threshold, else its own.  Means are over the classes with labels of that
    size, or also those with predictions alone."""
    gt, pred = _narrow(gt, "size"), _narrow(pred, "confidence", "size")
    sized = gt.where("size IS NOT NULL")
    labels = stored(sized.groupBy("size", "class_id").agg(F.count(F.lit(1)).alias("n_labels")), "labels")
    tp = stored(labelled(reindex(gt), reindex(suppress(pred, nms_iou)), thresholds, sizes=True).where("size IS NOT NULL"), "sized")
    by = ["size", "class_id"]
    ap, f1 = summaries(tp, labels, by, thresholds, ["size"])
    at = lambda i: F.max(F.when(F.col("thr") == thresholds[i], F.col("ap"))) if i < len(thresholds) else F.lit(0.0)
    ap = ap.groupBy(*by).agg(F.avg("ap").alias("map"), at(0).alias("map50"), at(5).alias("map75"))
    seen = tp.groupBy(*by).agg(F.count(F.lit(1)).alias("predictions"))
    per = labels.join(seen, by, "full").join(ap, by, "left").join(f1, by, "left")
    values = ("precision", "recall", "map50", "map75", "map")
    # A class that is missing from the curves has no prediction: its values are 0.
    used = F.col("n_labels").isNotNull() if ignore_empty else F.lit(True)
    rows = per.groupBy("size").agg(F.sum("n_labels").alias("labels"), F.sum("predictions").alias("predictions"), *[F.avg(F.when(used, F.coalesce(c, F.lit(0.0)))).alias(c) for c in values])
    images = sized.groupBy("size").agg(F.count_distinct("image").alias("images"))
    rows = gt.sparkSession.createDataFrame([(s,) for s in SIZES], "size string").join(rows, "size", "left").join(images, "size", "left")
    rows = rows.fillna(0, ["images", "labels", "predictions"]).fillna(0.0, [*values])
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return rows.select("size", "images", "labels", "predictions", "precision", "recall", f1.alias("f1"), "map50", "map75", "map", (0.1 * F.col("map50") + 0.9 * F.col("map")).alias("fitness"))


def errors(gt: DataFrame, pred: DataFrame, match_iou: float = 0.5, low_iou: float = 0.1, nms_iou: float | None = 0.5) -> DataFrame:
    """One row for each match, unmatched prediction and unmatched box: image, status,
    error_type, g, g_class, p, p_class, iou."""
    check_iou(match_iou)
    # One row for each image, whose boxes are at their places in file order: a box's number is its
    # place.  All three kinds of rows come from one pass.
    side = lambda df, name: df.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", "class_id", *BOX))).alias(name))
    both = side(gt, "gs").join(side(suppress(_narrow(pred, "confidence"), nms_iou), "ps"), "image", "full")
    placed = lambda c: F.transform(c, lambda b, k: F.struct(k.alias("k"), *[b[x].alias(x) for x in ("class_id", *BOX)]))
    both = both.select("image", *[placed(F.coalesce(c, F.array().cast(f"array<{both.schema[c].dataType.elementType.simpleString()}>"))).alias(c) for c in ("gs", "ps")])

    def near(box: Column, others: Column | str) -> Column:
        """iou, order (of equal overlaps the first is largest) and class of what overlaps a box."""
        each = F.filter(others, lambda o: may_overlap(box_of(box), box_of(o)))
        each = F.transform(each, lambda o: F.struct(iou(box_of(box), box_of(o)).alias("iou"), (-o["k"]).alias("order"), o["class_id"].alias("class")))
        return F.filter(each, lambda e: e["iou"] > 0)

    def own(seen: Column, kind: Column) -> Column:
        """The box of its class that a prediction picks: of equal overlaps the last."""
        fits = F.filter(seen, lambda e: (e["iou"] >= match_iou) & (e["class"] == kind))
        return F.array_max(F.transform(fits, lambda e: F.struct(e["iou"].alias("iou"), (-e["order"]).alias("g"))))

    seen = F.transform("ps", lambda q: F.struct(q["k"].alias("p"), q["class_id"].alias("p_class"), near(q, "gs").alias("near")))
    both = both.withColumn("seen", seen)
    both = both.withColumn("seen", F.transform("seen", lambda q: F.struct(q["p"].alias("p"), q["p_class"].alias("p_class"), F.array_max(q["near"]).alias("best"), own(q["near"], q["p_class"]).alias("own"))))
    both = both.withColumn("picks", F.transform("seen", lambda q: q["own"]["g"]))
    row = lambda status, kind, g, g_class, p, p_class, overlap: F.struct(F.lit(status).alias("status"), kind.alias("error_type"), g.alias("g"), g_class.alias("g_class"), p.alias("p"), p_class.alias("p_class"), F.coalesce(overlap, F.lit(0.0)).alias("iou"))
    taken = lambda g: F.coalesce(F.array_contains("picks", g), F.lit(False))

    def predicted(q: Column) -> Column:
        own, best = q["own"], q["best"]
        # A prediction without any overlap still carries the first box of its image.
        first = F.get("gs", F.lit(0))
        g, g_class, overlap = F.coalesce(-best["order"], F.when(first.isNotNull(), F.lit(0))), F.coalesce(best["class"], first["class_id"]), F.coalesce(best["iou"], F.lit(0.0))
        close = overlap >= match_iou
        kind = F.when(close & (g_class != q["p_class"]), "class_error_pred").when(close & taken(g), "duplicate_prediction").when(overlap < low_iou, "background_fp").otherwise("localisation_fp")
        hit = own.isNotNull() & (F.array_position("picks", own["g"]) == q["p"] + 1)
        return F.when(hit, row("tp", F.lit("tp"), own["g"], q["p_class"], q["p"], q["p_class"], own["iou"])).otherwise(row("fp", kind, g, g_class, q["p"], q["p_class"], overlap))

    def missed(b: Column) -> Column:
        best, g_class = b["best"], b["g_class"]
        overlap = F.coalesce(best["iou"], F.lit(0.0))
        close = overlap >= match_iou
        kind = F.when(close & (best["class"] != g_class), "fn_class_error").when(overlap >= low_iou, "fn_low_iou").otherwise("fn_no_pred")
        some = close & (best["class"] != g_class) | (overlap >= low_iou)
        return row("fn", kind, b["g"], g_class, F.when(some, -best["order"]), F.when(some, best["class"]), overlap)

    lost = F.filter("gs", lambda b: ~taken(b["k"]))
    lost = F.transform(lost, lambda b: F.struct(b["k"].alias("g"), b["class_id"].alias("g_class"), F.array_max(near(b, "ps")).alias("best")))
    rows = F.concat(F.transform("seen", predicted), F.transform(lost, missed))
    return both.select("image", F.explode(rows).alias("r")).select("image", "r.*")


def confusion(found: DataFrame) -> DataFrame:
    """p_class, g_class, n with -1 for background.  A confusion of classes that shows up as a
    false positive and as a miss counts once."""
    kind = F.col("error_type")
    seen = kind.isin("class_error_pred", "fn_class_error")
    p = F.when(~seen & (F.col("status") == "fn"), F.lit(-1)).otherwise(F.col("p_class"))
    g = F.when(~seen & (F.col("status") == "fp"), F.lit(-1)).otherwise(F.col("g_class"))
    # One pass: what is no confusion of classes keeps all of its rows in ``n``.
    rows = found.where(kind != "duplicate_prediction").select("image", "g", "p", p.alias("p_class"), g.alias("g_class"), seen.alias("seen"))
    once = rows.groupBy("image", "g", "p", "p_class", "g_class", "seen").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("p_class", "g_class").agg(F.sum(F.when(F.col("seen"), F.lit(1)).otherwise(F.col("n"))).alias("n"))


def duplicate_labels(gt: DataFrame, least: float = 0.9) -> DataFrame:
    """image, first, second, iou, kind: pairs of an image's boxes that all but coincide."""
    two = pairs(gt, gt, same_class=False, least=least).where("g < p")
    return two.select("image", F.col("g").alias("first"), F.col("p").alias("second"), "iou", F.when(F.col("g_class") == F.col("p_class"), "same_class_duplicate").otherwise("different_class_overlap").alias("kind"))


def review_group(found: DataFrame) -> DataFrame:
    """Adds the review folder of each error row."""
    name = lambda c, none: F.when(F.col("error_type").isin(none) | F.col(c).isNull(), "background").otherwise(F.col(c).cast("string"))
    return found.where("status <> 'tp'").withColumn("review_group", F.concat(F.lit("pred_"), name("p_class", ["fn_no_pred"]), F.lit("_gt_"), name("g_class", ["background_fp"])))


def compare(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, confidence_threshold: float | None = None) -> DataFrame:
    """image, class_id, status, iou, g, p, confidence: boxes in file order each take the free
    prediction of their class that overlaps most (first of equals), if it overlaps enough.

    The order-dependent fold runs over one image and class at a time, inside Spark."""
    check_iou(iou_threshold)
    if confidence_threshold is not None:
        pred = pred.where((F.col("confidence") >= confidence_threshold) | F.col("confidence").isNull())
    sides = ["image", "class_id"]
    g = gt.groupBy(*sides).agg(F.array_sort(F.collect_list(F.struct("ord", *BOX))).alias("gs"))
    p = pred.groupBy(*sides).agg(F.array_sort(F.collect_list(F.struct("ord", *BOX, "confidence"))).alias("ps"))
    both = g.join(p, sides, "full")
    kinds = {c: f"array<{both.schema[c].dataType.elementType.simpleString()}>" for c in ("gs", "ps")}
    both = both.select(*sides, *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in kinds.items()])
    # What overlaps each box, computed once: the fold only looks for the best that is still free.
    near = F.transform("gs", lambda b: F.filter(F.transform(F.filter("ps", lambda q: may_overlap(box_of(b), box_of(q))), lambda q: F.struct(iou(box_of(b), box_of(q)).alias("iou"), (-q["ord"]).alias("order"), q["confidence"].alias("confidence"))), lambda e: e["iou"] > 0))
    both = both.select(*sides, "ps", F.arrays_zip(F.transform("gs", lambda b: b["ord"]).alias("g"), near.alias("near")).alias("gs"))

    def take(state: Column, b: Column) -> Column:
        best = F.array_max(F.filter(b["near"], lambda e: ~F.array_contains(state["used"], -e["order"])))
        # The best is bound by a lambda, so that it is looked for once.
        return F.get(F.transform(F.array(F.struct(best.alias("e"))), lambda x: taken(state, b["g"], x["e"])), F.lit(0))

    def taken(state: Column, g: Column, best: Column) -> Column:
        hit = best["iou"] >= iou_threshold
        out = F.struct(
            F.when(hit, F.lit("tp")).otherwise(F.lit("fn")).alias("status"), F.round(F.coalesce(best["iou"], F.lit(0.0)), 6).alias("iou"), g.alias("g"),
            F.when(hit, -best["order"]).alias("p"), F.when(hit, best["confidence"]).alias("confidence"),
        )
        return F.struct(F.when(hit, F.array_append(state["used"], -best["order"])).otherwise(state["used"]).alias("used"), F.array_append(state["rows"], out).alias("rows"))

    zero = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<status:string,iou:double,g:int,p:int,confidence:double>>").alias("rows"))
    folded = both.select(*sides, "ps", F.aggregate("gs", zero, take).alias("s"))
    extra = F.transform(F.filter("ps", lambda q: ~F.array_contains(F.col("s.used"), q["ord"])), lambda q: F.struct(F.lit("fp").alias("status"), F.lit(0.0).alias("iou"), F.lit(None).cast("int").alias("g"), q["ord"].alias("p"), q["confidence"].alias("confidence")))
    return folded.select(*sides, F.explode(F.concat("s.rows", extra)).alias("r")).select(*sides, "r.*")


def counts_by_class(gt: DataFrame, pred: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """class_id, tp, fp, fn by the one-to-one matcher."""
    hits = match(gt, pred, (iou_threshold,)).groupBy("class_id").agg(F.count(F.lit(1)).alias("tp"))
    g = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = pred.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_pred"))
    rows = g.join(p, "class_id", "full").join(hits, "class_id", "left").fillna(0)
    return rows.select("class_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
