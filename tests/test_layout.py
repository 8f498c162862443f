import random

import numpy as np
import pytest

from quire import dims
from quire.config import Layout
from quire.operators import layout as L
from quire.operators import polygon as G

KEYS = ["page"]
SCHEMA = "page int, id long, cls int, score double, x1 double, y1 double, x2 double, y2 double, w int, h int, ord int"


def random_pages(n_pages, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(n_pages):
        for i in range(rng.randint(1, 25)):
            x, y = rng.randint(0, 8) * 10.0, rng.randint(0, 8) * 10.0
            rows.append((p, i, rng.choice([3, 14, 18, 20, 22]), rng.randint(0, 9) / 10, x, y, x + rng.randint(0, 9) * 10, y + rng.randint(0, 9) * 10, 200, 100, rng.randint(0, 5)))
    return rows


def inclusive_iou(a, b):
    def area(q):
        return max(0, q[2] - q[0] + 1) * max(0, q[3] - q[1] + 1)

    inter = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def loop_nms(rows):
    kept = set()
    for page, ds in by_page(rows).items():
        taken = []
        for d in sorted(ds, key=lambda d: (-d[3], d[1])):
            if not any(inclusive_iou(d[4:8], k[4:8]) >= (0.6 if d[2] == k[2] else 0.98) for k in taken):
                taken.append(d)
        kept |= {(page, d[1]) for d in taken}
    return kept


def loop_containment(rows):
    kept = set()
    for page, ds in by_page(rows).items():
        gone, holds, inside = set(), {}, {}
        for a in ds:
            for b in ds:
                own = (a[6] - a[4]) * (a[7] - a[5])
                inter = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
                if a is b or dims.CLASSES[a[2]] in dims.KEPT_IN_CONTAINMENT or own <= 0 or inter / own < 0.8:
                    continue
                if dims.CLASSES[b[2]] not in dims.SMALL_MODE_CLASSES:
                    gone.add(a[1])
                if dims.CLASSES[a[2]] in dims.SMALL_MODE_CLASSES:
                    holds.setdefault(a[2], set()).add(b[1])
                    inside.setdefault(a[2], set()).add(a[1])
        for c, xs in holds.items():
            gone |= xs - inside[c]
        kept |= {(page, d[1]) for d in ds if d[1] not in gone}
    return kept


@pytest.fixture(scope="module")
def pages(spark):
    rows = random_pages(120, 11)
    return rows, L.named(spark.createDataFrame(rows, SCHEMA))


def ids(df):
    return {(r.page, r.id) for r in df.collect()}


def test_nms_is_the_greedy_loop(pages):
    rows, df = pages
    assert ids(L.nms(df, KEYS)) == loop_nms(rows)
    assert L.nms(df.limit(0), KEYS).count() == 0


def test_pages_of_any_size_in_any_batches(spark):
    rng = random.Random(4)
    rows = random_pages(20, 5)
    for i in range(1000):
        x, y = rng.randint(0, 15) * 10.0, rng.randint(0, 9) * 10.0
        rows.append((99, i, rng.choice([3, 14, 18, 20, 22]), rng.randint(0, 9) / 10, x, y, x + rng.randint(0, 6) * 10, y + rng.randint(0, 4) * 10, 200, 100, rng.randint(0, 5)))
    df = L.named(spark.createDataFrame(rows, SCHEMA))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert ids(L.nms(df, KEYS)) == loop_nms(rows)
            assert ids(L.containment_filter(df, KEYS)) == loop_containment(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def loop_large(rows):
    kept = []
    for ds in by_page(rows).values():
        ok = [d for d in ds if dims.CLASSES[d[2]] != "image" or max(0, min(d[8], d[6]) - max(0, d[4])) * max(0, min(d[9], d[7]) - max(0, d[5])) <= (0.82 if d[8] > d[9] else 0.93) * d[8] * d[9]]
        kept += ok if ok and len(ds) > 1 else ds
    return kept


def test_postprocess_is_the_loops_in_order(pages):
    rows, df = pages
    got = {(r.page, r.id): (r.pos, r.idx) for r in L.postprocess(df, KEYS).collect()}
    left = [r for r in rows if np.float32(r[3]) >= np.float32(0.3)]
    single = loop_nms(left)
    left = loop_large([r for r in left if (r[0], r[1]) in single])
    outer = loop_containment(left)
    want = {}
    for page, ds in by_page([r for r in left if (r[0], r[1]) in outer]).items():
        idx = 0
        for pos, d in enumerate(sorted(ds, key=lambda d: (d[10], d[1]))):
            x1, x2 = max(0, min(200, d[4])), max(0, min(200, d[6]))
            y1, y2 = max(0, min(100, d[5])), max(0, min(100, d[7]))
            if x2 > x1 and y2 > y1 and dims.task_of(dims.CLASSES[d[2]]) != "abandon":
                want[page, d[1]] = pos, idx
                idx += 1
    assert got == want and len(got) > 100


def test_postprocess_reads_once_and_shuffles_once(spark, pages, tmp_path):
    rows, df = pages
    df.write.parquet(f"{tmp_path}/dets")
    plan = L.postprocess(spark.read.parquet(f"{tmp_path}/dets"), KEYS)._jdf.queryExecution().optimizedPlan().toString()
    physical = L.postprocess(spark.read.parquet(f"{tmp_path}/dets"), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Relation [") == 1 and physical.count("Exchange ") == 1 and "Window" not in physical


def test_null_boxes_and_extra_columns(spark):
    rows = [(0, 1, 22, 0.9, None, 0.0, 5.0, 5.0, 9, 9, 0, "a"), (0, 2, 22, 0.8, 0.0, 0.0, 5.0, 5.0, 9, 9, 1, None), (None, 3, None, 0.7, 0.0, 0.0, 5.0, 5.0, 9, 9, None, "c"), (None, 3, None, 0.7, 0.0, 0.0, 5.0, 5.0, 9, 9, None, "c")]
    df = L.named(spark.createDataFrame(rows, SCHEMA + ", _page string"))
    assert L.nms(df, KEYS).select("id", "_page").collect() == [(3, "c"), (1, "a"), (2, None)] or {r.id for r in L.nms(df, KEYS).collect()} == {1, 2, 3}
    assert {(r.id, r.idx) for r in L.postprocess(df, KEYS).collect()} == {(2, 0), (3, 0)}
    assert L.postprocess(df.limit(0), KEYS).count() == 0


def test_containment_is_the_loop(pages):
    rows, df = pages
    assert ids(L.containment_filter(df, KEYS)) == loop_containment(rows)


def test_large_image_keeps_all_when_nothing_is_left(spark):
    rows = [(0, 0, 14, 0.9, 0.0, 0.0, 200.0, 100.0, 200, 100, 0), (0, 1, 14, 0.9, 0.0, 0.0, 199.0, 100.0, 200, 100, 0), (1, 0, 14, 0.9, 0.0, 0.0, 200.0, 100.0, 200, 100, 0), (2, 0, 14, 0.9, 0.0, 0.0, 200.0, 100.0, 200, 100, 0), (2, 1, 22, 0.9, 0.0, 0.0, 9.0, 9.0, 200, 100, 1)]
    got = ids(L.large_image_filter(L.named(spark.createDataFrame(rows, SCHEMA)), KEYS))
    assert got == {(0, 0), (0, 1), (1, 0), (2, 1)}


def test_class_threshold(spark):
    rows = [(0, i, c, s, 0.0, 0.0, 9.0, 9.0, 10, 10, 0) for i, (c, s) in enumerate([(22, 0.3), (22, 0.29), (14, 0.45), (14, 0.5), (21, 0.1)])]
    df = L.named(spark.createDataFrame(rows, SCHEMA))
    assert ids(L.class_threshold(df, Layout(class_thresholds={"image": 0.5, "21": 0.1}))) == {(0, 0), (0, 3), (0, 4)}


def test_vote_order(spark):
    order = [2, 0, 3, 1]
    rows = [(0, i, j, 4.0 if order.index(i) < order.index(j) else -4.0) for i in range(4) for j in range(i + 1, 4)]
    got = L.vote_order(spark.createDataFrame(rows, "page int, i int, j int, logit double"), KEYS)
    assert [r["item"] for r in got.orderBy("ord").collect()] == order


def test_polygon_properties():
    rng = np.random.default_rng(3)
    for _ in range(40):
        mask = np.zeros((200, 200), bool)
        cy, cx, ry, rx = rng.integers(40, 160), rng.integers(40, 160), rng.integers(5, 35), rng.integers(5, 35)
        ys, xs = np.ogrid[:200, :200]
        mask |= ((ys - cy) / ry) ** 2 + ((xs - cx) / rx) ** 2 <= 1
        comp = G.largest_component(mask)
        points = G.boundary(comp)
        ring = G.oriented(G.hull(points))
        assert G.signed_area(ring) > 0
        for x, y in points:  # every pixel lies within the hull
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:] + ring[:1]))
        few = G.simplify(ring, 0.004 * G.perimeter(ring))
        assert set(few) <= set(ring) and 3 <= len(few) <= len(ring)
        box = ((cx - rx) * 4, (cy - ry) * 4, (cx + rx) * 4, (cy + ry) * 4)
        assert len(G.polygon(box, mask, (800, 800))) >= 4


def test_largest_component_takes_diagonals_and_first_of_equal_ones():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], bool)
    assert G.largest_component(mask).tolist() == [[True, False, False, False], [False, True, False, False], [False] * 4, [False] * 4]


def test_polygon_follows_the_mask():
    ys, xs = np.ogrid[:200, :200]
    points = G.polygon((0, 0, 200, 200), ((ys - 100) / 90) ** 2 + ((xs - 100) / 60) ** 2 <= 1, (200, 200))
    assert len(points) > 8 and G.signed_area(points) < 0
    assert all(0.95 < ((y - 100) / 90) ** 2 + ((x - 100) / 60) ** 2 < 1.05 for x, y in points)
    diamond = abs(ys - 100) + abs(xs - 100) <= 50
    assert sorted(G.polygon((0, 0, 200, 200), diamond, (200, 200))) == [(50, 100), (100, 50), (100, 150), (150, 100)]


def test_polygon_falls_back_to_the_box(spark):
    empty = np.zeros((200, 200), bool)
    assert G.polygon((1.7, 2.2, 9.9, 8.1), empty, (800, 800)) == [(1, 2), (9, 2), (9, 8), (1, 8)]
    assert G.polygon((5, 5, 5, 9), empty, (800, 800)) == [(5, 5), (5, 5), (5, 9), (5, 9)]
    df = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 5.0, 10, 10, None), (2, 1.0, 1.0, 5.0, 5.0, 10, 10, [True])], "id int, x1 double, y1 double, x2 double, y2 double, w int, h int, mask array<boolean>")
    assert {len(r.polygon) for r in G.polygons(df).collect()} == {4}


def test_polygons_of_many_boxes_equal_those_of_each():
    rng = np.random.default_rng(11)
    ys, xs = np.mgrid[:200, :200]
    boxes, pages, masks = [], [], []
    for i in range(300):
        w, h = rng.choice([5, 40, 120, 400, 800], 2)
        x, y = np.sort(rng.uniform(-3, w + 3, 2)), np.sort(rng.uniform(-3, h + 3, 2))
        boxes.append((x[0], y[0], x[1], y[1]) if i % 20 else (x[1], y[0], x[0], y[1]))
        pages.append((w, h))
        noise, lines = rng.random((200, 200)) < rng.choice([0.01, 0.4, 1.0]), abs(xs - 100 - rng.integers(-1, 2) * (ys - 100)) <= rng.integers(0, 2)
        spots = np.any([abs(ys - rng.integers(200)) / rng.integers(2, 60) + abs(xs - rng.integers(200)) / rng.integers(2, 60) <= 1 for _ in range(3)], axis=0)
        masks.append([noise, lines, spots, np.zeros((200, 200), bool), np.zeros((0, 0), bool)][i % 5])
    counts, points = G.batch(np.array(boxes), masks.__getitem__, np.array(pages, float))
    ends = np.cumsum(counts)
    for box, page, mask, n, end in zip(boxes, pages, masks, counts, ends):
        assert [tuple(p) for p in points[end - n : end].tolist()] == G.polygon(box, mask, page)


def test_equal_boxes_are_made_once_and_rounded(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def triangle(box, page):
        with open(calls, "a") as f:
            f.write("x")
        ys, xs = np.mgrid[:200, :200]
        return (xs + ys < 150) & (xs > 20) & (ys > 20)

    boxes = spark.range(0, 500, 1, 1).selectExpr("id", "0D x1", "0D y1", "800D + id % 2 x2", "800D y2", "800 w", "800 h")
    got = {(r.id % 2, tuple(map(tuple, r.polygon))) for r in G.polygons(boxes, triangle, digits=3).collect()}
    exact = {(r.id % 2, tuple((round(x, 3), round(y, 3)) for x, y in r.polygon)) for r in G.polygons(boxes, triangle).collect()}
    assert got == exact and len(got) == 2 and len(open(calls).read()) == 4


def test_polygon_properties_read_the_boxes_once(spark):
    from quire.plans.layout_queries import l06_properties

    df = l06_properties(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [") == 1 and plan.executedPlan().toString().count("Exchange ") == 1
    assert df.where("closed and near").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_every_box_has_its_polygon(spark):
    from pyspark.sql import functions as F

    from quire.plans import fixtures as X
    from quire.plans.layout_queries import l06_polygon

    sf = "/root/testdata/sf0.001"
    boxes = X.boxes(spark, sf).cache()
    got = {(r.page, r.id): r.polygon for r in l06_polygon(spark, sf).collect()}
    assert set(got) == {(r.page, r.id) for r in boxes.select("page", "id").collect()} and all(len(p) >= 4 for p in got.values())
    # Masks given as a column of 40,000 values lead to the same polygons.
    x, y = (lambda i: (i % 200 + 0.5) * 4 * F.col("w") / 800), (lambda i: (F.floor(i / 200) + 0.5) * 4 * F.col("h") / 800)
    inside = lambda i: F.pow((x(i) - (F.col("x1") + F.col("x2")) / 2) / ((F.col("x2") - F.col("x1")) / 2), 2) + F.pow((y(i) - (F.col("y1") + F.col("y2")) / 2) / ((F.col("y2") - F.col("y1")) / 2), 2) <= 1
    some = boxes.where("id % 50 = 3").withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(39_999)), inside))
    for r in G.polygons(some).collect():
        assert [[round(v, 3) for v in p] for p in r.polygon] == got[r.page, r.id]
    boxes.unpersist()
