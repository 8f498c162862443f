import itertools
import random

import numpy as np

from quire.operators.diff import assign, diff_copies, latest_version


def test_assignment_is_of_minimum_cost():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 4, (n, m))
        pairs = assign(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(len(c))) for p in itertools.permutations(range(c.shape[1]), len(c)))
        assert sum(cost[i, j] for i, j in pairs) == best


def rows(df):
    return sorted((r["k"], r["status"], tuple(r["diffs"])) for r in df.collect())


def test_multiset_nulls_and_clashing_names(spark):
    schema = "k int, net string, sign string, extra int"
    left = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 2), (1, "b", "y", 3), (2, None, "", 4), (3, "q", "q", 5)], schema)
    right = spark.createDataFrame([(1, "a", "x", 9), (1, "c", "y", 9), (1, "a", "z", 9), (2, None, None, 9), (4, "q", "q", 9)], schema)
    got = rows(diff_copies(left, right, ["k"], ["net", "sign"]))
    assert got == [(1, "changed", ("net",)), (1, "changed", ("sign",)), (2, "changed", ("sign",)), (3, "only_left", ()), (4, "only_right", ())]
    assert rows(diff_copies(left, left.union(left), ["k"], ["net", "sign"], multiset=False)) == []
    assert len(rows(diff_copies(left, left.union(left), ["k"], ["net", "sign"]))) == left.count()
    assert rows(diff_copies(left.limit(0), right.limit(0), ["k"], ["net", "sign"])) == []
    assert len(rows(diff_copies(left, right.limit(0), ["k"], ["net", "sign"]))) == left.count()


def test_hot_key_in_blocks_keeps_counts(spark):
    rng = random.Random(3)
    left = [(1, str(rng.random()), "s", i) for i in range(500)]
    right = [(1, a, "t", i) for _, a, _, i in left[:300]]
    schema = "k int, a string, b string, c int"
    got = rows(diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ["a", "b", "c"], block=16))
    assert sum(s == "changed" for _, s, _ in got) == 300 and sum(s == "only_left" for _, s, _ in got) == 200


def test_hot_key_pairs_rows_that_differ_in_few_fields(spark):
    rng = random.Random(3)
    left = [(1, str(rng.random()), "s", i) for i in range(500)] + [(1, "twice", "s", -1)] * 2
    right = [(1, a, "t", i) for _, a, _, i in left[:200]] + [(1, a, "t", i + 1000) for _, a, _, i in left[200:300]] + [(1, "twice", "u", -1)]
    schema = "k int, a string, b string, c int"
    got = rows(diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ["a", "b", "c"], block=16))
    assert [got.count((1, s, d)) for s, d in (("changed", ("b",)), ("changed", ("b", "c")), ("only_left", ()))] == [201, 100, 201] and len(got) == 502


def test_latest_version(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (2, None, "d"), (None, 1, "e"), (1, 7, "b")], "k int, v int, rank string")
    got = {(r.k, r.v, r["rank"]) for r in latest_version(df, ["k"], ["v"]).collect()}
    assert got == {(1, 7, "b"), (2, None, "d"), (None, 1, "e")}


def test_digests_tell_values_apart(spark):
    schema = "k int, a array<string>, b struct<x:string,y:int>, c string, d array<int>"
    left = spark.createDataFrame([(1, ["p", None], ("q", 1), "", [1, 2]), (2, None, None, None, None), (3, [], ("q", None), "z", [None])], schema)
    right = spark.createDataFrame([(1, [None, "p"], ("q", 1), None, [1, 2]), (2, None, None, None, None), (3, [None], (None, None), "z", [])], schema)
    got = rows(diff_copies(left, right, ["k"], ["a", "b", "c", "d"]))
    assert got == [(1, "changed", ("a", "c")), (3, "changed", ("a", "b", "d"))]


def test_pages_against_all_assignments(spark):
    """p5_copies over whole tables: as many pairs as the shorter side has, at the least number of differing fields."""
    from collections import Counter, defaultdict

    from quire.plans.problems import p5_copies

    sf = "/root/testdata/sf0.001"
    fields = ["scan_id", "page_index", "region_index", "content", "bbox_2d", "label"]
    sides = []
    for name in ("regions", "regions_mirror"):
        by = defaultdict(Counter)
        for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*fields).collect():
            by[r[0], r[1]][r[2], r[3], tuple(r[4]) if r[4] is not None else None, r[5]] += 1
        sides.append(by)
    want = {}
    for key in {*sides[0], *sides[1]}:
        a, b = list((sides[0][key] - sides[1][key]).elements()), list((sides[1][key] - sides[0][key]).elements())
        if len(a) > len(b):
            a, b = b, a
        # Least costs of the first rows of the shorter side for each set of rows of the longer one.
        best = {0: 0}
        for x in a:
            step = {}
            for used, c in best.items():
                for j, y in enumerate(b):
                    if not used >> j & 1:
                        v = c + sum(p != q for p, q in zip(x, y))
                        at = used | 1 << j
                        step[at] = min(v, step.get(at, v))
            best = step
        if a or b:
            want[key] = len(a), len(b) - len(a), min(best.values())
    got = defaultdict(lambda: [0, 0, 0])
    for r in p5_copies(spark, sf).collect():
        changed = r.status == "changed"
        got[r.scan_id, r.page_index][0 if changed else 1] += r["rows"]
        got[r.scan_id, r.page_index][2] += r["rows"] * len(r.diffs)
    assert {k: tuple(v) for k, v in got.items()} == want and max(v[0] for v in want.values()) > 1


def test_pairing_of_any_size_is_of_minimum_cost(spark):
    """Keys below and above the size that blocks once began at, with repeats and nulls, against one assignment of the whole key."""
    rng = random.Random(11)
    sides = []
    for more in (1.0, 0.6):
        sides.append([(k, *[rng.choice([None, *range(v)]) for v in (40, 25, 12, 5)]) for k, n in ((1, 757), (2, 300), (3, 9), (4, 2), (None, 40)) for _ in range(int(n * more))])
    schema = "k int, a int, b int, c int, d int"
    left, right = (spark.createDataFrame(s, schema) for s in sides)
    got = [(r["k"], r["status"], len(r["diffs"])) for r in diff_copies(left, right, ["k"], ["a", "b", "c", "d"]).collect()]
    assert sorted(got, key=str) == sorted(((r["k"], r["status"], len(r["diffs"])) for r in diff_copies(left.orderBy("d", "a"), right.orderBy("c"), ["k"], ["a", "b", "c", "d"]).collect()), key=str)
    for key in (1, 2, 3, 4, None):
        a, b = (itertools.chain.from_iterable([row] * n for row, n in side.items()) for side in _rest(*[[r[1:] for r in s if r[0] == key] for s in sides]))
        a, b = list(a), list(b)
        cost = np.array([[sum(p != q for p, q in zip(x, y)) for y in b] for x in a]).reshape(len(a), len(b))
        best = sum(cost[i, j] for i, j in assign(cost)) if a and b else 0
        mine = [(s, n) for k, s, n in got if k == key]
        assert (sum(n for _, n in mine), sum(s == "changed" for s, _ in mine), len(mine)) == (best, min(len(a), len(b)), max(len(a), len(b)))


def _rest(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return a - b, b - a


def test_many_fields_and_one(spark):
    rng = random.Random(5)
    names = [f"c{i}" for i in range(9)]
    sides = [[(1, *[rng.randrange(3) for _ in names]) for _ in range(n)] for n in (30, 25)]
    schema = "k int, " + ", ".join(f"{c} int" for c in names)
    got = diff_copies(*[spark.createDataFrame(s, schema) for s in sides], ["k"], names).collect()
    cost = np.array([[sum(p != q for p, q in zip(x, y)) for y in sides[1]] for x in sides[0]])
    assert sum(len(r["diffs"]) for r in got) == sum(cost[i, j] for i, j in assign(cost))
    got = rows(diff_copies(*[spark.createDataFrame(s, schema) for s in sides], ["k"], ["c0"]))
    a, b = (sum(n.values()) for n in _rest(*[[r[1] for r in s] for s in sides]))
    assert [got.count((1, s, d)) for s, d in (("changed", ("c0",)), ("only_left", ()), ("only_right", ()))] == [min(a, b), a - min(a, b), b - min(a, b)]


def test_a_row_repeated_often_takes_no_rows_of_its_own(spark):
    left = spark.range(120_000).selectExpr("1 k", "'x' a", "'s' b").union(spark.range(30_000).selectExpr("2 k", "'x' a", "'s' b"))
    right = spark.range(50_000).selectExpr("1 k", "'x' a", "'t' b")
    got = {(r["k"], r["status"], tuple(r["diffs"])): r["count"] for r in diff_copies(left, right, ["k"], ["a", "b"]).groupBy("k", "status", "diffs").count().collect()}
    assert got == {(1, "changed", ("b",)): 50_000, (1, "only_left", ()): 70_000, (2, "only_left", ()): 30_000}
