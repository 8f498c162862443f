import json

import pytest

from quire.operators import shred as S

TREE = S.Node("", members=(S.Node("a"), S.Node("xs", True, (S.Node("n"), S.Node("ys", True, (S.Node("v"),)))), S.Node("o", members=(S.Node("ws", True),))))


def brute(body):
    """Children by plain walking, without level sequences."""
    d = S.normalise(S.parse_body(body))
    if d is None:
        return set()
    out, pages = set(), d.get("pages", [])
    index = {}
    for p, page in enumerate(pages):
        out.add(("page", p, ""))
        for r, region in enumerate(page.get("regions", [])):
            i = S.as_text(region.get("index", r))
            out.add(("region", p, i))
            index.setdefault(p, set()).add(i)
    for f in d.get("figures", []):
        p, i = int(S.as_text(f["pageIndex"])), S.as_text(f["regionIndex"])
        out.add(("figure" if i in index.get(p, ()) else "orphan_figure", p, i))
    g = d.get("diagnostics", {})
    out |= {("warning", -1, str(i)) for i in range(len(g.get("warnings", [])))}
    for k, n in (("timingsMs", "timing"), ("metadata", "metadata")):
        out |= {(n, -1, x["key"]) for x in g.get(k, [])}
    return out


def rebuilt(cols, table):
    """Rows of a table as (ordinals, values) of one record."""
    found = S.rebuild(S._column_of(cols), TREE, table)
    values = {k: v.to_pylist() for k, v in found.values.items()}
    return [(tuple(int(o[i]) for o in found.ordinals), {k: v[i] for k, v in values.items()}) for i in range(len(found.record))]


def test_levels_of_a_leaf():
    rec = {"a": 1, "xs": [{"n": 1, "ys": [{"v": "p"}, {"v": None}]}, {"n": 2, "ys": []}, {}]}
    cols = S.shred(rec, TREE)
    levels = {path: list(zip(*c)) for path, c in cols.items()}
    assert levels[("xs", "ys", "v")] == [(0, 3, "p"), (2, 2, None), (1, 1, None), (1, 1, None)]
    assert levels[("xs", "n")] == [(0, 2, 1), (1, 2, 2), (1, 1, None)]
    assert levels[("o", "ws")] == [(0, 0, None)]
    assert rebuilt(cols, ("xs",)) == [((0,), {"n": "1"}), ((1,), {"n": "2"}), ((2,), {"n": None})]
    assert rebuilt(cols, ("xs", "ys")) == [((0, 0), {"v": "p"}), ((0, 1), {"v": None})]


def test_levels_over_records():
    import random

    rng = random.Random(2)

    def some(n, make):
        return rng.choice([None, [make() for _ in range(rng.randint(0, n))]])

    for _ in range(100):
        recs = [{"xs": some(4, lambda: rng.choice([None, {"n": rng.randint(0, 9), "ys": some(3, lambda: {"v": rng.choice([None, "q"])})}])), "o": rng.choice([None, {"ws": some(3, lambda: "w")}])} for _ in range(5)]
        cols = None
        for r in recs:
            cols = S.shred(r, TREE, cols)
        column = S._column_of(cols)
        found = S.rebuild(column, TREE, ("xs", "ys"))
        want = [(i, x, y, v["v"]) for i, r in enumerate(recs) for x, e in enumerate(r["xs"] or []) for y, v in enumerate((e or {}).get("ys") or [])]
        assert list(zip(found.record.tolist(), found.ordinals[0].tolist(), found.ordinals[1].tolist(), found.values["v"].to_pylist())) == want
        found = S.rebuild(column, TREE, ("o", "ws"))
        assert list(zip(found.record.tolist(), found.ordinals[0].tolist())) == [(i, k) for i, r in enumerate(recs) for k in range(len((r["o"] or {}).get("ws") or []))]


@pytest.mark.parametrize("rec", [{}, {"xs": []}, {"xs": None}, {"o": {"ws": ["", None]}}, {"xs": [None, {"ys": [None]}]}])
def test_shapes_do_not_crash(rec):
    cols = S.shred(rec, TREE)
    assert len(rebuilt(cols, ("xs",))) == len(rec.get("xs") or [])
    assert len(rebuilt(cols, ("o", "ws"))) == len((rec.get("o") or {}).get("ws") or [])


def test_packaging_of_any_depth():
    doc = {"pages": [{"regions": [{"index": 0}]}]}
    body = json.dumps(doc)
    for _ in range(9):
        body = json.dumps(body)
    wrapped = doc
    for i in range(7):
        wrapped = {f"envelope{i}": wrapped, "other": {"x": 1}}
    for b in (body, json.dumps(wrapped), json.dumps({"a": doc, "b": {"x": 1}}), json.dumps({"b": {"schemaVersion": 1}, "a": {"payload": json.dumps(doc)}}), json.dumps({"schemaVersion": 1, "body": doc})):
        assert brute(b) == {("page", 0, ""), ("region", 0, "0")}, b
    deep = '{"pages": [{"regions": [{"index": 0, "content": ' + "[" * 30_000 + "]" * 30_000 + "}]}]}"
    assert brute(deep) == {("page", 0, ""), ("region", 0, "0")}
    content = S.normalise(S.parse_body(deep))["pages"][0]["regions"][0]["content"]
    assert S.as_text(content) == "[" * 30_000 + "]" * 30_000
    assert S._dumps({"a": [1, {"b": None}]}) == '{"a": [1, {"b": null}]}'


def test_numbers_that_are_no_index(spark):
    figures = [{"pageIndex": i, "regionIndex": 0} for i in (1e12, 0.7, "0.0", 0, None, "x", 2**31)]
    body = json.dumps({"pages": [{"regions": [{"index": 0}]}], "figures": figures})
    df = spark.createDataFrame([(1, body)], "sidecar_id long, body string")
    got = sorted(tuple(r) for r in S.sidecar_children(df).where("child like '%figure'").collect())
    assert got == [(1, "figure", 0, "0")]
    table = {r.position: (r.page_index, r.orphan) for r in S.sidecar_tables(df)["figure"].collect()}
    assert table == {0: (None, True), 1: (None, True), 2: (0, False), 3: (0, False), 4: (None, True), 5: (None, True), 6: (None, True)}


def test_tables_against_plain_walk(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/sidecars.parquet")
    stored = S.levels(rows, ["sidecar_id"], "body")
    stored.write.parquet(f"{tmp_path}/levels")
    table = S.table_of(spark.read.parquet(f"{tmp_path}/levels"), ["sidecar_id"], ("pages", "regions"))
    assert "pages__regions__bbox2D" in table._jdf.queryExecution().executedPlan().toString()
    assert "diagnostics" not in table._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.sidecar_id, *r.ordinals, r.label, r.content) for r in table.collect())
    want = []
    for r in rows.collect():
        d = S.normalise(S.parse_body(r.body)) or {}
        want += [(r.sidecar_id, p, i, S.as_text(x.get("label")), S.as_text(x.get("content"))) for p, page in enumerate(d.get("pages", [])) for i, x in enumerate(page.get("regions", []))]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_bodies():
    doc = {"pages": [{"regions": [{"index": 0}, {"index": "7"}]}, []], "figures": {"page_index": 0.0, "region_index": 7}, "diagnostics": {"timings_ms": {"a": None}, "warnings": ["x"]}}
    plain = json.dumps(doc)
    want = {("page", 0, ""), ("page", 1, ""), ("region", 0, "0"), ("region", 0, "7"), ("figure", 0, "7"), ("timing", -1, "a"), ("warning", -1, "0")}
    for body in (plain, "﻿" + plain, json.dumps(plain), json.dumps({"document": doc, "exportedBy": "x"})):
        assert brute(body) == want
    for body in (None, "", " \n", plain[:-1], "null", "[]", "3"):
        assert brute(body) == set()


def test_children_against_plain_walk(spark):
    from pyspark.sql import Row

    bodies = {r.sidecar_id: r.body for r in spark.read.parquet("/root/testdata/sf0.001/sidecars.parquet").collect()}
    df = spark.createDataFrame([Row(sidecar_id=i, body=b, child="clash", ordinals=1) for i, b in bodies.items()] * 2)
    got = {(r.sidecar_id, r.child, r.page_index, r.item) for r in S.sidecar_children(df).collect()}
    assert got == {(i, *x) for i, b in bodies.items() for x in brute(b)}
    assert len(got) == S.sidecar_children(df).count()
    assert S.sidecar_children(df.limit(0)).count() == 0
    figures = S.sidecar_tables(df)["figure"]
    assert figures.where("orphan").select("sidecar_id", "page_index", "region_index").distinct().count() == len({x for x in got if x[1] == "orphan_figure"})
