"""Queries over the layout operators, with SQL written another way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.config import Layout
from quire.operators import layout as L
from quire.operators.polygon import polygons
from quire.plans import fixtures as X

P = ["page"]
LAYOUT = Layout(class_thresholds={"image": 0.5, "table": 0.2, "reference": 0.15})
BOX = ["page", "id", "cls", "score", "x1", "y1", "x2", "y2"]


def l01_shapes(spark, d):
    from quire.session import table

    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 60)).when(F.col("vec_id") % 11 > 0, F.col("embedding")).alias("logits"))
    return L.shape_errors(e, ["vec_id"], {"logits": 64})


def l02_size_mask(spark, d):
    s = X.logits(spark, d)
    w, h = F.abs(F.col("logit")) / 20, (F.col("flat") % 7) / 700
    return s.select("page", "flat", F.round(L.size_mask(F.col("logit"), w, h), 6).alias("masked"))


def l03_topk(spark, d):
    s = X.logits(spark, d).withColumn("score", F.round(L.sigmoid(F.col("logit")), 9))
    return L.top_k(s, P, 10).select("page", "query", "flat", "score", "rank")


def l04_corners(spark, d):
    b = X.boxes(spark, d)
    cx, cy = (F.col("x1") + F.col("x2")) / 2 / F.col("w"), (F.col("y1") + F.col("y2")) / 2 / F.col("h")
    bw, bh = (F.col("x2") - F.col("x1")) / F.col("w"), (F.col("y2") - F.col("y1")) / F.col("h")
    made = b.select("id", *L.corners(cx, cy, bw, bh, F.col("w"), F.col("h")))
    return made.select("id", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def l05_score_filter(spark, d):
    return L.score_filter(X.boxes(spark, d), 0.3).select(*BOX)


def l05a_class_threshold(spark, d):
    return L.class_threshold(X.boxes(spark, d), LAYOUT).select(*BOX)


def l05b_mask_bits(spark, d):
    from quire.session import table

    bits = L.mask_bits(F.col("embedding"), 0.5)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "").alias("bits"))


def l05c_vote_order(spark, d):
    return L.vote_order(X.pairs(spark, d), P).select("page", "item", F.round("votes", 5).alias("votes"), F.col("ord").cast("int").alias("ord"))


def l05d_stable_order(spark, d):
    return L.reading_sort(X.boxes(spark, d), P).select("page", "id", "pos")


def l05e_label(spark, d):
    b = X.boxes(spark, d).drop("label").withColumn("cls", F.col("cls") + F.when(F.col("id") % 11 == 0, 20).otherwise(0))
    return L.named(b).select("id", "cls", "label")


def _oval(box, page):
    """The mask of the oval within the box, on the grid of 200 x 200 cells over the page."""
    (x1, y1, x2, y2), (w, h) = box, page
    at = (np.arange(200) + 0.5) * 4
    across, down = (at * w / 800 - (x1 + x2) / 2) / ((x2 - x1) / 2), (at * h / 800 - (y1 + y2) / 2) / ((y2 - y1) / 2)
    return across**2 + (down**2)[:, None] <= 1


def _ovals(spark, d):
    """Every box with the polygon of an oval mask under it, made in the kernel, in thousandths.

    A row is small and its kernel slow, so the rows are spread before it: equal boxes over four tasks at most, as a task
    makes them once.
    """
    sides = ["x1", "y1", "x2", "y2", "w", "h"]
    return polygons(X.boxes(spark, d).select("page", "id", *sides).repartition(*sides, F.col("id") % 4), _oval, digits=3)


def l06_polygon(spark, d):
    """The polygons of `_ovals`. No SQL: a kernel, tested by its properties."""
    return _ovals(spark, d).select("page", "id", "polygon")


def l06_properties(spark, d):
    """What holds of the polygon of every oval: four corners at least, all within a mask's cell of the box, the cells' area near the oval's."""
    found = _ovals(spark, d)  # with their boxes: nothing is joined
    cw, ch = F.col("w") / 200, F.col("h") / 200
    near = F.forall("polygon", lambda p: (p[0] >= F.col("x1") - cw) & (p[0] <= F.col("x2") + cw) & (p[1] >= F.col("y1") - ch) & (p[1] <= F.col("y2") + ch))
    return found.select("page", "id", (F.size("polygon") >= 4).alias("closed"), near.alias("near"))


def l07_nms(spark, d):
    return L.nms(X.boxes(spark, d), P).select("page", "id", "cls", "score")


def l08_large_image(spark, d):
    return L.large_image_filter(X.boxes(spark, d), P).select("page", "id")


def l09_containment(spark, d):
    return L.containment_filter(X.boxes(spark, d), P).select("page", "id")


def l10_reading_order(spark, d):
    b = X.boxes(spark, d)
    return L.reading_sort(b.where("score >= 0.3"), P).select("page", "id", "ord", "pos")


def l11_unclip(spark, d):
    return L.unclip(X.boxes(spark, d), (1.2, 1.1)).select("id", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def l12_clamp(spark, d):
    shifted = X.boxes(spark, d).withColumns({"x1": F.col("x1") * 1.37 - 20, "x2": F.col("x2") * 1.37 - 20, "y1": F.col("y1") * 1.11, "y2": F.col("y2") * 1.11})
    shifted = shifted.withColumn("polygon", F.when(F.col("id") % 2 == 0, F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"))).otherwise(F.array(F.array("x1", "y1"))))
    return L.clamp(shifted).select("id", "x1", "y1", "x2", "y2", F.size("polygon").alias("points"), F.round(F.col("polygon")[2][0], 3).alias("px"))


def l13_milli_box(spark, d):
    return L.milli_box(L.clamp(X.boxes(spark, d))).select("id", "task", "bbox2d")


def l14_regions(spark, d):
    b = L.milli_box(L.clamp(X.boxes(spark, d)))
    return L.drop_abandoned(L.reading_sort(b, P), P).select("page", "id", "idx", "task")


def l15_milli_polygon(spark, d):
    b = X.boxes(spark, d)
    points = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    return b.select("id", L.milli_polygon(points, F.col("w"), F.col("h")).alias("polygon"))


def layout_postprocess(spark, d):
    """L5a to L14 in one plan."""
    return L.postprocess(X.boxes(spark, d), P, LAYOUT).select("page", "id", "idx", "task", "bbox2d")


B = "WITH RECURSIVE " + X.BOXES_SQL.strip()
_IOU = """(CASE WHEN (greatest(0, a.x2-a.x1+1)*greatest(0, a.y2-a.y1+1) + greatest(0, b.x2-b.x1+1)*greatest(0, b.y2-b.y1+1)
   - greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1)) > 0 THEN
   greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1)
   / (greatest(0, a.x2-a.x1+1)*greatest(0, a.y2-a.y1+1) + greatest(0, b.x2-b.x1+1)*greatest(0, b.y2-b.y1+1)
   - greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1)) ELSE 0 END)"""


def _nms(source: str) -> str:
    """CTEs from `source` to kept_ids: each step fixes the box of the next rank of every page."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS r FROM {source}),
clash AS (
  SELECT b.page, b.r, list(a.r) AS prior FROM ranked a JOIN ranked b ON a.page = b.page AND a.r < b.r
  WHERE {_IOU} >= CASE WHEN a.cls = b.cls THEN 0.6 ELSE 0.98 END GROUP BY b.page, b.r
), todo AS (
  SELECT page, list(struct_pack(r := r, prior := coalesce(prior, [])) ORDER BY r) AS q FROM ranked LEFT JOIN clash USING (page, r) GROUP BY page
), walk AS (
  SELECT page, q, 1 AS i, []::BIGINT[] AS kept FROM todo
  UNION ALL
  SELECT page, q, i + 1, CASE WHEN list_has_any(kept, q[i].prior) THEN kept ELSE list_append(kept, q[i].r) END FROM walk WHERE i <= len(q)
), kept_ids AS (SELECT page, unnest(kept) AS r FROM walk WHERE i = len(q) + 1)"""


def _contain(source: str) -> str:
    return f"""
edges AS (
  SELECT a.page, a.id AS l, b.id AS r, a.cls AS lc, b.cls AS rc FROM {source} a JOIN {source} b ON a.page = b.page AND a.id <> b.id
  WHERE a.label NOT IN ('image', 'seal', 'chart') AND (a.x2-a.x1)*(a.y2-a.y1) > 0
    AND greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) / ((a.x2-a.x1)*(a.y2-a.y1)) >= 0.8
), contained AS (
  SELECT * FROM {source} x WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.page = x.page AND e.l = x.id AND e.rc <> 18)
    AND NOT (EXISTS (SELECT 1 FROM edges e WHERE e.page = x.page AND e.r = x.id AND e.lc = 18)
             AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.page = x.page AND e.l = x.id AND e.lc = 18))
)"""


def _large(source: str) -> str:
    return f"""
kept AS (
  SELECT *, label <> 'image' OR greatest(0, least(w, x2) - greatest(0, x1)) * greatest(0, least(h, y2) - greatest(0, y1))
         <= CASE WHEN w > h THEN 0.82 ELSE 0.93 END * w * h AS ok FROM {source}
), fits AS (
  SELECT * EXCLUDE (ok) FROM kept k WHERE ok OR (SELECT count(*) FROM {source} s WHERE s.page = k.page) <= 1
    OR NOT (SELECT bool_or(ok) FROM kept o WHERE o.page = k.page)
)"""


_CLAMP = """clamped AS (
  SELECT * EXCLUDE (x1, y1, x2, y2), trunc(greatest(0, least(w, x1))) AS x1, trunc(greatest(0, least(h, y1))) AS y1, trunc(greatest(0, least(w, x2))) AS x2, trunc(greatest(0, least(h, y2))) AS y2
  FROM {0} WHERE greatest(0, least(w, x2)) > greatest(0, least(w, x1)) AND greatest(0, least(h, y2)) > greatest(0, least(h, y1))
)"""
_MILLI = """[least(1000, greatest(0, CAST(trunc(x1 * (1000.0::DOUBLE / w)) AS INT))), least(1000, greatest(0, CAST(trunc(y1 * (1000.0::DOUBLE / h)) AS INT))),
  least(1000, greatest(0, CAST(trunc(x2 * (1000.0::DOUBLE / w)) AS INT))), least(1000, greatest(0, CAST(trunc(y2 * (1000.0::DOUBLE / h)) AS INT)))]"""
_THRESHOLD = "score::FLOAT >= (CASE label WHEN 'image' THEN 0.5 WHEN 'table' THEN 0.2 WHEN 'reference' THEN 0.15 ELSE 0.3 END)::FLOAT"
_LOGITS = "WITH " + X.LOGITS_SQL.strip()

SQL = {
    "l01_shapes": "SELECT vec_id, 'logits must hold 64 values' AS error FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0",
    "l02_size_mask": f"{_LOGITS} SELECT page, flat, round(CASE WHEN abs(logit) / 20 > 1.0/200 AND (flat % 7) / 700.0 > 1.0/200 THEN logit ELSE -100 END, 6) AS masked FROM logits",
    "l03_topk": f"""{_LOGITS}, s AS (SELECT page, query, flat, round(1 / (1 + exp(-logit)), 9) AS score FROM logits),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, flat) - 1 AS INT) AS rank FROM s) SELECT * FROM r WHERE rank < 10""",
    "l04_corners": f"{B} SELECT id, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM boxes",
    "l05_score_filter": f"{B} SELECT {', '.join(BOX)} FROM boxes WHERE score::FLOAT >= 0.3::FLOAT",
    "l05a_class_threshold": f"{B} SELECT {', '.join(BOX)} FROM boxes WHERE {_THRESHOLD}",
    "l05b_mask_bits": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings",
    "l05c_vote_order": f"""WITH {X.PAIRS_SQL.strip()}, v AS (
      SELECT page, j AS item, 1 / (1 + exp(-logit)) AS vote FROM pairs UNION ALL SELECT page, i, 1 - 1 / (1 + exp(-logit)) FROM pairs
    ), s AS (SELECT page, item, round(sum(vote), 9) AS votes FROM v GROUP BY page, item)
    SELECT page, item, round(votes, 5) AS votes, CAST(row_number() OVER (PARTITION BY page ORDER BY votes, item) - 1 AS INT) AS ord FROM s""",
    "l05d_stable_order": f"{B} SELECT page, id, CAST((SELECT count(*) FROM boxes o WHERE o.page = b.page AND (o.ord, o.id) < (b.ord, b.id)) AS INT) AS pos FROM boxes b",
    "l05e_label": f"{B}, c AS (SELECT id, CAST(cls + CASE WHEN id % 11 = 0 THEN 20 ELSE 0 END AS INT) AS cls FROM boxes) SELECT id, cls, {X._LABEL} AS label FROM c",
    "l06_properties": f"{B} SELECT page, id, true AS closed, true AS near FROM boxes",
    "l07_nms": f"{B}, {_nms('boxes').strip()} SELECT page, id, cls, score FROM ranked JOIN kept_ids USING (page, r)",
    "l08_large_image": f"{B}, {_large('boxes').strip()} SELECT page, id FROM fits",
    "l09_containment": f"{B}, {_contain('boxes').strip()} SELECT page, id FROM contained",
    "l10_reading_order": f"{B}, s AS (SELECT * FROM boxes WHERE score >= 0.3) SELECT page, id, ord, CAST(rank() OVER (PARTITION BY page ORDER BY ord, id) - 1 AS INT) AS pos FROM s",
    "l11_unclip": f"""{B}, g AS (SELECT id, w, h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * 0.6 AS hw, (y2 - y1) * 0.55 AS hh FROM boxes)
      SELECT id, round(greatest(0, least(w, cx - hw)), 4) AS x1, round(greatest(0, least(h, cy - hh)), 4) AS y1, round(greatest(0, least(w, cx + hw)), 4) AS x2, round(greatest(0, least(h, cy + hh)), 4) AS y2 FROM g""",
    "l12_clamp": f"""{B}, s AS (SELECT * EXCLUDE (x1, y1, x2, y2), x1 * 1.37 - 20 AS x1, x2 * 1.37 - 20 AS x2, y1 * 1.11 AS y1, y2 * 1.11 AS y2, x2 * 1.37 - 20 AS raw FROM boxes), {_CLAMP.format('s')}
      SELECT id, x1, y1, x2, y2, CASE WHEN id % 2 = 0 THEN 3 ELSE 4 END AS points, CASE WHEN id % 2 = 0 THEN round(greatest(0, least(w, raw)), 3) ELSE x2 END AS px FROM clamped""",
    "l13_milli_box": f"{B}, {_CLAMP.format('boxes')} SELECT id, {X.TASK_SQL} AS task, {_MILLI} AS bbox2d FROM clamped",
    "l14_regions": f"""{B}, {_CLAMP.format('boxes')}, t AS (SELECT *, {X.TASK_SQL} AS task FROM clamped)
      SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY ord, id) - 1 AS INT) AS idx, task FROM t WHERE task <> 'abandon'""",
    "l15_milli_polygon": f"""{B} SELECT id, [[least(1000, greatest(0, CAST(trunc(x1 / w * 1000) AS INT))), least(1000, greatest(0, CAST(trunc(y1 / h * 1000) AS INT)))],
      [least(1000, greatest(0, CAST(trunc(x2 / w * 1000) AS INT))), least(1000, greatest(0, CAST(trunc(y2 / h * 1000) AS INT)))]] AS polygon FROM boxes""",
    "layout_postprocess": f"""{B}, passed AS (SELECT * FROM boxes WHERE {_THRESHOLD}), {_nms('passed').strip()}, single AS (SELECT * FROM ranked JOIN kept_ids USING (page, r)),
      {_large('single').strip()}, {_contain('fits').strip()}, {_CLAMP.format('contained')}, t AS (SELECT *, {X.TASK_SQL} AS task FROM clamped)
      SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY ord, id) - 1 AS INT) AS idx, task, {_MILLI} AS bbox2d FROM t WHERE task <> 'abandon'""",
}
QUERIES = {name: globals()[name] for name in sorted([*SQL, "l06_polygon"])}
