"""Layout decoding and post-processing: scoring, ranking, overlap suppression, containment, reading order.

Every operator takes a DataFrame of detections and the names of the columns that identify a page
(`keys`), and gives a DataFrame. Detections have `id` (their position in the page's list), `cls`,
`label`, `score`, box corners x1, y1, x2, y2 in pixels, and the page's size w, h where it is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import dims
from quire.config import Layout


#: The shapes a layout model gives per page: queries by classes, boxes, pairwise order, masks.
SHAPES = {"logits": 300 * 25, "boxes": 300 * 4, "order": 300 * 300, "masks": 300 * 200 * 200}


def shape_errors(preds: DataFrame, keys: Sequence[str], shapes: dict[str, int] = SHAPES) -> DataFrame:
    """L1: (keys, error) for each flat array that isn't of its shape, null ones included."""
    checks = [F.when(~F.coalesce(F.size(c) == n, F.lit(False)), F.lit(f"{c} must hold {n} values")) for c, n in shapes.items()]
    return preds.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("error"))


def class_names(config: dict[int, str] | None, model: dict[int, str] | None) -> dict[int, str]:
    """L5f: names of classes from the options, else from the model, else the built-in ones."""
    return config or model or dict(enumerate(dims.CLASSES))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def size_mask(logit: Column, w: Column, h: Column, mask_w: int = 200, mask_h: int = 200) -> Column:
    """L2: the logit, or -100 where the box is no larger than a mask cell either way."""
    return F.when((w > 1.0 / mask_w) & (h > 1.0 / mask_h), logit).otherwise(F.lit(-100.0))


def top_k(scores: DataFrame, keys: Sequence[str], k: int | Column, score: str = "score", flat: str = "flat") -> DataFrame:
    """L3, M4: the k best rows of a page by score, ties by flat index, with their `rank` from 0.

    Spark cuts each task's rows of a page to k before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(flat)))
    return scores.withColumn("rank", rank - 1).where(F.col("rank") < k)


def corners(cx: Column, cy: Column, bw: Column, bh: Column, w: Column, h: Column) -> list[Column]:
    """L4: centre, width and height in 0 to 1 to corners in pixels."""
    return [
        ((cx - bw / 2) * w).alias("x1"),
        ((cy - bh / 2) * h).alias("y1"),
        ((cx + bw / 2) * w).alias("x2"),
        ((cy + bh / 2) * h).alias("y2"),
    ]


def score_filter(dets: DataFrame, threshold: float) -> DataFrame:
    """Single precision on both sides, as scores are produced."""
    return dets.where(F.col("score").cast("float") >= F.lit(threshold).cast("float"))


def class_threshold(dets: DataFrame, layout: Layout) -> DataFrame:
    """The least threshold first, then each class's own."""
    own = F
    for i, _ in enumerate(dims.CLASSES):
        own = own.when(F.col("cls") == i, F.lit(layout.threshold_of(i)))
    own = own.otherwise(F.lit(layout.threshold)).cast("float")
    return score_filter(dets, layout.pre_threshold).where(F.col("score").cast("float") >= own)


def mask_bits(mask: Column, threshold: float) -> Column:
    """A mask of logits as bits."""
    return F.transform(mask, lambda x: sigmoid(x) > F.lit(threshold))


def vote_order(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reading order from pairwise logits (i, j, logit) with i < j.

    logit speaks for i before j, so j gains its sigmoid and i the rest. Items are ranked by votes
    ascending, ties by index; votes are rounded to 9 digits so that sums in another order agree.
    """
    p = sigmoid(F.col("logit"))
    sides = F.array(F.struct(F.col("j").alias("item"), p.alias("vote")), F.struct(F.col("i").alias("item"), (1 - p).alias("vote")))
    votes = pairs.select(*keys, F.explode(sides).alias("v")).groupBy(*keys, F.col("v.item").alias("item")).agg(F.round(F.sum("v.vote"), 9).alias("votes"))
    return votes.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("votes", "item")) - 1)


def named(dets: DataFrame, cls: str = "cls") -> DataFrame:
    """L5e: label of a class id, class_<id> where it is unknown."""
    label = F
    for i, name in enumerate(dims.CLASSES):
        label = label.when(F.col(cls) == i, F.lit(name))
    return dets.withColumn("label", label.otherwise(F.concat(F.lit("class_"), F.col(cls).cast("string"))))


#: Rows of a page's matrix of overlaps that are held at once.
ROWS = 512


def _suppressed(box: np.ndarray, cls: np.ndarray, layout: Layout) -> np.ndarray:
    """L7 on the boxes of a page in order of score: which are kept."""
    n = len(box)
    x1, y1, x2, y2 = box.T
    area = np.maximum(0.0, x2 - x1 + 1) * np.maximum(0.0, y2 - y1 + 1)
    keep = np.ones(n, bool)
    for a in range(0, n, ROWS):
        at = slice(a, a + ROWS)
        w = np.maximum(0.0, np.minimum(x2[at, None], x2[None, a:]) - np.maximum(x1[at, None], x1[None, a:]) + 1)
        h = np.maximum(0.0, np.minimum(y2[at, None], y2[None, a:]) - np.maximum(y1[at, None], y1[None, a:]) + 1)
        both = w * h
        union = area[at, None] + area[None, a:] - both
        share = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        clash = share >= np.where(cls[at, None] == cls[None, a:], layout.same_class_iou, layout.cross_class_iou)
        for i in np.flatnonzero(np.triu(clash, 1).any(1)).tolist():
            if keep[a + i]:
                keep[a + i + 1 :] &= ~clash[i, i + 1 :]
    return keep


def _not_too_large(box: np.ndarray, image: np.ndarray, w: np.ndarray, h: np.ndarray, layout: Layout) -> np.ndarray:
    """L8 on the boxes of a page."""
    if len(box) <= 1:
        return np.ones(len(box), bool)
    iw = np.maximum(0.0, np.minimum(w, box[:, 2]) - np.maximum(0.0, box[:, 0]))
    ih = np.maximum(0.0, np.minimum(h, box[:, 3]) - np.maximum(0.0, box[:, 1]))
    keep = ~image | ~(iw * ih > np.where(w > h, layout.large_image_landscape, layout.large_image_other) * w * h)
    return keep if keep.any() else ~keep


def _modes(layout: Layout) -> dict[str, list[int]]:
    """Class ids by mode."""
    modes = [layout.merge_modes.get(c, "small" if c in dims.SMALL_MODE_CLASSES else "large") for c in dims.CLASSES]
    return {m: [i for i, x in enumerate(modes) if x == m] for m in ("small", "large")}


def _not_contained(box: np.ndarray, cls: np.ndarray, kept: np.ndarray, layout: Layout) -> np.ndarray:
    """L9 on the boxes of a page; kept marks labels that no box takes away."""
    n, modes = len(box), _modes(layout)
    x1, y1, x2, y2 = box.T
    own = (x2 - x1) * (y2 - y1)
    large, gone, inside = np.isin(cls, modes["large"]), np.zeros(n, bool), np.zeros(n, bool)
    holds = {c: np.zeros(n, bool) for c in modes["small"] if (cls == c).any()}
    for a in range(0, n, ROWS):
        at = slice(a, a + ROWS)
        iw = np.maximum(0.0, np.minimum(x2[at, None], x2[None]) - np.maximum(x1[at, None], x1[None]))
        ih = np.maximum(0.0, np.minimum(y2[at, None], y2[None]) - np.maximum(y1[at, None], y1[None]))
        able = (own[at] > 0) & ~kept[at]
        edge = np.divide(iw * ih, own[at, None], out=np.zeros_like(iw), where=able[:, None]) >= layout.containment
        edge &= able[:, None]
        edge[np.arange(len(edge)), np.arange(a, a + len(edge))] = False
        gone[at] |= (edge & large[None]).any(1)
        inside[at] = edge.any(1)
        for c, held in holds.items():
            held |= edge[cls[at] == c].any(0)
    for c, held in holds.items():
        gone |= held & ~((cls == c) & inside)
    return ~gone


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where values are, nulls included."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def on_pages(dets: DataFrame, keys: Sequence[str], layout: Layout, steps: Sequence[str], live: Column | None = None) -> DataFrame:
    """The steps nms, large and contained, in this order, on whole pages: one exchange on the page and one kernel.

    Rows come by page, score and id; the kernel takes a page's boxes as arrays and hands the rows it keeps on
    as they are, whatever else they hold. A matrix of overlaps is held ROWS rows at a time, so a page may have
    any number of detections. With `live`, rows kept get their `pos` in reading order, and those of them that
    live `idx`, dense from 0, in that order. A box with a null or NaN corner overlaps none.
    """
    flagged = dets if live is None else dets.withColumn("_live", live)
    together = flagged.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), F.asc("id"))
    counted = live is not None
    given = [f for f in flagged.schema if f.name != "_live"]
    schema = T.StructType([*given] if not counted else [*given, T.StructField("pos", T.IntegerType()), T.StructField("idx", T.IntegerType())])

    def numbered(table: pa.Table, page: np.ndarray, kept: np.ndarray) -> tuple[pa.Table, list[pa.Array]]:
        table, page = table.take(pa.array(kept)), page[kept]
        order = pc.sort_indices(table.select(["ord", "id"]).append_column("_page", pa.array(page)), sort_keys=[("_page", "ascending"), ("ord", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        table, page = table.take(pa.array(order)), page[order]
        first = np.searchsorted(page, page)
        lives = table.column("_live").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(lives)))
        idx = np.where(lives, before[:-1] - before[first], 0)
        return table, [pa.array(np.arange(len(page)) - first, pa.int32()), pa.array(idx, pa.int32(), mask=~lives)]

    def settle(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        box = np.stack([_numbers(table, c) for c in ("x1", "y1", "x2", "y2")], 1)
        cls = table.column("cls").cast(pa.int64()).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        if "large" in steps:
            w, h = _numbers(table, "w"), _numbers(table, "h")
        if "large" in steps or "contained" in steps:
            label = table.column("label").combine_chunks()
            image = pc.equal(label, "image").fill_null(False).to_numpy(zero_copy_only=False)
            fixed = pc.is_in(label, pa.array(dims.KEPT_IN_CONTAINMENT, label.type)).to_numpy(zero_copy_only=False)
        found, page = [], np.zeros(len(table), np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(table)])):
            page[a:b] = k
            at = np.arange(a, b)
            with np.errstate(invalid="ignore"):
                if "nms" in steps:
                    at = at[_suppressed(box[at], cls[at], layout)]
                if "large" in steps:
                    at = at[_not_too_large(box[at], image[at], w[at], h[at], layout)]
                if "contained" in steps:
                    at = at[_not_contained(box[at], cls[at], fixed[at], layout)]
            found.append(at)
        kept = np.concatenate(found)
        if not counted:
            table, more = table.take(pa.array(kept)), []
        else:
            table, more = numbered(table, page, kept)
        columns = [table.column(f.name).combine_chunks() for f in given] + more
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the page that the last batch ended in
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            probe = table if not held else pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table])
            change = np.zeros(len(probe) - 1, bool)
            for key in keys:
                codes = _codes(probe.column(key))
                change |= codes[1:] != codes[:-1]
            # Where pages begin among the rows of the batch.
            begins = np.flatnonzero(change) + (0 if held else 1)
            if not len(begins):
                held.append(table)
                continue
            cut = int(begins[-1])
            size = sum(map(len, held))
            whole = pa.concat_tables([*held, table.slice(0, cut)])
            if len(whole):
                starts = np.unique(np.concatenate(([0], begins[:-1] + size)))
                yield settle(whole, starts)
            held = [table.slice(cut)]
        if held:
            yield settle(pa.concat_tables(held), np.array([0]))

    return together.mapInArrow(run, schema)


def nms(dets: DataFrame, keys: Sequence[str], layout: Layout = Layout()) -> DataFrame:
    """Greedy suppression in order of score, ties by id.

    A box goes where one kept before it on its page overlaps it by `same_class_iou` within a class or
    `cross_class_iou` across classes, areas with their border pixels.
    """
    return on_pages(dets, keys, layout, ["nms"])


def large_image_filter(dets: DataFrame, keys: Sequence[str], layout: Layout = Layout()) -> DataFrame:
    """Images that nearly fill a page go, unless that leaves nothing or there is one detection only."""
    page = Window.partitionBy(*keys)
    iw = F.greatest(F.lit(0.0), F.least(F.col("w"), F.col("x2")) - F.greatest(F.lit(0.0), F.col("x1")))
    ih = F.greatest(F.lit(0.0), F.least(F.col("h"), F.col("y2")) - F.greatest(F.lit(0.0), F.col("y1")))
    limit = F.when(F.col("w") > F.col("h"), F.lit(layout.large_image_landscape)).otherwise(F.lit(layout.large_image_other))
    keep = (F.col("label") != "image") | (iw * ih <= limit * F.col("w") * F.col("h"))
    marked = dets.withColumn("_keep", keep).withColumn("_n", F.count("*").over(page)).withColumn("_any", F.max("_keep").over(page))
    return marked.where((F.col("_n") <= 1) | F.col("_keep") | ~F.col("_any")).drop("_keep", "_n", "_any")


def containment_filter(dets: DataFrame, keys: Sequence[str], layout: Layout = Layout()) -> DataFrame:
    """Boxes that lie in others go, by the mode of the outer box's class.

    An edge l -> r says that the share `containment` of l lies in r; images, seals and charts have
    none. Where r's class has mode large, l goes. Where l's class has mode small, r goes unless it is of
    that class and lies in a box itself.
    """
    return on_pages(dets, keys, layout, ["contained"])


def reading_sort(dets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L5d, L10: `pos` by reading order, ties by prior position."""
    return dets.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "id")) - 1)


def _unclipped(ratio: tuple[float, float]) -> dict[str, Column]:
    rx, ry = max(1.0, ratio[0]), max(1.0, ratio[1])
    out = {}
    for a, b, size, r in (("x1", "x2", "w", rx), ("y1", "y2", "h", ry)):
        mid, half = (F.col(a) + F.col(b)) * 0.5, (F.col(b) - F.col(a)) * r * 0.5
        edge = F.greatest(F.lit(1.0), F.col(size).cast("double"))
        out[a] = F.greatest(F.lit(0.0), F.least(edge, mid - half))
        out[b] = F.greatest(F.lit(0.0), F.least(edge, mid + half))
    return out


def unclip(dets: DataFrame, ratio: tuple[float, float]) -> DataFrame:
    """Grow boxes about their centre by ratios of at least 1, within the page."""
    return dets.withColumns(_unclipped(ratio))


def _within(box: dict[str, Column]) -> dict[str, Column]:
    """Corners within the page."""
    return {c: F.greatest(F.lit(0.0), F.least(F.col(s).cast("double"), box[c])) for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))}


def _there(box: dict[str, Column]) -> Column:
    return (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def clamp(dets: DataFrame) -> DataFrame:
    """Boxes within the page in whole pixels; empty ones go; a polygon of less than three points becomes the box."""
    whole = _within({c: F.col(c) for c in ("x1", "y1", "x2", "y2")})
    out = dets.withColumns(whole).where(_there({c: F.col(c) for c in whole}))
    out = out.withColumns({c: F.col(c).cast("int").cast("double") for c in whole})
    if "polygon" in dets.columns:
        rect = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
        inside = F.transform("polygon", lambda p: F.array(F.greatest(F.lit(0.0), F.least(F.col("w").cast("double"), p[0])), F.greatest(F.lit(0.0), F.least(F.col("h").cast("double"), p[1]))))
        out = out.withColumn("polygon", F.when(F.size("polygon") >= 3, inside).otherwise(rect))
    return out


def milli_box(dets: DataFrame) -> DataFrame:
    """The box in thousandths of the page, truncated and kept within 0 to 1000, and the task of the label."""
    def cell(c: str, size: str) -> Column:
        return F.least(F.lit(1000), F.greatest(F.lit(0), (F.col(c) * (F.lit(1000.0) / F.col(size))).cast("int")))

    return dets.withColumn("bbox2d", F.array(cell("x1", "w"), cell("y1", "h"), cell("x2", "w"), cell("y2", "h"))).withColumn("task", dims.task_column(F.col("label")))


def milli_polygon(points: Column, w: Column, h: Column) -> Column:
    """Polygon points in thousandths: divided first and then scaled, which may truncate otherwise than a box."""
    def cell(v: Column, size: Column) -> Column:
        return F.least(F.lit(1000), F.greatest(F.lit(0), (v / size * 1000).cast("int")))

    return F.transform(points, lambda p: F.array(cell(p[0], w), cell(p[1], h)))


def drop_abandoned(dets: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Regions that are not recognised at all go, the rest are numbered densely as `idx`."""
    return dets.where("task <> 'abandon'").withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1)


def postprocess(dets: DataFrame, keys: Sequence[str], layout: Layout = Layout()) -> DataFrame:
    """L5a to L14 in order: column expressions around one exchange on the page and one kernel (see on_pages).

    Which boxes are empty once clamped, or abandoned, depends on their row alone, so the kernel numbers the
    regions and no second exchange is needed.
    """
    live = _there(_within(_unclipped(layout.unclip))) & (dims.task_column(F.col("label")) != "abandon")
    steps = (["nms"] if layout.nms else []) + ["large", "contained"]
    kept = on_pages(class_threshold(dets, layout), keys, layout, steps, live).where("idx is not null")
    return milli_box(clamp(unclip(kept, layout.unclip)))
