"""From a mask to the polygon of its largest component, as one kernel over Arrow batches.

Per row: crop the mask to the box, scale it to the box's pixels, take the largest 8-connected
component, its convex hull, simplify it, keep its convex corners. Any step that degenerates gives the
box itself. `polygon` takes one box, step by step; `batch` takes many and gives the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

EPSILON, SHARP, SHARP_TOLERANCE = 0.004, 45.0, 1.0
MODEL_SIDE = 800.0
#: Boxes whose polygons are made at once, and polygons that a task remembers.
BLOCK, KNOWN = 256, 65_536
Point = tuple[float, float]


def half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1))


def rectangle(box: tuple[float, float, float, float]) -> list[Point]:
    x1, y1, x2, y2 = (float(int(v)) for v in box)
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def crop(mask: np.ndarray, box: tuple[int, int, int, int], page: tuple[float, float]) -> np.ndarray:
    """The part of the mask under the box; the mask covers the page at a quarter of the model's resolution."""
    mh, mw = mask.shape
    sx, sy = MODEL_SIDE / max(1.0, page[0]) / 4.0, MODEL_SIDE / max(1.0, page[1]) / 4.0
    xs = [min(mw, max(0, half_away(v * sx))) for v in (box[0], box[2])]
    ys = [min(mh, max(0, half_away(v * sy))) for v in (box[1], box[3])]
    return mask[ys[0] : max(ys), xs[0] : max(xs)]


def resize(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    """Nearest neighbours."""
    ys = np.minimum(mask.shape[0] - 1, np.arange(h) * mask.shape[0] // h)
    xs = np.minimum(mask.shape[1] - 1, np.arange(w) * mask.shape[1] // w)
    return mask[np.ix_(ys, xs)]


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected component, the one met first in reading order of equal ones.

    Runs of a row are joined with those they touch in the row above (union-find over runs).
    """
    parent: list[int] = []
    size: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(runs)
            runs.append((y, a, b))
            parent.append(i)
            size.append(b - a)
            here.append(i)
            for j in above:
                _, c, d = runs[j]
                if c <= b and a <= d:  # diagonal neighbours touch
                    r, s = sorted((root(i), root(j)))
                    if r != s:
                        parent[s] = r
                        size[r] += size[s]
        above = here
    out = np.zeros(mask.shape, bool)
    if runs:
        best = max((i for i in range(len(runs)) if parent[i] == i), key=lambda i: (size[i], -i))
        for i, (y, a, b) in enumerate(runs):
            if root(i) == best:
                out[y, a:b] = True
    return out


def boundary(component: np.ndarray) -> list[tuple[int, int]]:
    """L6d: (x, y) of pixels with a neighbour outside, sorted."""
    p = np.pad(component, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    ys, xs = np.nonzero(component & ~inner)
    return sorted(zip(xs.tolist(), ys.tolist()))


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """L6e: convex hull without collinear points, by monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(run: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def signed_area(points: list[Point]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1])) / 2


def oriented(points: list[Point]) -> list[Point]:
    """L6f: the direction of a positive area."""
    return points[::-1] if signed_area(points) < 0 else points


def perimeter(points: list[Point]) -> float:
    """L6g."""
    return sum(math.dist(a, b) for a, b in zip(points, points[1:] + points[:1]))


def simplify(points: list[Point], epsilon: float) -> list[Point]:
    """L6h: Ramer-Douglas-Peucker on the closed line, with a stack of stretches instead of recursion."""
    if len(points) <= 3:
        return points
    line = np.array([*points, points[0]], float)
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        between = line[a + 1 : b] - line[a]
        length = math.hypot(*d)
        away = np.hypot(between[:, 0], between[:, 1]) if length == 0 else np.abs(d[1] * between[:, 0] - d[0] * between[:, 1]) / length
        k = int(np.argmax(away))
        if away[k] > epsilon:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    out = [points[i % len(points)] for i in sorted(keep)[:-1]]
    return out if len(out) >= 3 else points


def _corner(p: Point, c: Point, n: Point) -> Point | None:
    v, w = (p[0] - c[0], p[1] - c[1]), (n[0] - c[0], n[1] - c[1])
    a, b = math.hypot(*v), math.hypot(*w)
    if v[1] * w[0] - v[0] * w[1] >= 0 or not a or not b:
        return None
    angle = math.degrees(math.acos(max(-1.0, min(1.0, (v[0] * w[0] + v[1] * w[1]) / (a * b)))))
    dx, dy = v[0] / a + w[0] / b, v[1] / a + w[1] / b
    norm = math.hypot(dx, dy)
    if abs(angle - SHARP) < SHARP_TOLERANCE and norm:
        return c[0] + dx / norm * (a + b) / 2, c[1] + dy / norm * (a + b) / 2
    return float(c[0]), float(c[1])


def corners(points: list[Point]) -> list[Point]:
    """L6i: convex vertices; one of about 45 degrees moves along its bisector by the mean length of its edges."""
    found = (_corner(p, c, n) for p, c, n in zip(points[-1:] + points[:-1], points, points[1:] + points[:1]))
    return [c for c in found if c is not None]


def polygon(box: tuple[float, float, float, float], mask: np.ndarray, page: tuple[float, float]) -> list[Point]:
    """The mask's polygon in page pixels; L6j: the box where any step degenerates."""
    x1, y1, x2, y2 = (int(v) for v in box)
    if x2 <= x1 or y2 <= y1 or mask.size == 0:
        return rectangle(box)
    part = crop(mask, (x1, y1, x2, y2), page)
    if part.size == 0:
        return rectangle(box)
    outline = hull(boundary(largest_component(resize(part, x2 - x1, y2 - y1))))
    if len(outline) < 3:
        return rectangle(box)
    outline = oriented(outline)[::-1]  # convex corners count as such where the area is negative
    found = corners(simplify(outline, EPSILON * perimeter(outline)))
    if len(found) < 4:
        return rectangle(box)
    return [(x + x1, y + y1) for x, y in found]


def _starts(cells: np.ndarray, pixels: np.ndarray, most: int) -> np.ndarray:
    """For each row, the pixel that each of its cells begins at under L6b; cells without a pixel are as wide as none."""
    edges = np.arange(most + 1)
    return np.where(edges <= cells[:, None], -(-edges * pixels[:, None] // np.maximum(cells[:, None], 1)), pixels[:, None])


def _largest(runs: list[tuple[int, int, int]], weights: list[int]) -> list[bool]:
    """Of a mask's runs (row, start, end) in reading order, those of its largest component; L6c on runs."""
    parent, size = list(range(len(runs))), list(weights)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    j = 0
    for i, (y, a, b) in enumerate(runs):
        # Runs that end before this one begins touch none of its row's later ones.
        while runs[j][0] < y - 1 or (runs[j][0] == y - 1 and runs[j][2] < a):
            j += 1
        k = j
        while runs[k][0] == y - 1 and runs[k][1] <= b:  # diagonal neighbours touch
            r, s = sorted((root(i), root(k)))
            if r != s:
                parent[s] = r
                size[r] += size[s]
            k += 1
    best = max((i for i in range(len(runs)) if parent[i] == i), key=lambda i: (size[i], -i))
    return [root(i) == best for i in range(len(runs))]


def _simplified(x: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray, epsilon: np.ndarray) -> np.ndarray:
    """L6h on many rings (from `first`, `n` points each): whether each point is kept. All stretches of a depth are cut at once."""
    keep = np.zeros(len(x), bool)
    keep[first] = True
    ring = np.flatnonzero(n > 3)
    a, b = first[ring], first[ring] + n[ring]  # b is past the ring: its first point again
    while len(ring):
        inside = b - a - 1
        ring, a, b, inside = (v[inside > 0] for v in (ring, a, b, inside))
        if not len(ring):
            break
        till = np.cumsum(inside)
        which = np.repeat(np.arange(len(ring)), inside)
        at = np.arange(till[-1]) - np.repeat(till - inside, inside) + np.repeat(a, inside) + 1
        end = np.where(b == first[ring] + n[ring], first[ring], b)
        dx, dy = x[end] - x[a], y[end] - y[a]
        bx, by = x[at] - x[a][which], y[at] - y[a][which]
        length = np.sqrt(dx * dx + dy * dy)
        away = np.where(length[which] == 0, np.hypot(bx, by), np.abs(dy[which] * bx - dx[which] * by) / np.where(length == 0, 1, length)[which])
        most = np.maximum.reduceat(away, till - inside)
        cut = np.minimum.reduceat(np.where(away == most[which], at, len(x)), till - inside)
        far = most > epsilon[ring]
        ring, a, b, cut = (v[far] for v in (ring, a, b, cut))
        keep[cut] = True
        ring, a, b = np.concatenate((ring, ring)), np.concatenate((a, cut)), np.concatenate((cut, b))
    few = np.add.reduceat(keep, first, dtype=int) < 3 if len(first) else np.zeros(0, bool)
    return keep | np.repeat(few | (n <= 3), n)


def _ring(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of points sorted by box: where each box's points begin and how many they are; each point's predecessor and successor on its ring."""
    first = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else np.zeros(0, int)
    n = np.diff(np.append(first, len(b)))
    before, after = np.arange(len(b)) - 1, np.arange(len(b)) + 1
    before[first], after[first + n - 1] = first + n - 1, first
    return first, n, before, after


def batch(boxes: np.ndarray, mask: Callable[[int], np.ndarray], pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`polygon` of many boxes: how many points each has, and all points as rows of x and y. mask gives a box's mask by its place.

    Masks stay in cells, whose runs are scaled to pixels. The hull of a component is that of the ends of its rows;
    points that lie within their neighbours on a side go, for all boxes at once, until none does.
    """
    whole = boxes.astype(np.int64)
    wide, high = whole[:, 2] - whole[:, 0], whole[:, 3] - whole[:, 1]
    parts: list[np.ndarray] = [np.zeros((0, 0), bool)] * len(boxes)
    for i in np.flatnonzero((wide > 0) & (high > 0)).tolist():
        m = mask(i)
        if m.size:
            part = crop(m, tuple(whole[i].tolist()), tuple(pages[i].tolist()))
            if part.size:  # cells that no pixel takes go, as they would in pixels
                parts[i] = resize(part, min(part.shape[1], int(wide[i])), min(part.shape[0], int(high[i])))
    shape = np.array([p.shape for p in parts]).reshape(-1, 2)
    tall, across = (int(v) for v in shape.max(axis=0, initial=0))
    grid = np.zeros((len(boxes), tall, across + 2), bool)
    for i, p in enumerate(parts):
        if p.size:
            grid[i, : p.shape[0], 1 : p.shape[1] + 1] = p
    edge = np.flatnonzero(grid[:, :, 1:] != grid[:, :, :-1])
    row, at = np.divmod(edge, across + 1)
    box, y = np.divmod(row[::2], max(tall, 1))
    a, b = at[::2], at[1::2]
    col, line = _starts(shape[:, 1], wide, across), _starts(shape[:, 0], high, tall)

    # Masks of one run a row that touches the one above have one component.
    same = np.diff(box, prepend=-1) == 0
    joined = same & (np.diff(y, prepend=-9) == 1) & (a <= np.roll(b, 1)) & (np.roll(a, 1) <= b)
    keep = np.ones(len(box), bool)
    weight = (col[box, b] - col[box, a]) * (line[box, y + 1] - line[box, y])
    for i in np.unique(box[same & ~joined]).tolist():
        lo, hi = np.searchsorted(box, (i, i + 1))
        keep[lo:hi] = _largest(list(zip(y[lo:hi].tolist(), a[lo:hi].tolist(), b[lo:hi].tolist())), weight[lo:hi].tolist())
    box, y, a, b = (v[keep] for v in (box, y, a, b))
    head = (np.diff(box, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0)
    tail = np.append(head[1:], True)[: len(head)]
    box, y, a, b = box[head], y[head], a[head], b[tail]

    # Down the right side, up the left one.
    left, right, top, low = col[box, a], col[box, b] - 1, line[box, y], line[box, y + 1] - 1
    down, up = box * 4 * (tall + 1) + 2 * y, box * 4 * (tall + 1) + 4 * tall - 2 * y
    order = np.argsort(np.concatenate((down, down + 1, up, up - 1)))
    pb, px, py = (v[order] for v in (np.tile(box, 4), np.concatenate((right, right, left, left)), np.concatenate((top, low, top, low))))
    side = np.repeat([0, 0, 1, 1], len(box))[order]
    twice = (np.diff(pb, prepend=-1) == 0) & (np.diff(side, prepend=-1) == 0) & (np.diff(py, prepend=-1) == 0)
    pb, px, py, side = (v[~twice] for v in (pb, px, py, side))
    while len(pb):
        end = (np.diff(pb, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0)
        end |= np.append(end[1:], True)
        x0, y0, x2, y2 = np.roll(px, 1), np.roll(py, 1), np.roll(px, -1), np.roll(py, -1)
        stay = end | ((px - x0) * (y2 - py) - (py - y0) * (x2 - px) > 0)
        if stay.all():
            break
        pb, px, py, side = (v[stay] for v in (pb, px, py, side))
    before = _ring(pb)[2]
    new = (px != px[before]) | (py != py[before])
    pb, px, py = pb[new], px[new], py[new]
    first, n, _, _ = _ring(pb)
    solid = np.repeat(n >= 3, n)
    pb, px, py = pb[solid], px[solid], py[solid]

    # As in `polygon`: against the direction of a positive area, up to the first point by x and y.
    first, n, _, _ = _ring(pb)
    at = np.lexsort((py, px, pb))[first] if len(first) else first
    own = np.repeat(np.arange(len(first)), n)
    turned = first[own] + (at[own] - 1 - np.arange(len(pb))) % n[own]
    px, py = px[turned], py[turned]
    _, _, _, after = _ring(pb)
    lengths = np.sqrt((px - px[after]) ** 2 + (py - py[after]) ** 2)
    around = np.array([math.fsum(lengths[i : i + k].tolist()) for i, k in zip(first.tolist(), n.tolist())])
    stay = _simplified(px, py, first, n, EPSILON * around)
    pb, px, py = pb[stay], px[stay], py[stay]

    _, _, before, after = _ring(pb)
    vx, vy, wx, wy = px[before] - px, py[before] - py, px[after] - px, py[after] - py
    p, q = np.sqrt(vx * vx + vy * vy), np.sqrt(wx * wx + wy * wy)
    convex = (vy * wx - vx * wy < 0) & (p > 0) & (q > 0)
    near = np.abs(np.degrees(np.arccos(np.clip((vx * wx + vy * wy) / np.where(convex, p * q, 1), -1, 1))) - SHARP) < 2 * SHARP_TOLERANCE
    fx, fy = px.astype(float), py.astype(float)
    for i in np.flatnonzero(convex & near).tolist():
        three = [(int(px[k]), int(py[k])) for k in (before[i], i, after[i])]
        fx[i], fy[i] = _corner(*three)
    pb, fx, fy = pb[convex], fx[convex] + whole[pb[convex], 0], fy[convex] + whole[pb[convex], 1]

    counts = np.bincount(pb, minlength=len(boxes))
    flat = np.flatnonzero(counts < 4)
    good = counts[pb] >= 4
    corner = np.array([rectangle(tuple(boxes[i])) for i in flat]).reshape(-1, 2)
    points = np.concatenate((np.stack((fx[good], fy[good]), axis=1), corner))
    counts[flat] = 4
    return counts, points[np.argsort(np.concatenate((pb[good], np.repeat(flat, 4))), kind="stable")]


def _rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimals, as Spark's round."""
    out, unit = v.copy(), Decimal(1).scaleb(-digits)
    for at in zip(*np.nonzero(v != np.floor(v))):
        out[at] = float(Decimal(repr(float(v[at]))).quantize(unit, ROUND_HALF_UP))
    return out


def polygons(dets: DataFrame, mask: str | Callable[[tuple[float, ...], tuple[float, float]], np.ndarray] = "mask", side: int = 200, digits: int | None = None) -> DataFrame:
    """Adds `polygon` to detections with a box, the page's size and a flat square mask of booleans.

    mask is the column's name, or makes the square mask of a box and a page's size within the kernel, so that no
    column holds it; it depends on nothing else, and is called once for equal boxes of equal pages that meet in a
    task. A null or wrongly sized mask gives the box. With digits, points are rounded half up. Only the needed columns go to Python.
    """
    named = isinstance(mask, str)

    def made(boxes: np.ndarray, pages: np.ndarray, own: Callable[[int], np.ndarray]) -> pa.Array:
        sizes, points = [], []
        for k in range(0, len(boxes), BLOCK):
            n, p = batch(boxes[k : k + BLOCK], lambda i, k=k: square(own(k + i)), pages[k : k + BLOCK])
            sizes.append(n)
            points.append(p if digits is None else _rounded(p, digits))
        values = np.concatenate([np.zeros((0, 2)), *points])
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(values) + 1, 2, dtype=np.int32)), pa.array(values.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *sizes]).cumsum().astype(np.int32)), pairs)

    def square(m) -> np.ndarray:
        flat = np.zeros(0, bool) if m is None else np.asarray(m, bool).ravel()
        return flat.reshape(side, side) if flat.size == side * side else np.zeros((0, 0), bool)

    def given(x: pa.Scalar) -> np.ndarray | None:
        return x.values.to_numpy(zero_copy_only=False) if x.is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        store = made(np.zeros((0, 4)), np.zeros((0, 2)), lambda i: None)
        for rows in batches:
            values = np.stack([rows[c].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2", "w", "h")], axis=1)
            if np.isnan(values[:, :4]).any():
                raise ValueError("a box without a side")
            if named:
                column = rows[mask]
                out = made(values[:, :4], values[:, 4:], lambda i, column=column: given(column[i]))
                rows = rows.drop_columns([mask])
            else:
                some, back = np.unique(values, axis=0, return_inverse=True)
                if len(known) + len(some) > KNOWN:
                    known, store = {}, store[:0]
                keys = [v.tobytes() for v in some]
                new = some[np.array([k not in known for k in keys], bool)]
                make = lambda i, new=new: mask(tuple(new[i, :4].tolist()), tuple(new[i, 4:].tolist()))
                store = pa.concat_arrays([store, made(new[:, :4], new[:, 4:], make)])
                for v in new:
                    known[v.tobytes()] = len(known)
                out = store.take(pa.array(np.array([known[k] for k in keys], np.int64)[back.ravel()]))
            yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, "polygon"])

    kept = dets.drop("polygon")
    fields = [f for f in kept.schema if not named or f.name != mask]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType())))]))
