"""Nested JSON records as flat related tables, by columnar shredding.

A record is shredded into one column per leaf path of a tree of repeated and optional members.
Each column holds (repetition level, definition level, value): the repetition level says which
repeated ancestor a value continues, the definition level how many optional or repeated members
on its path are there. Every table of a repeated member is then rebuilt from the level sequences
of its leaves alone: a row begins where the repetition level is at most the member's own, exists
where the definition level reaches the member, and its ordinals count those beginnings, which
gives each child the key of its record and the position of each ancestor.

Columns run over all records of an Arrow batch, so that rebuilding is arithmetic on whole arrays of
levels. `levels` gives them as a DataFrame with an array of levels per leaf, which can be stored, and of
which a table reads its own leaves only.
"""

from __future__ import annotations

import json
import re
import sys
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import use_checkpoints

#: (repetition levels, definition levels, values) of one leaf column.
Levels = tuple[list[int], list[int], list[Any]]


@dataclass(frozen=True)
class Node:
    """A member: its name, whether it repeats, and its members. A node without members is a leaf."""

    name: str
    repeated: bool = False
    members: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Leaf:
    """A leaf path and its nodes, each of which adds a definition level."""

    path: tuple[str, ...]
    nodes: tuple[Node, ...]


@lru_cache(64)
def leaves(root: Node) -> tuple[Leaf, ...]:
    """All leaf paths under the root, in order."""

    def walk(node: Node, above: tuple[Node, ...]) -> Iterator[Leaf]:
        for m in node.members:
            chain = (*above, m)
            if m.members:
                yield from walk(m, chain)
            else:
                yield Leaf(tuple(n.name for n in chain), chain)

    return tuple(walk(root, ()))


def shred(record: Any, root: Node, columns: dict[tuple[str, ...], Levels] | None = None) -> dict[tuple[str, ...], Levels]:
    """Adds a record to the level sequences of every leaf path. A missing or null member ends a path at the level reached."""
    columns = {leaf.path: ([], [], []) for leaf in leaves(root)} if columns is None else columns

    def put(path: tuple[str, ...], rep: int, level: int, value: Any) -> None:
        reps, defs, values = columns[path]
        reps.append(rep)
        defs.append(level)
        values.append(value)

    def absent(node: Node, path: tuple[str, ...], rep: int, level: int) -> None:
        if not node.members:
            put(path, rep, level, None)
        for m in node.members:
            absent(m, (*path, m.name), rep, level)

    def walk(node: Node, path: tuple[str, ...], value: Any, rep: int, level: int, depth: int) -> None:
        """value is there (level counts it); depth is the number of repeated nodes down to here."""
        if not node.members:
            put(path, rep, level, value)
        for m in node.members:
            sub, below = (*path, m.name), value.get(m.name) if isinstance(value, dict) else None
            if m.repeated:
                items = below if isinstance(below, list) else []
                if not items:
                    absent(m, sub, rep, level)
                for i, x in enumerate(items):
                    at = rep if i == 0 else depth + 1
                    if x is None and m.members:  # a null object is there, but holds nothing
                        walk(m, sub, {}, at, level + 1, depth + 1)
                    else:
                        walk(m, sub, x, at, level + 1, depth + 1)
            elif below is None:
                absent(m, sub, rep, level)
            else:
                walk(m, sub, below, rep, level + 1, depth)

    walk(root, (), record, 0, 0, 0)
    return columns


@dataclass
class Rows:
    """Rows of a table: the number of each one's record, its ordinals from the outermost repeated ancestor to itself, its values by leaf."""

    record: np.ndarray
    ordinals: list[np.ndarray]
    values: dict[str, pa.Array]


@lru_cache(256)
def _under(root: Node, table: tuple[str, ...]) -> tuple[int, int, tuple[tuple[str, tuple[str, ...]], ...], tuple[str, ...]]:
    """(repetition and definition level of a table, its leaves that don't repeat below it by name, the first leaf of all)."""
    found = [x for x in leaves(root) if x.path[: len(table)] == table]
    chain = found[0].nodes[: len(table)]
    flat = [(".".join(x.path[len(table) :]) or "value", x.path) for x in found if not any(n.repeated for n in x.nodes[len(table) :])]
    return sum(n.repeated for n in chain), len(chain), tuple(flat), found[0].path


def rebuild(column: Callable[[tuple[str, ...]], tuple[np.ndarray, np.ndarray, pa.Array]], root: Node, table: tuple[str, ...]) -> Rows:
    """Rows of the repeated member at path `table` from the level sequences of its leaves.

    column gives the repetition levels, definition levels and values of a leaf path over all records, each of
    which begins with repetition level 0. Values are the leaves under the member that don't repeat below it.
    """
    own_rep, own_def, flat, first = _under(root, table)
    reps, defs, _ = column(first)
    record = np.cumsum(reps == 0) - 1
    mine = reps <= own_rep
    reps, there, record = reps[mine], defs[mine] >= own_def, record[mine]
    ordinals = []
    for k in range(1, own_rep + 1):
        # Counts the steps of level k since an entry of a lower level began anew.
        steps = np.cumsum(reps == k)
        ordinals.append((steps - np.maximum.accumulate(np.where(reps < k, steps, 0)))[there])
    values = {}
    for name, path in flat:
        r, d, v = column(path)
        values[name] = v.filter(pa.array((r <= own_rep) & (d >= own_def)))
    return Rows(record[there], ordinals, values)


# --- sidecar bodies ---------------------------------------------------------------------------

_PAIR = (Node("key"), Node("value"))

#: The tree of a bundle sidecar. A map is a repeated pair of key and value.
SIDECAR = Node(
    "",
    members=(
        Node("schemaVersion"),
        Node("markdownPath"),
        Node("figuresDirectory"),
        Node("pages", True, (Node("regions", True, (Node("index"), Node("label"), Node("content"), Node("bbox2D"))),)),
        Node(
            "figures",
            True,
            tuple(Node(n) for n in ("pageIndex", "regionIndex", "label", "bbox2D", "altText", "fileName", "relativePath", "widthPX", "heightPX", "mimeType", "sha256")),
        ),
        Node("diagnostics", False, (Node("warnings", True), Node("timingsMs", True, _PAIR), Node("metadata", True, _PAIR))),
    ),
)

#: Repeated members with their own table, and the table's name.
SIDECAR_TABLES = {
    ("pages",): "page",
    ("pages", "regions"): "region",
    ("figures",): "figure",
    ("diagnostics", "warnings"): "warning",
    ("diagnostics", "timingsMs"): "timing",
    ("diagnostics", "metadata"): "metadata",
}


def _key(name: str) -> str:
    """Spelling-free form of a member's name: bbox_2d, bbox2D and BBox-2d are one."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _loads(text: str) -> Any:
    """json.loads for nesting of any depth: beyond the C scanner's limit the scanner in Python goes on."""
    try:
        return json.loads(text)
    except RecursionError:
        decoder = json.JSONDecoder()
        decoder.parse_string = json.decoder.py_scanstring
        decoder.scan_once = json.scanner.py_make_scanner(decoder)
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 1000 + 4 * (text.count("[") + text.count("{"))))
        try:
            return decoder.decode(text)
        finally:
            sys.setrecursionlimit(before)


def parse_body(body: str | None) -> Any:
    """The JSON value of a body, without byte order mark and outer packaging as a JSON string, however often.

    None for null, empty, blank or incomplete bodies, and for those that aren't an object in the end.
    """
    while body is not None:
        body = body.strip("\ufeff \t\r\n")
        try:
            value = _loads(body) if body else None
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        body = value
    return None


def normalise(value: Any, root: Node = SIDECAR) -> dict | None:
    """The record in the tree's own spelling, whatever the exporter's nesting.

    Unwraps envelopes: of all objects reached through object members alone, at any depth, the one with the most
    known members that hold something is the record, the outermost and first of equal ones. Takes a single
    object for a list of one, a bare list of regions for a page, and a map for a list of pairs.
    """
    if not isinstance(value, dict):
        return None
    known = {_key(m.name): bool(m.members) or m.repeated for m in root.members}

    def score(v: dict) -> tuple[int, int]:
        met = [(known[k], x) for k, x in ((_key(k), x) for k, x in v.items()) if k in known]
        return sum(nested and isinstance(x, (list, dict)) for nested, x in met), len(met)

    best, best_score, queue = value, score(value), deque([value])
    while queue and not best_score[0]:
        inner = queue.popleft()
        for v in inner.values():
            if isinstance(v, str) and v.lstrip()[:1] == "{":
                v = parse_body(v)
            if isinstance(v, dict):
                queue.append(v)
                if (got := score(v)) > best_score:
                    best, best_score = v, got
    return _fit(best, root)


def _fit(value: Any, node: Node) -> Any:
    if not node.members:
        return value
    if not isinstance(value, dict):
        return {}
    by_key = {_key(k): v for k, v in value.items()}
    out = {}
    for m in node.members:
        v = by_key.get(_key(m.name))
        if v is None:
            continue
        if not m.repeated:
            out[m.name] = _fit(v, m) if m.members else v
            continue
        if m.members == _PAIR and isinstance(v, dict):
            v = [{"key": k, "value": x} for k, x in v.items()]
        elif not isinstance(v, list):
            v = [v]
        nested = [c for c in m.members if c.repeated]
        if len(nested) == 1:  # a bare list where an object with one list was meant
            v = [{nested[0].name: x} if isinstance(x, list) else x for x in v]
        out[m.name] = [_fit(x, m) if m.members else x for x in v]
    return out


def _dumps(value: Any) -> str:
    """json.dumps for nesting of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [value]
        while todo:
            x = todo.pop()
            if isinstance(x, _Text):
                out.append(x)
            elif isinstance(x, (list, dict)):
                parts = [[v] for v in x] if isinstance(x, list) else [[_Text(json.dumps(k, ensure_ascii=False) + ": "), v] for k, v in x.items()]
                flat = [y for i, p in enumerate(parts) for y in ([_Text(", ")] if i else []) + p]
                opening, closing = "[]" if isinstance(x, list) else "{}"
                todo += [_Text(closing), *reversed(flat), _Text(opening)]
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


class _Text(str):
    """Output that is done."""


def as_text(value: Any) -> str | None:
    """A leaf as text: whole numbers without fraction, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return str(int(value))
    return _dumps(value)


def whole(text: Column) -> Column:
    """The whole number of 32 bits that a text says, with or without a fraction of zeros; null for all else."""
    number = text.try_cast("double")
    return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**31), number).try_cast("int")


_ENTRY = pa.struct([("r", pa.int32()), ("d", pa.int32()), ("v", pa.string())])


def _level_names(root: Node) -> dict[tuple[str, ...], str]:
    return {x.path: "__".join(x.path) for x in leaves(root)}


def _shred_batch(batch: pa.RecordBatch, root: Node, parse: Callable[[str | None], Any]) -> tuple[np.ndarray, dict[tuple[str, ...], Levels], dict[tuple[str, ...], list[int]]]:
    """(rows with a record, level columns over their bodies, where each record begins in them) of a batch whose last column is the body."""
    columns, rows = {x.path: ([], [], []) for x in leaves(root)}, []
    begins: dict[tuple[str, ...], list[int]] = {path: [] for path in columns}
    for i, text in enumerate(batch.column(batch.num_columns - 1)):
        record = normalise(parse(text.as_py()), root)
        if record is None:
            continue
        rows.append(i)
        for path, at in begins.items():
            at.append(len(columns[path][0]))
        shred(record, root, columns)
    for path in columns:
        begins[path].append(len(columns[path][0]))
    return np.array(rows, np.int64), columns, begins


def _column_of(columns: dict[tuple[str, ...], Levels]) -> Callable[[tuple[str, ...]], tuple[np.ndarray, np.ndarray, pa.Array]]:
    @lru_cache(None)
    def column(path: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        reps, defs, values = columns[path]
        return np.array(reps, np.int32), np.array(defs, np.int32), pa.array(list(map(as_text, values)), pa.string())

    return column


def levels(df: DataFrame, keep: Sequence[str], body: str, *, root: Node = SIDECAR, parse: Callable[[str | None], Any] = parse_body) -> DataFrame:
    """The columns `keep` and one array of (r, d, v) per leaf path, its names joined by two underscores: a row for each body that holds a record.

    r and d are the repetition and definition level, v the value as text, null where absent. Each body is read
    once, in its own row. Null, empty, blank and incomplete bodies give no row.
    """
    names = _level_names(root)
    entry = T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("d", T.IntegerType()), T.StructField("v", T.StringType())]))
    picked = df.select(*keep, F.col(body).cast("string").alias("_body")).where("_body is not null")
    schema = T.StructType([*picked.drop("_body").schema.fields, *[T.StructField(n, entry) for n in names.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows, columns, begins = _shred_batch(part, root, parse)
                column, arrays = _column_of(columns), [c.take(pa.array(rows)) for c in part.columns[:-1]]
                for path in names:
                    r, d, v = column(path)
                    arrays.append(pa.ListArray.from_arrays(pa.array(begins[path], pa.int32()), pa.StructArray.from_arrays([pa.array(r), pa.array(d), v], fields=list(_ENTRY))))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return picked.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that the level columns held at once stay small."""
    for a in range(0, batch.num_rows, size):
        yield batch.slice(a, size)


def table_of(shredded: DataFrame, keep: Sequence[str], table: tuple[str, ...], *, root: Node = SIDECAR) -> DataFrame:
    """The table of the repeated member at path `table` from `levels`: keep, `ordinals` and a text column per leaf, by dotted path.

    Only the columns of its leaves are read.
    """
    _, _, flat, first = _under(root, table)
    names = _level_names(root)
    used = list(dict.fromkeys([first, *[path for _, path in flat]]))
    picked = shredded.select(*keep, *[names[p] for p in used])
    schema = T.StructType([*shredded.select(*keep).schema.fields, T.StructField("ordinals", T.ArrayType(T.IntegerType())), *[T.StructField(n, T.StringType()) for n, _ in flat]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = {p: batch.column(len(keep) + i).flatten() for i, p in enumerate(used)}
            rows = rebuild(lambda p: (flats[p].field("r").to_numpy(), flats[p].field("d").to_numpy(), flats[p].field("v")), root, table)
            n, depth = len(rows.record), len(rows.ordinals)
            ordinals = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), pa.array(np.stack(rows.ordinals, 1).reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows.record)) for i in range(len(keep))], ordinals, *rows.values.values()], schema.names)

    return picked.mapInArrow(run, schema)


def sidecar_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The related tables page, region, figure, warning, timing and metadata of `sidecars`.

    Each row has sidecar_id and its position (and that of its page); a figure has `orphan`, true
    where its page of the sidecar has no region of its index. Equal bodies that arrived again under
    a sidecar_id count once: rows of tables carry a digest of their body, and the bodies stay where they lie.
    Bodies are parsed once; their level columns are written by checkpoint() while the plan is made. Page indexes
    and sizes that are no whole numbers of 32 bits are null.
    """
    use_checkpoints(df.sparkSession)
    keep = ["sidecar_id", "body_key"]
    shredded = levels(df.select("sidecar_id", F.md5("body").alias("body_key"), "body"), keep, "body").checkpoint()

    def of(path: tuple[str, ...]) -> DataFrame:
        return table_of(shredded, keep, path).dropDuplicates([*keep, "ordinals"])

    at = F.col("ordinals")
    regions = of(("pages", "regions")).select("sidecar_id", at[0].alias("page_index"), at[1].alias("position"), F.coalesce("index", at[1].cast("string")).alias("region_index"), "label", "content", F.col("bbox2D").alias("bbox_2d"))
    figures = of(("figures",)).select(
        "sidecar_id",
        at[0].alias("position"),
        whole(F.col("pageIndex")).alias("page_index"),
        F.col("regionIndex").alias("region_index"),
        *[F.col(a).alias(b) for a, b in (("label", "label"), ("bbox2D", "bbox_2d"), ("altText", "alt_text"), ("fileName", "file_name"), ("relativePath", "relative_path"), ("mimeType", "mime_type"), ("sha256", "sha256"))],
        whole(F.col("widthPX")).alias("width_px"),
        whole(F.col("heightPX")).alias("height_px"),
    )
    seen = regions.select("sidecar_id", "page_index", "region_index", F.lit(True).alias("linked")).distinct()
    figures = figures.join(seen, ["sidecar_id", "page_index", "region_index"], "left").withColumn("orphan", F.col("linked").isNull()).drop("linked")
    maps = {n: of(("diagnostics", m)).select("sidecar_id", at[0].alias("position"), "key", "value") for n, m in (("timing", "timingsMs"), ("metadata", "metadata"))}
    return {
        "page": of(("pages",)).select("sidecar_id", at[0].alias("page_index")),
        "region": regions,
        "figure": figures,
        "warning": of(("diagnostics", "warnings")).select("sidecar_id", at[0].alias("position"), F.col("value").alias("warning")),
        **maps,
    }


def _items(name: str, rows: Rows) -> tuple[pa.Array, pa.Array]:
    """Page index and item of a table's rows, as text."""
    at = [pa.array(o).cast(pa.string()) for o in rows.ordinals]
    v = rows.values
    if name == "page":
        return at[0], pa.array([""] * len(rows.record), pa.string())
    if name == "region":
        return at[0], pc.coalesce(v["index"], at[1])
    if name == "figure":
        return v["pageIndex"], v["regionIndex"]
    return pa.array(["-1"] * len(rows.record), pa.string()), at[0] if name == "warning" else v["key"]


def sidecar_children(df: DataFrame) -> DataFrame:
    """One row per child record: (sidecar_id, child, page_index, item), distinct.

    The bodies are read once and where they lie: one aggregation over (sidecar_id, page_index, item)
    links each figure with the regions of its own sidecar, and makes sidecars that came again count once.
    A figure whose page index is no whole number of 32 bits is on no page and gives no row.
    """
    schema = "sidecar_id long, child string, page string, item string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                at, columns, _ = _shred_batch(part, SIDECAR, parse_body)
                ids, column = part.column(0).take(pa.array(at)), _column_of(columns)
                for path, name in SIDECAR_TABLES.items():
                    rows = rebuild(column, SIDECAR, path)
                    child = pa.array([name] * len(rows.record), pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows.record)), child, *_items(name, rows)], ["sidecar_id", "child", "page", "item"])

    picked = df.select(F.col("sidecar_id").cast("long").alias("sidecar_id"), F.col("body").cast("string").alias("body")).where("body is not null")
    rows = picked.mapInArrow(run, schema).select("sidecar_id", "child", whole(F.col("page")).alias("page_index"), "item")
    rows = rows.where("sidecar_id is not null and page_index is not null and item is not null")
    linked = F.col("child").isin("region", "figure")
    kinds = rows.groupBy("sidecar_id", "page_index", "item", F.when(~linked, F.col("child")).alias("other")).agg(
        F.max(F.col("child") == "region").alias("region"), F.max(F.col("child") == "figure").alias("figure")
    )
    names = F.when(F.col("other").isNotNull(), F.array("other")).otherwise(
        F.array_compact(F.array(F.when(F.col("region"), F.lit("region")), F.when(F.col("figure") & F.col("region"), F.lit("figure")).when(F.col("figure"), F.lit("orphan_figure"))))
    )
    return kinds.select("sidecar_id", F.explode(names).alias("child"), "page_index", "item")
