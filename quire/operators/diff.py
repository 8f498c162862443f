"""Differences between two copies of a dataset.

Only whether values are equal matters, so texts are replaced by digests in the scan and never shuffled.
Identical rows cancel by multiplicity in one hash aggregation over key and fields, which has a
map-side half, so a hot key or a row repeated millions of times shrinks before the shuffle. What
is left, normally a small part, is grouped by key, and left rows are paired with right rows at
minimum cost, the number of fields that differ, whatever the size of the key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import use_checkpoints

#: Default of an argument of diff_copies that has no effect any more.
BLOCK = 256
#: Up to so many fields, rows meet in nodes of the values they share; beyond, pairs are looked at one by one.
SHARED = 6
#: Rows that one array makes at most.
REPEAT = 10_000


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest `order` columns.

    Nulls in `order` count as oldest. Rows equal in `order` are told apart by all other columns
    of a sortable type, so the choice doesn't depend on the order of arrival. Spark limits each
    key to one row before the shuffle, so a key with millions of versions is no hot spot.
    """
    ties = [c for c, kind in df.dtypes if c not in (*keys, *order) and not kind.startswith("map")]
    by = [F.col(_q(c)).desc_nulls_last() for c in (*order, *ties)]
    rank = _fresh("rank", df.columns)
    w = Window.partitionBy(*[F.col(_q(k)) for k in keys]).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def _texts(kind: T.DataType) -> bool:
    """Whether values hold texts and nothing whose text form depends on more than its value."""
    if isinstance(kind, T.ArrayType):
        return _texts(kind.elementType)
    if isinstance(kind, T.StructType):
        plain = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType)
        return any(_texts(f.dataType) for f in kind) and all(_texts(f.dataType) or isinstance(f.dataType, plain) for f in kind)
    return isinstance(kind, T.StringType)


def digested(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows with 128-bit digests in place of texts, and of arrays and structs that hold texts; null stays null."""
    kinds = {f.name: f.dataType for f in df.schema}

    def digest(name: str) -> Column:
        c = F.col(_q(name))
        text = c if isinstance(kinds[name], T.StringType) else F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        return F.when(c.isNotNull(), F.unhex(F.md5(text)))

    return df.withColumns({name: digest(name) for name in fields if _texts(kinds[name])})


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    *,
    multiset: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Rows on one side only, and pairs that differ, with the fields they differ in.

    Returns the key columns, `status` ('only_left', 'only_right' or 'changed') and `diffs` (names
    of the differing fields in the order given; empty for one-sided rows).

    Defined cases: null equals null only, in keys and fields; '' is not null. Equal rows cancel
    one against one; with multiset=False repeats within a side count once. Empty inputs give no
    rows on either side beyond what the other side has. Columns other than keys and fields are
    not read, whatever their names. Texts are compared by 128-bit digests, and may come as `digested` ones.
    As many rows of a key are paired as its shorter side has, at the least number of differing fields in all. Which of the
    pairings of that cost it is depends on the rows of the key only. A key with leftover rows on both sides has its distinct ones in one task, as
    ranks of their values; `block` has no effect. What doesn't cancel is written by checkpoint() while the plan is made, so
    that both sides are read once.
    """
    ks, fs = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        # The key is one struct, in which null equals null.
        key = F.struct(*[F.col(_q(c)).alias(a) for c, a in zip(keys, ks)]).alias("k")
        return digested(df, fields).select(key, *[F.col(_q(c)).alias(a) for c, a in zip(fields, fs)], F.lit(sign).cast("long").alias("sign"))

    both = side(left, 1).unionByName(side(right, -1))
    if multiset:
        net = F.sum("sign")
    else:
        net = F.max(F.when(F.col("sign") > 0, 1).otherwise(0)) - F.max(F.when(F.col("sign") < 0, 1).otherwise(0))
    use_checkpoints(left.sparkSession)
    left_over = both.groupBy("k", *fs).agg(net.cast("long").alias("net")).where("net <> 0").checkpoint()

    sides = [F.sum(F.greatest(F.col("net") * sign, F.lit(0))) for sign in (1, -1)]
    totals = left_over.groupBy("k").agg(sides[0].alias("nl"), sides[1].alias("nr"))
    alone = totals.where("nl = 0 or nr = 0").select("k", F.when(F.col("nr") == 0, "only_left").otherwise("only_right").alias("status"), F.lit(0).alias("mask"), (F.col("nl") + F.col("nr")).alias("n"))
    by_key = Window.partitionBy("k")
    mixed = left_over.withColumn("most", F.max("net").over(by_key)).withColumn("least", F.min("net").over(by_key)).where("most > 0 and least < 0")
    # In place of values, their ranks within the key: equal where the values are, nulls included.
    ranks = [F.dense_rank().over(by_key.orderBy(f)).alias(f) for f in fs]
    grouped = mixed.select("k", *ranks, "net").groupBy("k").agg(F.collect_list(F.struct("net", *fs)).alias("rows"))
    schema = T.StructType([grouped.schema["k"], T.StructField("status", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    counted = grouped.mapInArrow(_paired(len(fs)), schema).unionByName(alone)

    times = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT).cast("long")))
    some = counted.withColumn("from", times)
    x = F.struct("status", "mask")
    found = some.select("k", F.explode(F.array_repeat(x, F.least(F.col("n") - F.col("from"), F.lit(REPEAT)).cast("int"))).alias("x"))
    flags = [F.when(F.col("x.mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(f)) for i, f in enumerate(fields)]
    named = [F.col(f"k.{k}").alias(name) for k, name in zip(ks, keys)]
    return found.select(*named, F.col("x.status").alias("status"), F.array_compact(F.array(*flags)).alias("diffs"))


def _groups(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, int]:
    """A number for each row, equal where all columns are, and how many numbers there are."""
    ids, n = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        values, c = np.unique(c, return_inverse=True)
        some, ids = np.unique(ids * len(values) + c, return_inverse=True)
        n = len(some)
    return ids, n


def _on_both(ids: np.ndarray, n: int, is_left: np.ndarray) -> np.ndarray:
    """Whether the rows of a number are on both sides."""
    return (np.bincount(ids[is_left], minlength=n) > 0)[ids] & (np.bincount(ids[~is_left], minlength=n) > 0)[ids]


def _paired(n_fields: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the leftover rows of each key to counts of its pairs by the fields that differ, and of one-sided rows."""
    every = (1 << n_fields) - 1
    subsets = range(1, every) if n_fields <= SHARED else range(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["rows"]
            flat = lists.flatten()
            key = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            net = flat.field(0).to_numpy()
            codes = [flat.field(1 + i).to_numpy().astype(np.int64) for i in range(n_fields)]
            # Values that the other side of a key doesn't have are alike, as rows agree in none of them.
            for i, c in enumerate(codes):
                codes[i] = np.where(_on_both(*_groups([key, c]), net > 0), c, -1)
            ids, n = _groups([key, net < 0, *codes])
            first = np.zeros(n, np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            key, is_left, codes = key[first], net[first] > 0, [c[first] for c in codes]
            count = np.zeros(n, np.int64)
            np.add.at(count, ids, np.abs(net))

            nodes = np.full((len(subsets), n), -1)
            gains: list[int] = []
            for k, s in enumerate(subsets):
                own = [c for i, c in enumerate(codes) if s >> i & 1]
                at = np.flatnonzero(np.all([c >= 0 for c in own], axis=0))
                if not len(at):
                    continue
                of, m = _groups([key[at], *[c[at] for c in own]])
                both = _on_both(of, m, is_left[at])
                nodes[k, at[both]] = of[both] + len(gains)
                gains += [s] * m
            ends = np.searchsorted(key, np.arange(len(lists) + 1))
            split = ends[:-1] + np.add.reduceat(is_left, ends[:-1], dtype=np.int64)
            left = np.add.reduceat(np.where(is_left, count, 0), ends[:-1])
            right = np.add.reduceat(np.where(is_left, 0, count), ends[:-1])
            same = np.zeros(n, np.int64)
            for i, c in enumerate(codes):
                same[ends[:-1]] |= (((c[ends[:-1]] == c[split]) & (c[split] >= 0)).astype(np.int64)) << i
            single = ends[1:] - ends[:-1] == 2
            rows: list[tuple[int, str, int, int]] = []
            for k, (a, m, b, nl, nr, one) in enumerate(zip(ends.tolist(), split.tolist(), ends[1:].tolist(), left.tolist(), right.tolist(), single.tolist())):
                pairs = min(nl, nr)
                if one:
                    by = {int(same[a]): pairs}
                else:
                    at, to = nodes[:, a:b].T.tolist(), gains
                    if n_fields > SHARED:
                        at, to = _pairs_as_nodes(np.stack([c[a:b] for c in codes], axis=1), m - a)
                    at = [[h for h in x if h >= 0] for x in at]
                    by = most_alike(count[a:m].tolist(), at[: m - a], count[m:b].tolist(), at[m - a :], to)
                    by[0] = pairs - sum(by.values())
                rows += [(k, "changed", every ^ s, c) for s, c in sorted(by.items()) if c]
                rows += [(k, status, 0, c) for status, c in (("only_left", nl - pairs), ("only_right", nr - pairs)) if c]
            at, status, mask, times = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["k"].take(pa.array(at, pa.int64())), pa.array(status, pa.string()), pa.array(mask, pa.int32()), pa.array(times, pa.int64())], names=["k", "status", "mask", "n"]
            )

    return run


def _pairs_as_nodes(codes: np.ndarray, n_left: int) -> tuple[list[list[int]], list[int]]:
    """A node for each pair of a left and a right row that share values."""
    at: list[list[int]] = [[] for _ in codes]
    to: list[int] = []
    bits = 1 << np.arange(codes.shape[1], dtype=np.int64)
    for i in range(n_left):
        alike = ((codes[n_left:] == codes[i]) & (codes[i] >= 0)) @ bits
        for j in np.flatnonzero(alike).tolist():
            at[i].append(len(to))
            at[n_left + j].append(len(to))
            to.append(int(alike[j]))
    return at, to


def most_alike(supply: list[int], left: list[list[int]], demand: list[int], right: list[list[int]], shared: Sequence[int]) -> dict[int, int]:
    """How many pairs share which fields, where all pairs together share most; pairs that share none aren't counted.

    A node stands for values of some fields (bits in `shared`) and lists in left and right the rows that have them:
    a pair meets in the node of all that it shares. Flow of most gain from left to right, by successive best paths. A best path
    gains no more than the ones before and less than there are fields, so that distances are made anew once a gain; paths of
    one gain are found by depth-first search over tight edges until there is none.
    """
    supply, demand = list(supply), list(demand)
    names = {h: k for k, h in enumerate(dict.fromkeys(h for x in left for h in x))}
    kinds = [shared[h] for h in names]
    gain = [v.bit_count() for v in kinds]
    left, right = [[names[h] for h in x] for x in left], [[names[h] for h in x if h in names] for x in right]
    into: list[list[int]] = [[] for _ in names]
    for j, x in enumerate(right):
        for h in x:
            into[h].append(j)
    sent: list[dict[int, int]] = [{} for _ in names]  # by left row
    got: list[dict[int, int]] = [{} for _ in right]  # by node
    n, m, far = len(left), len(left) + len(names), 1 << 60

    def arcs(v: int) -> list[tuple[int, int]]:
        """Nodes one may go to from v, and the cost."""
        if v < n:
            return [(n + h, 0) for h in left[v]]
        if v < m:
            h = v - n
            return [(m + j, -gain[h]) for j in into[h]] + [(i, 0) for i in sent[h]]
        return [(n + h, gain[h]) for h in got[v - m]]

    while True:
        cost = [far] * (m + len(right))
        queue = deque(i for i in range(n) if supply[i])
        waiting = [False] * len(cost)
        for i in queue:
            cost[i] = 0
        while queue:
            v = queue.popleft()
            waiting[v] = False
            for w, c in arcs(v):
                if cost[v] + c < cost[w]:
                    cost[w] = cost[v] + c
                    if not waiting[w]:
                        waiting[w] = True
                        queue.append(w)
        best = min((cost[m + j] for j in range(len(right)) if demand[j]), default=0)
        if best >= 0:
            break
        more = True
        while more:
            more = False
            todo: dict[int, list[int]] = {}  # arcs not given up in this pass, the next one last
            for i in range(n):
                path, on = [i], {i}
                while path and supply[i]:
                    v = path[-1]
                    if v >= m and demand[v - m] and cost[v] == best:
                        _send(path, supply, demand, sent, got, n, m)
                        more, path, on = True, [i], {i}
                        continue
                    if v not in todo:
                        todo[v] = [w for w, c in reversed(arcs(v)) if cost[v] + c == cost[w]]
                    while todo[v]:
                        w = todo[v][-1]
                        back = sent[v - n].get(w) if n <= v < m and w < n else got[v - m].get(w - n) if v >= m else 1
                        if back and w not in on:
                            path.append(w)
                            on.add(w)
                            break
                        todo[v].pop()
                    else:
                        on.discard(path.pop())
                        if path:
                            todo[path[-1]].pop()
    by: dict[int, int] = {}
    for kind, x in zip(kinds, sent):
        if x:
            by[kind] = by.get(kind, 0) + sum(x.values())
    return by


def _send(path: list[int], supply: list[int], demand: list[int], sent: list[dict[int, int]], got: list[dict[int, int]], n: int, m: int) -> None:
    """Sends along a path as much as it takes."""
    steps = list(zip(path, path[1:]))
    backs = [sent[v - n][w] if v < m else got[v - m][w - n] for v, w in steps if v >= m or (v >= n and w < n)]
    much = min(supply[path[0]], demand[path[-1] - m], *backs)
    supply[path[0]] -= much
    demand[path[-1] - m] -= much
    for v, w in steps:
        rows, key, by = (sent[w - n], v, much) if v < n else (got[v - m], w - n, -much) if v >= m else (sent[v - n], w, -much) if w < n else (got[w - m], v - n, much)
        rows[key] = rows.get(key, 0) + by
        if not rows[key]:
            del rows[key]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """A minimum-cost assignment of the shorter side (shortest augmenting paths with potentials); what `most_alike` is tested by."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            seen[at] = True
            row = owner[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~seen[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], at
            step_to = int(np.argmin(np.where(seen, np.inf, least)[1:])) + 1
            delta = least[step_to]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            at = step_to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _fresh(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name += "_"
    return name
