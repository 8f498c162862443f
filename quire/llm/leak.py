"""Evaluation passages inside a training corpus.

Seeds are n-grams of four words, next to each other or with a word left out in the middle, so that a copy
with every third word changed still has some. Of every WINDOW neighbouring n-grams of an item the one
rarest in the corpus, counted over all documents, is a seed. A document that holds a seed is aligned with
the item by Smith-Waterman over words around the diagonals of its seeds, and the alignment's score decides
whether the passage leaked, edited or not. A document and an item that share `run` consecutive words share
a seed in them and reach the score of `run` matches, so no such pair is missed; the longest run of equal
words is then measured exactly.

The items are the stated query set: their seeds go to every worker in blocks of bounded size, each block
against all documents, which are read once to count and once to align; beyond one block's words another two
passes follow. The documents are never shuffled: of them only n-gram counts, in number bounded by the items'
n-grams, and the pairs found leave the map.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a run that counts as a leak, n-grams of which the rarest is a seed, words of items that one pass handles.
RUN, WINDOW, BLOCK_WORDS = 12, 2, 2_000_000
#: Words of a seed by their distance from its first.
SHAPES = ((0, 1, 2, 3), (0, 1, 3, 4))
SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item of fewer than RUN words leaked where the alignment has this share of its own score.
WHOLE = 0.8

_WORD = re.compile(r"[^\W_]+")
_LINE_HYPHEN = re.compile("(?<=[^\\W_])[-‐\xad][^\\S\r\n\x85  ]*(?:\r\n?|[\n\x85  ])\\s*(?=[^\\W_])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC folding and lower-casing; a word split by a
    hyphen at a line end is one."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "-" in text or "‐" in text or "\xad" in text:
        text = _LINE_HYPHEN.sub("", text)
    return _WORD.findall(text)


class Items:
    """A block of items as word ids, with the hashes of their n-grams."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [(i, np.array([number(w, len(self.vocabulary)) for w in ws], np.int32)) for i, ws in items]
        self.grams = np.unique(np.concatenate([hashes(ids, x) for _, ids in self.items for x in range(len(SHAPES))] or [np.zeros(0, np.uint64)]))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram numbers) of the items' n-grams among word ids, -1 being a foreign word."""
        at, number = [], []
        for x, shape in enumerate(SHAPES):
            n = len(ids) - shape[-1]
            if n <= 0 or not len(self.grams):
                continue
            known = ids >= 0
            own = known[:n].copy()
            for k in shape[1:]:
                own &= known[k : n + k]
            p = np.flatnonzero(own)
            code = hashes(ids, x, p)
            k = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
            hit = self.grams[k] == code
            at.append(p[hit])
            number.append(k[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(number)

    def seeds(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram numbers in order, items' positions in the block, word positions): of each WINDOW neighbouring
        n-grams of a shape the rarest, the leftmost of equally rare ones; of all where an item has fewer."""
        out = []
        for k, (_, ids) in enumerate(self.items):
            for x in range(len(SHAPES)):
                number = np.searchsorted(self.grams, hashes(ids, x))
                if not len(number):
                    continue
                rarity, width = counts[number], min(WINDOW, len(number))
                chosen = np.unique(np.lib.stride_tricks.sliding_window_view(rarity, width).argmin(1) + np.arange(len(number) - width + 1))
                out.append(np.stack([number[chosen], np.full(len(chosen), k), chosen]))
        all_of = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        all_of = all_of[:, np.argsort(all_of[0], kind="stable")]
        return all_of[0], all_of[1], all_of[2]


def hashes(ids: np.ndarray, shape: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the n-gram of a shape at every position, or at those given. Seeds are verified by the alignment later."""
    n = max(0, len(ids) - SHAPES[shape][-1])
    at = np.arange(n) if at is None else at
    with np.errstate(over="ignore"):
        h = np.full(len(at), shape + 1, np.uint64)
        for k in SHAPES[shape]:
            h = (h ^ ids[at + k].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(best local score, matched words on its path) of pairs of word sequences.

    Row by row over many pairs at once, padded to the longest; within a row a gap's cost is linear, so the best
    gap is a running maximum.
    """
    if not pairs:
        return []
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.full((len(pairs), n), -2, np.int32), np.full((len(pairs), m), -3, np.int32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    steps, at = np.arange(m + 1, dtype=np.int32) * -GAP, np.arange(m + 1, dtype=np.int32)
    prev, prev_match = np.zeros((len(pairs), m + 1), np.int32), np.zeros((len(pairs), m + 1), np.int32)
    best, best_match, each = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.arange(len(pairs))
    for q in range(n):
        same = b == a[:, q, None]
        diagonal = prev[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        row = np.zeros_like(prev)
        row[:, 1:] = np.maximum(np.maximum(diagonal, prev[:, 1:] + GAP), 0)
        match = np.zeros_like(prev)
        match[:, 1:] = np.where(row[:, 1:] == diagonal, prev_match[:, :-1] + same, prev_match[:, 1:])
        match[row == 0] = 0
        lifted = row + steps
        reach = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == reach, at, 0), axis=1)
        prev = reach - steps
        prev_match = np.take_along_axis(match, source, axis=1)
        prev_match[prev <= 0] = 0
        top = prev.argmax(1)
        score = prev[each, top]
        better = score > best
        best = np.where(better, score, best)
        best_match = np.where(better, prev_match[each, top], best_match)
    return list(zip(best.tolist(), best_match.tolist()))


def _aligned(todo: list[tuple[np.ndarray, list[np.ndarray]]], cells: int = 100_000) -> list[tuple[int, int]]:
    """The best alignment of each item with the stretches of its document, pairs of like size together."""
    flat = [(k, item, part) for k, (item, parts) in enumerate(todo) for part in parts]
    order = sorted(range(len(flat)), key=lambda i: (len(flat[i][2]), len(flat[i][1])))
    best = [(0, 0)] * len(todo)
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(flat[order[b]][2]) <= cells and len(flat[order[b]][2]) <= 16 + 1.25 * len(flat[order[a]][2]):
            b += 1
        some = [flat[i] for i in order[a:b]]
        for (k, _, _), found in zip(some, smith_waterman([(x, y) for _, x, y in some])):
            best[k] = max(best[k], found)
        a = b
    return best


def longest_run(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, cells: int = 4_000_000) -> int:
    """Length of the longest run of equal words on the diagonals (position in the document less that in the item)."""
    at, best = np.arange(len(item)), 0
    step = max(1, cells // max(1, len(item)))
    for a in range(0, len(diagonals), step):
        p = diagonals[a : a + step, None] + at
        same = (doc[np.clip(p, 0, len(doc) - 1)] == item) & (p >= 0) & (p < len(doc))
        broken = np.maximum.accumulate(np.where(same, -1, at), axis=1)
        best = max(best, int(np.where(same, at - broken, 0).max()))
    return best


def _ids(vocabulary: dict[str, int], batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Word ids of a batch's texts joined by foreign words, and where each text begins."""
    get, joined, starts = vocabulary.get, [], []
    for value in batch.column(1):
        starts.append(len(joined))
        joined.extend([get(w, -1) for w in words(value.as_py())])
        joined.append(-1)
        if len(joined) > 2_000_000:
            yield np.array(joined, np.int32), starts
            joined, starts = [], []
    if starts:
        yield np.array(joined, np.int32), starts


def _counts(df: DataFrame, block: Items) -> np.ndarray:
    """Occurrences of each n-gram of the block in the whole corpus, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for ids, _ in _ids(block.vocabulary, batch):
                total += np.bincount(block.hits(ids)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(len(block.grams), np.int64)
    rows = df.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():  # at most one row for each n-gram of the block
        out[r["gram"]] = r["n"]
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, *, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_key, item_key, run_words, score, matched_words, item_words, leaked), a row for each pair that shares a seed.

    score is that of the best local alignment around the seeds (match 2, mismatch and gap -1) as a share of the
    item's own; matched_words the words equal in it; leaked says that it reaches that of `run` equal words, or
    of most of an item that has fewer words. run_words is the longest run of equal words on a diagonal of a
    seed, exact where it is at least `run`. Null and empty texts, and items of fewer than four words, are in no
    pair. Items that repeat under a key give the best row of the key, as documents do.
    """
    if run < WINDOW + SHAPES[0][-1]:
        raise ValueError("a run must hold a window of seeds")
    dk, ik = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    corpus = docs.select(F.col(f"`{doc_key}`").alias("doc_key"), F.col(f"`{doc_text}`").cast("string").alias("text")).where("text is not null and doc_key is not null")
    queries = items.select(F.col(f"`{item_key}`").alias("item_key"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null and item_key is not null")
    schema = T.StructType(
        [
            T.StructField("doc_key", dk),
            T.StructField("item_key", ik),
            T.StructField("run_words", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("matched_words", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("leaked", T.BooleanType()),
        ]
    )
    found = None
    for chunk in _blocks(queries, block_words):
        block = Items(chunk)
        if not len(block.grams):
            continue
        seeds = block.seeds(_counts(corpus, block))
        part = corpus.mapInArrow(_aligner(block, seeds, run), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    best = found.groupBy("doc_key", "item_key").agg(*[F.max(c).alias(c) for c in schema.names[2:]])
    return best.withColumnsRenamed({"doc_key": doc_key, "item_key": item_key})


def _blocks(queries: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' words, streamed to the driver in blocks of bounded size."""
    chunk, size = [], 0
    for r in queries.toLocalIterator():
        ws = words(r["text"])
        if chunk and size + len(ws) > block_words:
            yield chunk
            chunk, size = [], 0
        chunk.append((r["item_key"], ws))
        size += len(ws)
    if chunk:
        yield chunk


def _aligner(block: Items, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done, out = batch.column(0), 0, []
            for ids, starts in _ids(block.vocabulary, batch):
                pairs = [(d, k, diagonals, ids[starts[d] : (starts[d + 1] if d + 1 < len(starts) else len(ids)) - 1]) for d, k, diagonals in _pairs(block, seeds, ids, starts)]
                found = _aligned([(block.items[k][1], [own[a:b] for a, b in _windows(diagonals, len(block.items[k][1]), len(own))]) for _, k, diagonals, own in pairs])
                for (d, k, diagonals, own), (score, matched) in zip(pairs, found):
                    item_key, item = block.items[k]
                    if not score:  # hashes that clash
                        continue
                    leaked = score >= MATCH * min(least, max(SEED, WHOLE * len(item)))
                    out.append((keys[done + d].as_py(), item_key, longest_run(own, item, diagonals), score / (MATCH * len(item)), matched, len(item), leaked))
                done += len(starts)
            if out:
                cols = list(zip(*out))
                kinds = [batch.schema.field(0).type, None, pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
                names = ["doc_key", "item_key", "run_words", "score", "matched_words", "item_words", "leaked"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def _pairs(block: Items, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, starts: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, item, diagonals of their seeds), each pair once.

    Positions of a seed in a document by those in an item are a diagonal each; words that repeat have many on
    few diagonals. They are made `most` at a time and each diagonal is kept once.
    """
    grams, item_of, at_of = seeds
    at, gram = block.hits(ids)
    low, high = np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right")
    seen = high > low
    at, low, n = at[seen], low[seen], (high - low)[seen]
    order = np.argsort(at, kind="stable")
    at, low, n = at[order], low[order], n[order]
    doc = np.searchsorted(starts, at, "right") - 1
    begin = np.asarray(starts, np.int64)
    parts = []
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        each = np.repeat(np.arange(a, b), n[a:b])
        seed = np.arange(len(each)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[each]
        parts.append(_distinct(np.stack([doc[each], item_of[seed], at[each] - begin[doc[each]] - at_of[seed]])))
        a = b
    if not parts:
        return
    found = parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts, axis=1))
    change = np.flatnonzero((np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)) + 1
    for x, y in zip([0, *change.tolist()], [*change.tolist(), found.shape[1]]):
        yield int(found[0, x]), int(found[1, x]), found[2, x:y]


def _distinct(found: np.ndarray) -> np.ndarray:
    """Distinct columns of three rows of whole numbers, in order."""
    low = found.min(1)
    size = found.max(1) - low + 1
    if math.prod(map(int, size)) >= 1 << 62:
        return np.unique(found, axis=1)
    a, b, c = found - low[:, None]
    one = np.unique((a * size[1] + b) * size[2] + c)
    rest = one // size[2]
    return np.stack([rest // size[1], rest % size[1], one % size[2]]) + low[:, None]


def _windows(diagonals: np.ndarray, item_words: int, doc_words: int) -> list[tuple[int, int]]:
    """Stretches of the document in which the item would lie by its seeds, with room for edits, merged."""
    slack = 8 + item_words // 4
    spans = zip(np.maximum(0, diagonals - slack).tolist(), np.minimum(doc_words, diagonals + item_words + slack).tolist())
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
