"""Splitting of long texts at natural boundaries, with overlap.

A text is cut into atomic segments at every paragraph, line and sentence end. Adjacent pairs of
segments lie in a heap, weakest boundary first (word, sentence, line, paragraph; of equal ones the
pair of fewest tokens, then the leftmost), and are merged while their size plus the overlap with
the piece before fits the limit. A segment over the limit is first broken into phrases of whole words, a word
over it at tokens that end on a whole character. Every piece after the first begins with up to `overlap`
tokens of the end of the one before, from a word's beginning where there is one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import VOCABULARY, Bpe, pieces, tokenizer

MAX_TOKENS, OVERLAP, ATOM = 512, 64, 16
SIZE = 4  # bytes of a packed id
TOKEN, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
NAMES = ("token", "word", "sentence", "line", "paragraph")

_BREAKS = re.compile(r"([\r\n]\s*)|[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*")
_LINE_END = re.compile(r"\r\n?|\n")


@dataclass
class Piece:
    """Characters start to end of the text; the first `shared` tokens repeat the end of the piece before."""

    start: int
    end: int
    tokens: int
    shared: int
    cut: str  # kind of the boundary at its end


def boundaries(text: str) -> Iterator[tuple[int, int]]:
    """(position, strength) of paragraph, line and sentence ends, in order."""
    for m in _BREAKS.finditer(text):
        space = m[1]
        if space is None:
            yield m.end(), SENTENCE
        else:
            ends = space.count("\n") if "\r" not in space else len(_LINE_END.findall(space))
            yield m.end(), PARAGRAPH if ends > 1 else LINE


def units(bpe: Bpe, parts: list[str], ids: list[bytes], limit: int) -> tuple[list[int], list[int]]:
    """Character ends and sizes of the smallest parts a cut may lie between: the tokenizer's own pieces,
    which encode alike wherever they stand, and parts of those longer than the limit. Sizes and limit
    are bytes of packed ids, SIZE a token."""
    sizes = list(map(len, ids))
    if max(sizes) <= limit:
        return list(accumulate(map(len, parts))), sizes
    ends, counts, at = [], [], 0
    for part, own in zip(parts, ids):
        if len(own) <= limit:
            at += len(part)
            ends.append(at)
            counts.append(len(own))
            continue
        own, raw, n = array("i", own), b"", 0
        for i, token in enumerate(own):
            raw += bpe.tokens[token]
            n += 1
            following = bpe.tokens[own[i + 1]][0] if i + 1 < len(own) else 0
            if following & 0xC0 != 0x80:  # the next token doesn't go on within a character
                at += len(raw.decode("utf-8", "surrogatepass"))
                ends.append(at)
                counts.append(n * SIZE)
                raw, n = b"", 0
    return ends, counts


def split(bpe: Bpe, text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Piece]:
    """The pieces of a text of more than max_tokens tokens; none for any other."""
    if not text or len(text) * 4 <= max_tokens:  # a character has four bytes at most, a token one at least
        return []
    parts = pieces(text)
    ids = bpe.encode_pieces(parts)
    most, shared_most = max_tokens * SIZE, overlap * SIZE
    if sum(map(len, ids)) <= most:
        return []
    ends, sizes = units(bpe, parts, ids, most - shared_most)
    upto = [0, *accumulate(sizes)]
    n = len(ends)
    starts = [0, *ends]

    def room(first: int) -> int:
        """Size of its own that a segment beginning at unit `first` may have."""
        return most if first == 0 else most - shared_most

    strong: dict[int, int] = {}
    for at, kind in boundaries(text):
        i = bisect_left(starts, at)
        if i < n and starts[i] == at and strong.get(i, 0) < kind:
            strong[i] = kind

    def strength(i: int) -> int:
        """Of the boundary before unit i."""
        return strong.get(i) or (WORD if text[starts[i]].isspace() or text[starts[i] - 1].isspace() else TOKEN)

    # Atomic segments as first units: sentences; phrases of at least ATOM tokens in sentences over the
    # limit; phrases that end at any unit in words over it.
    firsts = [0, *sorted(strong.keys() - {0})]
    for level in (WORD, TOKEN):
        bounds, firsts = [*firsts, n], []
        for a, b in zip(bounds, bounds[1:]):
            firsts.append(a)
            if upto[b] - upto[a] > room(a):
                last = a
                for i in range(a + 1, b):
                    if upto[i] - upto[last] >= ATOM * SIZE and strength(i) >= level:
                        firsts.append(i)
                        last = i
    firsts = [a for a in firsts if a < n]

    # Segments as a linked list over their first units; the heap holds the boundary before `b`.
    bond = {i: strength(i) for i in firsts}
    after = dict(zip(firsts, [*firsts[1:], n]))
    before = dict(zip(firsts[1:], firsts))
    heap = [(bond[b], upto[after[b]] - upto[a], b) for a, b in zip(firsts, firsts[1:]) if upto[after[b]] - upto[a] <= room(a)]
    heapq.heapify(heap)
    while heap:
        _, size, b = heapq.heappop(heap)
        a = before.get(b)
        if a is None or upto[after[b]] - upto[a] != size:
            continue  # merged since, or of another size by now
        c = after.pop(b)
        del before[b]
        after[a] = c
        if c < n:
            before[c] = a
            if (size := upto[after[c]] - upto[a]) <= room(a):  # a pair too large stays so
                heapq.heappush(heap, (bond[c], size, c))
        if a and (size := upto[c] - upto[before[a]]) <= room(before[a]):
            heapq.heappush(heap, (bond[a], size, a))

    out, a, last = [], 0, 0
    while a < n:
        b = after[a]
        shared = a
        if a:
            fits = range(max(last, bisect_left(upto, upto[a] - shared_most)), a)
            shared = next((i for i in fits if strength(i) >= WORD), fits.start if len(fits) else a)
        out.append(Piece(starts[shared], starts[b], (upto[b] - upto[shared]) // SIZE, (upto[a] - upto[shared]) // SIZE, NAMES[bond[b]] if b < n else "end"))
        a, last = b, a
    return out


SCHEMA = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("overlap_tokens", T.IntegerType()),
    T.StructField("cut", T.StringType()),
    T.StructField("piece_text", T.StringType()),
]


def split_long(df: DataFrame, key: str, text: str, *, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """The pieces of each text over max_tokens tokens: (key, piece, start, end, n_tokens, overlap_tokens, cut, piece_text).

    start and end are character positions, the overlap included. Joined without their overlaps the
    pieces are the text. Texts within the limit, empty and null ones have no pieces. Rows that
    repeat give their pieces again. A text of no more bytes than max_tokens can't exceed it, as
    every token has a byte, and is left out before it reaches Python. There is no shuffle.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and under max_tokens")
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            rows, size = [], 0

            def full() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

            types = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.string(), pa.string()]
            names = ["key", *[f.name for f in SCHEMA]]
            for key_value, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                for i, p in enumerate(split(bpe, value, max_tokens, overlap)):
                    rows.append((key_value, i, p.start, p.end, p.tokens, p.shared, p.cut, value[p.start : p.end] if with_text else None))
                    size += p.end - p.start
                    if size > 16_000_000:
                        yield full()
                        rows, size = [], 0
            if rows:
                yield full()

    long = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where(F.octet_length("text") > max_tokens)
    out = long.mapInArrow(run, T.StructType([T.StructField("key", kind), *SCHEMA]))
    return out.withColumnRenamed("key", key)
