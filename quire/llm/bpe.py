"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges are compiled into a transducer over bytes. A state holds what may still change: the
last token that is settled, and the bytes read since. Reading a byte finds the one token that ends
the encoding of the longer prefix (the longest candidate that is compatible with the token before
it) and the positions from which a longer token could still start. What all of those agree on is
settled and emitted, so the lookahead is bounded by the longest token. States and transitions are
made when first met and kept; both tables have a size limit and start anew beyond it, so a worker's
memory is bounded. Encoding costs one table lookup a byte, and none for a piece met before.

Two tokens are compatible when the merges applied to their joined bytes give the two back. A
sequence of tokens is the encoding of its bytes exactly if all its neighbours are compatible, which
is why a state needs only the last settled token.
"""

from __future__ import annotations

import base64
import gc
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Where the public vocabularies lie; every operator takes the path as a parameter.
VOCABULARY = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def _ranges(kind: str, top: int) -> str:
    """A regular-expression class body of all characters up to `top` of a general category (first letter)."""
    out, start = [], None
    for cp in range(top + 2):
        inside = cp <= top and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=3)
def splitter(top: int = sys.maxunicode) -> re.Pattern:
    """The vocabulary's own split into pieces, for texts of characters up to `top`.

    Letters and numbers come first, which no other branch can begin with. Spelled out for the standard
    library's engine, which is several times faster with a class that is one bit map, as those up to
    FFFF are, than engines with property classes. White space is Unicode's White_Space, which lacks
    the four separators 1c to 1f that Python's own class has.
    """
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    letter, number = _ranges("L", top), _ranges("N", top)
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def pieces(text: str) -> list[str]:
    """The pieces within which merges happen; joined they are the text."""
    if text.isascii():
        top = 0x7F
    else:
        top = 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return splitter(top).findall(text)


class _State:
    """What may still change after the settled token `prev`.

    live: for every position from which a longer token could start, the end of what was read last:
    (trie node of the bytes since, boundaries of the encoding up to there as bits, its tokens).
    """

    __slots__ = ("prev", "live", "read", "next", "flush")

    def __init__(self, prev: int, live: tuple[tuple[int, int, tuple[int, ...]], ...], read: int):
        self.prev, self.live, self.read = prev, live, read
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.flush = live[-1][2]


class Bpe:
    """Encoder and decoder of a rank file: one line a token, base64 of its bytes and its id."""

    #: Most transitions, compatible pairs and pieces kept by a worker.
    NONE = 1 << 30
    STATES, PAIRS, PIECES = 200_000, 400_000, 300_000

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        #: Trie of the tokens: node * 256 + byte to node; at a node its token, NONE if there is none, and
        #: the token's complement where no longer token begins so.
        self.trie: dict[int, int] = {}
        token_at, inner = [-1], [True]
        for t, i in self.ranks.items():
            node = 0
            for byte in t:
                inner[node] = True
                child = self.trie.setdefault(node << 8 | byte, len(token_at))
                if child == len(token_at):
                    token_at.append(self.NONE)
                    inner.append(False)
                node = child
            token_at[node] = i
        self.at = [t if more else ~t for t, more in zip(token_at, inner)]
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "every", ()):  # states refer to one another in cycles
            state.next.clear()
        self.start = _State(-1, ((0, 1, ()),), 0)
        self.every = [self.start]
        #: States after an emission, by what they hold; the others have one way in and need no name.
        self.states: dict[tuple, _State] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Tokens of one piece by its merges in order of rank, the leftmost first: the definition the
        transducer follows. stop: the number of tokens at which to stop merging."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank == sys.maxsize:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: bytes, half: int) -> list[tuple[bytes, int]]:
        """A token, its first (half 0) or last (1) half, the half of that and so on, each with the rank
        of the merge that made it, -1 for a single byte."""
        out = []
        while len(token) > 1:
            out.append((token, self.ranks[token]))
            token = self.merge(token, 2)[half]
        return [*out, (token, -1)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b apart when b follows a within a piece.

        Goes back in time over the tokens that met at the border: the younger of the two is split
        into its halves, and had the two that met then a merge that comes before that moment, it
        would have joined them.
        """
        got = self.pairs.get(a << 32 | b)
        if got is not None:
            return got
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        xs, ys = self.spines[1].get(a), self.spines[0].get(b)
        if xs is None:
            xs = self.spines[1][a] = self._spine(self.tokens[a], 1)
        if ys is None:
            ys = self.spines[0][b] = self._spine(self.tokens[b], 0)
        ranks, before, i, j, got = self.ranks, sys.maxsize, 0, 0, True
        while True:
            (x, x_age), (y, y_age) = xs[i], ys[j]
            if ranks.get(x + y, sys.maxsize) < before:
                got = False
                break
            if x_age > y_age:
                before = x_age
                i += 1
            elif y_age < 0:
                break
            else:  # of two equal merges the left one comes first
                before = y_age + 1
                j += 1
        self.pairs[a << 32 | b] = got
        return got

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Determinise one transition: the next state, and the tokens settled by this byte."""
        trie, at, pairs, prev, none = self.trie, self.at, self.pairs, state.prev, self.NONE
        n = state.read + 1
        live, common, newest = [], -1, None
        for node, path, tokens in state.live:  # from the longest candidate to the shortest
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            token = at[node]
            if token >= 0:
                live.append((node, path, tokens))
                common &= path
            else:
                token = ~token
            if newest is None and token != none:
                left = tokens[-1] if tokens else prev
                fits = left < 0 or pairs.get(left << 32 | token)
                if fits is None:
                    fits = self.compatible(left, token)
                if fits:
                    newest = 0, path | 1 << n, (*tokens, token)
        live.append(newest)
        cut = (common & newest[1]).bit_length() - 1
        if cut <= 0:
            there, emitted = _State(prev, tuple(live), n), ()
        else:
            k = (newest[1] & (2 << cut) - 1).bit_count() - 1
            emitted = newest[2][:k]
            key = (emitted[-1], *[(node, path >> cut, tokens[k:]) for node, path, tokens in live])
            there = self.states.get(key)
            if there is None:
                there = self.states[key] = _State(key[0], key[1:], n - cut)
        if len(self.every) > self.STATES:
            self._reset()
        self.every.append(there)
        state.next[byte] = there, emitted
        return there, emitted

    def _last(self, state: _State, byte: int) -> tuple[int, ...]:
        """Tokens not yet emitted when this byte ends the piece. Most pieces end in a state of their
        own, so none is made for it."""
        for node, _, tokens in state.live:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            token = self.at[node]
            token = token if token >= 0 else ~token
            if token != self.NONE:
                left = tokens[-1] if tokens else state.prev
                if left < 0 or self.compatible(left, token):
                    return (*tokens, token)
        raise ValueError("the vocabulary lacks a byte")

    def transduce(self, data: bytes) -> list[int]:
        """Encoding of one piece by walking the transducer."""
        state, out = self.start, []
        for byte in data[:-1]:
            step = state.next.get(byte)
            if step is None:
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        step = state.next.get(data[-1])
        if step is None:
            out += self._last(state, data[-1])
        else:
            out += step[1]
            out += step[0].flush
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece as packed 32-bit integers, which join faster than lists."""
        got = self.known.get(text)
        if got is None:
            got = array("i", self.transduce(text.encode("utf-8", "surrogatepass"))).tobytes()
            if len(text) <= 40:
                if len(self.known) >= self.PIECES:
                    self.known.clear()
                self.known[text] = got
        return got

    def encode_pieces(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        got = list(map(self.known.get, parts))
        if None in got:
            piece = self.piece
            got = [piece(p) if g is None else g for p, g in zip(parts, got)]
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Text that looks like a special token is ordinary text."""
        return array("i", b"".join(self.encode_pieces(pieces(text)))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of each id as soon as its characters are whole; what never becomes whole gives U+FFFD."""
        machine = Utf8()
        for i in ids:
            yield machine.feed(self.tokens[i])
        yield machine.end()


class Utf8:
    """Incremental UTF-8 state machine: bytes in any portions, whole characters out.

    The state is the number of bytes still due, the range the next one must lie in and the bits so
    far. An ill-formed sequence gives one U+FFFD for its longest part that could have begun a
    character, as the Unicode standard recommends.
    """

    #: First byte's range, bytes that follow, range of the next byte (Unicode standard, table 3-7).
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF),
        (0xE0, 0xE0, 2, 0xA0, 0xBF),
        (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF),
        (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self) -> None:
        self.due, self.low, self.high, self.bits = 0, 0x80, 0xBF, 0
        self.first = {}
        for a, b, due, low, high in self.LEADS:
            for byte in range(a, b + 1):
                self.first[byte] = due, low, high, byte & (0x3F >> due)

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.bits, self.due, self.low, self.high = self.bits << 6 | byte & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.bits))
                    continue
                out.append("�")
                self.due = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.first:
                self.due, self.low, self.high, self.bits = self.first[byte]
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.due = self.due, 0
        return "�" if left else ""


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Bpe:
    """One encoder a worker process, kept between tasks."""
    bpe = Bpe(path)
    gc.set_threshold(2_000_000, 50, 1000)  # its tables are many small objects that live long
    return bpe
