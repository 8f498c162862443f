"""Per-document text statistics, and whether a page is prose, a list, a table or junk.

Statistics are sums over words and lines. A text is cut into chunks; each chunk gives a partial
result that is associative: besides sums it holds the state at its two borders (the first and last
line so far, the word cut by the border, the last words before it), so that joining two partials
corrects what the border cut apart. Partials are merged in order as a tree, in groups of FAN, until
one is left; ratios and rules follow from it. The chunks of a text of ordinary length are merged
where it lies, those of a huge one are spread over the cluster and merged by aggregations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk of a text that is merged where it lies and of one that is spread, and partials merged at once.
CHUNK, SPREAD, FAN = 1_024, 262_144, 64

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"\r\n?|\n")
_LEADER = re.compile(r"\.{4,}|…{2,}")
_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b[^>]*>", re.I)
_ITEM = re.compile(r"(?:[-*•·▪◦–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[\d{1,3}\])\s")
#: The longest list marker with the white space after it; a line's head is kept that far.
MARKER = 6
_ENDS, _CLOSERS = tuple(".!?:;。！？…"), "\"'”’»)]"
_GAP = re.compile(r"\S {3,}(?=\S)")
_COMMA = re.compile(r"[^\s,],(?=[^\s,]|$)|,(?=,|$)")
_HEX = re.compile(r"(?:[0-9a-f]{2}|[0-9a-f]{8})", re.I)
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûëïœæå")
#: Where a text may be cut: after a line, or within a word. No pattern of a line spans such a place but tags.
_SEAM = re.compile(r"\n|(?<=[^\W_])(?=[^\W_])")


def cuts(text: str, size: int) -> Iterator[str]:
    """The text in chunks of `size` characters or as many more as the next place to cut takes, tags kept whole."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while True:
            m = _SEAM.search(text, at)
            at = m.end() if m else len(text)
            # A tag holds no ">" but its last character, so one that spans the place begins after the last before it.
            tag = _TAG.search(text, text.rfind(">", start, at) + 1 or start) if m and text.find("<", start, at) >= 0 else None
            if not tag or not tag.start() < at < tag.end():
                break
            at = tag.end()
        yield text[start:at]
        start = at
    yield text[start:]


class _Kinds(dict):
    """What a character counts as: letter and vowel, letter, digit, other word character, white space, bar or hyphen, symbol."""

    VOWEL, LETTER, DIGIT, NUMBER, SPACE, RULE, SYMBOL = range(7)

    def __missing__(self, c: str) -> int:
        if c.isspace():
            k = self.SPACE
        elif c.isdecimal():
            k = self.DIGIT
        elif _WORD.match(c):
            k = self.VOWEL if c.lower()[0] in _VOWELS else self.LETTER
        else:
            k = self.RULE if c in "|-" else self.SYMBOL
        self[c] = k
        return k


_KINDS = _Kinds()
#: The same for ASCII bytes, and the bytes of words in Latin-1 with blanks for the others.
_KIND_BYTES = bytes(_KINDS[chr(i)] if i < 128 else 255 for i in range(256))
_WORD_BYTES = bytes(i if chr(i).isalnum() else 32 for i in range(256))
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def _kinds_of(text: str) -> tuple[list[int], bool]:
    """How many characters of each kind, and whether all word characters are in Latin-1."""
    plain = text.encode("ascii", "ignore")
    n = list(map(plain.translate(_KIND_BYTES).count, range(7)))
    latin = True
    if len(plain) < len(text):
        for c in _NOT_ASCII.findall(text):
            k = _KINDS[c]
            n[k] += 1
            if k <= _Kinds.NUMBER and c > "\xff":
                latin = False
    return n, latin


def _words_of(text: str, latin: bool) -> list[str]:
    """Runs of word characters. Characters beyond Latin-1 are none where `latin`, so they may all be the same."""
    if latin:
        return text.encode("latin-1", "replace").translate(_WORD_BYTES).decode("latin-1").split()
    return _WORD.findall(text)


class Common(dict):
    """Lower-case words: 1 for a common one, HEX more for one that may be a group of hex digits. Words are looked up once."""

    HEX, MOST = 1 << 32, 500_000

    def __init__(self, words: Iterable[str]):
        super().__init__()
        self.words = frozenset(words)

    def __missing__(self, word: str) -> int:
        if len(self) > self.MOST:
            self.clear()
        self[word] = got = (word in self.words) + self.HEX * (len(word) in (2, 8) and _HEX.fullmatch(word) is not None)
        return got


@dataclass
class Line:
    """A line, or the part of it seen so far: how it begins and ends, and its delimiters."""

    head: str = ""  # from the first visible character on
    ended: bool = False  # by a sentence's end, white space and closing marks after it left out
    pipes: int = 0
    cells: int = 0  # tabs, semicolons, commas without a space, wide gaps
    tags: int = 0
    leaders: int = 0

    @classmethod
    def of(cls, text: str) -> "Line":
        body = text.strip()
        if not body:
            return cls()
        cells = text.count("\t") + text.count(";") - text.count("; ")
        if "," in text:
            cells += len(_COMMA.findall(text))
        if "   " in body:
            cells += len(_GAP.findall(body))
        tags = len(_TAG.findall(text)) if "<" in text else 0
        leaders = len(_LEADER.findall(text)) if "..." in text or "……" in text else 0
        return cls(text.lstrip()[:MARKER], body.rstrip(_CLOSERS).endswith(_ENDS), text.count("|"), cells, tags, leaders)

    def join(self, other: "Line") -> "Line":
        """This part followed by the other. A line is cut within a word or not at all, so delimiters add up."""
        if not self.head or not other.head:
            return other if other.head else self
        return Line((self.head + other.head)[:MARKER], other.ended, self.pipes + other.pipes, self.cells + other.cells, self.tags + other.tags, self.leaders + other.leaders)


@dataclass
class Sums:
    """What adds up over chunks."""

    chars: int = 0
    spaces: int = 0
    symbols: int = 0
    letters: int = 0
    vowels: int = 0
    digits: int = 0
    words: int = 0
    word_chars: int = 0
    common: int = 0
    hexes: int = 0
    long_chars: int = 0
    repeats: int = 0
    lines: int = 0
    punctuated: int = 0
    items: int = 0
    rows: int = 0
    tags: int = 0
    toc: int = 0

    def add(self, other: "Sums") -> None:
        for k, v in vars(other).items():
            setattr(self, k, getattr(self, k) + v)


@dataclass
class Partial:
    """Sums over what is whole, and the state at both borders.

    first and last: the lines that touch the borders, the same one while `breaks` is false.
    open_start, open_end: the words that touch them, kept out of the sums until they are whole.
    """

    sums: Sums = field(default_factory=Sums)
    breaks: bool = False
    first: Line = field(default_factory=Line)
    last: Line = field(default_factory=Line)
    open_start: str = ""
    open_end: str = ""
    solid: bool = True  # no character outside a word so far: open_start is all there is
    early: list[str] = field(default_factory=list)  # the first three whole words
    late: list[str] = field(default_factory=list)  # the last three


def _close_line(s: Sums, line: Line) -> None:
    if not line.head:
        return
    s.lines += 1
    s.punctuated += line.ended
    s.items += _ITEM.match(line.head) is not None
    s.rows += line.pipes >= 2 or line.cells >= 1 or line.tags >= 1
    s.tags += line.tags
    s.toc += line.leaders >= 1


def _close_plain(s: Sums, lines: Iterable[str]) -> None:
    """The same for whole lines of a chunk without any delimiter but commas."""
    for x in lines:
        body = x.strip()
        if body:
            s.lines += 1
            if body.endswith(_ENDS) or body[-1] in _CLOSERS and body.rstrip(_CLOSERS).endswith(_ENDS):
                s.punctuated += 1
            # A marker's first character isn't a letter, or its second is a dot or a bracket.
            if (not body[0].isalpha() or body[1:2] in (".", ")")) and _ITEM.match(x.lstrip()[:MARKER]):
                s.items += 1
            if "," in x and _COMMA.search(x):
                s.rows += 1


def _add_words(p: Partial, words: list[str], common: Common) -> None:
    """Whole words that follow those of p."""
    s, new = p.sums, list(map(str.lower, words))
    flags = sum(map(common.__getitem__, new))
    s.common += flags % Common.HEX
    s.hexes += flags // Common.HEX
    seen = ["", "", "", *p.late][-3:] + new
    s.repeats += len([1 for a, b, c, d in zip(seen[3:], seen[2:], seen[1:], seen) if a == b or a == c or a == d])
    s.words += len(words)
    sizes = list(map(len, words))
    s.word_chars += sum(sizes)
    if sizes and max(sizes) > 24:
        s.long_chars += sum(n for n in sizes if n > 24)
    if len(p.early) < 3:
        p.early = (p.early + new[:3])[:3]
    p.late = (p.late + new)[-3:] if len(new) < 3 else new[-3:]


def partial(text: str, common: Common) -> Partial:
    """The partial result of one chunk."""
    p = Partial()
    if not text:
        return p
    s = p.sums
    plain = _TAG.sub(" ", text) if "<" in text else text
    n, latin = _kinds_of(plain)
    s.chars = len(text)
    s.spaces = n[_Kinds.SPACE] if plain is text else s.chars - sum(map(len, text.split()))
    s.letters, s.vowels, s.digits, s.symbols = n[_Kinds.LETTER] + n[_Kinds.VOWEL], n[_Kinds.VOWEL], n[_Kinds.DIGIT], n[_Kinds.SYMBOL]
    if "..." in plain or "……" in plain:
        s.symbols -= sum(map(len, _LEADER.findall(plain)))
    lines = _BREAK.split(text) if "\r" in text else text.split("\n")
    p.first = Line.of(lines[0])
    p.breaks = len(lines) > 1
    p.last = Line.of(lines[-1]) if p.breaks else p.first
    if any(map(text.__contains__, ("|", "\t", ";", "<", "   ", "...", "……"))):
        for x in lines[1:-1]:
            _close_line(s, Line.of(x))
    else:
        _close_plain(s, lines[1:-1])
    words = _words_of(plain, latin)
    if words and len(words[0]) == len(plain):
        p.open_start = plain
        return p
    p.solid = False
    if words and plain.startswith(words[0]):
        p.open_start = words.pop(0)
    if words and plain.endswith(words[-1]):
        p.open_end = words.pop()
    _add_words(p, words, common)
    return p


def merge(a: Partial, b: Partial, common: Common) -> Partial:
    """The partial result of a's text followed by b's."""
    if not b.sums.chars:
        return a
    if not a.sums.chars:
        return b
    out = Partial(sums=Sums(**vars(a.sums)), early=list(a.early), late=list(a.late))
    # Lines: the two that meet are one.
    met = a.last.join(b.first) if a.breaks else a.first.join(b.first)
    if not a.breaks:
        out.first = met
    else:
        out.first = a.first
        if b.breaks:
            _close_line(out.sums, met)
    out.breaks = a.breaks or b.breaks
    out.last = b.last if b.breaks else met
    # Words: so are the two that meet, or the one of them that is there.
    left, right = (a.open_start if a.solid else a.open_end), b.open_start
    joint = left + right
    out.solid = a.solid and b.solid
    if out.solid:
        out.open_start = joint
    elif a.solid:
        out.open_start, out.open_end = joint, b.open_end
    elif b.solid:
        out.open_start, out.open_end = a.open_start, joint
    else:
        out.open_start, out.open_end = a.open_start, b.open_end
        if joint:
            _add_words(out, [joint], common)
    # b's first words may repeat a's last.
    chain = out.late + b.early
    k = len(out.late)
    before = sum(w in b.early[max(0, i - 3) : i] for i, w in enumerate(b.early))
    after = sum(chain[i] in chain[max(0, i - 3) : i] for i in range(k, len(chain)))
    out.sums.add(b.sums)
    out.sums.repeats += after - before
    out.early = (out.early + b.early)[:3]
    out.late = (out.late + b.late)[-3:] if len(b.late) < 3 else b.late
    return out


def finish(p: Partial, common: Common) -> Sums:
    """The sums of a whole text: what touches the borders is whole now."""
    q = Partial(sums=Sums(**vars(p.sums)), early=[], late=[])
    _close_line(q.sums, p.first)
    if p.breaks:
        _close_line(q.sums, p.last)
    if p.open_start:
        # Before the first words: what repeats it there counts as it does within a text.
        tail = [p.open_start.lower(), *p.early]
        old = sum(w in p.early[max(0, i - 3) : i] for i, w in enumerate(p.early))
        new = sum(tail[i] in tail[max(0, i - 3) : i] for i in range(1, len(tail)))
        _add_words(q, [p.open_start], common)
        q.sums.repeats += new - old
        q.late = tail[-3:]
    if p.open_end:
        q.late = p.late if len(p.late) >= 3 or not p.open_start else [p.open_start.lower(), *p.late][-3:]
        _add_words(q, [p.open_end], common)
    return q.sums


#: Bounds of the rules, as shares.
PROSE_COMMON, TABLE_ROWS, TABLE_TAGS, LIST_ITEMS = 0.235, 0.5, 8, 0.5
JUNK_SYMBOLS, JUNK_REPEATS, JUNK_HEX, JUNK_LONG, JUNK_VOWELS, JUNK_WORD, JUNK_TORN = 0.4, 0.6, 0.75, 0.5, 0.18, 1.7, 2.6


def kind(s: Sums) -> str | None:
    """prose, list, table or junk; None for a text without a visible character."""
    if s.chars == s.spaces:
        return None
    seen = s.chars - s.spaces
    if not s.words:
        return "junk"
    mean, symbols = s.word_chars / s.words, s.symbols / seen
    if (
        (mean < JUNK_WORD and symbols > 0.15)
        or (mean < JUNK_TORN and symbols > 0.25 and s.digits < 0.05 * s.letters)
        or symbols > JUNK_SYMBOLS
        or (s.words > 8 and s.repeats > JUNK_REPEATS * s.words)
        or s.hexes > JUNK_HEX * s.words
        or s.long_chars > JUNK_LONG * s.word_chars
        or (s.letters > 20 and s.vowels < JUNK_VOWELS * s.letters)
    ):
        return "junk"
    common = s.common / s.words
    if s.lines and s.toc >= LIST_ITEMS * s.lines:
        return "list"
    if s.tags >= TABLE_TAGS and common < PROSE_COMMON:
        return "table"
    if s.lines and s.items >= LIST_ITEMS * s.lines and common < 0.3:
        return "list"
    if common >= PROSE_COMMON:
        return "prose"
    if s.lines and s.rows >= TABLE_ROWS * s.lines:
        return "table"
    return "list"


STATS = T.StructType(
    [
        T.StructField("word_count", T.LongType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("punctuated_lines", T.DoubleType()),
        T.StructField("common_words", T.DoubleType()),
        T.StructField("kind", T.StringType()),
    ]
)


def _row(s: Sums) -> tuple:
    seen = s.chars - s.spaces
    share = lambda a, b: round(a / b, 6) if b else 0.0
    return s.words, share(s.word_chars, s.words), share(s.symbols, seen), share(s.punctuated, s.lines), share(s.common, s.words), kind(s)


def _pack(p: Partial) -> str:
    return json.dumps(asdict(p), ensure_ascii=False)


def _unpack(text: str) -> Partial:
    d = json.loads(text)
    return Partial(Sums(**d.pop("sums")), first=Line(**d.pop("first")), last=Line(**d.pop("last")), **d)


def combine(parts: list[Partial], common: Common) -> Partial:
    """Partials in order as one: a tree of groups of FAN."""
    while len(parts) > 1:
        groups = [parts[i : i + FAN] for i in range(0, len(parts), FAN)]
        parts = []
        for g in groups:
            total = g[0]
            for x in g[1:]:
                total = merge(total, x, common)
            parts.append(total)
    return parts[0] if parts else Partial()


def sums(text: str, common: Common, chunk: int = CHUNK) -> Sums:
    """The sums of a text: chunks, partials and their tree."""
    return finish(combine([partial(x, common) for x in cuts(text, chunk)], common), common)


def word_set(common_words: DataFrame, most: int = 1_000_000) -> frozenset[str]:
    """The distinct words of a list of frequent words, lower case. A list of over `most` is refused."""
    words = frozenset(r[0].lower() for r in common_words.select("word").where("word is not null").distinct().limit(most + 1).toLocalIterator())
    if len(words) > most:
        raise ValueError("common_words is a list of frequent words; it has over a million")
    return words


def statistics(df: DataFrame, key: str, text: str, common_words: DataFrame, *, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(key, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words, kind), a row a key.

    Words are runs of letters and digits; symbols the other visible characters without table tags,
    bars, hyphens and dot leaders, as a share of all visible ones; lines are those with a visible character. Null, empty
    and blank texts have counts and ratios of 0 and a null kind. Rows that repeat under a key count
    once; of different texts under one key one is taken, always the same. common_words holds a
    column `word`; it is read to the driver, and refused beyond a million words. Texts of over `spread`
    characters are cut into chunks of that size, which go over the cluster; the result is the same.
    """
    words = word_set(common_words)
    kind_of_key = df.schema[key].dataType
    value = F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"\r\n?", "\n")
    rows = df.select(F.col(f"`{key}`").alias("key"), value.alias("text"))
    small, large = rows.where(F.char_length("text") <= spread), rows.where(F.char_length("text") > spread)
    out = T.StructType([T.StructField("key", kind_of_key), *STATS.fields, T.StructField("first_of", T.LongType())])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = Common(words)
        for b in batches:
            found = [_row(sums(t, common, chunk)) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], **dict(zip(STATS.names, zip(*found))), "first_of": b["first_of"]}) if len(b) else pd.DataFrame(columns=out.names)

    done = small.select("key", "text", F.xxhash64("text").alias("first_of")).mapInPandas(whole, out)

    at = [T.StructField("key", kind_of_key), T.StructField("doc", T.LongType()), T.StructField("at", T.LongType())]
    states = T.StructType([*at, T.StructField("state", T.StringType())])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, d, t in zip(b["key"], b["doc"], b["text"]):
                for i, x in enumerate(cuts(t, spread)):
                    yield pd.DataFrame({"key": [k], "doc": [d], "at": [i], "text": [x]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = Common(words)
        for b in batches:
            yield b[["key", "doc", "at"]].assign(state=[_pack(combine([partial(x, common) for x in cuts(t, chunk)], common)) for t in b["text"]])

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = Common(words)
        for b in batches:
            yield b[["key", "doc", "at"]].assign(state=[_pack(combine(list(map(_unpack, x)), common)) for x in b["states"]])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = Common(words)
        for b in batches:
            found = [_row(finish(_unpack(x), common)) for x in b["state"]]
            yield pd.DataFrame({"key": b["key"], **dict(zip(STATS.names, zip(*found))), "first_of": b["doc"]}) if len(b) else pd.DataFrame(columns=out.names)

    tree = large.select("key", F.xxhash64("text").alias("doc"), "text").mapInPandas(pieces, T.StructType([*at, T.StructField("text", T.StringType())]))
    tree = tree.repartition("key", "doc", "at").mapInPandas(part, states)
    for _ in range(3):
        # A set of FAN states at most; chunks of rows that repeat are equal.
        group = tree.groupBy("key", "doc", F.floor(F.col("at") / FAN).alias("at")).agg(F.sort_array(F.collect_set(F.struct("at", "state"))).alias("s"))
        tree = group.select("key", "doc", "at", F.col("s.state").alias("states")).mapInPandas(level, states)
    done = done.unionByName(tree.mapInPandas(last, out))
    one = done.groupBy("key").agg(F.min_by(F.struct(*STATS.names), "first_of").alias("s"))
    return one.select(F.col("key").alias(key), "s.*")
