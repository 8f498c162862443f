"""Repair of text from scanned pages.

Running headers and footers are edge lines that recur in a scan once page numbers are taken out and
confusable characters folded together. The rest of a page is one stream without line ends, read by a
Viterbi decoder: tokens are kept, corrected by confusions, joined over a line-end hyphen (as a word or
as a compound that owns the hyphen), merged with the next or split into words, which may be misread
themselves, whichever gives the likeliest words. Where words are in no doubt there is one path only, so
the decoder works on the stretches between them. Word costs come from a lexicon counted over all pages
and, for words outside it, from a character model of the lexicon's words. Paragraph boundaries are then
chosen by dynamic programming over the lines.

Pages are read twice: once for word counts and edge lines, once to decode them.
"""

from __future__ import annotations

import copy
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import quality
from quire.session import use_checkpoints

#: Misread form and what was printed, as seen in scans.
CONFUSIONS = (
    ("€", "e"), ("¢", "e"), ("@", "a"), ("1", "i"), ("1", "l"), ("|", "i"), ("|", "l"), ("!", "l"), ("!", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("9", "g"),
    ("8", "b"), ("+", "t"), ("(", "c"), ("и", "n"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("m", "rn"),
)
#: Of these, characters that are not letters of a word; the others are letters that stand for others.
ODD = frozenset("€¢@1|!05698+(иſﬁﬂ")
HYPHENS = "-‐\xad¬"

#: Words that every worker holds, most frequent first; their counts are over all pages. Counts of rarer words are joined to the pages that ask for them.
LEXICON_WORDS = 200_000
#: A word is taken for a misreading of another so many times as frequent.
DOMINATES = 12
#: Lines at each edge of a page that may make up a running header or footer.
EDGE_LINES = 2
#: A word takes part in splits and merges from this share of all words on, and from two on.
COMMON_SHARE = 1e-6
#: Above this cost a token is in doubt: it may be split or merged with a neighbour.
DOUBT = 12.0
#: Costs in nats of a misread character, a line-end hyphen, a lost and a spurious space; of a word outside the lexicon.
CONFUSED, HYPHENED, SPLIT, MERGED, UNKNOWN = 6.0, 0.5, 11.0, 9.0, 7.0

_BREAK = re.compile(r"\r\n?|\n")
_ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})|c{1,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: A line that holds a page number and nothing else: bare, in dashes or brackets, of a total, with a word for page.
_NUMBER = re.compile(
    rf"[-–—~|*·\[(<\s]*(?:(?:page|pg|p|seite|s|página|pagina|pág|blatt|feuille|folio|f)\b\.?\s*)?(?P<n>\d{{1,5}}|{_ROMAN})(?:\s*(?:/|of|von|de|sur|aus)\s*(?P<of>\d{{1,5}}))?[-–—~|*·\])>\s]*", re.I
)
_LEAD, _TRAIL = "([{“”„«»\"'‘’–—•·*", ".,;:!?)]}“”»«\"'’‘…–—"
_CITE = re.compile(r"\[\d+\][.,;:!?”)]*$")


def page_number(line: str) -> int | None:
    """The number of a line that holds a page number only."""
    text = line.strip()
    m = _NUMBER.fullmatch(text) if text else None
    if not m:
        return None
    n = m.group("n")
    return int(n) if n.isdigit() else _roman(n.lower())


def _roman(text: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, [*text[1:], None]):
        total += -value[a] if b and value[a] < value[b] else value[a]
    return total


#: Characters as the strokes they may be misread in; a misread form and what was printed come out alike.
STROKES = {"ﬁ": "fi", "ﬂ": "fi", "€": "e", "¢": "e", "@": "a", "и": "n", "0": "o", "+": "t", "5": "s", "ſ": "s", "(": "c", "9": "g", "6": "b", "8": "b", "1": "i", "|": "i", "!": "i", "l": "i", "d": "ci", "u": "ii", "h": "ii", "m": "rn", "w": "vv"}


def strokes(text: str) -> str:
    """No form holds a character that has one, so they are put in one after the other."""
    for c, form in STROKES.items():
        if c in text:
            text = text.replace(c, form)
    return text


_COUNTER, _BLANK = re.compile(r"(?<!\S)[\d|./-]+(?!\S)"), re.compile(r"[\W_]+")


def fold(line: str) -> str:
    """A line without numbers, case and white space, confusable characters made equal."""
    return _BLANK.sub("", strokes(_COUNTER.sub(" ", line.lower())))


@dataclass
class Edges:
    """Lines of a page and what lies at its edges."""

    lines: list[str]
    top: list[int]  # the first visible lines, outermost first
    bottom: list[int]
    numbers: dict[int, int]  # line -> page number, for lines at an edge that hold nothing else


def edges(content: str) -> Edges:
    lines = _BREAK.split(content or "")
    seen = [i for i, x in enumerate(lines) if x.strip()]
    numbers, sides = {}, []
    for order in (seen, seen[::-1]):
        side = []
        for i in order:
            n = page_number(lines[i])
            if n is not None and all(k in numbers for k in side) and len(side) < 2:
                numbers[i] = n
                side.append(i)
                continue
            side.append(i)
            # A number may also stand under the header or over the footer.
            break
        after = order[len(side) : len(side) + 1]
        if after and (n := page_number(lines[after[0]])) is not None and len(seen) > 3:
            numbers[after[0]] = n
            side.append(after[0])
        sides.append(side)
    return Edges(lines, sides[0], sides[1], numbers)


def edge_lines(e: Edges) -> list[tuple[int, int]]:
    """(place, line) of lines that may be running ones: at each edge the outermost but for page numbers, and those that adjoin it.

    place is twice the depth from the edge, and one more at the bottom.
    """
    out = []
    for at_bottom, side in ((0, e.top), (1, e.bottom)):
        i = next((i for i in side if i not in e.numbers), None)
        depth = 0
        while i is not None and depth < EDGE_LINES and 0 <= i < len(e.lines) and e.lines[i].strip() and i not in e.numbers:
            out.append((2 * depth + at_bottom, i))
            i, depth = i - 1 if at_bottom else i + 1, depth + 1
    return out


def running(places: dict[int, int]) -> set[int]:
    """Of place -> line of recurring lines, the lines that reach the edge without a gap."""
    out = set()
    for at_bottom in (0, 1):
        at = at_bottom
        while at in places:
            out.add(places[at])
            at += 2
    return out


# --- words ------------------------------------------------------------------------------------


def core(token: str) -> tuple[int, int]:
    """Where the word lies in a token, punctuation around it left out."""
    rest = token.lstrip(_LEAD)
    a = len(token) - len(rest)
    return a, a + len(rest.rstrip(_TRAIL))


def is_word(text: str) -> bool:
    letters = text.replace("-", "").replace("'", "").replace("’", "")
    return letters.isalpha()


def readings(word: str) -> tuple[tuple[str, int], ...]:
    """(what may have been printed, confusions undone) for a lower-case word: the odd characters all undone, and at most one other place."""
    spots = []
    for bad, good in CONFUSIONS:
        at = word.find(bad)
        while at >= 0:
            spots.append((at, bad, good))
            at = word.find(bad, at + 1)
    odd = {at for at, c in enumerate(word) if c in ODD}
    if not spots or len(odd) > 3:  # see Lexicon.undo
        return ()
    forced = [[x for x in spots if x[0] == at] for at in sorted(odd)]
    free = [x for x in spots if x[0] not in odd]
    out = {}
    for choice in product(*forced):
        for extra in [(), *[(x,) for x in free]]:
            edits = sorted([*choice, *extra])
            if not edits or any(x[0] + len(x[1]) > y[0] for x, y in zip(edits, edits[1:])):
                continue
            text, last = [], 0
            for at, bad, good in edits:
                text += [word[last:at], good]
                last = at + len(bad)
            out["".join([*text, word[last:]])] = len(edits)
    return tuple(out.items())


def confusions(bad: str, good: str) -> int | None:
    """The fewest confusions that turn what was printed into the form met; None where none do."""
    best = {(0, 0): 0}
    for i in range(len(bad) + 1):
        for j in range(len(good) + 1):
            n = best.get((i, j))
            if n is None:
                continue
            steps = [(1, 1, 0)] if bad[i : i + 1] == good[j : j + 1] else []
            steps += [(len(b), len(g), 1) for b, g in CONFUSIONS if bad.startswith(b, i) and good.startswith(g, j)]
            for di, dj, more in steps:
                at = i + di, j + dj
                if at[0] <= len(bad) and at[1] <= len(good) and n + more < best.get(at, math.inf):
                    best[at] = n + more
    return best.get((len(bad), len(good)))


class Lexicon:
    """Word costs: -log of the share for known words, a character model for others."""

    ORDER = 4

    def __init__(self, counts: dict[str, int]):
        words = {w: n for w, n in counts.items() if is_word(w) and ODD.isdisjoint(w)}
        alike: dict[str, list[str]] = defaultdict(list)
        for w in words:
            alike[strokes(w)].append(w)
        self.counts = dict(words)
        for group in alike.values():
            if len(group) > 1:
                for w in group:
                    if any(words[c] >= DOMINATES * words[w] and confusions(w, c) for c in group):
                        del self.counts[w]
        self.alike = {k: [w for w in g if self.known(w)] for k, g in alike.items()}
        self.total = sum(self.counts.values()) + 1
        self.least = max(2, math.ceil(COMMON_SHARE * self.total))
        self.longest = max(map(len, self.counts), default=0)
        grams: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for w in self.counts:
            text = "^" * (self.ORDER - 1) + w + "$"
            for i in range(self.ORDER - 1, len(text)):
                for k in range(self.ORDER):
                    grams[text[i - k : i]][text[i]] += 1
        self.grams = {h: (sum(c.values()), dict(c)) for h, c in grams.items()}
        self.memo: dict[str, float] = {}
        self.after: dict[str, float] = {}
        self.read: dict[str, tuple[float, str, int]] = {}
        self.parts: dict[str, tuple[float, list[str]] | None] = {}
        #: Tokens in no doubt that stand as they are.
        self.sure: set[str] = set()

    def known(self, word: str) -> bool:
        return self.counts.get(word, 0) > 1

    def frequent(self, word: str) -> bool:
        return self.counts.get(word, 0) >= self.least

    def _surprise(self, context: str, c: str) -> float:
        """-log probability of a character after the ORDER - 1 before it, shorter contexts smoothing longer ones (Witten-Bell)."""
        got = self.after.get(context + c)
        if got is None:
            p = 1e-4
            for k in range(self.ORDER):
                found = self.grams.get(context[len(context) - k :])
                if found:
                    total, after = found
                    p = (after.get(c, 0) + len(after) * p) / (total + len(after))
            if len(self.after) > 300_000:
                self.after.clear()
            self.after[context + c] = got = -math.log(p)
        return got

    def spelling(self, word: str) -> float:
        """-log probability of the word's characters."""
        got = self.memo.get(word)
        if got is not None:
            return got
        n = self.ORDER - 1
        text = "^" * n + word + "$"
        out = sum(self._surprise(text[i - n : i], text[i]) for i in range(n, len(text)))
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def undo(self, word: str) -> str:
        """The likeliest spelling of a word with all its odd characters undone (Viterbi over the character model's contexts)."""
        n = self.ORDER - 1
        paths = {"^" * n: (0.0, "")}
        for c in word:
            goods = [g for b, g in CONFUSIONS if b == c] if c in ODD else [c]
            after: dict[str, tuple[float, str]] = {}
            for context, (cost, text) in paths.items():
                for good in goods:
                    here, at = cost, context
                    for x in good:
                        here += self._surprise(at, x)
                        at = (at + x)[-n:]
                    if at not in after or here < after[at][0]:
                        after[at] = here, text + good
            paths = after
        return min((cost + self._surprise(at, "$"), text) for at, (cost, text) in paths.items())[1]

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        if n > 1:
            return -math.log(n / self.total)
        if not any(map(str.isalpha, word)):
            return 4.0 + len(word)
        if "-" in word.strip("-"):
            parts = [p for p in word.split("-") if p]
            return 3.0 + sum(map(self.cost, parts))
        return UNKNOWN + self.spelling(word)

    def candidates(self, word: str) -> dict[str, int]:
        """What may have been printed for a lower-case word, and the confusions undone: near forms, known words however often misread, and all odd characters undone."""
        out = dict(readings(word))
        for w in self.alike.get(strokes(word), ()):
            if w not in out and w != word and (n := confusions(word, w)) and 2 * n <= len(w):
                out[w] = n
        odd = sum(c in ODD for c in word)
        if odd > 3:
            out.setdefault(self.undo(word), odd)
        return out

    def segments(self, word: str) -> tuple[float, list[str]] | None:
        """(cost, lengths) of the cheapest cut of an unknown lower-case word into frequent ones, misread or not; None where there is none."""
        if word in self.parts:
            return self.parts[word]
        n, forms = len(word), [STROKES.get(c, c) for c in word]
        best: list[tuple[float, int, str] | None] = [(0.0, 0, ""), *[None] * n]
        for j in range(2, n + 1):
            for i in range(max(0, j - self.longest), j - 1):
                if best[i] is None or (i == 0 and j == n):
                    continue
                part = word[i:j]
                if self.counts.get(part, 0) >= self.least:
                    options = [(self.cost(part), part)]
                elif alike := self.alike.get("".join(forms[i:j])):
                    options = [(self.cost(w) + CONFUSED * k, w) for w in alike if self.frequent(w) and (k := confusions(part, w))]
                else:
                    continue
                for cost, w in options:
                    cost += best[i][0] + (SPLIT if i else 0.0)
                    if best[j] is None or cost < best[j][0]:
                        best[j] = cost, i, w
        found, j = [], n
        while j and best[j]:
            found.append(best[j][2])
            j = best[j][1]
        got = (best[n][0], found[::-1]) if best[n] and len(found) > 1 else None
        if len(self.parts) > 200_000:
            self.parts.clear()
        self.parts[word] = got
        return got


class _Asked:
    """Counts that remember which words they don't have."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.missed = counts, set()

    def get(self, word: str, default: int = 0) -> int:
        got = self.counts.get(word)
        if got is None:
            self.missed.add(word)
            return default
        return got


class _Joined:
    """Two mappings as one."""

    def __init__(self, base: Any, more: dict):
        self.base, self.more = base, more

    def get(self, key: str, default: Any = None) -> Any:
        got = self.base.get(key)
        if got is None:
            return self.more.get(key, default)
        return got + self.more.get(key, []) if isinstance(got, list) else got


def _fresh(lex: Lexicon, counts: Any) -> Lexicon:
    """The lexicon with other counts, nothing remembered of those it had."""
    new = copy.copy(lex)
    new.counts, new.read, new.parts, new.sure = counts, {}, {}, set()
    return new


def asked_words(lines: list[tuple[int, str]], lex: Lexicon) -> set[str]:
    """Words whose counts a page's decoding may ask for beyond the lexicon. An unknown word is asked for most, so none is left out."""
    asked = _Asked(lex.counts)
    decode(lines, _fresh(lex, asked))
    return {w for w in asked.missed if is_word(w)}


def with_words(lex: Lexicon, words: dict[str, int]) -> Lexicon:
    """The lexicon with the counts of some rarer words."""
    new = _fresh(lex, _Joined(lex.counts, words))
    alike: dict[str, list[str]] = defaultdict(list)
    for w in words:
        if ODD.isdisjoint(w):
            alike[strokes(w)].append(w)
    new.alike = _Joined(lex.alike, alike)
    return new


# --- decoding ---------------------------------------------------------------------------------


@dataclass
class Token:
    text: str
    hyphen: bool = False  # at a line's end, with a hyphen as its last character
    line: int = 0
    last: bool = False  # at a line's end


@dataclass
class Reading:
    """Decoded tokens and the noise undone."""

    lines: list[tuple[int, list[str]]] = field(default_factory=list)  # tokens by the line they began on
    hyphens: int = 0
    misreads: int = 0
    splits: int = 0
    merges: int = 0

    @property
    def words(self) -> list[tuple[str, int]]:
        return [(w, i) for i, ws in self.lines for w in ws]

    def of(self, line: int) -> list[str]:
        """The tokens of a line, which is the last one or comes after it."""
        if not self.lines or self.lines[-1][0] != line:
            self.lines.append((line, []))
        return self.lines[-1][1]


def _hyphen(text: str) -> bool:
    return len(text) > 1 and text[-1] in HYPHENS and text[-2].isalpha()


def _best(lex: Lexicon, text: str) -> tuple[float, str, int]:
    """(cost, text, characters corrected) of the best reading of one token, remembered as tokens recur."""
    got = lex.read.get(text)
    if got is None:
        if len(lex.read) > 200_000:
            lex.read.clear()
            lex.sure.clear()
        got = lex.read[text] = _read_token(lex, text)
        if got[0] <= DOUBT and got[1] == text and not _hyphen(text):
            lex.sure.add(text)
    return got


def _read_token(lex: Lexicon, text: str) -> tuple[float, str, int]:
    a, b = core(text)
    word = text[a:b]
    low = word.lower()
    if not word or lex.known(low):
        return (lex.cost(low) if word else 1.0), text, 0
    if _CITE.search(text) or not any(map(str.isalpha, word)) or sum(map(str.isalpha, word)) < 2:
        # A bracket or bar may have replaced a letter at the token's edge; a bare number has no letters.
        if sum(map(str.isalpha, text)) < 2:
            return 4.0 + len(word), text, 0
    found = (lex.cost(low) if is_word(low) else UNKNOWN + 5.0 + lex.spelling(low), text, 0)
    spans = {(a, b)}
    if a and text[a - 1] in "(!|":
        spans.add((a - 1, b))
    if b < len(text) and text[b] in "!(|":
        spans.add((a, b + 1))
    for x, y in sorted(spans):
        wide = text[x:y].lower()
        for reading, n in lex.candidates(wide).items():
            if not is_word(reading):
                continue
            known = lex.known(reading)
            if (x, y) != (a, b) and not known:
                continue
            odd = sum(c in ODD for c in wide)
            if not known and odd and any(c.isdigit() for c in wide) and sum(map(str.isalpha, wide)) < 3:
                continue
            cost = lex.cost(reading) + CONFUSED * n
            if cost < found[0]:
                found = (cost, text[:x] + _like(reading, text[x:y]) + text[y:], n)
    return found


def _like(word: str, shape: str) -> str:
    letters = [c for c in shape if c.isalpha()]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return word.upper()
    return word[:1].upper() + word[1:] if shape[:1].isupper() else word


def decode(lines: list[tuple[int, str]], lex: Lexicon) -> Reading:
    """The cheapest reading of numbered lines as one stream.

    Tokens in no doubt pass; a stretch from the token before a doubtful one to the first two in no
    doubt is read by Viterbi over its positions, no edge leading over its ends.
    """
    out, held, sure = Reading(), [], lex.sure
    settled = 0  # tokens in no doubt at the end of what is held
    for i, line in lines:
        parts = line.split()
        if not held and sure.issuperset(parts):
            out.lines.append((i, parts))
            continue
        now = None if held else out.of(i)
        for k, p in enumerate(parts):
            if now is not None and p in sure:
                now.append(p)
                continue
            last = k == len(parts) - 1
            hyphen = last and _hyphen(p)
            cost, text, m = _best(lex, p)
            doubt = hyphen or cost > DOUBT
            if now is not None:
                if not doubt:
                    now.append(text)
                    out.misreads += m > 0
                    continue
                if k and now[-1:] == parts[k - 1 : k] and now[-1] in sure:
                    held.append(Token(now.pop(), False, i, False))
                now = None
            held.append(Token(p, hyphen, i, last))
            settled = 0 if doubt else settled + 1
            if settled == 2:
                _viterbi(held, lex, out)
                held, settled, now = [], 0, out.of(i)
    if held:
        _viterbi(held, lex, out)
    return out


def _viterbi(stream: list[Token], lex: Lexicon, out: Reading) -> None:
    """Adds the cheapest path through a stretch."""
    n = len(stream)
    best: list[tuple[float, tuple | None]] = [(0.0, None), *[(math.inf, None)] * n]
    plain = [_best(lex, t.text) for t in stream]

    def offer(i: int, j: int, cost: float, texts: list[str], h: int, m: int, s: int, g: int) -> None:
        if best[i][0] + cost < best[j][0]:
            best[j] = best[i][0] + cost, (i, texts, h, m, s, g)

    for i, t in enumerate(stream):
        cost, text, m = plain[i]
        follows = stream[i + 1] if i + 1 < n else None
        if t.hyphen and follows and follows.text[:1].isalpha() | (follows.text[:1] in ODD):
            whole, own = t.text[:-1] + follows.text, t.text[:-1] + "-" + follows.text
            c, x, k = _best(lex, whole)
            offer(i, i + 2, c + HYPHENED, [x], 1, k, 0, 0)
            c, x, k = _best(lex, own)
            cap = 0.0 if t.text[-1] in "-‐" else 4.0
            if not follows.text[:1].isupper() or t.text[:-1].isupper():
                cap += 1.0
            offer(i, i + 2, c + HYPHENED + cap, [x], 0, k, 0, 0)
            offer(i, i + 1, cost + 12.0, [text], 0, m, 0, 0)
            continue
        offer(i, i + 1, cost, [text], 1 if t.hyphen else 0, m, 0, 0)
        if cost > DOUBT:
            a, b = core(t.text)
            low = t.text[a:b].lower()
            if low.isalpha() and not lex.known(low) and (found := lex.segments(low)):
                pieces = [*found[1]]
                pieces[0] = t.text[:a] + _like(pieces[0], t.text[a:b])
                pieces[-1] += t.text[b:]
                wrong = "".join(found[1]) != low
                offer(i, i + 1, found[0], pieces, 0, int(wrong), 1, 0)
        if follows and follows.text[:1].islower() and not t.last and (cost > DOUBT or plain[i + 1][0] > DOUBT):
            joined = t.text + follows.text
            p, q = core(joined)
            if lex.frequent(joined[p:q].lower()):
                offer(i, i + 2, lex.cost(joined[p:q].lower()) + MERGED, [joined], 0, 0, 0, 1)
    j, steps = n, []
    while j:
        steps.append(best[j][1])
        j = best[j][1][0]
    for i, texts, h, m, s, g in reversed(steps):
        out.of(stream[i].line).extend(texts)
        out.hyphens += h
        out.misreads += m > 0
        out.splits += s
        out.merges += g


_SENTENCE_END = re.compile(r"[.!?:…][”\"'’»)\]]*$")


def paragraphs(lines: list[tuple[int, str]], all_lines: list[str]) -> list[int]:
    """First lines of the paragraphs of a page's body, by dynamic programming over its lines.

    A paragraph costs a constant, one of a single line somewhat more; a line inside one that is short of
    the page's width costs by how much it lacks, more if it ends a sentence; a boundary costs where the
    line before doesn't end a sentence or the next begins with a small letter, and gains by a blank line
    or an indentation. Each line is the first of a paragraph or goes on with one: two states, one pass.
    """
    if not lines:
        return []
    n = len(lines)
    stripped = [x.strip() for _, x in lines]
    ends = [len(x.rstrip()) for _, x in lines]
    width = sorted(ends)[int(0.8 * (n - 1))] or 1
    indents = [len(x) - len(x.lstrip()) for _, x in lines]
    base = min(indents)
    ended = [_SENTENCE_END.search(x) is not None for x in stripped]
    # cost[0], cost[1]: the cheapest reading of the lines so far in which the last one goes on, or is a first one.
    cost, back = (math.inf, 2.0), []
    for k in range(1, n):
        before, here = stripped[k - 1], stripped[k]
        lack = max(0.0, (width - ends[k - 1] - len(here.split(None, 1)[0]) - 1) / width)
        gap = lines[k][0] - lines[k - 1][0] > 1 and any(not all_lines[i].strip() for i in range(lines[k - 1][0] + 1, lines[k][0]))
        inside = 4.0 * gap * (2.0 if ended[k - 1] else 0.75) + (3.0 if indents[k] > base + 1 else 0.0) + 6.0 * lack * (1.5 if ended[k - 1] else 0.7)
        between = 2.0 + 6.0 * here[:1].islower() + 3.0 * (before[-1:] in HYPHENS) + 1.5 * (not ended[k - 1])
        on = (cost[0] + inside, 0) if cost[0] <= cost[1] else (cost[1] + inside, 1)
        new = (cost[0] + between, 0) if cost[0] <= cost[1] + 0.25 else (cost[1] + 0.25 + between, 1)
        back.append((on[1], new[1]))
        cost = on[0], new[0]
    state, firsts = int(cost[1] + 0.25 < cost[0]), []
    for k in range(n - 1, -1, -1):
        if state or not k:
            firsts.append(lines[k][0])
        if k:
            state = back[k - 1][state]
    return firsts[::-1]


# --- pages ------------------------------------------------------------------------------------

_SHAPE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("scan_id", T.LongType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)


def _pages(df: DataFrame) -> DataFrame:
    """Rows of pages with a digest of their text, `text_key`, by which marks find the text they were made from."""
    picked = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in _SHAPE]).where("page_id is not null")
    return picked.withColumn("text_key", F.xxhash64("content"))


_SEEN = "word string, n long, page_id long, text_key long, scan_id long, page_index int, line int, place int, folded string, number int, offset int, plain boolean"


def survey(pages: DataFrame) -> DataFrame:
    """One pass over the texts: rows (word, n) of each task's word counts, and of each page one with line -1 and those of its edges.

    Edge rows have `place` and `folded` of lines that may be running ones, or `number`, its `offset` to the
    page index and whether it is `plain`. Tokens are counted as they are and taken apart once each.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in _SEEN.split(", ")]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [f for f, _ in fields])

    def words(tokens: Counter) -> list[tuple]:
        counts: dict[str, int] = defaultdict(int)
        for t, n in tokens.items():
            a, z = core(t)
            if is_word(t[a:z]):
                counts[t[a:z].lower()] += n
        return [(w, n, *[None] * 10) for w, n in counts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        for batch in batches:
            b, out = batch.to_pydict(), []
            for page_id, key, scan_id, index, text in zip(b["page_id"], b["text_key"], b["scan_id"], b["page_index"], b["content"]):
                page = (None, None, page_id, key, scan_id, index)
                out.append((*page, -1, None, None, None, None, None))
                e = edges(text or "")
                for place, i in edge_lines(e):
                    f = fold(e.lines[i])
                    if len(f) > 1:
                        out.append((*page, i, place, f, None, None, None))
                for i, n in e.numbers.items():
                    plain = e.lines[i].strip()
                    out.append((*page, i, None, None, n, None if page[5] is None else n - page[5], plain.isdigit() or plain.isalpha()))
                met: list[str] = []
                for line in e.lines:
                    met += line.split()
                    if met and met[-1][-1] in HYPHENS and _hyphen(met[-1]):
                        met.pop()
                tokens.update(met)
            yield frame(out)
            if len(tokens) > 500_000:
                yield frame(words(tokens))
                tokens.clear()
        yield frame(words(tokens))

    return pages.mapInArrow(run, _SEEN)


def word_counts(seen: DataFrame) -> DataFrame:
    """(word, n) over all pages, lower case."""
    return seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(seen: DataFrame, most: int = LEXICON_WORDS) -> dict[str, int]:
    """The `most` most frequent words with their counts over all pages, which bounds what goes to the driver and workers."""
    top = word_counts(seen).where("n > 1 and char_length(word) > 0").orderBy(F.desc("n"), "word").limit(most)
    return {r["word"]: r["n"] for r in top.toLocalIterator()}


def running_lines(seen: DataFrame) -> DataFrame:
    """(page_id, text_key, headers, numbers), a row a page: places and lines of its recurring edge lines, and lines that are its number.

    A folded edge line recurs where two or more pages of the scan have it at that depth. Where page numbers of a
    scan go on with its page index, others are none; where there is no such pair of pages, a number
    counts unless it is a bare one of four digits, like a year. Of differing texts under one page_id
    always the same one is taken, first by scan and page index.
    """
    marks = seen.where("line >= 0").withColumn("depth", F.floor(F.col("place") / 2))
    one = seen.where("line = -1").groupBy("page_id").agg(F.min(F.struct("scan_id", "page_index", "text_key")).alias("x")).select("page_id", "x.text_key")
    # Pages of a scan per folded line, and per difference of page number and index, counted partly in the map.
    shared = marks.where("folded is not null").groupBy("scan_id", "depth", "folded").agg(F.count_distinct("page_id").alias("pages")).where("pages > 1")
    steady = marks.where("offset is not null").groupBy("scan_id", "offset").agg(F.count_distinct("page_id").alias("pages"))
    headers = marks.where("folded is not null").join(shared, ["scan_id", "depth", "folded"])
    best = steady.groupBy("scan_id").agg(F.max("pages").alias("best"))
    numbers = marks.where("number is not null").join(steady, ["scan_id", "offset"], "left").join(best, "scan_id", "left")
    steady_scan = F.coalesce(F.col("best") > 1, F.lit(False))
    alone = ~steady_scan & (~F.col("plain") | (F.col("number") < 1000))
    numbers = numbers.where(alone | F.coalesce(F.col("pages") > 1, F.lit(False)))
    found = headers.select("page_id", "text_key", "place", "line").unionByName(numbers.select("page_id", "text_key", F.lit(None).cast("int").alias("place"), "line"))
    lines = found.groupBy("page_id", "text_key").agg(
        F.collect_set(F.when(F.col("place").isNotNull(), F.struct("place", "line"))).alias("headers"), F.collect_set(F.when(F.col("place").isNull(), F.col("line"))).alias("numbers")
    )
    return one.join(lines, ["page_id", "text_key"], "left")


_LEXICON: dict[str, Lexicon] = {}


def _lexicon_of(name: str, counts: Any) -> Lexicon:
    """The lexicon of a broadcast, built once in each worker."""
    if name not in _LEXICON:
        _LEXICON.clear()
        _LEXICON[name] = Lexicon(counts.value)
    return _LEXICON[name]


def repair(df: DataFrame, common_words: DataFrame, *, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(page_id, kinds, repaired, n_hyphens, n_misreads, n_splits, n_merges), a row for each page.

    kinds holds those of 'hyphen', 'misread', 'header' and 'page_number' that the page has; repaired is
    its text as paragraphs of one line each, parted by blank lines, without headers and numbers. Null,
    empty and blank pages have no kinds and an empty text. Pages that are tables or junk keep their
    lines as they are, and only their headers and numbers are noise. Equal rows count once; pages
    without a scan share headers with none. What the first pass finds is written by checkpoint() while
    the plan is made; the most frequent words go from there to the driver and as a broadcast to workers, and where
    there are more than `lexicon_words`, the counts of the others are joined to the pages that need them.
    """
    pages = _pages(df)
    use_checkpoints(df.sparkSession)
    seen = survey(pages).checkpoint()
    words = lexicon(seen, lexicon_words)
    counts, name = df.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
    common = quality.word_set(common_words)
    # Only this join moves texts; rows that repeat lie together after it.
    marked = pages.join(running_lines(seen), ["page_id", "text_key"]).dropDuplicates(["page_id", "text_key"]).select("page_id", "content", "headers", "numbers")

    def body_of(content: str | None, headers: Any, numbers: Any) -> tuple[list[str], list[tuple[int, str]], set[int], set[int]]:
        drop_h = set() if headers is None else running({int(x["place"]): int(x["line"]) for x in headers})
        drop_n = set() if numbers is None else set(map(int, numbers))
        lines = _BREAK.split(content or "")
        return lines, [(i, x) for i, x in enumerate(lines) if x.strip() and i not in drop_h and i not in drop_n], drop_h, drop_n

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _lexicon_of(name, counts)
        for b in batches:
            out = [(p, w) for p, *x in zip(b["page_id"], b["content"], b["headers"], b["numbers"]) for w in asked_words(body_of(*x)[1], lex)]
            yield pd.DataFrame(out, columns=["page_id", "word"])

    if len(words) == lexicon_words:
        # More words than workers hold: each page gets the counts of those that its readings ask for.
        rare = marked.mapInPandas(ask, "page_id long, word string").join(word_counts(seen).where("n > 1"), "word").groupBy("page_id").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
        marked = marked.join(rare, "page_id", "left")
    else:
        marked = marked.withColumn("rare", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    schema = "page_id long, kinds array<string>, repaired string, n_hyphens int, n_misreads int, n_splits int, n_merges int"
    kinds_of = {"page_id": pa.int64(), "kinds": pa.list_(pa.string()), "repaired": pa.string(), **{f"n_{x}": pa.int32() for x in ("hyphens", "misreads", "splits", "merges")}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, often = _lexicon_of(name, counts), quality.Common(common)
        for batch in batches:
            b, out = batch.to_pydict(), []
            for page_id, content, headers, numbers, rare in zip(b["page_id"], b["content"], b["headers"], b["numbers"], b["rare"]):
                lines, body, drop_h, drop_n = body_of(content, headers, numbers)
                text = "\n".join(x for _, x in body)
                kind = quality.kind(quality.sums(text, often, quality.SPREAD))
                kinds = ["header"] * bool(drop_h) + ["page_number"] * bool(drop_n - drop_h)
                if kind in (None, "table", "junk"):
                    out.append((page_id, kinds, text, 0, 0, 0, 0))
                    continue
                r = decode(body, lex if rare is None else with_words(lex, {x["word"]: int(x["n"]) for x in rare}))
                kinds += ["hyphen"] * bool(r.hyphens)
                kinds += ["misread"] * bool(r.misreads)
                firsts = {i for i, _ in body} if kind == "list" else set(paragraphs(body, lines))
                gap, fixed = "\n\n" if kind == "prose" else "\n", []
                for line, words in r.lines:
                    if fixed and words:
                        fixed.append(gap if line in firsts else " ")
                    fixed.append(" ".join(words))
                out.append((page_id, kinds, "".join(fixed), r.hyphens, r.misreads, r.splits, r.merges))
            columns = zip(*out) if out else [[]] * len(kinds_of)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds_of.values())], list(kinds_of))

    return marked.mapInArrow(run, schema)
