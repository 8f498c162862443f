"""Text rules of the formatter as column expressions.

White space is Unicode's throughout, as `trim` alone knows spaces only; digits are any decimal digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\p{Z}\s\x{85}]"
_BLANK = r"[\p{Zs}\t]"  # white space without line ends


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x computed once. Rules that use their input several times, one upon another, would
    otherwise grow the plan's expression beyond what can be compiled."""
    return F.element_at(F.transform(F.array(x), f), 1)


def trim(x: Column) -> Column:
    """White space and line ends off both ends."""
    return F.regexp_replace(x, rf"^{_WHITE}+|{_WHITE}+$", "")


def trim_blanks(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+$", "")


def clean(x: Column) -> Column:
    r"""trims, takes the two characters \t off both ends, cuts runs of dots and underscores to three."""
    out = F.regexp_replace(trim(x), r"^(?:\\t)+|(?:\\t)+$", "")
    for run, three in ((r"\.{3,}", "..."), ("·{3,}", "···"), ("_{3,}", "___"), (r"(?:\\_){3,}", r"\\_\\_\\_")):
        out = F.regexp_replace(out, run, three)
    return trim(out)


def title(x: Column, mark: str) -> Column:
    """heading marks and one bullet off, then the mark. An empty title stays a bare mark."""
    bare = trim(F.regexp_replace(x, "^#+", ""))
    return F.concat(F.lit(mark), trim(F.regexp_replace(bare, r"^[-*] ", "")))


def formula(x: Column) -> Column:
    """one pair of delimiters off, then $$ on lines of their own."""


    def inner(t: Column) -> Column:
        out = F
        for a, b in (("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)")):
            out = out.when(t.startswith(a) & t.endswith(b) & (F.char_length(t) >= 4), F.substring(t, F.lit(3), F.char_length(t) - 4))
        return out.otherwise(t)

    return F.concat(F.lit("$$\n"), trim(let(trim(x), inner)), F.lit("\n$$"))


def bullet(x: Column) -> Column:
    """a leading dot, bullet or star becomes '- '."""
    # A dot becomes '- ', so that a star can't follow from it: the two cases exclude each other.
    rest = trim_blanks(F.regexp_replace(x, r"^(?:[·•]|\* )", ""))
    return F.when(x.rlike(r"^(?:[·•]|\* )"), F.concat(F.lit("- "), rest)).otherwise(x)


def numbering(x: Column) -> Column:
    """(1)x, 1.x, a)x and full-width brackets to one form and one space. Texts of several lines stay as they are."""
    enclosed = r"^[(（](\p{Nd}+|[A-Za-z])[)）]([^\n\r]*)$"
    suffixed = r"^(\p{Nd}+|[A-Za-z])([.)）])([^\n\r]*)$"

    def joined(head: Column, rest: Column) -> Column:
        return F.concat(head, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit(" "), rest)))

    one_line = ~x.rlike(r"[\n\r]")
    a = joined(F.concat(F.lit("("), F.regexp_extract(x, enclosed, 1), F.lit(")")), trim_blanks(F.regexp_extract(x, enclosed, 2)))
    b = joined(F.concat(F.regexp_extract(x, suffixed, 1), F.replace(F.regexp_extract(x, suffixed, 2), F.lit("）"), F.lit(")"))), trim_blanks(F.regexp_extract(x, suffixed, 3)))
    # A text has one of the two forms at most, as they begin differently.
    return F.when(one_line & x.rlike(enclosed), a).when(one_line & x.rlike(suffixed), b).otherwise(x)


def double_newlines(x: Column) -> Column:
    """F8: a single line end between two lines that aren't empty becomes two."""
    return F.regexp_replace(x, r"(?<=[^\n])\n(?=[^\n])", "\n\n")


def text_block(x: Column) -> Column:
    return let(x, lambda a: let(bullet(a), lambda b: double_newlines(numbering(b))))


def formula_tag(block: Column, number: Column) -> Column:
    """The tag of F9: the number without its brackets inside a formula block that ends in $$."""
    bare = F.regexp_replace(trim(number), r"^(?:\(([\s\S]*)\)|（([\s\S]*)）)$", "$1$2")
    tagged = F.concat(F.substring(block, F.lit(1), F.char_length(block) - 3), F.lit(" \\tag{"), bare, F.lit("}\n$$"))
    return F.when(block.endswith("\n$$"), tagged).otherwise(block)
