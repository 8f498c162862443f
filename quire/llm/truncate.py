"""Texts cut off by field limits or broken transfers.

The length of every text is taken under several codings a store may have counted in: characters,
UTF-8 bytes, UTF-16 units, with HTML entities, as JSON with and without escaped non-ASCII, with CRLF
line ends. Grouped by source and coding, every hidden limit shows as a pile of texts of one length that
mostly stop unfinished, wherever it lies: a source may have several, or have got another one in time. Then
the endings are inspected: a text at a limit of its source, or one whose last sentence or table is not
complete and doesn't run on in the next text region of the scan, was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.diff import latest_version

#: A limit is believed when this many texts, and this share of a source's texts, have its length, PILE times as many as
#: the NEAR lengths on either side have on average, UNFINISHED of them stop unfinished and DIFFERENT of them differ.
LEAST_TEXTS, LEAST_SHARE, PILE, NEAR, UNFINISHED, DIFFERENT = 5, 0.02, 4.0, 20, 0.5, 4
#: Piles of several codings within this share of their length are one pile; the coding with most texts explains it.
SAME_PILE = 0.1
#: Lengths of a histogram that one task looks at together.
SPAN = 4096

#: Labels of running text (a sentence must end) and of headings and the like (it need not).
PROSE = ("text", "abstract", "reference_content", "vision_footnote", "vertical_text", "content")
#: A label that says nothing about the kind of text: it may be prose or a heading, a caption or a seal.
VAGUE = "content"

#: Kinds of length, by name.
CODINGS = ("chars", "utf8", "utf16", "html", "json_ascii", "json", "crlf", "utf8_crlf")

_END = r"""[.!?。！？][\p{Pf}\p{Pe}"'’”»)\]]*$"""
_DOTS = r"(?:\.\.\.|…)$"
_ITEM = r"(?:[-*•·–]|\d{1,3}[.)]|\(\d{1,3}\)|[A-Za-z][.)])\s"
_CAPTION = r"(?i)^\s*(?:#|(?:figure|fig|table|abbildung|abb|tabelle|tableau|figura|tabla)\.?\s*\p{Nd})"
#: A dot after a number or a single capital that begins a word doesn't end a sentence.
_OPEN_DOT = r"(?:^|\s)(?:\p{Nd}{1,3}|\p{Lu})\.$"


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text under each coding; null for null."""
    chars, utf8 = F.char_length(text), F.octet_length(text)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    astral = count(r"[\x{10000}-\x{10FFFF}]")
    newlines = count(r"(?<!\r)\n")
    escapes = count(r"""["\\\n\r\t]""") + 5 * count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    non_ascii = count(r"[^\x00-\x7f]")
    return {
        "chars": chars,
        "utf8": utf8,
        "utf16": chars + astral,
        "html": chars + 4 * count("&") + 3 * count("[<>]"),
        "json_ascii": chars + escapes + 5 * non_ascii + 6 * astral,
        "json": chars + escapes,
        "crlf": chars + newlines,
        "utf8_crlf": utf8 + newlines,
    }


def features(regions: DataFrame) -> DataFrame:
    """What the later steps need of each text or table region: its lengths and how it begins and ends.

    Taken where the rows lie, so that no text goes into a shuffle.
    """
    content = F.col("content")
    end = F.regexp_replace(content, r"\s+$", "")
    whole = F.regexp_replace(content, "\ufffd+$", "")
    tabular = (F.col("task") == "table") | (F.col("label") == "table")
    first_line, last_line = F.substring_index(end, "\n", 1), F.substring_index(end, "\n", -1)
    bars = F.lit(r"\|")
    short_row = ~last_line.rlike(r"\|$") | (F.regexp_count(last_line, bars) < F.regexp_count(first_line, bars))
    marks = regions.where("task in ('text', 'table') and region_id is not null").select(
        "region_id",
        "scan_id",
        "page_index",
        "region_index",
        "label",
        "source",
        "ingested_at",
        (F.col("label").isin(*PROSE) & (F.col("task") == "text")).alias("prose"),
        tabular.alias("tabular"),
        (content != "").alias("filled"),
        F.expr("shiftleft(1L, int(pmod(xxhash64(content), 64)))").alias("mark"),
        F.array(*[c.cast("int") for c in lengths(whole).values()]).alias("sizes"),
        ((F.col("label") != VAGUE) | (~end.rlike(_CAPTION) & (end.rlike(r"[.!?][\p{Pf}\p{Pe}\"']*\s+\S") | end.rlike(r"[,;]$")))).alias("sentences"),
        content.rlike("\ufffd$").alias("torn"),
        content.rlike(r"^\p{Ll}(?![.)]\s)").alias("begins_low"),
        end.rlike(_DOTS).alias("dots"),
        (end.rlike(_END) & ~end.rlike(_OPEN_DOT)).alias("ends_well"),
        (F.regexp_count(end, F.lit(r"[(“«„]")) > F.regexp_count(end, F.lit(r"[)”»“]"))).alias("opened"),
        (end.rlike(r"^\s*" + _ITEM) & end.rlike(r"\n\s*" + _ITEM)).alias("list"),
        F.when(tabular & end.rlike(r"(?i)^\s*<table"), F.when(end.rlike(r"(?i)</table>$"), "closed").otherwise("open")).when(tabular & end.rlike(r"^\s*\|") & short_row, "open").alias("table_end"),
    )
    sentence = F.col("prose") & F.col("sentences") & ~F.col("list") & (~F.col("ends_well") | F.col("opened") | F.col("dots"))
    return marks.withColumn("unfinished", F.coalesce(F.when(F.col("tabular"), F.col("table_end") == "open").otherwise(sentence) | F.col("torn"), F.lit(False)))


def field_limits(marks: DataFrame) -> DataFrame:
    """(source, coding, limit_length, at_limit, texts): each hidden limit of each source.

    Takes the rows of `features`. One aggregation to a histogram over (source, coding, length), partly in the map;
    its piles stand out against the lengths near them, which are looked at in spans of lengths with their borders
    repeated, so that no task needs all lengths of a source. Of several codings that fit a pile, the one with most
    texts is taken, of equal ones the first in CODINGS. Null texts and sources count for nothing. A cut within a
    character may leave U+FFFD for the bytes lost; such ends are taken off before measuring, and a byte limit also
    counts those of the lengths up to three under it. That texts of a pile differ is seen by 64 classes of digests.
    """
    rows = marks.where("filled and source is not null").select("source", "unfinished", "torn", "mark", F.posexplode("sizes").alias("coding", "n"))
    sizes = rows.groupBy("source", "coding", "n").agg(F.count("*").alias("k"), F.count_if("unfinished").alias("u"), F.count_if("torn").alias("t"), F.bit_or("mark").alias("marks"))
    texts = sizes.where("coding = 0").groupBy("source").agg(F.sum("k").alias("texts"))
    halo = NEAR + 4
    span = F.floor(F.col("n") / SPAN)
    near = F.array_distinct(F.array(span, F.floor((F.col("n") - halo) / SPAN), F.floor((F.col("n") + halo) / SPAN)))
    spread = sizes.select("*", span.alias("own"), F.explode(near).alias("span"))
    byte = F.col("coding").isin(1, 7)

    def around(low: int, high: int, c: str = "k") -> Column:
        w = Window.partitionBy("source", "coding", "span").orderBy("n").rangeBetween(low, high)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    torn = F.when(byte, around(-3, -1, "t")).otherwise(0)
    piles = spread.select(
        "*",
        (F.col("k") + torn).alias("at_limit"),
        (F.col("u") + torn).alias("open"),
        (around(-NEAR, -1) + around(1, NEAR) - torn).alias("beside"),
        # The pile's own greatest length: the one beyond has fewer.
        around(1, 1).alias("beyond"),
    ).where("own = span")
    piles = piles.join(texts, "source").where(
        (F.col("k") >= LEAST_TEXTS)
        & (F.col("at_limit") >= LEAST_SHARE * F.col("texts"))
        & (F.col("at_limit") * 2 * NEAR >= PILE * F.col("beside"))
        & (F.bit_count("marks") >= DIFFERENT)
        & (F.col("open") >= UNFINISHED * F.col("at_limit"))
        & (F.col("k") >= F.col("beyond"))
    )
    # Each pile has LEAST_SHARE of a source's texts, so a source has a bounded number of them.
    every = piles.groupBy("source", "texts").agg(F.sort_array(F.collect_list(F.struct("at_limit", (-F.col("coding")).alias("order"), "n")), asc=False).alias("p"))
    none = F.array().cast(every.schema["p"].dataType)

    def explained(kept: Column, x: Column) -> Column:
        return F.exists(kept, lambda y: (F.abs(y["n"] - x["n"]) <= F.when(y["order"] == x["order"], 4).otherwise(SAME_PILE * F.greatest(y["n"], x["n"]))))

    best = every.select("source", "texts", F.explode(F.aggregate("p", none, lambda kept, x: F.when(explained(kept, x), kept).otherwise(F.concat(kept, F.array(x))))).alias("b"))
    names = F.array(*[F.lit(c) for c in CODINGS])
    return best.select("source", names[-F.col("b.order")].alias("coding"), F.col("b.n").alias("limit_length"), F.col("b.at_limit").alias("at_limit"), "texts")


def truncated(regions: DataFrame) -> DataFrame:
    """The latest version of every text and table region with `cut` and `reason`.

    Columns region_id, source, label, cut (boolean), reason ('limit', 'marked', 'sentence', 'table',
    'bytes' or null). Null and empty contents are no rows. Regions labelled 'content' count as prose where
    a sentence ends before their end, or where they stop at a comma or semicolon, as no heading does. Regions whose source is null have no limit
    but their endings are inspected. Regions without scan, page or region order follow none. A sentence
    runs on where the next text region, on the page or the pages after, begins with a small letter that isn't a list's; the
    pages of a scan are linked by a summary of one row a page, so a scan of any length is no hot spot.
    """
    rows = latest_version(features(regions), ["region_id"], ["ingested_at"])
    codings = F.array(*[F.lit(c) for c in CODINGS])
    limit = F.struct((F.array_position(codings, F.col("coding")) - 1).cast("int").alias("coding"), F.col("limit_length").alias("n"))
    limits = field_limits(rows).groupBy("source").agg(F.collect_list(limit).alias("limits"))

    # A region of vague label goes on with a sentence or says nothing.
    begins = F.when(F.col("label") == "text", F.coalesce("begins_low", F.lit(False))).when((F.col("label") == VAGUE) & F.col("begins_low"), F.lit(True))
    # Rows without a scan are on their own.
    rows = rows.withColumn("lone", F.when(F.col("scan_id").isNull(), F.col("region_id")))
    on_page = Window.partitionBy("scan_id", "lone", "page_index").orderBy(F.desc("region_index"), F.desc("region_id")).rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.where(begins.isNotNull() & F.col("scan_id").isNotNull()).groupBy("scan_id", "page_index").agg(F.min_by(begins, F.struct("region_index", "region_id")).alias("first_low"))
    spine = rows.where("scan_id is not null").select("scan_id", "page_index").distinct().join(pages, ["scan_id", "page_index"], "left")
    ahead = Window.partitionBy("scan_id").orderBy(F.desc("page_index")).rowsBetween(Window.unboundedPreceding, -1)
    after = spine.select("scan_id", "page_index", F.last("first_low", ignorenulls=True).over(ahead).alias("page_low"))
    rows = rows.withColumn("next_low", F.last(begins, ignorenulls=True).over(on_page)).where("filled")
    rows = rows.join(after, ["scan_id", "page_index"], "left").join(limits, "source", "left")
    runs_on = F.coalesce("next_low", "page_low", F.lit(False))


    def within(slack: Column | int) -> Column:
        return F.coalesce(F.exists("limits", lambda x: (F.get("sizes", x["coding"]) <= x["n"]) & (F.get("sizes", x["coding"]) >= x["n"] - slack)), F.lit(False))

    at_limit, near_limit = within(F.when(F.col("torn"), 3).otherwise(0)), within(3)
    text_cut = (
        F.when(F.expr("torn"), "bytes")
        .when(F.col("dots") & near_limit, "marked")
        .when(at_limit & ~F.col("dots") & (~F.col("ends_well") | F.col("opened")), "limit")
        .when(F.col("list") | F.col("dots") | F.col("ends_well") | runs_on | ~F.col("sentences"), None)
        .otherwise("sentence")
    )
    table_cut = F.when(F.col("torn"), "bytes").when(F.col("table_end") == "open", "table").when(at_limit & ~F.col("table_end").eqNullSafe("closed"), "limit")
    reason = F.when(F.col("tabular"), table_cut).when(F.col("prose"), text_cut).when(F.col("torn"), "bytes")
    return rows.select("region_id", "source", "label", reason.isNotNull().alias("cut"), reason.alias("reason"))


def truncation_rates(regions: DataFrame) -> DataFrame:
    """(source, texts, cut, rate): how often each source's text and table regions are cut."""
    by = truncated(regions).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
    return by.withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))
