"""From recognised regions to Markdown: normalising, merging of neighbours, ordered assembly.

Regions have doc, page, idx (order within the page), label, content (null: not recognised, '': empty)
and bbox. All neighbour rules work over windows of one page, so that the chain needs one shuffle on
(doc, page); documents need one more on doc. A merge of neighbours i and i+1 depends on their own
values only and is taken greedily from the left, which within each run of mergeable pairs is every
second pair, the first one included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import dims
from quire.functions import text as X

PAGE = ["doc", "page"]
BULLET_TOLERANCE = 10
RULE = "\n\n---\n\n"


def normalise(regions: DataFrame) -> DataFrame:
    """F1 to F8: dense order, output label, block text by label. Null content stays null."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    out = regions.withColumn("idx", F.row_number().over(w) - 1).withColumn("out_label", dims.output_label(F.col("label")))


    def titled(c: Column) -> Column:
        return F.when(F.col("label") == "doc_title", X.title(c, "# ")).when(F.col("label") == "paragraph_title", X.title(c, "## ")).otherwise(c)

    def shaped(t: Column) -> Column:
        return F.when(F.col("out_label") == "formula", X.formula(t)).when(F.col("out_label") == "text", X.text_block(t)).otherwise(t)

    return out.withColumn("block", X.let(X.clean(F.col("content")), lambda c: X.let(titled(c), shaped)))


def _greedy(rows: DataFrame, pair: Column) -> DataFrame:
    """Adds `_take`, true where a row is merged with its successor, and `_taken`, where with its predecessor."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    run = Window.partitionBy(*PAGE, "_run").orderBy("idx")
    out = rows.withColumn("_pair", F.coalesce(pair, F.lit(False)))
    out = out.withColumn("_run", F.sum(F.when(F.col("_pair"), 0).otherwise(1)).over(w))
    out = out.withColumn("_take", F.col("_pair") & (F.sum(F.when(F.col("_pair"), 1).otherwise(0)).over(run) % 2 == 1))
    return out.withColumn("_taken", F.coalesce(F.lag("_take").over(w), F.lit(False))).drop("_pair", "_run")


def merge_formula_numbers(rows: DataFrame) -> DataFrame:
    """a formula and its number, in either order, become one tagged block; a number without formula is dropped."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    is_number, is_formula = F.col("label") == "formula_number", F.col("out_label") == "formula"
    rows = rows.withColumns({"_n": is_number, "_f": is_formula})
    rows = rows.withColumns({f"_next_{c}": F.lead(c).over(w) for c in ("_n", "_f", "block", "label", "out_label", "bbox", "content")})
    pair = (F.col("_n") & F.col("_next__f")) | (F.col("_f") & F.col("_next__n"))
    out = _greedy(rows, pair).where(~F.col("_taken") & (F.col("_take") | ~F.col("_n")))
    number_first = F.col("_take") & F.col("_n")
    formula = F.when(number_first, F.col("_next_block")).otherwise(F.col("block"))
    number = F.when(number_first, F.col("block")).otherwise(F.col("_next_block"))
    tagged = F.when(formula.isNotNull() & number.isNotNull(), X.formula_tag(formula, number)).otherwise(formula)
    kept = {c: F.when(number_first, F.col(f"_next_{c}")).otherwise(F.col(c)) for c in ("label", "out_label", "bbox", "content")}
    out = out.withColumns({"block": F.when(F.col("_take"), tagged).otherwise(F.col("block")), **kept})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def merge_hyphenated(rows: DataFrame) -> DataFrame:
    """a text that ends in a hyphen takes in the next one where that begins with a small letter."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    is_text = F.col("out_label") == "text"
    rows = rows.withColumns({"_trim": X.trim(F.col("block")), "_text": is_text})
    rows = rows.withColumns({"_next_trim": F.lead("_trim").over(w), "_next_text": F.lead("_text").over(w)})
    pair = F.col("_text") & F.col("_next_text") & F.col("_trim").endswith("-") & F.col("_next_trim").rlike(r"^\p{IsLowercase}")
    out = _greedy(rows, pair).where(~F.col("_taken"))
    joined = F.concat(F.regexp_replace("_trim", "-$", ""), F.col("_next_trim"))
    out = out.withColumn("block", F.when(F.col("_take"), joined).otherwise(F.col("block")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def fill_bullets(rows: DataFrame) -> DataFrame:
    """a text between two bullets with about the same left edge becomes a bullet."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    plain = F.col("label") == "text"
    rows = rows.withColumns({"_b": plain & F.col("block").startswith("- "), "_left": F.get("bbox", F.lit(0))})
    near = [(F.coalesce(f("_b").over(w), F.lit(False)), F.abs(F.col("_left") - f("_left").over(w)) <= BULLET_TOLERANCE) for f in (F.lag, F.lead)]
    fill = plain & ~F.col("block").startswith("- ") & near[0][0] & near[1][0] & near[0][1] & near[1][1]
    out = rows.withColumn("block", F.when(F.coalesce(fill, F.lit(False)), F.concat(F.lit("- "), F.col("block"))).otherwise(F.col("block")))
    return out.drop("_b", "_left")


def renumber(rows: DataFrame) -> DataFrame:
    """idx from 0 without gaps."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("idx")) - 1)


def blocks(regions: DataFrame) -> DataFrame:
    """F1 to F12 in order."""
    return renumber(fill_bullets(merge_hyphenated(merge_formula_numbers(normalise(regions)))))


#: An image marker as it is printed.
MARKER = "![{alt}](page={page},bbox=[{box}])"


def placeholders(rows: DataFrame) -> DataFrame:
    """Image markers of F13: page, box and a counter within the page."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    is_image = (F.col("out_label") == "image") & F.col("bbox").isNotNull()
    nth = F.sum(F.when(is_image, 1).otherwise(0)).over(w) - 1
    box = F.array_join(F.transform("bbox", lambda v: v.cast("string")), ", ")
    page = F.col("page").cast("string")
    fields = {"{alt}": F.concat(F.lit("Image "), page, F.lit("-"), nth.cast("string")), "{page}": page, "{box}": box}
    marker = F.concat(*[fields.get(x, F.lit(x)) for x in re.split(r"(\{\w+\})", MARKER)])
    return rows.withColumn("block", F.when(is_image, marker).otherwise(F.col("block")))


def page_markdown(rows: DataFrame) -> DataFrame:
    """a page's blocks in order, parted by blank lines; null blocks leave none."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("idx", "block"))))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """pages in order, parted by the separator."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "markdown")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["markdown"]), separator).alias("markdown"))


def no_layout_markdown(pages: DataFrame) -> DataFrame:
    """whole-page texts are cleaned only; pages are parted by a rule."""
    clean = pages.select("doc", "page", F.coalesce(X.clean(F.col("content")), F.lit("")).alias("markdown"))
    return document_markdown(clean, RULE)


def no_layout_pages(pages: DataFrame) -> DataFrame:
    """(doc, pages) as page_results gives them: one text region a page, without a box."""
    rows = pages.select("doc", "page", F.lit(0).alias("idx"), F.lit("text").alias("out_label"), F.coalesce(X.clean(F.col("content")), F.lit("")).alias("block"), F.lit(None).cast("array<int>").alias("bbox"))
    return page_results(rows)


def page_results(rows: DataFrame) -> DataFrame:
    """One row a document: pages as arrays of {index, label, content, bbox_2d}, in order."""
    region = F.struct(F.col("idx").alias("index"), F.col("out_label").alias("label"), F.col("block").alias("content"), F.col("bbox").alias("bbox_2d"))
    pages = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(region)).alias("regions"))
    ordered = F.sort_array(F.collect_list(F.struct("page", "regions")))
    return pages.groupBy("doc").agg(F.transform(ordered, lambda p: p["regions"]).alias("pages"))
