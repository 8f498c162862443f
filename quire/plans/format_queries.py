"""Queries over the formatter, with SQL written another way: lists and recursion instead of look-around and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import dims
from quire.functions import text as T
from quire.operators import formatting as O
from quire.plans import fixtures as X
from quire.session import table


def _strings(spark, d):
    """id, content: hand-written strings and the contents of all regions."""
    e = X.edge(spark, d).select(F.col("id").cast("long").alias("id"), "content")
    r = X.regions(spark, d).where("content is not null").select((F.col("idx") + 1000).alias("id"), "content")
    return e.unionByName(r)


def _over_strings(f):
    return lambda spark, d: _strings(spark, d).select("id", f(F.col("content")).alias("block"))


f03_clean = _over_strings(T.clean)
f04_title = _over_strings(lambda x: T.title(x, "## "))
f05_formula = _over_strings(T.formula)
f06_bullet = _over_strings(T.bullet)
f07_numbering = _over_strings(T.numbering)
f08_newlines = _over_strings(T.double_newlines)
ref_p19_trim = _over_strings(T.trim)


def f01_order(spark, d):
    return O.normalise(X.regions(spark, d)).select("doc", "page", "idx", "label")


def f02_label(spark, d):
    return X.regions(spark, d).select("doc", "page", F.col("idx").alias("key"), dims.output_label(F.col("label")).alias("out_label"))


def f08_normalise(spark, d):
    return O.normalise(X.regions(spark, d)).select("doc", "page", "idx", "out_label", "block")


_OUT = ["doc", "page", "idx", "label", "out_label", "block"]


def f09_formula_numbers(spark, d):
    return O.merge_formula_numbers(O.normalise(_mixed(spark, d))).select(*_OUT)


def _mixed(spark, d):
    """Regions with more formula numbers than the table has: every fifth region is one."""
    r = X.regions(spark, d)
    fifth = F.col("idx") % 5
    return r.withColumn("content", F.when(fifth == 0, F.concat(F.lit("("), (F.col("idx") % 97).cast("string"), F.lit(")"))).otherwise(F.col("content"))).withColumn(
        "label", F.when(fifth == 0, "formula_number").when(fifth.isin(1, 2), "display_formula").otherwise(F.col("label"))
    )


def f10_hyphenated(spark, d):
    return O.merge_hyphenated(O.normalise(_broken(spark, d))).select(*_OUT)


def _broken(spark, d):
    """Regions of which some end in a hyphen and some begin with a small letter."""
    r = X.regions(spark, d).where("content is not null").withColumn("label", F.lit("text"))
    c = F.when(F.col("idx") % 4 < 2, F.concat("content", F.lit("-"))).otherwise(F.col("content"))
    return r.withColumn("content", F.when(F.col("idx") % 3 > 0, F.concat(F.lit("q"), c)).otherwise(c))


def f11_bullets(spark, d):
    r = X.regions(spark, d).withColumn("content", F.when(F.col("idx") % 3 < 2, F.concat(F.lit("- "), F.col("content"))).otherwise(F.col("content")))
    r = r.withColumn("label", F.when(F.col("idx") % 7 > 0, "text").otherwise(F.col("label"))).withColumn("bbox", F.array((F.col("idx") % 13).cast("int"), F.lit(0), F.lit(9), F.lit(9)))
    return O.fill_bullets(O.normalise(r)).select(*_OUT)


def f12_blocks(spark, d):
    return O.blocks(X.regions(spark, d)).select(*_OUT)


def f13_page_markdown(spark, d):
    return O.page_markdown(O.placeholders(O.normalise(X.regions(spark, d)))).select("doc", "page", "markdown")


def f14_documents(spark, d):
    """Regions to Markdown documents: the whole chain."""
    return O.document_markdown(O.page_markdown(O.placeholders(O.blocks(X.regions(spark, d)))))


def f15_no_layout(spark, d):
    p = table(spark, d, "page_texts").select(F.col("scan_id").alias("doc"), F.col("page_index").alias("page"), "content").distinct()
    return O.no_layout_markdown(p)


NL = "chr(10)"
_W = r"[\p{Z}\s\x{85}]"
_B = r"[\p{Zs}\t]"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def blanks_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def clean_sql(x: str) -> str:
    out = rf"regexp_replace({trim_sql(x)}, '^(\\t)+|(\\t)+$', '', 'g')"
    out = rf"regexp_replace(regexp_replace(regexp_replace({out}, '\.{{3,}}', '...', 'g'), '·{{3,}}', '···', 'g'), '_{{3,}}', '___', 'g')"
    return trim_sql(rf"regexp_replace({out}, '(\\_){{3,}}', '\\_\\_\\_', 'g')")


def title_sql(x: str, mark: str) -> str:
    return rf"'{mark}' || " + trim_sql(rf"regexp_replace({trim_sql(f'''ltrim({x}, '#')''')}, '^[-*] ', '')")


def formula_sql(x: str) -> str:
    t = trim_sql(x)
    cases = " ".join(f"WHEN starts_with({t}, '{a}') AND ends_with({t}, '{b}') AND len({t}) >= 4 THEN {t}[3:-3]" for a, b in (("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)")))
    return f"'$$' || {NL} || " + trim_sql(f"CASE {cases} ELSE {t} END") + f" || {NL} || '$$'"


def bullet_sql(x: str) -> str:
    dot = f"(CASE WHEN left({x}, 1) IN ('·', '•') THEN '- ' || {blanks_sql(f'{x}[2:]')} ELSE {x} END)"
    return f"(CASE WHEN starts_with({dot}, '* ') THEN '- ' || {blanks_sql(f'{dot}[3:]')} ELSE {dot} END)"


def numbering_sql(x: str) -> str:
    a, b = r"^[(（](\p{Nd}+|[A-Za-z])[)）]([^\n\r]*)$", r"^(\p{Nd}+|[A-Za-z])([.)）])([^\n\r]*)$"
    rest_a, rest_b = blanks_sql(f"regexp_extract({x}, '{a}', 2)"), blanks_sql(f"regexp_extract({x}, '{b}', 3)")
    one = f"NOT contains({x}, {NL}) AND NOT contains({x}, chr(13))"
    return f"""(CASE WHEN {one} AND regexp_matches({x}, '{a}') THEN rtrim('(' || regexp_extract({x}, '{a}', 1) || ') ' || {rest_a}, ' ')
      WHEN {one} AND regexp_matches({x}, '{b}') THEN rtrim(regexp_extract({x}, '{b}', 1) || replace(regexp_extract({x}, '{b}', 2), '）', ')') || ' ' || {rest_b}, ' ') ELSE {x} END)"""


def newlines_sql(x: str) -> str:
    split = f"string_split({x}, {NL})"
    return f"""array_to_string(list_transform(range(1, len({split}) + 1), lambda i: CASE WHEN i = 1 THEN {split}[i]
      WHEN {split}[i - 1] <> '' AND {split}[i] <> '' THEN {NL} || {NL} || {split}[i] ELSE {NL} || {split}[i] END), '')"""


_STRINGS = f"WITH {X.REGIONS_SQL.strip()}, {X.EDGE_SQL}, strings AS (SELECT id::BIGINT AS id, content FROM edge UNION ALL SELECT idx + 1000, content FROM regs WHERE content IS NOT NULL)"


def normal_sql(source: str, prefix: str) -> str:
    """CTEs from regions in `source` to `{prefix}`: idx, out_label, block."""
    p = prefix
    return f"""
{p}0 AS (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INT) AS idx, label, content, bbox, {X.OUTPUT_SQL} AS out_label, {clean_sql('content')} AS c FROM {source}),
{p}1 AS (SELECT *, CASE label WHEN 'doc_title' THEN {title_sql('c', '# ')} WHEN 'paragraph_title' THEN {title_sql('c', '## ')} ELSE c END AS t FROM {p}0),
{p}2 AS (SELECT *, CASE WHEN out_label = 'text' THEN {bullet_sql('t')} END AS b FROM {p}1),
{p}3 AS (SELECT *, {numbering_sql('b')} AS n FROM {p}2),
{p} AS (SELECT doc, page, idx, label, out_label, content, bbox, CASE out_label WHEN 'formula' THEN {formula_sql('t')} WHEN 'text' THEN {newlines_sql('n')} ELSE t END AS block FROM {p}3)"""


def greedy_sql(source: str, pair: str, prefix: str) -> str:
    """CTEs to `{prefix}`: rows of source with took, by walking each page from its first row."""
    p = prefix
    return f"""
{p}r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY idx) AS r FROM {source}),
{p}p AS (SELECT a.doc, a.page, a.r, coalesce({pair}, false) AS pair FROM {p}r a LEFT JOIN {p}r b ON a.doc = b.doc AND a.page = b.page AND b.r = a.r + 1),
{p}w AS (SELECT doc, page, r, pair AS took FROM {p}p WHERE r = 1 UNION ALL SELECT n.doc, n.page, n.r, n.pair AND NOT w.took FROM {p}w w JOIN {p}p n ON n.doc = w.doc AND n.page = w.page AND n.r = w.r + 1),
{p} AS (SELECT s.*, w.took, coalesce(v.took, false) AS taken FROM {p}r s JOIN {p}w w USING (doc, page, r) LEFT JOIN {p}w v ON v.doc = s.doc AND v.page = s.page AND v.r = s.r - 1)"""


def numbers_sql(source: str, prefix: str) -> str:
    p = prefix
    n = trim_sql("number")
    bare = rf"regexp_replace(regexp_replace({n}, '^\(([\s\S]*)\)$', '\1'), '^（([\s\S]*)）$', '\1')"
    pair = "(a.label = 'formula_number' AND b.out_label = 'formula') OR (a.out_label = 'formula' AND b.label = 'formula_number')"
    return (
        greedy_sql(source, pair, p + "g")
        + f""",
{p}m AS (SELECT a.doc, a.page, a.idx, a.took, a.label AS la, CASE WHEN a.took AND a.label = 'formula_number' THEN b.label ELSE a.label END AS label,
   CASE WHEN a.took AND a.label = 'formula_number' THEN b.out_label ELSE a.out_label END AS out_label, CASE WHEN a.took AND a.label = 'formula_number' THEN b.bbox ELSE a.bbox END AS bbox,
   CASE WHEN a.took AND a.label = 'formula_number' THEN b.block ELSE a.block END AS block, CASE WHEN a.label = 'formula_number' THEN a.block ELSE b.block END AS number
   FROM {p}g a LEFT JOIN {p}g b ON a.doc = b.doc AND a.page = b.page AND b.r = a.r + 1 WHERE NOT a.taken AND (a.took OR a.label <> 'formula_number')),
{p} AS (SELECT doc, page, idx, label, out_label, bbox, CASE WHEN took AND block IS NOT NULL AND number IS NOT NULL AND ends_with(block, {NL} || '$$')
   THEN left(block, len(block) - 3) || ' \\tag{{' || {bare} || '}}' || {NL} || '$$' ELSE block END AS block FROM {p}m)"""
    ).replace("\\\\tag", "\\tag")


def hyphen_sql(source: str, prefix: str) -> str:
    p, a, b = prefix, trim_sql("a.block"), trim_sql("b.block")
    pair = f"a.out_label = 'text' AND b.out_label = 'text' AND ends_with({a}, '-') AND left({b}, 1) = lower(left({b}, 1)) AND left({b}, 1) <> upper(left({b}, 1))"
    return (
        greedy_sql(source, pair, p + "g")
        + f""",
{p} AS (SELECT a.doc, a.page, a.idx, a.label, a.out_label, a.bbox, CASE WHEN a.took THEN left({a}, len({a}) - 1) || {b} ELSE a.block END AS block
   FROM {p}g a LEFT JOIN {p}g b ON a.doc = b.doc AND a.page = b.page AND b.r = a.r + 1 WHERE NOT a.taken)"""
    )


def bullets_sql(source: str, prefix: str) -> str:
    p = prefix
    return f"""
{p}r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY idx) AS r FROM {source}),
{p} AS (SELECT a.doc, a.page, a.idx, a.label, a.out_label, a.bbox, CASE WHEN a.label = 'text' AND b.label = 'text' AND c.label = 'text' AND NOT starts_with(a.block, '- ')
   AND starts_with(b.block, '- ') AND starts_with(c.block, '- ') AND abs(a.bbox[1] - b.bbox[1]) <= 10 AND abs(a.bbox[1] - c.bbox[1]) <= 10 THEN '- ' || a.block ELSE a.block END AS block
   FROM {p}r a LEFT JOIN {p}r b ON b.doc = a.doc AND b.page = a.page AND b.r = a.r - 1 LEFT JOIN {p}r c ON c.doc = a.doc AND c.page = a.page AND c.r = a.r + 1)"""


def marks_sql(source: str, prefix: str) -> str:
    return f"""
{prefix}k AS (SELECT *, sum(CASE WHEN out_label = 'image' AND bbox IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS nth FROM {source}),
{prefix} AS (SELECT * EXCLUDE (block, nth), CASE WHEN out_label = 'image' AND bbox IS NOT NULL THEN '![Image ' || page || '-' || nth::INT || '](page=' || page || ',bbox=[' || array_to_string(bbox, ', ') || '])' ELSE block END AS block FROM {prefix}k)"""


_R = f"WITH RECURSIVE {X.REGIONS_SQL.strip()}"
_PICK = "SELECT doc, page, idx, label, out_label, block FROM"
_RE = "SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INT) AS idx, label, out_label, bbox, block FROM"
BLOCKS_SQL = f"{_R}, {normal_sql('regs', 'n').strip()}, {numbers_sql('n', 'm').strip()}, {hyphen_sql('m', 'h').strip()}, {bullets_sql('h', 'b').strip()}, blocks AS ({_RE} b)"
_PAGE_MD = f"SELECT doc, page, coalesce(string_agg(block, {NL} || {NL} ORDER BY idx), '') AS markdown FROM"

SQL = {
    "ref_p19_trim": f"{_STRINGS} SELECT id, {trim_sql('content')} AS block FROM strings",
    "f01_order": f"{_R} SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INT) AS idx, label FROM regs",
    "f02_label": f"{_R} SELECT doc, page, idx AS key, {X.OUTPUT_SQL} AS out_label FROM regs",
    "f03_clean": f"{_STRINGS} SELECT id, {clean_sql('content')} AS block FROM strings",
    "f04_title": f"{_STRINGS} SELECT id, {title_sql('content', '## ')} AS block FROM strings",
    "f05_formula": f"{_STRINGS} SELECT id, {formula_sql('content')} AS block FROM strings",
    "f06_bullet": f"{_STRINGS} SELECT id, {bullet_sql('content')} AS block FROM strings",
    "f07_numbering": f"{_STRINGS} SELECT id, {numbering_sql('content')} AS block FROM strings",
    "f08_newlines": f"{_STRINGS} SELECT id, {newlines_sql('content')} AS block FROM strings",
    "f08_normalise": f"{_R}, {normal_sql('regs', 'n').strip()} SELECT doc, page, idx, out_label, block FROM n",
    "f09_formula_numbers": f"""{_R}, mixed AS (SELECT doc, page, idx, bbox, CASE WHEN idx % 5 = 0 THEN 'formula_number' WHEN idx % 5 IN (1, 2) THEN 'display_formula' ELSE label END AS label,
      CASE WHEN idx % 5 = 0 THEN '(' || idx % 97 || ')' ELSE content END AS content FROM regs), {normal_sql('mixed', 'n').strip()}, {numbers_sql('n', 'm').strip()} {_PICK} m""",
    "f10_hyphenated": f"""{_R}, broken AS (SELECT doc, page, idx, bbox, 'text' AS label, CASE WHEN idx % 3 > 0 THEN 'q' ELSE '' END || content || CASE WHEN idx % 4 < 2 THEN '-' ELSE '' END AS content FROM regs WHERE content IS NOT NULL),
      {normal_sql('broken', 'n').strip()}, {hyphen_sql('n', 'h').strip()} {_PICK} h""",
    "f11_bullets": f"""{_R}, s AS (SELECT doc, page, idx, CASE WHEN idx % 7 > 0 THEN 'text' ELSE label END AS label, CASE WHEN idx % 3 < 2 THEN '- ' || content ELSE content END AS content, [CAST(idx % 13 AS INT), 0, 9, 9] AS bbox FROM regs),
      {normal_sql('s', 'n').strip()}, {bullets_sql('n', 'b').strip()} {_PICK} b""",
    "f12_blocks": f"{BLOCKS_SQL} {_PICK} blocks",
    "f13_page_markdown": f"{_R}, {normal_sql('regs', 'n').strip()}, {marks_sql('n', 'k').strip()} {_PAGE_MD} k GROUP BY doc, page",
    "f14_documents": f"{BLOCKS_SQL}, {marks_sql('blocks', 'k').strip()}, pages AS ({_PAGE_MD} k GROUP BY doc, page) SELECT doc, string_agg(markdown, {NL} || {NL} ORDER BY page) AS markdown FROM pages GROUP BY doc",
    "f15_no_layout": f"""WITH p AS (SELECT DISTINCT scan_id AS doc, page_index AS page, content FROM page_texts), c AS (SELECT doc, page, coalesce({clean_sql('content')}, '') AS m FROM p)
      SELECT doc, string_agg(m, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY page, m) AS markdown FROM c GROUP BY doc""",
}
QUERIES = {name: globals()[name] for name in SQL}
