"""Queries of the general data problems, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.diff import diff_copies, digested, latest_version
from quire.operators.shred import sidecar_children, sidecar_tables
from quire.session import table

DIFF_FIELDS = ["content", "bbox_2d", "label"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar_children(table(spark, sf_dir, "sidecars"))


def p2_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure table with each figure's link to its region."""
    figures = sidecar_tables(table(spark, sf_dir, "sidecars"))["figure"]
    return figures.select("sidecar_id", "position", "page_index", "region_index", "file_name", "width_px", "height_px", "sha256", "orphan")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "regions").select("region_id", "ingested_at", *DIFF_FIELDS)
    newest = latest_version(digested(regions, DIFF_FIELDS), ["region_id"], ["ingested_at"])
    found = diff_copies(newest, table(spark, sf_dir, "regions_mirror"), ["region_id"], DIFF_FIELDS, multiset=False)
    one_sided = F.when(F.col("status") == "only_left", F.array(F.lit("only_regions"))).when(F.col("status") == "only_right", F.array(F.lit("only_mirror")))
    return found.select("region_id", F.explode(F.coalesce(one_sided, F.col("diffs"))).alias("diff")).where("region_id is not null")


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both systems, older versions and repeats included, by page: rows of a page are told apart by their fields only.

    No SQL: the pairs are a minimum-cost assignment, tested against all assignments.
    """
    found = diff_copies(table(spark, sf_dir, "regions"), table(spark, sf_dir, "regions_mirror"), ["scan_id", "page_index"], ["region_index", *DIFF_FIELDS])
    return found.groupBy("scan_id", "page_index", "status", "diffs").agg(F.count("*").alias("rows"))


P5_SQL = """
WITH l AS (
  SELECT region_id, content, bbox_2d, label FROM regions
  QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) = 1
), r AS (
  SELECT DISTINCT region_id, content, bbox_2d, label FROM regions_mirror
), j AS (
  SELECT coalesce(l.region_id, r.region_id) AS region_id, l.region_id AS a, r.region_id AS b,
         l.content IS DISTINCT FROM r.content AS c, l.bbox_2d IS DISTINCT FROM r.bbox_2d AS x, l.label IS DISTINCT FROM r.label AS y
  FROM l FULL JOIN r ON l.region_id = r.region_id
)
SELECT region_id, 'only_regions' AS diff FROM j WHERE b IS NULL
UNION ALL SELECT region_id, 'only_mirror' FROM j WHERE a IS NULL
UNION ALL SELECT region_id, 'content' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND c
UNION ALL SELECT region_id, 'bbox_2d' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND x
UNION ALL SELECT region_id, 'label' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND y
"""

# Bodies without byte order mark and white space around them, out of a JSON string or the envelope `document`; both spellings of keys.
_TRIM = "trim({0}, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE [] END"


def _either(record: str, camel: str, snake: str, arrow: str = "->>") -> str:
    return f"coalesce({record} {arrow} '$.{camel}', {record} {arrow} '$.{snake}')"


_BODIES = f"""
bare AS (SELECT DISTINCT sidecar_id, body AS body_key, {_TRIM.format('body')} AS b FROM sidecars WHERE sidecar_id IS NOT NULL AND body IS NOT NULL),
unpacked AS (SELECT sidecar_id, body_key, CASE WHEN b LIKE '"%' THEN {_TRIM.format("json_extract_string(TRY_CAST(b AS JSON), '$')")} ELSE b END AS b FROM bare),
parsed AS (SELECT sidecar_id, body_key, TRY_CAST(b AS JSON) AS j FROM unpacked),
records AS (SELECT sidecar_id, body_key, CASE WHEN json_type(j -> '$.document') = 'OBJECT' THEN j -> '$.document' ELSE j END AS j FROM parsed WHERE json_type(j) = 'OBJECT'),
lists AS (SELECT sidecar_id, body_key, {_LIST.format("(j -> '$.pages')")} AS ps, {_LIST.format("(j -> '$.figures')")} AS fs, j -> '$.diagnostics' AS d FROM records),
pages AS (SELECT sidecar_id, body_key, unnest(ps) AS p, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS page_index FROM lists),
listed AS (SELECT sidecar_id, page_index, {_LIST.format("(CASE WHEN json_type(p) = 'ARRAY' THEN p ELSE p -> '$.regions' END)")} AS rs FROM pages),
regs AS (SELECT DISTINCT sidecar_id, page_index, coalesce(r ->> '$.index', CAST(k AS VARCHAR)) AS item FROM (SELECT sidecar_id, page_index, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS k FROM listed)),
figs AS (SELECT sidecar_id, body_key, CAST(k AS INT) AS position, TRY_CAST({_either('f', 'pageIndex', 'page_index')} AS INT) AS page_index, {_either('f', 'regionIndex', 'region_index')} AS region_index, f
  FROM (SELECT sidecar_id, body_key, unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS k FROM lists))"""
P2_FOUND_SQL = f"""WITH {_BODIES.strip()}
SELECT DISTINCT sidecar_id, 'page' AS child, page_index, '' AS item FROM pages
UNION ALL SELECT sidecar_id, 'region', page_index, item FROM regs
UNION ALL SELECT DISTINCT f.sidecar_id, CASE WHEN r.item IS NULL THEN 'orphan_figure' ELSE 'figure' END, f.page_index, f.region_index
  FROM figs f LEFT JOIN regs r ON f.sidecar_id = r.sidecar_id AND f.page_index = r.page_index AND f.region_index = r.item WHERE f.page_index IS NOT NULL AND f.region_index IS NOT NULL
UNION ALL SELECT DISTINCT sidecar_id, 'warning', -1, CAST(unnest(range(len({_LIST.format("(d -> '$.warnings')")}))) AS VARCHAR) FROM lists
UNION ALL SELECT DISTINCT sidecar_id, 'timing', -1, unnest(json_keys({_either('d', 'timingsMs', 'timings_ms', '->')})) FROM lists
UNION ALL SELECT DISTINCT sidecar_id, 'metadata', -1, unnest(json_keys(d -> '$.metadata')) FROM lists"""
P2_FIGURES_SQL = f"""WITH {_BODIES.strip()}
SELECT f.sidecar_id, position, f.page_index, region_index, {_either('f', 'fileName', 'file_name')} AS file_name, TRY_CAST({_either('f', 'widthPX', 'width_px')} AS INT) AS width_px,
  TRY_CAST({_either('f', 'heightPX', 'height_px')} AS INT) AS height_px, f ->> '$.sha256' AS sha256, r.item IS NULL AS orphan
FROM figs f LEFT JOIN regs r ON f.sidecar_id = r.sidecar_id AND f.page_index = r.page_index AND f.region_index = r.item"""

QUERIES = {"p2_found": p2_found, "p2_figures": p2_figures, "p5_found": p5_found, "p5_copies": p5_copies}
SQL = {"p2_found": P2_FOUND_SQL, "p2_figures": P2_FIGURES_SQL, "p5_found": P5_SQL}
