"""Inputs of the layout operators derived from the test tables, once for Spark and once as SQL.

The tables hold finished regions but no raw detections, so boxes come from `orders` (its key is
unique and contiguous, 150 boxes a page), logits and pairs from `embeddings`, page sizes from
`page_texts`. Formatting and bundling run on the latest versions of `regions`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import dims
from quire.operators import layout as L
from quire.operators.diff import latest_version
from quire.session import table


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, cls, label, score, x1..y2, w, h, ord."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("t"), (F.col("o_totalprice") * 7).cast("long").alias("t7"))
    page = F.floor(F.col("o_orderkey") / 150).cast("long")
    d = o.select(page.alias("page"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("cls"), "o_custkey", "t", "t7")
    d = d.withColumn("w", F.when(F.col("page") % 10 == 0, 400).otherwise(800)).withColumn("h", F.when(F.col("page") % 10 == 0, 300).otherwise(800))
    full = (F.col("cls") == 14) & (F.col("page") % 10).isin(0, 1)
    x1, y1 = ((F.col("o_custkey") * 37) % 12 * 50).cast("double"), (F.col("t") % 12 * 50).cast("double")
    return L.named(
        d.select(
            "page",
            "id",
            "cls",
            ((F.col("t7") % 1000) / 1000).alias("score"),
            F.when(full, 0.0).otherwise(x1).alias("x1"),
            F.when(full, 0.0).otherwise(y1).alias("y1"),
            F.when(full, F.col("w") - 1.0).otherwise(x1 + 40 + F.col("id") % 5 * 40).alias("x2"),
            F.when(full, F.col("h") - 1.0).otherwise(y1 + 30 + F.col("t") % 7 * 30).alias("y2"),
            "w",
            "h",
            ((F.col("id") * 7919) % 151).cast("int").alias("ord"),
        )
    )


_LABEL = "CASE cls " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(dims.CLASSES)) + " ELSE 'class_' || cls END"
_TASK = "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in v)}) THEN '{t}'" for t, v in dims.TASK_LABELS.items() if t != "text") + " ELSE 'text' END"
TASK_SQL = _TASK
OUTPUT_SQL = "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in v)}) THEN '{t}'" for t, v in dims.OUTPUT_LABELS.items()) + " ELSE label END"

BOXES_SQL = f"""
raw AS (
  SELECT o_orderkey // 150 AS page, o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS cls, o_custkey AS c,
         CAST(trunc(o_totalprice) AS BIGINT) AS t, CAST(trunc(o_totalprice * 7) AS BIGINT) AS t7 FROM orders
), sized AS (
  SELECT *, CASE WHEN page % 10 = 0 THEN 400 ELSE 800 END AS w, CASE WHEN page % 10 = 0 THEN 300 ELSE 800 END AS h,
         cls = 14 AND page % 10 IN (0, 1) AS f FROM raw
), boxes AS (
  SELECT page, id, cls, {_LABEL} AS label, (t7 % 1000) / 1000.0::DOUBLE AS score,
         CASE WHEN f THEN 0.0::DOUBLE ELSE (c * 37 % 12 * 50)::DOUBLE END AS x1,
         CASE WHEN f THEN 0.0::DOUBLE ELSE (t % 12 * 50)::DOUBLE END AS y1,
         CASE WHEN f THEN w - 1.0::DOUBLE ELSE (c * 37 % 12 * 50 + 40 + id % 5 * 40)::DOUBLE END AS x2,
         CASE WHEN f THEN h - 1.0::DOUBLE ELSE (t % 12 * 50 + 30 + t % 7 * 30)::DOUBLE END AS y2,
         w, h, CAST(id * 7919 % 151 AS INT) AS ord FROM sized
)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, query, flat, logit: ten queries a page, one class an element."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("cls", "x"))
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("page"),
        F.col("vec_id").alias("query"),
        (F.col("vec_id") % 10 * 64 + F.col("cls")).cast("long").alias("flat"),
        F.col("x").cast("double").alias("logit"),
    )


LOGITS_SQL = """
long AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS cls FROM embeddings),
logits AS (SELECT vec_id // 10 AS page, vec_id AS query, CAST(vec_id % 10 * 64 + cls AS BIGINT) AS flat, x::DOUBLE AS logit FROM long)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, i, j, logit: dot products of the vectors of a page of ten, i before j."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("page"), F.col("vec_id").alias("v"), "embedding")
    a, b = e.select("page", F.col("v").alias("i"), F.col("embedding").alias("a")), e.select("page", F.col("v").alias("j"), F.col("embedding").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "page").where("i < j").select("page", "i", "j", F.round(dot, 6).alias("logit"))


PAIRS_SQL = """
pairs AS (
  SELECT a.vec_id // 10 AS page, a.vec_id AS i, b.vec_id AS j,
         round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS logit
  FROM embeddings a JOIN embeddings b ON a.vec_id // 10 = b.vec_id // 10 AND a.vec_id < b.vec_id
)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, w, h: page sizes made from the key."""
    p = table(spark, sf_dir, "page_texts").select("page_id").where("page_id is not null").distinct()
    return p.select("page_id", (F.lit(400) + F.col("page_id") * 37 % 3000).cast("int").alias("w"), (F.lit(300) + F.col("page_id") * 53 % 4000).cast("int").alias("h"))


PAGES_SQL = "pages AS (SELECT DISTINCT page_id, CAST(400 + page_id * 37 % 3000 AS INT) AS w, CAST(300 + page_id * 53 % 4000 AS INT) AS h FROM page_texts)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, idx, label, content, bbox: the latest version of every region; idx repeats nowhere in a page."""
    r = table(spark, sf_dir, "regions").select("region_id", "scan_id", "page_index", "region_index", "label", "content", "bbox_2d", "ingested_at")
    newest = latest_version(r, ["region_id"], ["ingested_at"])
    return newest.select(
        F.col("scan_id").alias("doc"),
        F.col("page_index").alias("page"),
        (F.col("region_index").cast("long") * 10_000_000 + F.col("region_id")).alias("idx"),
        "label",
        "content",
        F.col("bbox_2d").alias("bbox"),
    )


REGIONS_SQL = """
regs AS (
  SELECT scan_id AS doc, page_index AS page, region_index::BIGINT * 10000000 + region_id AS idx, label, content, bbox_2d AS bbox
  FROM (SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) = 1)
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, idx, task, width, height, prompt, seq of regions to recognise."""
    r = L.drop_abandoned(regions(spark, sf_dir).withColumn("task", dims.task_column(F.col("label"))).withColumnRenamed("idx", "pos"), ["doc", "page"])
    prompt = F
    for t, p in dims.PROMPTS.items():
        prompt = prompt.when(F.col("task") == t, F.lit(p))
    return r.where(F.col("task").isin(*dims.JOB_TASKS)).select(
        "doc", "page", "idx", "pos", "task", ((F.col("pos") % 3) * 16 + 16).cast("int").alias("width"), ((F.col("pos") % 2) * 8 + 16).cast("int").alias("height"), prompt.alias("prompt")
    )


JOBS_SQL = (
    REGIONS_SQL
    + f""", tasked AS (SELECT *, {_TASK} AS task FROM regs),
units AS (SELECT doc, page, idx AS pos, label, content, bbox, task, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INT) AS idx FROM tasked WHERE task <> 'abandon'),
jobs AS (
  SELECT doc, page, idx, pos, task, CAST(pos % 3 * 16 + 16 AS INT) AS width, CAST(pos % 2 * 8 + 16 AS INT) AS height,
         CASE task WHEN 'text' THEN 'Text Recognition:' WHEN 'table' THEN 'Table Recognition:' ELSE 'Formula Recognition:' END AS prompt
  FROM units WHERE task IN ('text', 'table', 'formula')
)"""
)

#: Hand-written strings that trigger every rule of the formatter.
EDGE = [
    "  plain text  ", "\\tlead\\t", "a.....b", "x····y", "__________", "\\_\\_\\_\\_end", "· dot item", "•item", "* star  item", "(1)one", "（2）two", "3.three", "4)  four", "a)alpha", "B）beta", "(c）mixed",
    "one\ntwo", "one\n\ntwo\nthree", "\nlead", "tail\n", "## - Heading", "# * Other", "###", "$$ x + y $$", "\\[ a = b \\]", "\\( c \\)", "$$", "$$$", "plain formula", "", "   ", "1.", "(x)", "12", "1.2\n3", "word-", "- kept", "*no", "·", "　wide　", "multi\n1)x",
]


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, content over EDGE, each under a title, a text and a formula label."""
    rows = [(i * 3 + k, label, x) for i, x in enumerate(EDGE) for k, label in enumerate(("text", "display_formula", "paragraph_title"))]
    return spark.createDataFrame(rows, "id int, label string, content string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EDGE_SQL = "edge(id, label, content) AS (VALUES " + ", ".join(
    f"({i * 3 + k}, '{label}', {_quoted(x)})" for i, x in enumerate(EDGE) for k, label in enumerate(("text", "display_formula", "paragraph_title"))
) + ")"
