"""Queries over sources' arithmetic, jobs, bundles, diagnostics and model sizes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import adapters, dims
from quire.config import Bundle, Config
from quire.functions import model_math as M
from quire.operators import bundle as B
from quire.operators import formatting as O
from quire.operators import jobs as J
from quire.operators import layout as L
from quire.plans import fixtures as X
from quire.plans import format_queries as Q
from quire.session import table
from quire.sources import files as S
from quire.sources import sinks


def s01_inputs(spark, d):
    """Files of a listing with a known extension, in natural order, and their kind."""
    listing = table(spark, d, "scans").select(F.concat(F.lit("/in/"), "stem", F.lit("."), "ext").alias("path")).distinct()
    return S.natural_order(S.accepted(listing)).select("path", "stem", "kind", F.col("pos").cast("int").alias("pos"))


def s07_page_cap(spark, d):
    p = table(spark, d, "scans").select("scan_id", "kind", "page_count").distinct()
    return S.page_numbers(p, M.page_cap(4, 6)).select("scan_id", "page_index")


def s08_raster(spark, d):
    p = X.pages(spark, d)
    return p.select("page_id", M.raster_size(F.col("w").cast("double"), F.col("h").cast("double")).alias("ceiled"), M.raster_size(F.col("w").cast("double"), F.col("h").cast("double"), whole="round").alias("rounded"))


def s10_empty(spark, d):
    docs = table(spark, d, "scans").select(F.col("scan_id").alias("doc"), "stem").distinct()
    return S.empty_documents(docs, X.regions(spark, d), "doc").select("doc", "stem", "error")


def c01_markdown_files(spark, d):
    """Newline-terminated Markdown by stem, by the column that the sinks write."""
    names = table(spark, d, "scans").groupBy(F.col("scan_id").alias("doc")).agg(F.min("stem").alias("stem"))
    return names.join(Q.f14_documents(spark, d), "doc").select("stem", sinks.terminated(F.col("markdown")).alias("content"))


def ref_p01_page_mismatch(spark, d):
    scans = table(spark, d, "scans").select(F.col("scan_id").alias("doc"), "page_count").distinct().where("page_count > 0")
    pages = scans.select("doc", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    return J.page_mismatch(pages, X.regions(spark, d).where("label <> 'seal'"))


def ref_p02_pair_pages(spark, d):
    pages = table(spark, d, "scans").select(F.col("scan_id").alias("doc"), "page_count").distinct().where("page_count > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    return J.pair_pages(pages, X.regions(spark, d)).select("doc", "page", "idx", "label")


def _units(spark, d):
    r = X.regions(spark, d).withColumn("task", dims.task_column(F.col("label"))).withColumnRenamed("idx", "pos")
    return L.drop_abandoned(r, O.PAGE)


def ref_p03_units(spark, d):
    return _units(spark, d).select("doc", "page", "pos", "idx", "task")


def ref_p04_counters(spark, d):
    return J.counters(_units(spark, d))


def ref_p05_pixel_box(spark, d):
    u = _units(spark, d)
    return u.select("pos", J.pixel_box(F.col("bbox"), F.lit(640), F.lit(480)).alias("box"))


def ref_p07_crop_failures(spark, d):
    u = _units(spark, d).withColumn("crop", J.pixel_box(F.col("bbox"), F.lit(64), F.lit(48)))
    return J.crop_failures(u).where("warning is not null").select("doc", "page", "idx", "content", "warning")


def ref_p08_jobs(spark, d):
    return J.make_jobs(_units(spark, d)).select("doc", "page", "idx", "task")


def ref_p09_prompts(spark, d):
    u = _units(spark, d)
    override = F.when(F.col("pos") % 3 == 0, " \t").when(F.col("pos") % 3 == 1, " Read it: ")
    return J.make_jobs(u, override=override).select("doc", "page", "idx", "prompt")


def ref_p10_buckets(spark, d):
    return J.buckets(X.jobs(spark, d)).select("doc", "page", "idx", F.col("seq").cast("int").alias("seq"), F.col("bucket").cast("int").alias("bucket"))


def ref_p11_batches(spark, d):
    return J.batches(J.buckets(X.jobs(spark, d)), 4).select("doc", "page", "idx", F.col("bucket").cast("int").alias("bucket"), "batch")


def ref_p12_recognise(spark, d):
    return adapters.recognise(X.jobs(spark, d), adapters.StubRecognizer()).select("doc", "page", "idx", "text")


class _NoFormulas(adapters.StubRecognizer):
    """Fails for batches of formulas."""

    def recognize(self, batch):
        if "formula" in set(batch["task"]):
            raise RuntimeError("engine stopped")
        return super().recognize(batch)


def ref_p13_failed_batches(spark, d):
    """Each job of a failed batch has its error."""
    return adapters.recognise(X.jobs(spark, d), _NoFormulas()).select("doc", "page", "idx", "text", "error")


def ref_p15_scheduler_stats(spark, d):
    return J.scheduler_stats(J.batches(J.buckets(X.jobs(spark, d)), 4))


def _results(spark, d):
    """Texts by key; every seventh job failed, every eleventh has no result."""
    j = X.jobs(spark, d).where("pos % 11 <> 0")
    bad = F.col("pos") % 7 == 0
    return j.select("doc", "page", "idx", F.when(~bad, F.concat(F.lit("text "), F.col("pos").cast("string"))).alias("text"), F.when(bad, "engine stopped").alias("error"))


def ref_p16_merge(spark, d):
    u = _units(spark, d).withColumn("content", F.lit(None).cast("string"))
    return J.merge_results(u, _results(spark, d)).select("doc", "page", "idx", "content", "warning")


def _page_results(spark, d):
    p = table(spark, d, "page_texts").select(F.col("scan_id").alias("doc"), F.col("page_index").alias("page")).distinct()
    bad = (F.col("doc") + F.col("page")) % 5 == 0
    return p, p.where("(doc * 3 + page) % 7 <> 0").select("doc", "page", F.when(~bad, F.lit("whole page")).alias("text"), F.when(bad, "engine stopped").alias("error"))


def ref_p17_merge_pages(spark, d):
    p, r = _page_results(spark, d)
    return J.merge_page_results(p, r).select("doc", "page", "content", "warning")


def ref_p18_page_jobs(spark, d):
    p = table(spark, d, "page_texts").select(F.col("scan_id").alias("doc"), F.col("page_index").alias("page"), F.lit(640).alias("w"), F.lit(480).alias("h")).distinct()
    return J.page_jobs(p)


def _out(spark, d):
    return O.blocks(X.regions(spark, d))


def b01_candidates(spark, d):
    c = B.candidates(_out(spark, d))
    return c.select("doc", "page", "idx", F.col("page_ordinal").cast("int").alias("page_ordinal"), F.col("ordinal").cast("int").alias("ordinal"))


def b02_pixel_box(spark, d):
    c = B.candidates(_out(spark, d))
    return c.select("doc", "page", "idx", J.pixel_box(F.col("bbox"), F.lit(2480), F.lit(3508)).alias("box"))


def b04_names(spark, d):
    c = B.candidates(_out(spark, d)).withColumn("idx", F.when(F.col("idx") == 0, 12345).otherwise(F.col("idx")))
    up = Bundle(figure_format="jpeg", figure_naming="upstream_cropped")
    cols = (F.col("page"), F.col("idx"), F.col("page_ordinal"))
    return c.select("doc", "page", "idx", B.file_name(*cols).alias("padded"), B.file_name(*cols, up).alias("upstream"))


def b05_sha256(spark, d):
    return X.regions(spark, d).where("content is not null").select("idx", B.sha256(F.encode("content", "UTF-8")).alias("digest"))


def b06_markers(spark, d):
    rows = _out(spark, d)
    md = O.document_markdown(O.page_markdown(O.placeholders(rows)))
    f = B.figures(rows).withColumn("path", F.when(F.col("ordinal") % 4 != 3, F.col("relative_path")))
    paths = f.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]).alias("paths"))
    both = md.join(paths, "doc", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return both.select("doc", B.rewrite_markers(F.col("markdown"), F.col("paths")).alias("markdown"), B.marker_mismatch(F.col("markdown"), F.col("paths")).alias("warning"))


def b07_sidecar(spark, d):
    """Sidecars of all documents: every region's content and box, every figure on a page of 2480 x 3508, without its bytes."""
    rows = _out(spark, d)
    made = B.figures(rows).withColumn("box", J.pixel_box(F.col("bbox"), F.lit(2480), F.lit(3508))).withColumn("data", F.lit(None).cast("binary"))
    assets = B.figure_assets(made.withColumn("problem", F.when(F.col("box").isNull(), "crop").otherwise("pixels")))
    lost = made.where("box is null").select("doc", F.lit(3).alias("stage"), "page", "idx", B.figure_warning(F.lit("crop")).alias("warning"))
    out = O.page_results(rows).join(assets, "doc", "left").join(B.collect_warnings(lost), "doc", "left")
    figures = F.coalesce("figures", F.array().cast(assets.schema["figures"].dataType))
    json = B.sidecar_json(B.sidecar_pages(F.col("pages")), B.figure_records(figures), F.coalesce("warnings", F.array().cast("array<string>")), F.create_map(F.lit("total"), F.lit(1.5)), F.create_map(F.lit("k"), F.lit("v")))
    return out.select("doc", json.alias("sidecar"))


def d02_metadata(spark, d):
    """Every key of every document's metadata."""
    units = _units(spark, d)
    stats = J.counters(units).join(units.groupBy("doc").agg(F.count_distinct("page").alias("pages")), "doc")
    found = B.metadata(stats.join(J.scheduler_stats(J.batches(J.buckets(X.jobs(spark, d)), 4)), "doc", "left"), Config())
    return found.select("doc", F.explode("metadata").alias("key", "value"))


def d03_prompt_hash(spark, d):
    return X.jobs(spark, d).select("prompt").distinct().select("prompt", B.prompt_hash(F.col("prompt")).alias("digest"))


def d04_warnings(spark, d):
    u = _units(spark, d).withColumn("content", F.lit(None).cast("string"))
    merged = J.merge_results(u, _results(spark, d)).select("doc", F.lit(2).alias("stage"), "page", "idx", "warning")
    crops = J.crop_failures(_units(spark, d).withColumn("crop", J.pixel_box(F.col("bbox"), F.lit(64), F.lit(48)))).select("doc", F.lit(1).alias("stage"), "page", "idx", "warning")
    return B.collect_warnings(merged.unionByName(crops))


def m04_query_topk(spark, d):
    best = X.logits(spark, d).groupBy("page", "query").agg(F.max("logit").alias("score"))
    return L.top_k(best, ["page"], 3, "score", "query").select("page", "query", F.round("score", 6).alias("score"), "rank")


def m05_anchors(spark, d):
    return M.anchors(spark, [(80, 80), (40, 40), (20, 20)])


def m06_mask_box(spark, d):
    e = table(spark, d, "embeddings")
    mask = F.transform("embedding", lambda x: F.when(x > 0.2, 1.0).otherwise(-1.0))
    return e.select("vec_id", F.transform(M.mask_box(mask, 8), lambda v: F.round(v, 6)).alias("box"))


def m07_smart_resize(spark, d):
    return X.pages(spark, d).select("page_id", M.smart_resize(F.lit(2), F.col("h"), F.col("w")).alias("plain"), M.smart_resize(F.lit(2), F.col("h"), F.col("w"), most=1_003_520).alias("small"), M.smart_resize(F.lit(2), F.col("h") % 30 + 1, F.col("w") % 200 + 1).alias("tiny"))


def m08_backend(spark, d):
    return X.pages(spark, d).select("page_id", M.resize_backend(F.col("h") % 40, F.col("w") % 400).alias("backend"))


def m11_tokens(spark, d):
    p = X.pages(spark, d)
    tokens = F.array(F.lit(1), F.lit(99), F.lit(3), F.lit(99))
    return p.select("page_id", M.image_tokens(F.lit(1), F.floor(F.col("h") / 280), F.floor(F.col("w") / 280)).alias("n"), M.expand_placeholder(tokens, 99, (F.col("page_id") % 4).cast("int")).alias("ids"))


def m12_prompt(spark, d):
    return X.jobs(spark, d).select("prompt").distinct().select("prompt", M.chat_prompt(F.col("prompt")).alias("text"))


def m13_left_pad(spark, d):
    p = X.pages(spark, d)
    ids = F.sequence(F.lit(1), (F.col("page_id") % 5 + 1).cast("int"))
    padded, mask = M.left_pad(ids, F.lit(6), 0)
    return p.select("page_id", padded.alias("ids"), mask.alias("mask"))


def _vocabulary(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "x")).select("vec_id", "token", F.round(F.col("x").cast("double") * 4, 4).alias("logit"))


def m16_filters(spark, d):
    return M.sampling_filters(_vocabulary(spark, d), ["vec_id"], 0.9, 12).select("vec_id", "token", F.round("p", 8).alias("p"))


def m16_argmax(spark, d):
    """The next token at temperature 0, penalised by the last 20 of 30 tokens."""
    history = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: ((F.col("vec_id") * 7 + i * i) % 64).cast("int"))
    return M.next_token(_vocabulary(spark, d).withColumn("history", history), ["vec_id"], temperature=0, penalty=1.5)


def m16_penalty(spark, d):
    return _vocabulary(spark, d).select("vec_id", "token", (F.round(M.repetition_penalty(F.col("logit"), F.col("token") < 20), 6) + 0.0).alias("logit"))


def m17_stop(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("page_id") * (i + 1)) % 11).cast("int"))
    return X.pages(spark, d).select("page_id", M.until_stop(tokens, [3, 7], 8).alias("ids"))


def m19_snapshot(spark, d):
    s = table(spark, d, "scans").select(F.col("source").alias("model"), F.col("stem").alias("name"), (F.col("n_bytes") % 3 == 0).alias("is_symlink"), F.concat(F.lit("to/"), "stem").alias("target"), F.date_trunc("month", "modified_at").alias("mtime")).distinct()
    return M.newest_snapshot(s)


def m20_signature(spark, d):
    return M.input_signature(X.jobs(spark, d)).select("doc", "page", "idx", "image_tokens", "prompt_chars")


def c02_page_json(spark, d):
    return sinks.page_json(_out(spark, d))


_J = f"WITH {X.JOBS_SQL.strip()}"
_PX = """CASE WHEN len(bbox) = 4 AND {0} < {2} AND {1} < {3} THEN [{0}, {1}, {2}, {3}] END"""


def _cells(w: int, h: int) -> str:
    return _PX.format(*[f"greatest(0, least({s}, CAST(trunc(bbox[{i}]::DOUBLE * {s} / 1000) AS INT)))" for i, s in ((1, w), (2, h), (3, w), (4, h))])


_SEQ = f"""{_J}, s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, idx) - 1 AS seq FROM jobs),
firsts AS (SELECT doc, prompt, task, width, height, min(seq) AS f FROM s GROUP BY ALL), nums AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY f) - 1 AS bucket FROM firsts),
b AS (SELECT s.*, n.bucket FROM s JOIN nums n USING (doc, prompt, task, width, height)),
bb AS (SELECT *, CAST((SELECT count(*) FROM b o WHERE o.doc = b.doc AND o.bucket = b.bucket AND o.seq < b.seq) // 4 AS INT) AS batch FROM b)"""
_RES = f"""{_J}, res AS (SELECT doc, page, idx, CASE WHEN pos % 7 <> 0 THEN 'text ' || pos END AS text, CASE WHEN pos % 7 = 0 THEN 'engine stopped' END AS error FROM jobs WHERE pos % 11 <> 0),
merged AS (SELECT u.doc, u.page, u.idx, CASE WHEN r.error IS NOT NULL THEN '' ELSE r.text END AS content,
  CASE WHEN r.error IS NOT NULL THEN 'page[' || u.page || '] region[' || u.idx || '] recognition failed: ' || r.error END AS warning FROM units u LEFT JOIN res r USING (doc, page, idx))"""
_CROPS = f"SELECT doc, page, idx, '' AS content, 'page[' || page || '] region[' || idx || '] crop failed' AS warning FROM (SELECT *, {_cells(64, 48)} AS crop FROM units) WHERE crop IS NULL AND task IN ('text', 'table', 'formula')"
_CAND = f"""{Q.BLOCKS_SQL}, cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INT) AS page_ordinal, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, idx) - 1 AS INT) AS ordinal
  FROM blocks WHERE out_label = 'image' AND len(bbox) = 4)"""
_DOCMD = f"{Q.marks_sql('blocks', 'k').strip()}, pagesmd AS ({Q._PAGE_MD} k GROUP BY doc, page), docmd AS (SELECT doc, string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS markdown FROM pagesmd GROUP BY doc)"
_PAD = "CASE WHEN len(({0})::VARCHAR) >= 4 THEN ({0})::VARCHAR ELSE lpad(({0})::VARCHAR, 4, '0') END"
_SCANPAGES = "scanpages AS (SELECT doc, CAST(unnest(range(page_count)) AS INT) AS page FROM (SELECT DISTINCT scan_id AS doc, page_count FROM scans WHERE page_count > 0))"


def _resize(h: str, w: str, most: int) -> str:
    g = f"CASE WHEN {h} < 28 OR {w} < 28 THEN greatest(28.0::DOUBLE / {h}, 28.0::DOUBLE / {w}) ELSE 1.0::DOUBLE END"
    return f"""(SELECT CASE WHEN greatest(hh, ww) / least(hh, ww) <= 200 THEN CASE
      WHEN 2 * hb * wb > {most} THEN [CAST(greatest(28, floor(hh / sqrt(2 * hh * ww / {most}.0) / 28) * 28) AS INT), CAST(greatest(28, floor(ww / sqrt(2 * hh * ww / {most}.0) / 28) * 28) AS INT)]
      WHEN 2 * hb * wb < 12544 THEN [CAST(ceil(hh * sqrt(12544.0 / (2 * hh * ww)) / 28) * 28 AS INT), CAST(ceil(ww * sqrt(12544.0 / (2 * hh * ww)) / 28) * 28 AS INT)]
      ELSE [CAST(hb AS INT), CAST(wb AS INT)] END END
      FROM (SELECT hh, ww, round(hh / 28) * 28 AS hb, round(ww / 28) * 28 AS wb FROM (SELECT floor({h} * ({g})) AS hh, floor({w} * ({g})) AS ww)))"""


SQL = {
    "s01_inputs": """WITH f AS (SELECT DISTINCT '/in/' || stem || '.' || ext AS path, ext FROM scans WHERE lower(ext) IN ('png', 'jpg', 'jpeg', 'heic', 'pdf')),
      n AS (SELECT path, regexp_replace(path, '^.*/', '') AS name, CASE WHEN lower(ext) = 'pdf' THEN 'pdf' ELSE 'image' END AS kind FROM f),
      k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(ltrim(t, '0'), 20, '0') ELSE t END), '') AS nat FROM n)
      SELECT path, regexp_replace(name, '[.][^.]*$', '') AS stem, kind, CAST(row_number() OVER (ORDER BY nat COLLATE "C", path COLLATE "C") - 1 AS INT) AS pos FROM k""",
    "s07_page_cap": "WITH s AS (SELECT DISTINCT scan_id, kind, page_count FROM scans) SELECT scan_id, CAST(unnest(range(CASE WHEN kind = 'pdf' THEN least(coalesce(page_count, 0), 4) ELSE 1 END)) AS INT) AS page_index FROM s",
    "s08_raster": f"""WITH {X.PAGES_SQL}, s AS (SELECT *, least(200 / 72.0::DOUBLE, 3500.0::DOUBLE / greatest(w, h)) AS f FROM pages)
      SELECT page_id, [greatest(1, CAST(ceil(w * f) AS INT)), greatest(1, CAST(ceil(h * f) AS INT))] AS ceiled, [greatest(1, CAST(round(w * f) AS INT)), greatest(1, CAST(round(h * f) AS INT))] AS rounded FROM s""",
    "s10_empty": f"WITH {X.REGIONS_SQL.strip()} SELECT DISTINCT scan_id AS doc, stem, 'the document has no pages' AS error FROM scans WHERE scan_id NOT IN (SELECT doc FROM regs WHERE doc IS NOT NULL)",
    "c01_markdown_files": Q.SQL["f14_documents"].replace("SELECT doc, string_agg(markdown", "SELECT (SELECT min(stem) FROM scans WHERE scan_id = doc) AS stem, rtrim(string_agg(markdown").replace("ORDER BY page) AS markdown FROM pages GROUP BY doc", "ORDER BY page), chr(10)) || chr(10) AS content FROM pages WHERE doc IN (SELECT scan_id FROM scans) GROUP BY doc"),
    "ref_p01_page_mismatch": f"""WITH {X.REGIONS_SQL.strip()}, {_SCANPAGES}, a AS (SELECT doc, count(*) AS pages FROM scanpages GROUP BY doc), b AS (SELECT doc, count(DISTINCT page) AS detected FROM regs WHERE label <> 'seal' GROUP BY doc)
      SELECT doc, coalesce(pages, 0) AS pages, coalesce(detected, 0) AS detected FROM a FULL JOIN b USING (doc) WHERE coalesce(pages, 0) <> coalesce(detected, 0)""",
    "ref_p02_pair_pages": f"WITH {X.REGIONS_SQL.strip()}, {_SCANPAGES} SELECT doc, page, idx, label FROM regs SEMI JOIN scanpages USING (doc, page)",
    "ref_p03_units": f"{_J} SELECT doc, page, pos, idx, task FROM units",
    "ref_p04_counters": f"""{_J} SELECT doc, count(*) AS detections, count(*) FILTER (task = 'skip') AS skip_count, count(*) FILTER (task = 'text') AS text_count, count(*) FILTER (task = 'table') AS table_count,
      count(*) FILTER (task = 'formula') AS formula_count, count(*) FILTER (task IN ('text', 'table', 'formula')) AS jobs FROM units GROUP BY doc""",
    "ref_p05_pixel_box": f"{_J} SELECT pos, {_cells(640, 480)} AS box FROM units",
    "ref_p07_crop_failures": f"{_J} {_CROPS}",
    "ref_p08_jobs": f"{_J} SELECT doc, page, idx, task FROM units WHERE task NOT IN ('skip', 'abandon')",
    "ref_p09_prompts": f"{_J} SELECT doc, page, idx, CASE WHEN pos % 3 = 1 THEN 'Read it:' ELSE prompt END AS prompt FROM jobs",
    "ref_p10_buckets": f"{_SEQ} SELECT doc, page, idx, CAST(seq AS INT) AS seq, CAST(bucket AS INT) AS bucket FROM b",
    "ref_p11_batches": f"{_SEQ} SELECT doc, page, idx, CAST(bucket AS INT) AS bucket, batch FROM bb",
    "ref_p12_recognise": f"""{_J} SELECT doc, page, idx, CASE task WHEN 'table' THEN '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' WHEN 'formula' THEN 'x^2 + y^2 = z^2'
      ELSE 'Recognized text ' || width || 'x' || height END AS text FROM jobs""",
    "ref_p13_failed_batches": f"""{_J} SELECT doc, page, idx, CASE task WHEN 'table' THEN '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' WHEN 'text' THEN 'Recognized text ' || width || 'x' || height END AS text,
      CASE task WHEN 'formula' THEN 'engine stopped' END AS error FROM jobs""",
    "ref_p15_scheduler_stats": f"""{_SEQ}, n AS (SELECT doc, bucket, batch, count(*) AS n FROM bb GROUP BY ALL)
      SELECT doc, count(DISTINCT bucket) AS buckets, count(*) AS batches, max(n) AS max_batch, round(avg(n), 4) AS mean_batch, CAST(sum(n) AS BIGINT) AS queued FROM n GROUP BY doc""",
    "ref_p16_merge": f"{_RES} SELECT * FROM merged",
    "ref_p17_merge_pages": """WITH p AS (SELECT DISTINCT scan_id AS doc, page_index AS page FROM page_texts)
      SELECT doc, page, CASE WHEN (doc * 3 + page) % 7 = 0 OR (doc + page) % 5 = 0 THEN '' ELSE 'whole page' END AS content,
      CASE WHEN (doc * 3 + page) % 7 = 0 THEN 'page[' || page || '] region[0] recognition failed: missing result' WHEN (doc + page) % 5 = 0 THEN 'page[' || page || '] region[0] recognition failed: engine stopped' END AS warning FROM p""",
    "ref_p18_page_jobs": f"SELECT DISTINCT scan_id AS doc, page_index AS page, 0 AS idx, 'text' AS task, '{dims.PAGE_PROMPT}' AS prompt, 640 AS width, 480 AS height FROM page_texts",
    "b01_candidates": f"{_CAND} SELECT doc, page, idx, page_ordinal, ordinal FROM cand",
    "b02_pixel_box": f"{_CAND} SELECT doc, page, idx, {_cells(2480, 3508)} AS box FROM cand",
    "b04_names": f"""{_CAND}, c AS (SELECT doc, page, CASE WHEN idx = 0 THEN 12345 ELSE idx END AS idx, page_ordinal FROM cand)
      SELECT doc, page, idx, 'page_' || {_PAD.format('page + 1')} || '_region_' || {_PAD.format('idx + 1')} || '.heic' AS padded, 'cropped_page' || page || '_idx' || page_ordinal || '.jpg' AS upstream FROM c""",
    "b05_sha256": f"WITH {X.REGIONS_SQL.strip()} SELECT idx, sha256(content) AS digest FROM regs WHERE content IS NOT NULL",
    "b06_markers": f"""{_CAND.replace("blocks WHERE out_label", "blocks WHERE out_label")}, named AS (SELECT doc, page, idx, CASE WHEN ordinal % 4 <> 3 THEN 'figures/page_' || {_PAD.format('page + 1')} || '_region_' || {_PAD.format('idx + 1')} || '.heic' END AS path, page_ordinal FROM cand),
      shown AS (SELECT b.doc, b.page, b.idx, CASE WHEN n.doc IS NULL THEN b.block WHEN n.path IS NULL THEN '![Image ' || b.page || '-' || n.page_ordinal || '](page=' || b.page || ',bbox=[' || array_to_string(b.bbox, ', ') || '])'
        ELSE '![Image ' || b.page || '-' || n.page_ordinal || '](' || n.path || ')' END AS block FROM blocks b LEFT JOIN named n USING (doc, page, idx)),
      pg AS ({Q._PAGE_MD} shown GROUP BY doc, page) SELECT doc, string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS markdown, NULL::VARCHAR AS warning FROM pg GROUP BY doc""",
    "b07_sidecar": f"""{_CAND}, pg AS (SELECT doc, page, '{{"regions":[' || string_agg('{{' || coalesce('"bbox2D":[' || array_to_string(bbox, ',') || '],', '') || coalesce('"content":' || to_json(block)::VARCHAR || ',', '') || '"index":' || idx || ',"label":"' || out_label || '"}}', ',' ORDER BY idx) || ']}}' AS j FROM blocks GROUP BY doc, page),
      px AS (SELECT *, {_cells(2480, 3508)} AS box, 'page_' || {_PAD.format('page + 1')} || '_region_' || {_PAD.format('idx + 1')} || '.heic' AS name FROM cand),
      fg AS (SELECT doc, string_agg('{{"altText":"Image ' || page || '-' || page_ordinal || '","bbox2D":[' || array_to_string(bbox, ',') || '],"fileName":"' || name || '","heightPX":' || (box[4] - box[2]) || ',"label":"image","mimeType":"image/heic","pageIndex":' || page
        || ',"regionIndex":' || idx || ',"relativePath":"figures/' || name || '","widthPX":' || (box[3] - box[1]) || '}}', ',' ORDER BY ordinal) AS j FROM px WHERE box IS NOT NULL GROUP BY doc),
      w AS (SELECT doc, string_agg('"bundle.figure crop failed: page=' || page || ' region=' || idx || '"', ',' ORDER BY page, idx) AS j FROM px WHERE box IS NULL GROUP BY doc)
      SELECT doc, '{{"diagnostics":{{"metadata":{{"k":"v"}},"timingsMs":{{"total":1.5}},"warnings":[' || coalesce(any_value(w.j), '') || ']}},"figures":[' || coalesce(any_value(fg.j), '') || '],"figuresDirectory":"figures","markdownPath":"document.md","pages":['
        || string_agg(pg.j, ',' ORDER BY page) || '],"schemaVersion":1}}' AS sidecar FROM pg LEFT JOIN fg USING (doc) LEFT JOIN w USING (doc) GROUP BY doc""",
    "d02_metadata": f"""{_SEQ}, n AS (SELECT doc, bucket, batch, count(*) AS n FROM bb GROUP BY ALL), st AS (SELECT doc, count(*) AS batches, count(DISTINCT bucket) AS buckets, max(n) AS most, avg(n) AS mean, sum(n) AS queued FROM n GROUP BY doc),
      c AS (SELECT doc, count(*) AS dets, count(DISTINCT page) AS pages, count(*) FILTER (task = 'skip') AS skip, count(*) FILTER (task = 'text') AS text, count(*) FILTER (task = 'table') AS tab, count(*) FILTER (task = 'formula') AS formula FROM units GROUP BY doc),
      j AS (SELECT c.*, coalesce(batches, 0) AS batches, coalesce(buckets, 0) AS buckets, coalesce(most, 0) AS most, coalesce(mean, 0) AS mean, coalesce(queued, 0) AS queued FROM c LEFT JOIN st USING (doc)),
      own AS (SELECT doc, unnest([('pageCount', pages::VARCHAR), ('layoutDetectionCount', dets::VARCHAR), ('detectionCount', dets::VARCHAR), ('skipRegionCount', skip::VARCHAR), ('recognitionTextJobCount', text::VARCHAR), ('recognitionTableJobCount', tab::VARCHAR),
        ('recognitionFormulaJobCount', formula::VARCHAR), ('recognitionJobCount', (text + tab + formula)::VARCHAR), ('inferenceBucketCount', buckets::VARCHAR), ('inferenceBatchCount', batches::VARCHAR), ('inferenceMaxBatchSize', most::VARCHAR),
        ('inferenceQueuedJobCount', CAST(queued AS BIGINT)::VARCHAR), ('inferenceAverageBatchSize', printf('%.2f', mean::DOUBLE))]) AS e FROM j),
      fixed(key, value) AS (VALUES ('layoutEnabled', 'true'), ('markdownBundleEnabled', 'false'), ('markdownBundleGenerated', 'false'), ('markdownBundleFigureCount', '0'), ('maxConcurrentRecognitions', '1'), ('maxPagesOption', 'nil'), ('defaultMaxPages', 'nil'), ('effectiveMaxPages', 'nil'),
        ('pdfDPI', '200'), ('pdfMaxRenderedLongSide', '3500'), ('inferenceBatchSize', '4'), ('inferenceBatchMaxWaitMs', '8'), ('inferenceMaxInflightJobs', '1'), ('pdfRenderConcurrency', '2'), ('ocrPreprocessConcurrency', '4'), ('bundleEncodeConcurrency', '2'),
        ('layoutPostprocessFastPath', 'true'), ('pageRenderDebugDump', 'nil'), ('pageRenderDebugCount', '0'), ('noLayoutPromptHash', left(sha256('{dims.PAGE_PROMPT}'), 16)), ('textPromptHash', left(sha256('Text Recognition:'), 16)),
        ('tablePromptHash', left(sha256('Table Recognition:'), 16)), ('formulaPromptHash', left(sha256('Formula Recognition:'), 16)))
      SELECT doc, e[1] AS key, e[2] AS value FROM own UNION ALL SELECT doc, key, value FROM j, fixed""",
    "d03_prompt_hash": f"{_J} SELECT DISTINCT prompt, left(sha256(prompt), 16) AS digest FROM jobs",
    "d04_warnings": f"""{_RES}, w AS (SELECT doc, 2 AS stage, page, idx, warning FROM merged WHERE warning IS NOT NULL UNION ALL SELECT doc, 1, page, idx, warning FROM ({_CROPS}))
      SELECT doc, list(warning ORDER BY stage, page, idx) AS warnings FROM w GROUP BY doc""",
    "m04_query_topk": f"""WITH {X.LOGITS_SQL.strip()}, b AS (SELECT page, query, max(logit) AS s FROM logits GROUP BY page, query)
      SELECT page, query, round(s, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY s DESC, query) - 1 AS INT) AS rank FROM b) WHERE rank < 3""",
    "m05_anchors": """WITH l(level, g, wh) AS (VALUES (0, 80, 0.05::DOUBLE), (1, 40, 0.1::DOUBLE), (2, 20, 0.2::DOUBLE)), ys AS (SELECT *, CAST(unnest(range(g)) AS INT) AS y FROM l), xs AS (SELECT *, CAST(unnest(range(g)) AS INT) AS x FROM ys),
      c AS (SELECT level, y, x, (x + 0.5) / g::DOUBLE AS cx, (y + 0.5) / g::DOUBLE AS cy, wh FROM xs), v AS (SELECT *, cx > 0.01 AND cx < 0.99 AND cy > 0.01 AND cy < 0.99 AS valid FROM c)
      SELECT level, y, x, CASE WHEN valid THEN round(ln(cx / (1 - cx)), 6) END AS cx, CASE WHEN valid THEN round(ln(cy / (1 - cy)), 6) END AS cy, CASE WHEN valid THEN round(ln(wh / (1 - wh)), 6) END AS wh, valid FROM v""",
    "m06_mask_box": """WITH c AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), b AS (SELECT vec_id, min(i % 8) AS x1, max(i % 8) + 1 AS x2, min(i // 8) AS y1, max(i // 8) + 1 AS y2 FROM c WHERE e > 0.2::DOUBLE GROUP BY vec_id)
      SELECT vec_id, CASE WHEN x1 IS NULL THEN [0.5::DOUBLE, 0.5, 0.001, 0.001] ELSE [round((x1 + x2) / 16.0::DOUBLE, 6), round((y1 + y2) / 16.0::DOUBLE, 6), round((x2 - x1) / 8.0::DOUBLE, 6), round((y2 - y1) / 8.0::DOUBLE, 6)] END AS box FROM embeddings LEFT JOIN b USING (vec_id)""",
    "m07_smart_resize": f"WITH {X.PAGES_SQL} SELECT page_id, {_resize('h', 'w', 9633792)} AS plain, {_resize('h', 'w', 1003520)} AS small, {_resize('(h % 30 + 1)', '(w % 200 + 1)', 9633792)} AS tiny FROM pages",
    "m08_backend": f"WITH {X.PAGES_SQL} SELECT page_id, CASE WHEN h % 40 <= 24 OR w % 400 >= 8 * (h % 40) THEN 'vimage' ELSE 'lanczos' END AS backend FROM pages",
    "m11_tokens": f"""WITH {X.PAGES_SQL} SELECT page_id, greatest(1, CAST((h // 280) * (w // 280) // 4 AS INT)) AS n,
      list_concat(list_concat([1], list_transform(range(page_id % 4), lambda i: 99)), [3, 99]) AS ids FROM pages""",
    "m12_prompt": f"{_J} SELECT DISTINCT prompt, '[gMASK]<sop><|user|>' || chr(10) || '<|begin_of_image|><|image|><|end_of_image|>' || prompt || '<|assistant|>' || chr(10) AS text FROM jobs",
    "m13_left_pad": f"""WITH {X.PAGES_SQL}, n AS (SELECT page_id, CAST(page_id % 5 + 1 AS INT) AS n FROM pages) SELECT page_id, list_transform(range(1, 7), lambda i: CASE WHEN i > 6 - n THEN CAST(i - (6 - n) AS INT) ELSE 0 END) AS ids,
      list_transform(range(1, 7), lambda i: CASE WHEN i > 6 - n THEN 1 ELSE 0 END) AS mask FROM n""",
    "m16_filters": """WITH v AS (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS token FROM embeddings), l AS (SELECT vec_id, token, round(x::DOUBLE * 4, 4) AS logit FROM v),
      e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT *, round(e / sum(e) OVER (PARTITION BY vec_id), 12) AS p FROM e),
      c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p, token DESC ROWS UNBOUNDED PRECEDING) AS below, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS r FROM p)
      SELECT vec_id, token, round(p, 8) AS p FROM c WHERE round(below, 9) > 0.1 AND r <= 12""",
    "m16_argmax": """WITH v AS (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS token FROM embeddings), l AS (SELECT vec_id, token, round(x::DOUBLE * 4, 4) AS logit FROM v),
      p AS (SELECT vec_id, token, CASE WHEN NOT list_contains(list_transform(range(10, 30), lambda i: CAST((vec_id * 7 + i * i) % 64 AS INT)), token) THEN logit WHEN logit < 0 THEN logit * 1.5::DOUBLE ELSE logit / 1.5::DOUBLE END AS logit FROM l)
      SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM p) WHERE r = 1""",
    "m16_penalty": """WITH v AS (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS token FROM embeddings), l AS (SELECT vec_id, token, round(x::DOUBLE * 4, 4) AS logit FROM v)
      SELECT vec_id, token, round(CASE WHEN token >= 20 THEN logit WHEN logit < 0 THEN logit * 1.1::DOUBLE ELSE logit / 1.1::DOUBLE END, 6) + 0.0::DOUBLE AS logit FROM l""",
    "m17_stop": f"""WITH {X.PAGES_SQL}, t AS (SELECT page_id, list_transform(range(0, 10), lambda i: CAST(page_id * (i + 1) % 11 AS INT)) AS t FROM pages),
      s AS (SELECT *, list_min(list_filter([list_position(t, 3), list_position(t, 7)], lambda p: p > 0)) AS first FROM t) SELECT page_id, t[1:least(8, coalesce(first - 1, 10))] AS ids FROM s""",
    "m19_snapshot": """WITH s AS (SELECT DISTINCT source AS model, stem AS name, n_bytes % 3 = 0 AS is_symlink, 'to/' || stem AS target, date_trunc('month', modified_at)::TIMESTAMP AS mtime FROM scans)
      SELECT model, arg_max(CASE WHEN is_symlink THEN target ELSE name END, (mtime, name)) AS path, max(mtime) AS mtime FROM s GROUP BY model""",
    "m20_signature": f"""{_J} SELECT doc, page, idx, (SELECT greatest(1, CAST((r[1] // 14) * (r[2] // 14) // 4 AS INT)) FROM (SELECT {_resize('height', 'width', 9633792)} AS r)) AS image_tokens, CAST(len(prompt) + 78 AS INT) AS prompt_chars FROM jobs""",
    "c02_page_json": f"""{Q.BLOCKS_SQL}, r AS (SELECT doc, page, idx, '{{"bbox_2d":' || coalesce('[' || array_to_string(bbox, ',') || ']', 'null') || ',"content":' || to_json(coalesce(block, ''))::VARCHAR || ',"index":' || idx || ',"label":"' || out_label || '"}}' AS j FROM blocks),
      p AS (SELECT doc, page, '[' || string_agg(j, ',' ORDER BY idx) || ']' AS j FROM r GROUP BY doc, page) SELECT doc, '[' || string_agg(j, ',' ORDER BY page) || ']' AS json FROM p GROUP BY doc""",
}
QUERIES = {name: globals()[name] for name in SQL}
