"""Figure bundles and diagnostics of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import Bundle, Config, ParseOptions
from quire.operators import formatting

#: What formatting prints for an image, with the alternative text as its group.
MARKER = re.escape(formatting.MARKER).replace(r"\{alt\}", r"([^\]]*)").replace(r"\{page\}", r"\d+").replace(r"\{box\}", r"\d+(?:, \d+){3}")
MIME = {"heic": "image/heic", "jpeg": "image/jpeg", "png": "image/png"}
EXTENSION = {"heic": "heic", "jpeg": "jpg", "png": "png"}


def wanted(config: Config, options: ParseOptions = ParseOptions()) -> bool:
    """Figures need layout, the bundle option and Markdown."""
    return config.enable_layout and config.bundle.enabled and options.include_markdown


def candidates(rows: DataFrame) -> DataFrame:
    """B1: images with a box of four values, numbered within the page and the document, from 0."""
    c = rows.where((F.col("out_label") == "image") & (F.size("bbox") == 4))
    on_page = Window.partitionBy("doc", "page").orderBy("idx")
    in_doc = Window.partitionBy("doc").orderBy("page", "idx")
    return c.withColumn("page_ordinal", F.row_number().over(on_page) - 1).withColumn("ordinal", F.row_number().over(in_doc) - 1)


def _padded(n: Column) -> Column:
    """Four digits at least; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.char_length(text) >= 4, text).otherwise(F.lpad(text, 4, "0"))


def file_name(page: Column, idx: Column, page_ordinal: Column, bundle: Bundle = Bundle()) -> Column:
    """Page and region from 1 in four digits, or the upstream's form from 0."""
    ext = F.lit("." + EXTENSION[bundle.figure_format])
    if bundle.figure_naming == "upstream_cropped":
        return F.concat(F.lit("cropped_page"), page.cast("string"), F.lit("_idx"), page_ordinal.cast("string"), ext)
    return F.concat(F.lit("page_"), _padded(page + 1), F.lit("_region_"), _padded(idx + 1), ext)


def figures(rows: DataFrame, bundle: Bundle = Bundle()) -> DataFrame:
    """Figure records of candidates: names, paths, alternative text, label and box."""
    c = candidates(rows)
    name = file_name(F.col("page"), F.col("idx"), F.col("page_ordinal"), bundle)
    alt = F.concat(F.lit("Image "), F.col("page").cast("string"), F.lit("-"), F.col("page_ordinal").cast("string"))
    return c.select("doc", "page", "idx", "ordinal", "page_ordinal", F.col("out_label").alias("label"), "bbox", alt.alias("alt_text"), name.alias("file_name"), F.concat(F.lit(bundle.figures_dir + "/"), name).alias("relative_path"))


def figure_warning(problem: Column) -> Column:
    """The warning of a figure that isn't made: pixels, crop or encode."""
    what = F.when(problem == "pixels", "pixels missing").otherwise(F.concat(problem, F.lit(" failed")))
    return F.when(problem.isNotNull(), F.concat(F.lit("bundle.figure "), what, F.lit(": page="), F.col("page").cast("string"), F.lit(" region="), F.col("idx").cast("string")))


def figure_assets(made: DataFrame, bundle: Bundle = Bundle()) -> DataFrame:
    """(doc, figures): records of figures with box and data, in order of the document; failed ones have none."""
    asset = F.struct(
        "ordinal",
        F.col("page").alias("page_index"),
        F.col("idx").alias("region_index"),
        "label",
        F.col("bbox").alias("bbox_2d"),
        "alt_text",
        "file_name",
        "relative_path",
        (F.col("box")[2] - F.col("box")[0]).alias("width_px"),
        (F.col("box")[3] - F.col("box")[1]).alias("height_px"),
        F.lit(MIME[bundle.figure_format]).alias("mime_type"),
        sha256(F.col("data")).alias("sha256"),
        "data",
    )
    kept = F.when(F.col("problem").isNull() | (F.col("problem") == "pixels"), asset)
    listed = made.groupBy("doc").agg(F.sort_array(F.collect_list(kept)).alias("figures"))
    return listed.withColumn("figures", F.transform("figures", lambda f: f.dropFields("ordinal")))


def figure_records(figures: Column) -> Column:
    """Records of the sidecar: without bytes, keys in alphabetical order."""
    names = {"altText": "alt_text", "bbox2D": "bbox_2d", "fileName": "file_name", "heightPX": "height_px", "label": "label", "mimeType": "mime_type", "pageIndex": "page_index", "regionIndex": "region_index", "relativePath": "relative_path", "sha256": "sha256", "widthPX": "width_px"}
    return F.transform(figures, lambda f: F.struct(*[f[c].alias(k) for k, c in names.items()]))


def sidecar_pages(pages: Column) -> Column:
    """Pages of the sidecar: regions with keys in alphabetical order; null content or box is left out."""
    region = lambda r: F.struct(r["bbox_2d"].alias("bbox2D"), r["content"].alias("content"), r["index"].alias("index"), r["label"].alias("label"))
    return F.transform(pages, lambda p: F.struct(F.transform(p, region).alias("regions")))


def sha256(data: Column) -> Column:
    """Hex digest of bytes."""
    return F.sha2(data, 256)


def rewrite_markers(markdown: Column, paths: Column) -> Column:
    """The n-th marker gets the n-th path; one without a path stays as it is."""
    parts = F.split(markdown, MARKER, -1)
    marks = F.regexp_extract_all(markdown, F.lit(MARKER), F.lit(0))
    alts = F.regexp_extract_all(markdown, F.lit(MARKER), F.lit(1))
    last = F.element_at(parts, -1)
    joined = F.transform(
        marks,
        lambda m, i: F.concat(F.get(parts, i), F.when(F.get(paths, i).isNull(), m).otherwise(F.concat(F.lit("!["), F.get(alts, i), F.lit("]("), F.get(paths, i), F.lit(")")))),
    )
    return F.concat(F.array_join(joined, ""), last)


def marker_mismatch(markdown: Column, paths: Column) -> Column:
    """The warning of B6 where markers and figures differ in number, else null."""
    return count_mismatch(F.regexp_count(markdown, F.lit(MARKER)), F.size(paths))


def count_mismatch(markers: Column, figures: Column) -> Column:
    """The same from the two numbers."""
    text = F.concat(F.lit("bundle.figure marker count mismatch: markers="), markers.cast("string"), F.lit(" figures="), figures.cast("string"))
    return F.when(markers != figures, text)


def sidecar_json(pages: Column, figure_records: Column, warnings: Column, timings: Column, metadata: Column, bundle: Bundle = Bundle()) -> Column:
    """The sidecar with keys in alphabetical order."""
    return F.to_json(
        F.struct(
            F.struct(metadata.alias("metadata"), timings.alias("timingsMs"), warnings.alias("warnings")).alias("diagnostics"),
            figure_records.alias("figures"),
            F.lit(bundle.figures_dir).alias("figuresDirectory"),
            F.lit(bundle.markdown_name).alias("markdownPath"),
            pages.alias("pages"),
            F.lit(1).alias("schemaVersion"),
        )
    )


def prompt_hash(prompt: Column) -> Column:
    """D3: the first 16 hex digits of a prompt's digest."""
    return F.substring(F.sha2(prompt, 256), 1, 16)


def metadata(stats: DataFrame, config: Config, options: ParseOptions = ParseOptions()) -> DataFrame:
    """(doc, metadata): a map of 36 strings from counters and scheduler statistics (see jobs) and options.

    stats also has `pages` and, where figures were made, `figures`. There is one path from masks to contours and
    no dump of rendered pages, so what the reference says of these is fixed.
    """

    def word(x: object) -> str:
        return "nil" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    caps = [x for x in (options.max_pages, config.default_max_pages) if x is not None]
    fixed = {
        "layoutEnabled": config.enable_layout,
        "markdownBundleEnabled": config.bundle.enabled,
        "markdownBundleGenerated": wanted(config, options),
        "maxConcurrentRecognitions": config.max_concurrent_recognitions,
        "maxPagesOption": options.max_pages,
        "defaultMaxPages": config.default_max_pages,
        "effectiveMaxPages": min(caps) if caps else None,
        "pdfDPI": config.pdf_dpi,
        "pdfMaxRenderedLongSide": config.pdf_max_long_side,
        "inferenceBatchSize": config.performance.batch_size,
        "inferenceBatchMaxWaitMs": config.performance.batch_max_wait_ms,
        "inferenceMaxInflightJobs": config.inflight,
        "pdfRenderConcurrency": config.performance.render_concurrency,
        "ocrPreprocessConcurrency": config.performance.preprocess_concurrency,
        "bundleEncodeConcurrency": config.performance.encode_concurrency,
        "layoutPostprocessFastPath": True,
        "pageRenderDebugDump": None,
        "pageRenderDebugCount": 0,
    }
    counted = {
        "pageCount": "pages",
        "markdownBundleFigureCount": "figures",
        "layoutDetectionCount": "detections",
        "detectionCount": "detections",
        "skipRegionCount": "skip_count",
        "recognitionTextJobCount": "text_count",
        "recognitionTableJobCount": "table_count",
        "recognitionFormulaJobCount": "formula_count",
        "recognitionJobCount": "jobs",
        "inferenceBucketCount": "buckets",
        "inferenceBatchCount": "batches",
        "inferenceMaxBatchSize": "max_batch",
        "inferenceQueuedJobCount": "queued",
    }
    if "figures" not in stats.columns:
        stats = stats.withColumn("figures", F.lit(0))
    entries = [x for k, v in fixed.items() for x in (F.lit(k), F.lit(word(v)))]
    entries += [x for k, c in counted.items() for x in (F.lit(k), F.coalesce(F.col(c), F.lit(0)).cast("string"))]
    entries += [F.lit("inferenceAverageBatchSize"), F.format_string("%.2f", F.bround(F.coalesce("mean_batch", F.lit(0.0)), 2))]
    for name in ("page", "text", "table", "formula"):
        entries += [F.lit(("noLayout" if name == "page" else name) + "PromptHash"), prompt_hash(F.lit(getattr(config.prompts, name)))]
    return stats.select("doc", F.create_map(*entries).alias("metadata"))


def timings(rows: DataFrame) -> DataFrame:
    """(doc, timings): milliseconds in the recogniser, summed over a document's jobs."""
    return rows.groupBy("doc").agg(F.create_map(F.lit("ocr_inference"), F.round(F.coalesce(F.sum("ms"), F.lit(0.0)), 3)).alias("timings"))


def collect_warnings(rows: DataFrame) -> DataFrame:
    """(doc, warnings): warnings of (doc, stage, page, idx, warning) rows in order of stage, page and region."""
    ordered = F.sort_array(F.collect_list(F.struct("stage", "page", "idx", "warning")))
    return rows.where("warning is not null").groupBy("doc").agg(F.transform(ordered, lambda x: x["warning"]).alias("warnings"))
