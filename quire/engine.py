"""The whole pipeline as one lazy plan: pages, detections, regions, jobs, texts, Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import adapters
from quire.config import Config, ParseOptions
from quire.functions.text import trim
from quire.operators import bundle as B
from quire.operators import formatting as O
from quire.operators import jobs as J
from quire.operators import layout as L
from quire.operators.polygon import polygons
from quire.session import use_checkpoints


class Engine:
    """Parses pages of documents with a detector and a recogniser given from outside.

    parse takes pages (doc LONG, page INT, w INT, h INT, and whatever the detector reads) and gives a row a
    document: doc, markdown, pages, warnings, timings, metadata and, with bundles on, figures and sidecar. Options
    are checked before anything is planned; failures of single regions become warnings. Recognised regions
    are written once to the session's checkpoint folder, as Markdown, JSON, warnings and counters all read
    them and recognition must not run for each; encoded figures likewise. So detection and recognition run
    while parse plans the rest; what it returns is lazy. timings holds `ocr_inference`, the milliseconds spent in the
    recogniser on a document's jobs (D1); of other stages, which documents share, Spark's event log tells.

    Figures are cropped from the pages' `rgb` (rows of 8-bit pixels). One that can't be cropped or encoded
    keeps its marker in the Markdown, and a warning says so. Where pages have no such column, figures are
    linked and listed without bytes for a caller that holds the images, with a warning each.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), detector: adapters.Detector | None = None, recognizer: adapters.Recognizer | None = None, encoders: dict[str, adapters.Encoder] = adapters.ENCODERS):
        self.spark, self.config = spark, config.check()
        self.detector, self.recognizer = detector or adapters.StubDetector(), recognizer or adapters.StubRecognizer()
        self.encoders = encoders

    def _texts(self, jobs: DataFrame, pages: DataFrame) -> DataFrame:
        if getattr(self.recognizer, "pixels", False) and "rgb" in pages.columns:
            if "crop" not in jobs.columns:
                jobs = jobs.withColumn("crop", F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height")))
            jobs = adapters.with_pixels(jobs, pages)
        found = adapters.recognise(jobs, self.recognizer, self.config.performance.batch_size)
        return found.withColumn("text", trim(F.col("text")))

    def _outlined(self, dets: DataFrame) -> DataFrame:
        """Polygons of masks, for detections that pass their threshold; a polygon given by the detector stays."""
        if "mask_logits" in dets.columns:
            bits = L.mask_bits(F.col("mask_logits"), self.config.layout.pre_threshold)
            dets = dets.withColumn("mask", F.coalesce("mask", bits) if "mask" in dets.columns else bits).drop("mask_logits")
        if "mask" not in dets.columns:
            return dets
        dets = L.class_threshold(dets, self.config.layout)
        if "polygon" not in dets.columns:
            return polygons(dets)
        return polygons(dets.withColumnRenamed("polygon", "given")).withColumn("polygon", F.coalesce("given", "polygon")).drop("given")

    def regions(self, pages: DataFrame) -> DataFrame:
        """Recognised regions: doc, page, idx, label, task, bbox, width, height, content, crop_warning, warning, polygon (in thousandths; null where the detector gives neither mask nor polygon)."""
        dets = self._outlined(L.named(adapters.detect(pages, self.detector)))
        found = L.postprocess(dets, O.PAGE, self.config.layout).withColumnRenamed("bbox2d", "bbox")
        outline = L.milli_polygon(F.col("polygon"), F.col("w"), F.col("h")) if "polygon" in found.columns else F.lit(None).cast("array<array<int>>")
        found = found.select("doc", "page", "idx", "label", "task", "bbox", outline.alias("polygon"), F.lit(None).cast("string").alias("content"), J.pixel_box(F.col("bbox"), F.col("w"), F.col("h")).alias("crop"))
        found = J.crop_failures(found).withColumnRenamed("warning", "crop_warning")
        found = found.withColumn("width", F.col("crop")[2] - F.col("crop")[0]).withColumn("height", F.col("crop")[3] - F.col("crop")[1])
        jobs = J.make_jobs(found.where("crop is not null"), self.config.prompts)
        return J.merge_results(found, self._texts(jobs, pages)).drop("crop")

    def figures(self, rows: DataFrame, pages: DataFrame) -> DataFrame:
        """Figures of formatted rows with box, data and problem (null: made; pixels, crop, encode)."""
        c = self.config.bundle
        found = B.figures(rows, c).join(pages.select("doc", "page", "w", "h", *[x for x in ("rgb",) if x in pages.columns]), ["doc", "page"])
        found = found.withColumn("box", J.pixel_box(F.col("bbox"), F.col("w"), F.col("h")))
        if "rgb" in pages.columns:
            return adapters.encode_figures(found, self.encoders.get(c.figure_format), c.quality)
        return found.withColumn("data", F.lit(None).cast("binary")).withColumn("problem", F.when(F.col("box").isNull(), "crop").otherwise("pixels"))

    def parse(self, pages: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
        options.check()
        caps = [c for c in (options.max_pages, self.config.default_max_pages) if c is not None]
        if caps:
            pages = pages.where(F.col("page") < min(caps))
        if not self.config.enable_layout:
            jobs = J.page_jobs(pages, self.config.prompts)
            use_checkpoints(self.spark)
            merged = J.merge_page_results(pages.select("doc", "page"), self._texts(jobs, pages)).checkpoint()
            warnings = B.collect_warnings(merged.select("doc", F.lit(2).alias("stage"), "page", F.lit(0).alias("idx"), "warning"))
            out = O.no_layout_markdown(merged).join(O.no_layout_pages(merged), "doc").join(B.timings(merged), "doc", "left").join(warnings, "doc", "left")
            return out if options.include_markdown else out.withColumn("markdown", F.lit(""))
        use_checkpoints(self.spark)
        regions = self.regions(pages).checkpoint()
        rows = O.blocks(regions)
        shown = O.placeholders(rows)
        bundled, made = B.wanted(self.config, options), None
        if bundled:
            # Figures take their paths by joining on the region, before the document is put together.
            made = self.figures(rows, pages).checkpoint()
            markers = shown.groupBy("doc").agg(F.sum(F.regexp_count("block", F.lit(B.MARKER))).alias("markers"))
            counts = markers.join(made.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            figures = made.where("problem is null or problem = 'pixels'").select("doc", "page", "idx", "relative_path", "alt_text")
            linked = F.concat(F.lit("!["), F.col("alt_text"), F.lit("]("), F.col("relative_path"), F.lit(")"))
            shown = shown.join(figures, ["doc", "page", "idx"], "left").withColumn("block", F.when(F.col("relative_path").isNotNull(), linked).otherwise(F.col("block")))
        out = O.document_markdown(O.page_markdown(shown)).join(O.page_results(rows), "doc")
        both = regions.select("doc", "page", "idx", F.explode(F.array(F.struct(F.lit(1).alias("stage"), F.col("crop_warning").alias("warning")), F.struct(F.lit(2).alias("stage"), "warning"))).alias("w"))
        warned = both.select("doc", "w.stage", "page", "idx", "w.warning")
        if bundled:
            warned = warned.unionByName(made.select("doc", F.lit(3).alias("stage"), "page", "idx", B.figure_warning(F.col("problem")).alias("warning")))
            mismatch = B.count_mismatch(F.col("markers"), F.col("n"))
            warned = warned.unionByName(counts.select("doc", F.lit(4).alias("stage"), F.lit(0).alias("page"), F.lit(0).alias("idx"), mismatch.alias("warning")))
        out = out.join(B.collect_warnings(warned), "doc", "left").join(B.timings(regions), "doc", "left")
        if not options.include_markdown:
            out = out.withColumn("markdown", F.lit(""))
        if options.include_diagnostics:
            jobs = J.make_jobs(regions.where("width is not null"), self.config.prompts)
            stats = J.counters(regions).join(J.scheduler_stats(J.batches(J.buckets(jobs), self.config.performance.batch_size)), "doc", "left")
            stats = stats.join(pages.groupBy("doc").agg(F.count_distinct("page").alias("pages")), "doc")
            if bundled:
                listed = made.where("problem is null or problem = 'pixels'").groupBy("doc").agg(F.count("*").alias("figures"))
                stats = stats.join(listed, "doc", "left")
            out = out.join(B.metadata(stats, self.config, options), "doc", "left")
        if bundled:
            out = out.join(B.figure_assets(made, self.config.bundle), "doc", "left")
            out = out.withColumn("figures", F.coalesce("figures", F.array().cast(out.schema["figures"].dataType)))
            words = [F.coalesce("warnings", F.array().cast("array<string>")), F.col("metadata")] if options.include_diagnostics else [F.array().cast("array<string>"), F.create_map().cast("map<string,string>")]
            spent = F.col("timings") if options.include_diagnostics else F.create_map().cast("map<string,double>")
            sidecar = B.sidecar_json(B.sidecar_pages(F.col("pages")), B.figure_records(F.col("figures")), words[0], spent, words[1], self.config.bundle)
            out = out.withColumn("sidecar", sidecar)
        return out
