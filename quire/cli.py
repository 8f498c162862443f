"""Batch command: every file of a directory to <stem>/<stem>.md and .json, its figures, and a timing report.

    python -m quire.cli INPUT OUTPUT [--no-layout] [--bundle] [--max-pages N] [--include-diagnostics]
        [--figures-dir-name NAME] [--figure-format png|jpeg|heic] [--figure-naming upstream-cropped|page-region-padded] [--report FILE]

PDF pages come from a page loader (see adapters.PageLoader), which doesn't ship: without one, PDFs are reported as failed.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import adapters
from quire.config import Bundle, Config, ParseOptions
from quire.engine import Engine
from quire.session import local_session
from quire.sources import files, sinks

NAMING = {"upstream-cropped": "upstream_cropped", "page-region-padded": "page_region_padded"}


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description=__doc__.split("\n")[0])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--no-layout", "--disable-layout", action="store_true", help="recognise whole pages")
    p.add_argument("--bundle", action="store_true", help="link figures by path and write them")
    p.add_argument("--max-pages", type=int, help="pages of a PDF at most")
    p.add_argument("--include-diagnostics", action="store_true", help="keep warnings and metadata in the sidecar")
    p.add_argument("--figures-dir-name", default="imgs")
    p.add_argument("--figure-format", type=str.lower, choices=("png", "jpeg", "jpg", "heic"), help="the first of jpeg and png that has an encoder by default")
    p.add_argument("--figure-naming", choices=sorted(NAMING), default="upstream-cropped")
    p.add_argument("--report", help="write timings and counts as JSON")
    return p.parse_args(argv)


def report(wall_s: float, documents: int, failed: int, jobs: int, inference_ms: float) -> str:
    """Counts, wall time, and recognition jobs a second of the time spent in the recogniser; null without either."""
    rate = round(jobs / (inference_ms / 1000), 3) if jobs and inference_ms > 0 else None
    return json.dumps({"documents": documents, "failed": failed, "jobs": jobs, "wallMs": round(wall_s * 1000, 1), "inferenceMs": round(inference_ms, 3), "jobsPerSecond": rate}, sort_keys=True)


def main(argv: list[str], spark: SparkSession | None = None, loader: adapters.PageLoader | None = None, **engine: object) -> int:
    """The exit code: 1 where a document failed. engine: detector, recognizer and encoders of the Engine."""
    args, began = arguments(argv), time.time()
    spark = spark or local_session("*")
    form = {"jpg": "jpeg", None: "jpeg" if "jpeg" in adapters.ENCODERS else "png"}.get(args.figure_format, args.figure_format)
    bundle = Bundle(enabled=args.bundle, figure_format=form, figure_naming=NAMING[args.figure_naming], figures_dir=args.figures_dir_name)
    config = Config(enable_layout=not args.no_layout, bundle=bundle)
    options = ParseOptions(include_diagnostics=args.include_diagnostics or bool(args.report), max_pages=args.max_pages)
    options.check()
    listing = files.natural_order(files.scan(spark, args.input, with_content=False)).select(F.col("pos").cast("long").alias("doc"), "path", "stem", "kind").checkpoint()
    pixels = args.bundle or getattr(engine.get("recognizer"), "pixels", False)
    found = files.images(spark, args.input)
    sizes = ["path", F.col("width").alias("w"), F.col("height").alias("h")]
    found = files.with_rgb(found).select(*sizes, "rgb") if pixels else found.select(*sizes)
    pages = listing.join(found.where("width is not null"), "path").select("doc", F.lit(0).alias("page"), "w", "h", *["rgb"] * pixels)
    if loader is not None:
        loaded = files.pdf_pages(files.scan(spark, args.input).where("kind = 'pdf'"), loader, args.max_pages)
        loaded = loaded.join(listing, "path").select("doc", "page", "w", "h", *["rgb"] * pixels)
        pages = pages.unionByName(loaded)
    parsed = Engine(spark, config, **engine).parse(pages, options)
    bundled = "figures" in parsed.columns
    counted = F.col("metadata")["recognitionJobCount"].cast("long") if "metadata" in parsed.columns else F.size("pages").cast("long")
    parsed = parsed.select("doc", "markdown", sinks.pages_json(F.col("pages")).alias("json"), *["figures"] * bundled, counted.alias("jobs"), F.col("timings")["ocr_inference"].alias("ms"))
    docs = listing.join(parsed, "doc", "left")
    # The files are written once; the outcome is what the report and the exit code read.
    outcome = sinks.export_files(docs.where("markdown is not null"), args.output).checkpoint()
    lost = docs.where("markdown is null").count()
    bad = outcome.where("error is not null").count() + lost
    if args.report:
        sums = docs.agg(F.sum("jobs"), F.sum("ms")).collect()[0]
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(report(time.time() - began, outcome.count() + lost, bad, sums[0] or 0, sums[1] or 0.0) + "\n")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
