"""Region preparation and recognition scheduling: jobs, buckets, batches, merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import dims
from quire.config import Prompts
from quire.functions.text import trim

PAGE = ["doc", "page"]


def page_mismatch(pages: DataFrame, dets: DataFrame) -> DataFrame:
    """(doc, pages, detected) of documents whose detections don't cover each page once."""
    a = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    b = dets.groupBy("doc").agg(F.count_distinct("page").alias("detected"))
    both = a.join(b, "doc", "full").select("doc", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("detected", F.lit(0)).alias("detected"))
    return both.where("pages <> detected")


def pair_pages(pages: DataFrame, dets: DataFrame) -> DataFrame:
    """Pages with their detections."""
    return pages.join(dets, PAGE)


def counters(regions: DataFrame) -> DataFrame:
    """Detections, skipped regions and jobs by task of each document; jobs are the sum of three tasks."""
    by = {t: F.count_if(F.col("task") == t) for t in ("skip", *dims.JOB_TASKS)}
    out = regions.groupBy("doc").agg(F.count("*").alias("detections"), *[n.alias(f"{t}_count") for t, n in by.items()])
    return out.withColumn("jobs", sum((F.col(f"{t}_count") for t in dims.JOB_TASKS), F.lit(0)))


def pixel_box(bbox: Column, width: Column, height: Column) -> Column:
    """P5, B2: a box of thousandths in whole pixels, within the image; null where it is empty."""

    def cell(i: int, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size, (F.element_at(bbox, i + 1).cast("double") * size / 1000).cast("int")))

    box = F.array(cell(0, width), cell(1, height), cell(2, width), cell(3, height))
    return F.when((F.size(bbox) == 4) & (box[0] < box[2]) & (box[1] < box[3]), box)


def crop_failures(regions: DataFrame) -> DataFrame:
    """Regions to recognise without a crop keep going with '' and a warning."""
    bad = F.col("crop").isNull() & F.col("task").isin(*dims.JOB_TASKS)
    warning = F.concat(F.lit("page["), F.col("page").cast("string"), F.lit("] region["), F.col("idx").cast("string"), F.lit("] crop failed"))
    return regions.withColumn("content", F.when(bad, F.lit("")).otherwise(F.col("content"))).withColumn("warning", F.when(bad, warning))


def make_jobs(regions: DataFrame, prompts: Prompts = Prompts(), override: Column | None = None) -> DataFrame:
    """Regions of the three tasks, with the override where it isn't blank or the task's prompt."""
    own = F.when(F.col("task") == "text", prompts.text).when(F.col("task") == "table", prompts.table).otherwise(prompts.formula)
    prompt = own if override is None else F.coalesce(F.nullif(trim(override), F.lit("")), own)
    return regions.where(F.col("task").isin(*dims.JOB_TASKS)).withColumn("prompt", prompt)


def page_jobs(pages: DataFrame, prompts: Prompts = Prompts()) -> DataFrame:
    """One text job a page, with the whole-page prompt."""
    return pages.select("doc", "page", F.lit(0).alias("idx"), F.lit("text").alias("task"), F.lit(prompts.page).alias("prompt"), F.col("w").alias("width"), F.col("h").alias("height"))


BUCKET = ["doc", "prompt", "task", "width", "height"]


def buckets(jobs: DataFrame) -> DataFrame:
    """P10: `seq` in reading order of the document and `bucket`, numbered by first job."""
    out = jobs.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("page", "idx")) - 1)
    out = out.withColumn("_first", F.min("seq").over(Window.partitionBy(*BUCKET)))
    return out.withColumn("bucket", F.dense_rank().over(Window.partitionBy("doc").orderBy("_first")) - 1).drop("_first")


def batches(jobs: DataFrame, size: int) -> DataFrame:
    """`batch` within the bucket, of at most `size` jobs."""
    nth = F.row_number().over(Window.partitionBy("doc", "bucket").orderBy("seq")) - 1
    return jobs.withColumn("batch", F.floor(nth / F.lit(size)).cast("int"))


def scheduler_stats(batched: DataFrame) -> DataFrame:
    """Buckets, batches, greatest and mean batch size and queued jobs of each document."""
    by = batched.groupBy("doc", "bucket", "batch").agg(F.count("*").alias("n"))
    return by.groupBy("doc").agg(
        F.count_distinct("bucket").alias("buckets"), F.count("*").alias("batches"), F.max("n").alias("max_batch"), F.round(F.avg("n"), 4).alias("mean_batch"), F.sum("n").alias("queued")
    )


def _warning(text: Column) -> Column:
    return F.concat(F.lit("page["), F.col("page").cast("string"), F.lit("] region["), F.col("idx").cast("string"), F.lit("] recognition failed: "), text)


def merge_results(regions: DataFrame, results: DataFrame) -> DataFrame:
    """The result's text; '' and a warning where it failed; content stays null where there is none. Results of no region are ignored.

    `ms` comes along where results have it.
    """
    r = results.select("doc", "page", "idx", F.col("text").alias("_text"), F.col("error").alias("_error"), F.lit(True).alias("_there"), *[c for c in ("ms",) if c in results.columns])
    out = regions.join(r, ["doc", "page", "idx"], "left")
    failed = F.coalesce(F.col("_there"), F.lit(False)) & F.col("_error").isNotNull()
    content = F.when(failed, F.lit("")).when(F.col("_there"), F.col("_text")).otherwise(F.col("content"))
    return out.withColumn("content", content).withColumn("warning", F.when(failed, _warning(F.col("_error")))).drop("_text", "_error", "_there")


def merge_page_results(pages: DataFrame, results: DataFrame) -> DataFrame:
    """As merge_results for whole pages, where a missing result is a failure too."""
    r = results.select("doc", "page", F.col("text").alias("_text"), F.col("error").alias("_error"), *[c for c in ("ms",) if c in results.columns])
    out = pages.join(r, PAGE, "left").withColumn("idx", F.lit(0))
    bad = F.col("_error").isNotNull() | F.col("_text").isNull()
    out = out.withColumn("content", F.when(bad, F.lit("")).otherwise(F.col("_text")))
    return out.withColumn("warning", F.when(bad, _warning(F.coalesce("_error", F.lit("missing result"))))).drop("_text", "_error", "idx")
