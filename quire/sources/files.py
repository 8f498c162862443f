"""Inputs: directory scans, natural order, kinds, page caps, images."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import use_checkpoints

EXTENSIONS = ("png", "jpg", "jpeg", "heic", "pdf")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def accepted(files: DataFrame) -> DataFrame:
    """Files of a known extension whose names aren't hidden, with name, stem and kind."""
    name = F.substring_index("path", "/", -1)
    out = files.withColumn("name", name).where(extension(F.col("path")).isin(*EXTENSIONS) & ~F.col("name").startswith("."))
    return out.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("kind", F.when(extension(F.col("path")) == "pdf", "pdf").otherwise("image"))


def natural_key(name: Column) -> Column:
    """Names compare without case, runs of digits by value: by how many there are and then as text. The locale's own order isn't reproduced."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda t: F.concat(F.lpad(F.char_length(F.ltrim(t, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(t, F.lit("0")))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^[0-9]"), number(t)).otherwise(t)), "")


def natural_order(files: DataFrame) -> DataFrame:
    """`pos` in natural order of names.

    Files are sorted in ranges, which checkpoint() fixes while the plan is made; a position is that within its range
    and the number of files in the ranges before, of which there are as many as tasks.
    """
    use_checkpoints(files.sparkSession)
    listed = files.withColumn("_key", natural_key(F.col("name"))).orderBy("_key", "path").drop("_key").checkpoint()
    at = F.monotonically_increasing_id()
    listed = listed.withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = listed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return listed.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("pos", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def scan(spark: SparkSession, directory: str, with_content: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, name, stem, kind) of a directory's files, not of its sub-directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    return accepted(files if with_content else files.drop("content"))


def images(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded images (path, width, height, channels, data as BGR rows). A file that can't be decoded has null sizes."""
    got = spark.read.format("image").option("dropInvalid", "false").load(directory)
    i = "image."
    # The two sources write the scheme of local files with one slash or three.
    origin = F.regexp_replace(i + "origin", "^file:/+", "file:/")
    return got.select(origin.alias("path"), F.nullif(F.col(i + "width"), F.lit(-1)).alias("width"), F.nullif(F.col(i + "height"), F.lit(-1)).alias("height"), F.col(i + "nChannels").alias("channels"), F.col(i + "data").alias("data"))


def with_rgb(got: DataFrame) -> DataFrame:
    """Decoded images with `rgb` in place of channels and data: rows of plain RGB, grey spread, alpha dropped; null where not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for rows in batches:
            out = []
            for data, n, w, h in zip(rows["data"], rows["channels"], rows["width"], rows["height"]):
                if data is None or n not in (1, 3, 4) or len(data) != w * h * n:
                    out.append(None)
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(-1, int(n))
                out.append((np.repeat(bgr, 3, axis=1) if n == 1 else bgr[:, 2::-1]).tobytes())
            yield rows.drop(columns=["channels", "data"]).assign(rgb=out)

    return got.mapInPandas(run, "path string, width int, height int, rgb binary")


def page_numbers(documents: DataFrame, cap: int | None) -> DataFrame:
    """`page_index` of each page to raster: of a PDF those under the cap, of an image the one.

    The cap is applied to the numbers, before any page is rendered. Unknown page counts are 0.
    """
    n = F.coalesce(F.col("page_count"), F.lit(0))
    n = F.when(F.col("kind") == "pdf", n if cap is None else F.least(n, F.lit(cap))).otherwise(F.lit(1))
    return documents.withColumn("_n", n).where("_n > 0").select(*documents.columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("page_index"))


def pdf_pages(documents: DataFrame, loader: Any, cap: int | None) -> DataFrame:
    """(path, page, w, h, rgb) of documents (path, kind, content) by a page loader; one that can't be loaded has no pages (see S10).

    The loader is called with the cap, so that no page beyond it is rendered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, kind, content in zip(rows["path"], rows["kind"], rows["content"]):
                try:
                    made = [(path, i, w, h, rgb) for i, w, h, rgb in loader.load(bytes(content), kind, cap) if cap is None or i < cap]
                except Exception:  # noqa: BLE001 - whatever the loader raises is the document's problem
                    made = []
                yield pd.DataFrame(made, columns=["path", "page", "w", "h", "rgb"])

    return documents.select("path", "kind", "content").mapInPandas(run, "path string, page int, w int, h int, rgb binary")


def empty_documents(documents: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Documents without a page, with an error instead of a failed run."""
    return documents.join(pages.select(key).distinct(), key, "left_anti").withColumn("error", F.lit("the document has no pages"))


def bgr_to_rgb(data: bytes, width: int, height: int, stride: int) -> bytes:
    """Rows of BGR pixels, each padded to stride bytes, as plain RGB."""
    import numpy as np

    rows = np.frombuffer(data, np.uint8)[: stride * height].reshape(height, stride)[:, : width * 3].reshape(height, width, 3)
    return rows[:, :, ::-1].tobytes()
