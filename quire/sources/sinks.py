"""Outputs: Markdown and JSON files by stem, figures, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_json(rows: DataFrame) -> DataFrame:
    """(doc, json): pages as lists of {bbox_2d, content, index, label}; null content is '', a null box null."""
    region = F.struct("idx", F.to_json(F.struct(F.col("bbox").alias("bbox_2d"), F.coalesce("block", F.lit("")).alias("content"), F.col("idx").alias("index"), F.col("out_label").alias("label")), {"ignoreNullFields": "false"}).alias("j"))
    pages = rows.groupBy("doc", "page").agg(F.sort_array(F.collect_list(region)).alias("r"))
    pages = pages.select("doc", "page", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias("j"))
    docs = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "j"))).alias("p"))
    return docs.select("doc", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def terminated(markdown: Column) -> Column:
    """Markdown that ends in one newline."""
    return F.concat(F.rtrim(F.coalesce(markdown, F.lit("")), F.lit("\n")), F.lit("\n"))


def write_documents(docs: DataFrame, directory: str) -> None:
    """A folder for each stem, replaced as a whole, with the Markdown and JSON of its document as a row.

    Written by Spark's own committer, so that a lost executor leaves no half-written folder.
    """
    docs.select("stem", terminated(F.col("markdown")).alias("markdown"), "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").json(directory)


def pages_json(pages: Column) -> Column:
    """C2 of the `pages` of page_results: null content is '', a null box null, keys in alphabetical order."""
    region = lambda r: F.struct(r["bbox_2d"].alias("bbox_2d"), F.coalesce(r["content"], F.lit("")).alias("content"), r["index"].alias("index"), r["label"].alias("label"))
    return F.to_json(F.transform(pages, lambda p: F.transform(p, region)), {"ignoreNullFields": "false"})


def export_files(docs: DataFrame, directory: str) -> DataFrame:
    """(stem, error): <stem>/<stem>.md, newline-terminated, <stem>/<stem>.json and, where docs have `figures`, their files.

    For folders that all executors share. A document's folder is written under a name of its own attempt and then
    takes the place of the one before, of which no file stays (C4), so that tasks run again do no harm; a
    document that fails is reported, keeps the folder it had, and the others go on.
    """

    def write(stem: str, markdown: str, text: str | None, figures: list) -> None:
        import os
        import shutil
        import uuid

        if not stem or "/" in stem or stem in (".", ".."):
            raise ValueError(f"not a file name: {stem!r}")
        base, part = os.path.join(directory, stem), os.path.join(directory, f".{uuid.uuid4().hex}")
        files = {f"{stem}.md": markdown.encode(), f"{stem}.json": (json.dumps(json.loads(text or "[]"), ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()}
        for path, data in figures:
            if os.path.isabs(path) or ".." in path.split("/"):
                raise ValueError(f"not a path under the folder: {path!r}")
            if data is not None:
                files[path] = data
        try:
            for path, data in files.items():
                target = os.path.join(part, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(data)
            if os.path.lexists(base):
                os.replace(base, part + ".old")
            os.replace(part, base)
        finally:
            shutil.rmtree(part, ignore_errors=True)
            shutil.rmtree(part + ".old", ignore_errors=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            errors = []
            lists = rows["figures"] if "figures" in rows else [()] * len(rows)
            for stem, markdown, text, figures in zip(rows["stem"], rows["markdown"], rows["json"], lists):
                try:
                    write(stem, markdown, text, [(f["relative_path"], f["data"]) for f in (() if figures is None else figures)])
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"stem": rows["stem"], "error": errors})

    picked = ["stem", terminated(F.col("markdown")).alias("markdown"), "json"]
    if "figures" in docs.columns:
        picked.append(F.transform("figures", lambda f: F.struct(f["relative_path"].alias("relative_path"), f["data"].alias("data"))).alias("figures"))
    return docs.select(*picked).mapInPandas(run, "stem string, error string")
