"""Boundaries to code outside the engine: page rasters, layout detection, text recognition, image encoding.

Model weights, PDF and photo codecs don't ship with the engine. Each boundary is a protocol that takes
and gives batches; the stand-ins here are deterministic, so that plans and tests run without them.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Recognizer(Protocol):
    """Texts of a batch of equal task, prompt and image size, in order. May raise for the batch.

    The batch has the region's box in pixels as `crop` and its `polygon` in thousandths of the page, null where
    there is none. One whose attribute `pixels` is true also gets `pixels`: the rows of the crop, masked by its
    polygon, of width * height * 3 bytes.
    """

    def recognize(self, batch: pd.DataFrame) -> list[str]: ...


class Detector(Protocol):
    """Detections of pages: rows of page keys, cls, score, x1, y1, x2, y2, ord.

    A detector that also gives some of OPTIONAL names them in its attribute `optional`: mask_logits or mask, a
    flat square over the page, or polygon, points in the page's pixels, which goes before a mask where it isn't null.
    """

    def detect(self, pages: pd.DataFrame) -> pd.DataFrame: ...


class PageLoader(Protocol):
    """Pages of one document's bytes: (page_index, width, height, data)."""

    def load(self, content: bytes, kind: str, max_pages: int | None) -> Iterator[tuple[int, int, int, bytes]]: ...


_MADE: dict[str, object] = {}


class Shared:
    """A detector or recogniser that each worker makes when it needs it first, and keeps for all its tasks.

    Only the factory travels with a task, not the model. `optional` and `pixels` are those of what it makes.
    """

    def __init__(self, factory: Callable[[], object], *, optional: tuple[str, ...] = (), pixels: bool = False):
        self.factory, self.optional, self.pixels, self.name = factory, optional, pixels, uuid.uuid4().hex

    def get(self) -> object:
        if self.name not in _MADE:
            _MADE[self.name] = self.factory()
        return _MADE[self.name]


def _made(model: object) -> object:
    return model.get() if isinstance(model, Shared) else model


class StubRecognizer:
    """Text from the job's task and size, without an image."""

    def recognize(self, batch: pd.DataFrame) -> list[str]:
        out = []
        for task, w, h in zip(batch["task"], batch["width"], batch["height"]):
            if task == "table":
                out.append("| A | B |\n| --- | --- |\n| 1 | 2 |")
            elif task == "formula":
                out.append("x^2 + y^2 = z^2")
            else:
                out.append(f"Recognized text {w}x{h}")
        return out


class StubDetector:
    """A text block over an image and a chart on every page."""

    ROWS = ((22, 0.9, 0.0, 0.0, 1.0, 0.26), (14, 0.9, 0.08, 0.3, 0.42, 0.9), (3, 0.9, 0.52, 0.28, 0.92, 0.94))

    def detect(self, pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, page, w, h in zip(pages["doc"], pages["page"], pages["w"], pages["h"]):
            for i, (cls, score, x1, y1, x2, y2) in enumerate(self.ROWS):
                out.append((doc, page, i, cls, score, x1 * w, y1 * h, x2 * w, y2 * h, w, h, i))
        return pd.DataFrame(out, columns=["doc", "page", "id", "cls", "score", "x1", "y1", "x2", "y2", "w", "h", "ord"])


DETECTIONS = "doc long, page int, id long, cls int, score double, x1 double, y1 double, x2 double, y2 double, w int, h int, ord int"

OPTIONAL = {"mask_logits": "array<double>", "mask": "array<boolean>", "polygon": "array<array<double>>"}


def detect(pages: DataFrame, detector: Detector) -> DataFrame:
    """Detections of (doc, page, w, h, ...) pages; the detector runs on Arrow batches where pages lie."""
    more = [f"{c} {kind}" for c, kind in OPTIONAL.items() if c in getattr(detector, "optional", ())]
    return pages.mapInPandas(lambda batches: (_made(detector).detect(b) for b in batches), ", ".join([DETECTIONS, *more]))


def with_pixels(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs with `pixels`, the rows of their crop; white outside of their polygon, null where the page's rows don't fill it.

    A page's jobs come to its rows as one list, by one exchange on the page, so that no page is sent more than once.
    """
    rest = [f for f in jobs.schema if f.name not in ("doc", "page")]
    listed = jobs.groupBy("doc", "page").agg(F.collect_list(F.struct(*[f.name for f in rest])).alias("_jobs"))
    both = listed.join(pages.select("doc", "page", F.col("w").alias("_w"), F.col("h").alias("_h"), "rgb"), ["doc", "page"], "left")
    schema = T.StructType([jobs.schema["doc"], jobs.schema["page"], *rest, T.StructField("pixels", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from quire.functions.images import crop_region

        for rows in batches:
            for doc, page, todo, w, h, rgb in zip(rows["doc"], rows["page"], rows["_jobs"], rows["_w"], rows["_h"], rows["rgb"]):
                image = np.frombuffer(rgb, np.uint8).reshape(int(h), int(w), 3) if rgb is not None and len(rgb) == w * h * 3 else None
                out = []
                for job in todo:
                    job = dict(job) if isinstance(job, dict) else job.asDict()
                    points = job.get("polygon")
                    points = [] if points is None else [(x * w / 1000, y * h / 1000) for x, y in points]
                    try:
                        part = None if image is None else crop_region(image, tuple(int(v) for v in job["crop"]), points).tobytes()
                    except ValueError:
                        part = None
                    out.append({"doc": doc, "page": page, **job, "pixels": part})
                yield pd.DataFrame(out, columns=schema.names)

    return both.mapInPandas(run, schema)


def recognise(jobs: DataFrame, recognizer: Recognizer, batch_size: int = 4, retry: bool = False) -> DataFrame:
    """(doc, page, idx, text, error, ms) of jobs with doc, page, idx, task, prompt, width, height.

    Jobs of one bucket come together by a shuffle on what makes batches alike (task, prompt, size) and
    are sorted within their task, so that batches of one bucket follow each other. A hot bucket is
    spread by a salt of the document. Of a batch that fails or gives the wrong number of texts each job has an
    error instead of a text; with `retry` its jobs are tried again one by one first. None fails the run. `ms` is a
    job's share of its batch's time (D1). A recogniser that wants pixels never sees a job that has none.
    """
    cols = ["doc", "page", "idx", "task", "prompt", "width", "height"]
    bucket = ["task", "prompt", "width", "height"]

    def texts(batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
        try:
            found = _made(recognizer).recognize(batch)
            if len(found) == len(batch):
                return [(x, None) for x in found]
            problem = f"{len(found)} texts for {len(batch)} jobs"
        except Exception as e:  # noqa: BLE001 - whatever the recogniser raises is the job's error
            problem = str(e)
        if len(batch) == 1 or not retry:
            return [(None, problem)] * len(batch)
        return [texts(batch.iloc[i : i + 1])[0] for i in range(len(batch))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[["doc", "page", "idx"]]
            back: dict[int, tuple[str | None, str | None, float]] = {}
            if pixels:
                back = {i: (None, "no pixels", 0.0) for i, x in enumerate(rows["pixels"]) if x is None}
            for at in rows.groupby(bucket, sort=False, dropna=False).indices.values():
                at = [i for i in at.tolist() if i not in back]
                for a in range(0, len(at), batch_size):
                    part, began = at[a : a + batch_size], time.perf_counter()
                    found = texts(rows.iloc[part])
                    ms = (time.perf_counter() - began) * 1000 / len(part)
                    back.update({i: (*f, ms) for i, f in zip(part, found)})
            for k, name in enumerate(("text", "error", "ms")):
                out = out.assign(**{name: [back[i][k] for i in range(len(rows))]})
            yield out

    pixels = "pixels" in jobs.columns and getattr(recognizer, "pixels", False)
    extra = [c for c in ("crop", "polygon", "pixels") if c in jobs.columns]
    together = jobs.select(*cols, *extra).repartition(*bucket, F.pmod(F.hash("doc"), F.lit(64))).sortWithinPartitions(*bucket, "doc", "page", "idx")
    schema = T.StructType([f for f in jobs.select("doc", "page", "idx").schema] + [T.StructField("text", T.StringType()), T.StructField("error", T.StringType()), T.StructField("ms", T.DoubleType())])
    return together.mapInPandas(run, schema)


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG of 8-bit RGB rows, by the standard library alone."""
    if len(rgb) != width * height * 3:
        raise ValueError("rgb must hold width * height * 3 bytes")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


#: Encoders by format: (rgb bytes, width, height, quality) to file bytes. HEIC and JPEG come from outside.
Encoder = Callable[[bytes, int, int, float], bytes]
ENCODERS: dict[str, Encoder] = {"png": lambda rgb, w, h, quality: png(w, h, rgb)}


def encode_figures(figures: DataFrame, encoder: Encoder | None, quality: float) -> DataFrame:
    """Adds `data` and `problem` to figures with `box` in the pixels of their page, w, h and its `rgb` rows.

    Only the rows under the box go to Python. A figure without a box or with rows that don't fill the page
    fails as a crop; one without an encoder, or whose encoder raises, as an encoding; none fails the run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple[bytes | None, str | None]] = []
            for band, box, w in zip(rows["_band"], rows["box"], rows["w"]):
                if band is None:
                    out.append((None, "crop"))
                    continue
                try:
                    x1, y1, x2, y2 = (int(v) for v in box)
                    w = int(w)
                    rgb = b"".join(band[(y * w + x1) * 3 : (y * w + x2) * 3] for y in range(y2 - y1))
                    out.append((encoder(rgb, x2 - x1, y2 - y1, quality), None) if encoder else (None, "encode"))
                except Exception:  # noqa: BLE001 - whatever the encoder raises is the figure's problem
                    out.append((None, "encode"))
            made = rows.drop(columns="_band")
            made["data"], made["problem"] = [d for d, _ in out], [p for _, p in out]
            yield made

    whole = F.length("rgb") == F.col("w").cast("long") * F.col("h") * 3
    at, n = F.col("box")[1] * F.col("w") * 3 + 1, (F.col("box")[3] - F.col("box")[1]) * F.col("w") * 3
    cut = figures.withColumn("_band", F.when(whole & F.col("box").isNotNull(), F.substring("rgb", at, n))).drop("rgb")
    schema = T.StructType([f for f in cut.drop("_band").schema] + [T.StructField("data", T.BinaryType()), T.StructField("problem", T.StringType())])
    return cut.mapInPandas(run, schema)
