import json
import os

import pytest
from pyspark.sql import functions as F

from quire import adapters, dims
from quire.config import Bundle, Config, ConfigError, Layout, ParseOptions, Performance
from quire.engine import Engine
from quire.sources import files, sinks


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


def pages(spark):
    return spark.createDataFrame([(1, 0, 640, 480), (1, 1, 640, 480), (2, 0, 320, 200)], "doc long, page int, w int, h int")


def test_bundle_on(shared):
    got = {r.doc: r for r in Engine(shared, Config(bundle=Bundle(enabled=True))).parse(pages(shared)).collect()}
    assert "![Image 0-0](figures/page_0001_region_0002.heic)" in got[1].markdown and "![Image 0-1](figures/page_0001_region_0003.heic)" in got[1].markdown
    assert "bbox=" not in got[1].markdown and got[1].metadata["recognitionJobCount"] == "2"


def test_bundle_off_keeps_markers(shared):
    got = {r.doc: r for r in Engine(shared).parse(pages(shared)).collect()}
    assert "page=0" in got[2].markdown and "bbox=[" in got[2].markdown and "Recognized text 320x52" in got[2].markdown


def test_without_layout(shared):
    got = {r.doc: r.markdown for r in Engine(shared, Config(enable_layout=False, bundle=Bundle(enabled=True))).parse(pages(shared), ParseOptions(max_pages=1)).collect()}
    assert got == {1: "Recognized text 640x480", 2: "Recognized text 320x200"}
    one = Engine(shared, Config(enable_layout=False)).parse(pages(shared)).where("doc = 1").collect()[0]
    assert [[tuple(r) for r in p] for p in one.pages] == [[(0, "text", "Recognized text 640x480", None)]] * 2 and one.timings["ocr_inference"] >= 0


def test_defaults_and_validation():
    c = Config()
    assert (c.performance.batch_size, c.performance.batch_max_wait_ms, c.performance.max_inflight, c.performance.render_concurrency, c.performance.preprocess_concurrency, c.performance.encode_concurrency) == (4, 8, 64, 2, 4, 2)
    g = c.generation
    assert (g.max_tokens, g.temperature, g.prefill_step, g.top_p, g.top_k, g.repetition_penalty) == (4096, 0.8, 2048, 0.9, 50, 1.1)
    assert Config.from_json(c.to_json()) == c and Config.from_json("{}") == c
    assert Config(max_concurrent_recognitions=3).inflight == 3 and Config(performance=Performance(batch_size=6, max_inflight=40)).inflight == 40
    assert Config.from_json('{"layout": {"unclip": {"width": 2, "height": 3}}}').layout.unclip == (2.0, 3.0) and Config.from_json('{"layout": {"unclip": 1.5}}').layout.unclip == (1.5, 1.5)
    assert dims.task_of("display_formula") == dims.task_of("inline_formula") == "formula" and dims.task_of("formula") == "text"
    assert sorted(x for v in dims.TASK_LABELS.values() for x in v) == sorted(dims.CLASSES)
    for bad in (Config(pdf_dpi=0), Config(layout=Layout(threshold=2)), Config(layout=Layout(merge_modes={"text": "other"})), Config(bundle=Bundle(figures_dir="a/b")), Config(max_concurrent_recognitions=0)):
        with pytest.raises(ConfigError):
            bad.check()
    with pytest.raises(ConfigError):
        ParseOptions(max_pages=0).check()
    assert ParseOptions() == ParseOptions(True, True, None)


def test_files_and_images(spark, tmp_path):
    for name in ("p10.PNG", "p2.png", ".hidden.png", "note.txt", "doc.PDF"):
        (tmp_path / name).write_bytes(adapters.png(3, 2, bytes(range(18))) if name.lower().endswith("png") else b"fake-pdf")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.png").write_bytes(b"")
    got = files.natural_order(files.scan(spark, str(tmp_path), with_content=False)).orderBy("pos").collect()
    assert [(r.name, r.kind) for r in got] == [("doc.PDF", "pdf"), ("p2.png", "image"), ("p10.PNG", "image")]
    image = files.images(spark, str(tmp_path / "p2.png")).collect()[0]
    assert (image.width, image.height) == (3, 2)
    assert files.bgr_to_rgb(bytes(image["data"]), 3, 2, 9) == bytes(range(18))


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# T", '[[{"index": 0}]]'), ("b/c", "x", "[]"), ("d", None, None)], "stem string, markdown string, json string")
    got = {r.stem: r.error for r in sinks.export_files(docs, str(tmp_path)).collect()}
    assert got["a"] is None and got["d"] is None and "not a file name" in got["b/c"]
    assert (tmp_path / "a" / "a.md").read_text() == "# T\n" and json.loads((tmp_path / "a" / "a.json").read_text()) == [[{"index": 0}]]
    assert sorted(os.listdir(tmp_path / "a")) == ["a.json", "a.md"]
    sinks.write_documents(docs.where("stem = 'a'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    from quire.streaming.directory import file_stream, parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(adapters.png(1, 1, b"abc"))
    seen = []
    query = parse_stream(file_stream(spark, str(tmp_path / "in")), lambda batch, i: seen.extend(r.name for r in batch.select("name").collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert seen == ["a.png"]


def test_image_kernels():
    import numpy as np

    from quire.functions import images as I

    image = np.arange(10 * 8 * 3, dtype=np.uint8).reshape(8, 10, 3)
    assert (I.crop(image, (2, 1, 5, 4)) == image[1:4, 2:5]).all()
    with pytest.raises(ValueError):
        I.crop(image, (5, 5, 5, 9))
    keep = I.inside([(0, 0), (4, 0), (4, 4), (0, 4)], 10, 8)
    assert keep.sum() == 16 and keep[:4, :4].all()
    part = I.crop_region(image, (2, 1, 8, 7), [(2, 1), (5, 1), (5, 4), (2, 4)])
    assert (part[:3, :3] == image[1:4, 2:5]).all() and (part[3:] == 255).all() and (part[:, 3:] == 255).all()
    assert (I.mask_white(image, [(0, 0), (1, 1)]) == image).all()
    assert np.allclose(I.resize(image, 10, 8), image) and I.layout_input(image, 16).shape == (3, 16, 16)
    assert np.allclose(I.normalise(np.full((1, 1, 3), 255, np.uint8), (0.5,) * 3, (0.5,) * 3), 1.0)
    frames = np.arange(2 * 3 * 56 * 28).reshape(2, 3, 56, 28)
    rows, grid = I.patchify(frames)
    assert grid == (1, 4, 2) and rows.shape == (8, 3 * 2 * 14 * 14)
    assert (rows[1].reshape(3, 2, 14, 14) == frames[:, :, :14, 14:28].transpose(1, 0, 2, 3)).all()
    assert I.patchify(frames[:1])[1] == (1, 4, 2)


def test_command(shared, tmp_path):
    from quire.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(adapters.png(4, 4, bytes(48)))
    out, rep = str(tmp_path / "out"), str(tmp_path / "report.json")
    (tmp_path / "out" / "a").mkdir(parents=True)
    (tmp_path / "out" / "a" / "old.txt").write_text("of a run before")
    assert main([str(tmp_path / "in"), out, "--report", rep], shared) == 0
    assert (tmp_path / "out" / "a" / "a.md").read_text().startswith("Recognized text")
    regions = json.loads((tmp_path / "out" / "a" / "a.json").read_text())[0]
    assert [r["index"] for r in regions] == [0, 1, 2] and all(set(r) == {"bbox_2d", "content", "index", "label"} for r in regions) and regions[1]["content"].startswith("![Image") | (regions[1]["content"] == "")
    assert sorted(os.listdir(tmp_path / "out")) == ["a"] and sorted(os.listdir(tmp_path / "out" / "a")) == ["a.json", "a.md"]
    told = json.loads(open(rep).read())
    assert (told["documents"], told["failed"], told["jobs"]) == (1, 0, 1) and told["jobsPerSecond"] is None or told["jobsPerSecond"] > 0
    (tmp_path / "in" / "b.pdf").write_bytes(b"fake-pdf")
    assert main([str(tmp_path / "in"), out, "--no-layout"], shared) == 1
    assert json.loads((tmp_path / "out" / "a" / "a.json").read_text()) == [[{"bbox_2d": None, "content": "Recognized text 4x4", "index": 0, "label": "text"}]]


def test_command_loads_pdf_pages(shared, tmp_path):
    from quire.cli import main

    class Loader:
        def load(self, content, kind, cap):
            assert content == b"fake-pdf"
            for i in range(3 if cap is None else min(3, cap)):
                yield i, 64, 48, bytes([i]) * (64 * 48 * 3)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.pdf").write_bytes(b"fake-pdf")
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--bundle", "--max-pages", "2", "--figure-format", "png", "--figure-naming", "page-region-padded", "--figures-dir-name", "figs"], shared, Loader()) == 0
    assert len(json.loads((tmp_path / "out" / "b" / "b.json").read_text())) == 2
    assert sorted(os.listdir(tmp_path / "out" / "b" / "figs"))[0] == "page_0001_region_0002.png" and len(os.listdir(tmp_path / "out" / "b" / "figs")) == 4


def gradient(w, h):
    return bytes(v for y in range(h) for x in range(w) for v in (x * 255 // w, y * 255 // h, 128))


def test_pixels_reach_the_recogniser(shared):
    class Reads:
        """Finds the crop in the gradient by its pixels alone."""

        pixels = True

        def recognize(self, batch):
            out = []
            for data, w, h in zip(batch["pixels"], batch["width"], batch["height"]):
                assert len(data) == w * h * 3
                out.append(f"Recognized text {w}x{h} from {data[0]},{data[1]} to {data[-3]},{data[-2]}")
            return out

    rgb = gradient(640, 480)
    given = shared.createDataFrame([(1, 0, 640, 480, rgb), (1, 1, 640, 480, None)], "doc long, page int, w int, h int, rgb binary")
    got = Engine(shared, Config(bundle=Bundle(enabled=True, figure_format="png")), recognizer=Reads()).parse(given).collect()[0]
    assert got.pages[0][0].content == f"Recognized text 640x123 from 0,0 to {639 * 255 // 640},{122 * 255 // 480}"
    assert got.pages[1][0].content == "" and "page[1] region[0] recognition failed: no pixels" in got.warnings
    assert len(got.figures) == 2 and json.loads(got.sidecar)["schemaVersion"] == 1 and "ocr_inference" in json.loads(got.sidecar)["diagnostics"]["timingsMs"]
    plain = Engine(shared, Config(enable_layout=False), recognizer=Reads()).parse(given).collect()[0]
    assert plain.pages[0][0].content.startswith("Recognized text 640x480 from 0,0")


def test_crops_are_masked_by_their_polygon(shared):
    rgb = bytes(range(100)) * 3
    pages_ = shared.createDataFrame([(1, 0, 10, 10, rgb)], "doc long, page int, w int, h int, rgb binary")
    jobs = shared.createDataFrame([(1, 0, 0, [0, 0, 4, 4], [[0, 0], [200, 0], [200, 1000], [0, 1000]]), (1, 0, 1, [2, 2, 3, 3], None), (1, 0, 2, [5, 5, 5, 5], None)], "doc long, page int, idx int, crop array<int>, polygon array<array<int>>")
    got = {r.idx: r.pixels for r in adapters.with_pixels(jobs, pages_).collect()}
    rows = [bytes(got[0][y * 12 : y * 12 + 12]) for y in range(4)]
    assert all(r[:6] == rgb[y * 30 : y * 30 + 6] and r[6:] == b"\xff" * 6 for y, r in enumerate(rows))
    assert bytes(got[1]) == rgb[66:69] and got[2] is None


def test_one_model_a_worker(shared):
    class Slow:
        def __init__(self):
            import os
            import uuid

            self.name = f"{os.getpid()} {uuid.uuid4()}"

        def recognize(self, batch):
            return [self.name] * len(batch)

    jobs = shared.range(400).select(F.col("id").alias("doc"), F.lit(0).alias("page"), F.lit(0).alias("idx"), F.lit("text").alias("task"), F.lit("p").alias("prompt"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    model = adapters.Shared(Slow)
    names = {r.text for _ in range(2) for r in adapters.recognise(jobs, model).collect()}
    assert len(names) == len({n.split()[0] for n in names})


def test_a_failed_batch_fails_each_of_its_jobs(shared):
    class Fails:
        def recognize(self, batch):
            if 3 in list(batch["idx"]):
                raise RuntimeError("engine stopped")
            return ["ok"] * (len(batch) - (7 in list(batch["idx"])))

    jobs = shared.createDataFrame([(1, 0, i) for i in range(12)], "doc long, page int, idx int").select("*", F.lit("text").alias("task"), F.lit("p").alias("prompt"), F.lit(1).alias("width"), F.lit(1).alias("height")).coalesce(1)
    got = {r.idx: (r.text, r.error) for r in adapters.recognise(jobs, Fails()).collect()}
    assert [got[i] for i in range(12)] == [(None, "engine stopped")] * 4 + [(None, "3 texts for 4 jobs")] * 4 + [("ok", None)] * 4
    again = {r.idx: r.error for r in adapters.recognise(jobs, Fails(), retry=True).collect()}
    assert {i for i, e in again.items() if e} == {3, 7}


def test_sampling(shared):
    from quire.functions import model_math as M

    scores = shared.createDataFrame([(k, t, float(x)) for k in range(400) for t, x in enumerate([2.0, 1.0, 0.0, -9.0])], "step int, token int, logit double").withColumn("history", F.lit(None).cast("array<int>"))
    drawn = [r.token for r in M.next_token(scores, ["step"], temperature=1.0, top_p=1.0, top_k=0, seed=5).collect()]
    assert drawn.count(0) > drawn.count(1) > drawn.count(2) > drawn.count(3) and abs(drawn.count(0) / 400 - 0.665) < 0.08
    assert {r.token for r in M.next_token(scores, ["step"], temperature=0).collect()} == {0}
    assert {r.token for r in M.next_token(scores, ["step"], temperature=1.0, top_k=1).collect()} == {0}
    near = scores.withColumn("history", F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(3), 19)))
    far = scores.withColumn("history", F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(3), 20)))
    assert {r.token for r in M.next_token(near, ["step"], temperature=0, penalty=3.0).collect()} == {1}
    assert {r.token for r in M.next_token(far, ["step"], temperature=0, penalty=3.0).collect()} == {0}


def test_natural_order_of_long_numbers(shared):
    names = ["a" + "1" * 25 + "2.png", "a" + "1" * 26 + ".png", "a" + "0" * 30 + "7.png", "a12.png", "b.png", "A3.png", "a.png"]
    df = shared.createDataFrame([(f"/x/{n}",) for n in names], "path string").repartition(3)
    got = [r.name for r in files.natural_order(files.accepted(df)).orderBy("pos").collect()]
    assert got == ["a.png", "A3.png", "a" + "0" * 30 + "7.png", "a12.png", "a" + "1" * 26 + ".png", "a" + "1" * 25 + "2.png", "b.png"]
    assert [r.pos for r in files.natural_order(files.accepted(df)).orderBy("pos").collect()] == list(range(7))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quire.session import shared_dir

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("local[4]")).startswith("file:") and shared_dir(session("yarn", "hdfs://x")) == "hdfs://x"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_masks_and_polygons_reach_the_regions(shared):
    # Defined here, as workers don't import this module.
    class Outlines(adapters.StubDetector):
        """The stub's boxes with an oval mask, or a triangle for the last."""

        def __init__(self, *optional):
            self.optional = optional

        def detect(self, pages):
            import numpy as np

            found = adapters.StubDetector.detect(self, pages)
            at = np.arange(200)
            oval = ((at[:, None] - 100) / 90) ** 2 + ((at - 100) / 90) ** 2 <= 1
            if "mask" in self.optional:
                found["mask"] = [oval.ravel().tolist()] * len(found)
            if "mask_logits" in self.optional:
                found["mask_logits"] = [np.where(oval, 3.0, -3.0).ravel().tolist()] * len(found)
            if "polygon" in self.optional:
                found["polygon"] = [[[x1, y1], [x2, y1], [x2, y2]] if cls == 3 else None for cls, x1, y1, x2, y2 in zip(found["cls"], found["x1"], found["y1"], found["x2"], found["y2"])]
            return found

    class SeesPolygons(adapters.StubRecognizer):
        def recognize(self, batch):
            return [f"points {0 if p is None else len(p)} in {len(c)}" for p, c in zip(batch["polygon"], batch["crop"])]

    one = pages(shared).where("doc = 2")

    def found(*optional):
        return {r.idx: r for r in Engine(shared, detector=Outlines(*optional), recognizer=SeesPolygons()).regions(one).collect()}

    plain, masks, logits, both = found(), found("mask"), found("mask_logits"), found("mask", "polygon")
    assert len(plain) == 3 and all(r.polygon is None for r in plain.values()) and plain[0].content == "points 0 in 4"
    assert {i: r.polygon for i, r in masks.items()} == {i: r.polygon for i, r in logits.items()}
    for i, r in masks.items():
        x1, y1, x2, y2 = r.bbox
        assert len(r.polygon) > 3 and all(x1 - 1 <= x <= x2 + 1 and y1 - 1 <= y <= y2 + 1 for x, y in r.polygon) and r.bbox == plain[i].bbox
    assert masks[0].content == f"points {len(masks[0].polygon)} in 4" and masks[0].polygon != [[0, 0], [1000, 0], [1000, 260], [0, 260]]
    assert [len(both[i].polygon) for i in range(3)] == [len(masks[0].polygon), len(masks[1].polygon), 3]


def test_bundle_makes_figures_and_sidecar(shared):
    import hashlib

    rgb = bytes(i % 251 for i in range(50 * 40 * 3))
    given = shared.createDataFrame([(1, 0, 50, 40, rgb), (1, 1, 50, 40, None), (2, 0, 50, 40, rgb[:9])], "doc long, page int, w int, h int, rgb binary")
    got = {r.doc: r for r in Engine(shared, Config(bundle=Bundle(enabled=True, figure_format="png"))).parse(given).collect()}
    one = got[1]
    assert [(f.page_index, f.region_index, f.relative_path) for f in one.figures] == [(0, 1, "figures/page_0001_region_0002.png"), (0, 2, "figures/page_0001_region_0003.png")]
    for f in one.figures:
        x1, y1, x2, y2 = (v * n // 1000 for v, n in zip(f.bbox_2d, (50, 40, 50, 40)))
        assert (f.width_px, f.height_px) == (x2 - x1, y2 - y1) and f.sha256 == hashlib.sha256(f.data).hexdigest()
        assert bytes(f.data) == adapters.png(x2 - x1, y2 - y1, b"".join(rgb[(y * 50 + x1) * 3 : (y * 50 + x2) * 3] for y in range(y1, y2)))
    # A figure that isn't made keeps its marker, with a warning.
    assert one.warnings == ["bundle.figure crop failed: page=1 region=1", "bundle.figure crop failed: page=1 region=2"] and "(figures/page_0001_region_0002.png)" in one.markdown and one.markdown.count("bbox=[") == 2
    assert got[2].figures == [] and got[2].markdown.count("bbox=[") == 2
    side = json.loads(one.sidecar)
    assert side["schemaVersion"] == 1 and len(side["pages"]) == 2 and side["diagnostics"]["warnings"] == one.warnings and side["diagnostics"]["metadata"] == one.metadata
    assert [r["index"] for r in side["pages"][0]["regions"]] == [0, 1, 2] and side["pages"][0]["regions"][0]["content"].startswith("Recognized")
    assert [(f["sha256"], f["mimeType"]) for f in side["figures"]] == [(f.sha256, "image/png") for f in one.figures] and "data" not in side["figures"][0]
    assert all(list(x) == sorted(x) for x in (side, side["figures"][0], side["pages"][0]["regions"][0]))
    no_codec = Engine(shared, Config(bundle=Bundle(enabled=True))).parse(given.where("doc = 1 and page = 0")).collect()[0]
    assert no_codec.figures == [] and no_codec.warnings[0] == "bundle.figure encode failed: page=0 region=1" and no_codec.markdown.count("bbox=[") == 2


def test_command_writes_the_figures_it_links(shared, tmp_path):
    import re

    from quire.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(adapters.png(40, 40, bytes(4800)))
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--bundle"], shared) == 0
    links = re.findall(r"\((imgs/[^)]*)\)", (tmp_path / "out" / "a" / "a.md").read_text())
    assert len(links) == 2 and all((tmp_path / "out" / "a" / x).read_bytes().startswith(b"\x89PNG") for x in links)


def test_whole_metadata(shared):
    from hashlib import sha256

    want = {
        "layoutEnabled": "true", "markdownBundleEnabled": "true", "markdownBundleGenerated": "true", "markdownBundleFigureCount": "2", "pageCount": "2", "layoutDetectionCount": "6", "maxConcurrentRecognitions": "1",
        "maxPagesOption": "7", "defaultMaxPages": "nil", "effectiveMaxPages": "7", "pdfDPI": "200", "pdfMaxRenderedLongSide": "3500", "inferenceBatchSize": "4", "inferenceBatchMaxWaitMs": "8", "inferenceMaxInflightJobs": "1",
        "pdfRenderConcurrency": "2", "ocrPreprocessConcurrency": "4", "bundleEncodeConcurrency": "2", "layoutPostprocessFastPath": "true", "recognitionJobCount": "2", "recognitionTextJobCount": "2", "recognitionTableJobCount": "0",
        "recognitionFormulaJobCount": "0", "skipRegionCount": "4", "detectionCount": "6", "inferenceBucketCount": "1", "inferenceBatchCount": "1", "inferenceMaxBatchSize": "2", "inferenceAverageBatchSize": "2.00", "inferenceQueuedJobCount": "2",
        "pageRenderDebugDump": "nil", "pageRenderDebugCount": "0",
    }
    for name, prompt in (("noLayout", dims.PAGE_PROMPT), *((t, dims.PROMPTS[t]) for t in ("text", "table", "formula"))):
        want[name + "PromptHash"] = sha256(prompt.encode()).hexdigest()[:16]
    given = shared.createDataFrame([(1, 0, 50, 40, bytes(6000)), (1, 1, 50, 40, None)], "doc long, page int, w int, h int, rgb binary")
    got = Engine(shared, Config(bundle=Bundle(enabled=True, figure_format="png"))).parse(given, ParseOptions(max_pages=7)).collect()
    assert got[0].metadata == want and len(want) == 36
