import random

from quire.operators import bundle as B
from quire.operators import formatting as O
from quire.operators import jobs as J
from quire.adapters import StubRecognizer, recognise

SCHEMA = "doc long, page int, idx long, label string, content string, bbox array<int>"


def pages(spark, rows):
    return spark.createDataFrame([(1, p, i, l, c, [0, 0, 9, 9]) for p, page in enumerate(rows) for i, (l, c) in enumerate(page)], SCHEMA)


def content(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.page, r.idx)):
        out.setdefault(r.page, []).append(r.block)
    return out


def loop_numbers(page):
    out, i = [], 0
    while i < len(page):
        label, text = page[i]
        after = page[i + 1] if i + 1 < len(page) else (None, None)
        if label == "formula_number" and after[0] == "display_formula":
            out.append(f"$$\n{after[1]} \\tag{{{text.strip('()')}}}\n$$")
            i += 2
        elif label == "formula_number":
            i += 1
        elif label == "display_formula" and after[0] == "formula_number":
            out.append(f"$$\n{text} \\tag{{{after[1].strip('()')}}}\n$$")
            i += 2
        else:
            out.append(f"$$\n{text}\n$$" if label == "display_formula" else text)
            i += 1
    return out


def test_formula_numbers_are_paired_as_by_the_loop(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        rows.append([(l, f"({k})" if l == "formula_number" else f"x{k}") for k, l in enumerate(rng.choices(["formula_number", "display_formula", "text"], k=rng.randint(1, 9)))])
    got = content(O.merge_formula_numbers(O.normalise(pages(spark, rows))))
    assert {p: v for p, v in got.items() if v} == {p: w for p, r in enumerate(rows) if (w := loop_numbers(r))}


def test_hyphenated_texts_are_joined_once(spark):
    rng = random.Random(6)
    rows = [[("text", rng.choice(["w", "W"]) + str(k) + rng.choice(["-", ""])) for k in range(rng.randint(1, 8))] for _ in range(150)]

    def loop(page):
        out, i = [], 0
        texts = [c for _, c in page]
        while i < len(texts):
            if i + 1 < len(texts) and texts[i].endswith("-") and texts[i + 1][0].islower():
                out.append(texts[i][:-1] + texts[i + 1])
                i += 2
            else:
                out.append(texts[i])
                i += 1
        return out

    assert content(O.merge_hyphenated(O.normalise(pages(spark, rows)))) == {p: loop(r) for p, r in enumerate(rows)}


def test_null_and_empty_content_differ(spark):
    df = pages(spark, [[("text", None), ("text", ""), ("doc_title", ""), ("text", "a")]])
    md = O.page_markdown(O.placeholders(O.blocks(df))).collect()[0].markdown
    assert md == "\n\n# \n\na"
    assert O.blocks(df.limit(0)).count() == 0


JOBS = "doc long, page int, idx int, width int, height int, task string, prompt string"


def test_scheduler_cases(spark):
    a = spark.createDataFrame([(1, 0, 0, 16, 16, "text", "A"), (1, 0, 1, 16, 16, "text", "A"), (1, 1, 0, 16, 16, "table", "B")], JOBS)
    s = J.scheduler_stats(J.batches(J.buckets(a), 2)).collect()[0]
    assert (s.buckets, s.batches, s.max_batch, s.queued) == (2, 2, 2, 3)
    b = spark.createDataFrame([(1, 0, 0, 16, 16, "text", "A"), (1, 0, 1, 16, 16, "table", "A"), (1, 0, 2, 24, 16, "text", "A")], JOBS)
    s = J.scheduler_stats(J.batches(J.buckets(b), 8)).collect()[0]
    assert (s.buckets, s.batches) == (3, 3)


def test_recognition_failures_become_errors(spark):
    class Failing:
        def recognize(self, batch):
            if (batch["page"] == 13).any():
                raise RuntimeError("engine stopped")
            return ["only one"] if len(batch) > 1 else [f"p{batch['page'].iloc[0]}"]

    jobs = spark.createDataFrame([(1, p, 0, 16, 16, "text", "A") for p in range(20)], JOBS)
    got = {r.page: (r.text, r.error) for r in recognise(jobs, Failing(), retry=True).collect()}
    assert got[13] == (None, "engine stopped") and got[12] == ("p12", None) and len(got) == 20
    ok = {r.page: r.text for r in recognise(jobs, StubRecognizer(), 8).collect()}
    assert set(ok.values()) == {"Recognized text 16x16"}
    assert recognise(jobs.limit(0), StubRecognizer()).count() == 0


def test_markers(spark):
    md = "a ![x](page=0,bbox=[1, 2, 3, 4]) b ![](page=1,bbox=[1, 2, 3, 4]) ![z](page=1,bbox=[1])"
    df = spark.createDataFrame([(md, ["p/1.png", None]), ("none", []), (md, ["p/1.png"])], "md string, paths array<string>")
    from pyspark.sql import functions as F

    got = [r.x for r in df.select(B.rewrite_markers(F.col("md"), F.col("paths")).alias("x")).collect()]
    assert got[0] == "a ![x](p/1.png) b ![](page=1,bbox=[1, 2, 3, 4]) ![z](page=1,bbox=[1])" and got[1] == "none" and got[2] == got[0]
    warn = [r.x for r in df.select(B.marker_mismatch(F.col("md"), F.col("paths")).alias("x")).collect()]
    assert warn[0] is None and warn[2].endswith("markers=2 figures=1")
