import datetime

import pytest
from pyspark.sql import functions as F

from quire.llm import truncate as T

SCHEMA = "region_id long, scan_id long, page_index int, region_index int, label string, task string, content string, source string, ingested_at timestamp, cut string"
T0 = datetime.datetime(2025, 1, 1)


def row(i, content, label="text", task="text", source="plain", scan=None, page=0, index=0, day=0):
    return (i, scan if scan is not None else 10_000 + (i or 0), page, index, label, task, content, source, T0 + datetime.timedelta(days=day), "clash")


def lengths(text):
    import html
    import json

    utf8 = len(text.encode())
    return {
        "chars": len(text),
        "utf8": utf8,
        "utf16": len(text.encode("utf-16-le")) // 2,
        "html": len(html.escape(text, quote=False)),
        "json_ascii": len(json.dumps(text)) - 2,
        "json": len(json.dumps(text, ensure_ascii=False)) - 2,
        "crlf": len(text.replace("\n", "\r\n")),
        "utf8_crlf": len(text.replace("\n", "\r\n").encode()),
    }


@pytest.mark.parametrize("text", ["", "plain", "é ü 中\n😀", 'a "q" \\ <b> & \t\n', "x\r\ny\x01"])
def test_lengths(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[c.alias(n) for n, c in T.lengths(F.col("t")).items()]).collect()[0].asDict()
    want = lengths(text)
    if "\r" in text:
        want["crlf"] = len(text)
        want["utf8_crlf"] = len(text.encode())
    assert got == want


SENTENCE = "The mill at Dorow was opened by the council and the river was low that year. "


def cut_at(n, k):
    return ((f"{k} " + SENTENCE) * 9)[:n]


@pytest.fixture(scope="module")
def found(spark):
    rows = [row(i, cut_at(100, i), source="chars100", index=i) for i in range(40)]
    rows += [row(100 + i, "é" * (i % 7) + cut_at(30 + i % 9, i) + ".", source="chars100") for i in range(40)]
    rows += [row(200 + i, cut_at(117, i) + "...", source="marked120") for i in range(30)]
    rows += [row(300 + i, cut_at(20 + 2 * i, i).rstrip() + ".", source="marked120") for i in range(20)]
    rows += [row(400 + i, ("é" * i + cut_at(150, i)).encode()[:90].decode("utf-8", "replace"), source="bytes90") for i in range(30)]
    rows += [row(500, "The mill was open"), row(501, "The mill was open."), row(502, "They stopped there..."), row(503, "* dry hatch\n* cold gate"), row(504, "Notes on the mill", "paragraph_title"), row(505, "[3] Dorow, F. The mill was")]
    rows += [row(510, "The mill was open and", scan=1), row(511, None, "image", "skip", scan=1, index=1), row(512, "the river was low.", scan=1, index=2)]
    rows += [row(515, "The mill was open and", scan=3), row(516, "a) The river was low.", scan=3, index=1)]
    rows += [row(550, "Lower assembly of Belor", "content"), row(551, "Figure 8. Notes on the mill", "content"), row(552, "It was open. The river was", "content"), row(553, "BELOW ARCHIVE 23350", "content")]
    rows += [row(554, "The mill was open and", scan=4), row(555, "the river was low.", "content", scan=4, index=1), row(556, "It was open.", scan=4, index=2)]
    rows += [row(513, "It was not-", scan=2), row(514, "ed there.", scan=2, page=3)]
    rows += [row(520, "<table><tr><td>a</td></tr></table>", "table", "table"), row(521, "<table><tr><td>a</td></tr><tr><td>b", "table", "table"), row(522, "| a | b |\n| --- | --- |\n| c | d |", "table", "table"), row(523, "| a | b |\n| --- | --- |\n| c |", "table", "table")]
    rows += [row(530, "The mill was", day=0), row(530, "The mill was open.", day=1), row(531, "The mill was open.", day=0), row(531, "The mill", day=1), row(531, "The mill", day=1)]
    rows += [row(540, None), row(541, ""), row(542, "no source end", source=None), row(None, "The mill")]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, {r.region_id: r.reason for r in T.truncated(df).collect()}


def test_limits(found):
    df, _ = found
    got = {r.source: (r.coding, r.limit_length) for r in T.field_limits(T.features(df)).collect()}
    assert got == {"chars100": ("chars", 100), "marked120": ("chars", 120), "bytes90": ("utf8", 90)}


def test_reasons(found):
    df, got = found
    assert all(got[i] == "limit" for i in range(40) if cut_at(100, i).rstrip()[-1] != ".") and not any(got[100 + i] for i in range(40))
    assert all(got[200 + i] == "marked" for i in range(30)) and not any(got[300 + i] for i in range(20))
    ends = {r.region_id: r.content[-1] for r in df.where("source = 'bytes90'").collect()}
    assert all(bool(got[i]) != (c == ".") for i, c in ends.items()) and {got[i] for i in ends} >= {"limit"}
    cut = {i for i in got if i >= 500 and got[i]}
    assert cut == {500, 505, 515, 521, 523, 531, 542, 552}
    assert 540 not in got and 541 not in got and None not in got


def test_rates_and_empty(found):
    df, _ = found
    rates = {r.source: (r.texts, r.cut) for r in T.truncation_rates(df).collect()}
    assert rates["marked120"] == (50, 30)
    assert T.truncated(df.limit(0)).count() == 0 and T.truncation_rates(df.limit(0)).count() == 0


def test_every_limit_of_a_source(spark):
    """Two limits, a longer text beyond them, and a limit under a byte coding; a pile of whole texts is none."""
    rows = [row(i, cut_at(100, i), source="two") for i in range(40)] + [row(100 + i, cut_at(250, i), source="two") for i in range(30)]
    rows += [row(200 + i, cut_at(30 + 3 * i, i).rstrip() + ".", source="two") for i in range(60)] + [row(300, cut_at(400, 7), source="two")]
    rows += [row(400 + i, cut_at(90, i), source="outlier") for i in range(30)] + [row(450, cut_at(400, 3), source="outlier")]
    rows += [row(500 + i, "The mill at Dorow was open.", source="same") for i in range(50)] + [row(560 + i, cut_at(40 + 5 * i, i) + ".", source="same") for i in range(40)]
    rows += [row(700 + i, cut_at(4090, i) if i % 2 else cut_at(60 + i, i) + ".", source="border") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.source, r.coding, r.limit_length, r.at_limit) for r in T.field_limits(T.features(df)).collect())
    border = len(cut_at(4090, 1))
    assert [x[:3] for x in got if x[0] != "border"] == [("outlier", "chars", 90), ("two", "chars", 100), ("two", "chars", 250)]
    cut = {r.region_id: r.reason for r in T.truncated(df).where("cut").collect()}
    assert all(cut.get(i) == "limit" for i in [*range(40), *range(100, 130), *range(400, 430)] if (cut_at(100, i) if i < 40 else cut_at(250, i - 100) if i < 400 else cut_at(90, i - 400)).rstrip()[-1] != ".")
    assert not any(i in cut for i in range(500, 550)) and border > 100


def test_rows_without_a_scan_follow_none(spark):
    rows = [(1, None, 0, 0, "text", "text", "The mill was open and", "s", T0, "x"), (2, None, 0, 1, "text", "text", "the river was low.", "s", T0, "x")]
    assert {r.region_id: r.cut for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: True, 2: False}
