import random
import re

from quire.llm import quality as Q

COMMON = Q.Common("the of and was in a at to by".split())


def sums(text):
    return Q.sums(text, COMMON, 1 << 30)


def chunked(text, size):
    parts = list(Q.cuts(text, size))
    assert "".join(parts) == text and all(len(x) >= size for x in parts[:-1])
    packed = [Q._unpack(Q._pack(Q.partial(x, COMMON))) for x in parts]
    return Q.finish(Q.combine(packed, COMMON), COMMON)


def test_chunks_give_the_sums_of_the_whole():
    rng = random.Random(4)
    parts = ["the", "  ", "\n", "word", " ", ".", "<td>", "...... ", "a", "| x |", "\t", "naïve", "(1) ", "12", "was ", "\n\n", "-", ", "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        for size in (1, 2, 5, 30):
            assert chunked(text, size) == sums(text), text


def test_borders_far_from_their_ends():
    # However long the white space, closing marks, tags or runs of dots at a border of chunks are.
    for text in ("A line ends here." + " " * 100, " " * 90 + "- item one\n" + " " * 300 + "2) item two", " " * 90 + "text" + " " * 90, "end." + ")" * 500 + "\nnext", '<td style="' + "a b " * 100 + '">cell</td>', "x" + " " * 400 + "y", "a" + "." * 400 + "b", "a" * 700 + "\n" + "b c" * 200):
        for size in (1, 7, 64, 200):
            assert chunked(text, size) == sums(text), (text, size)
    assert sums("A line ends here." + " " * 100).punctuated == 1
    assert sums(" " * 90 + "- item one\n" + " " * 90 + "2) item two").items == 2
    assert sums(" " * 90 + "text" + " " * 90).lines == 1


def test_kinds():
    prose = "The mill was opened by the council in the town. It was noted at the time, and the river was low.\n" * 3
    cases = {
        "prose": [prose, "HEADER 3\n\n" + prose],
        "list": ["* dry hatch\n* open window\n* cold gate", "1) one unit\n2) tin cup\n3) red box", "Cold gate: 12\nDry hatch: yes\nLamp oil: -", "1 Dry hatch of Belum ........... 6\n2 Lamp oil ........ 19"],
        "table": ["| Gate | Lamp oil |\n| --- | --- |\n| Dorow | 4% |\n| Belum | 17 |", "Gate;Lamp\nDorow;12\nBelum;", "Gate\tLamp\nDorow\t12", "Gate      Lamp\nDorow       12\nBelum        3", "<table><tr><td>Gate</td><td>Lamp</td></tr><tr><td>1</td><td>2</td></tr></table>\n3"],
        "junk": ["45x\n" * 30, "COPY DRAFT " * 20, "~ , _ . ; l ' j\n. | r I t", "=====\n-----", "zvnr rttrkz xtzrb jdqqq fns fwbkdtp hcggjbfjw", "9e ca 42 f7 4a 52 fb 3f 37 c1 5a f5", "Â©¬Ã© âÃÂœÂ ÂïœÃâ© ï»©Âï »œÃâŸ ©âœœ œŸ œÂ¬ ¿©Ââ¿Ÿœâ¬ ©ïâ¬Ÿ"],
    }
    for want, texts in cases.items():
        for t in texts:
            assert Q.kind(sums(t)) == want, (want, t)
    assert Q.kind(sums("")) is None and Q.kind(sums(" \n\t ")) is None


def test_statistics(spark):
    long = "The mill was open. " * 4000
    rows = [(1, None, 9), (2, "", 9), (3, " \n", 9), (4, "The mill, at noon.\nOpen", 9), (4, "The mill, at noon.\nOpen", 9), (5, long, 9), (5, long, 9), (None, "the of", 9)]
    df = spark.createDataFrame(rows, "page_id long, content string, kind int")
    words = spark.createDataFrame([("the",), ("At",), (None,)], "word string")
    got = {r.page_id: r for r in Q.statistics(df, "page_id", "content", words, chunk=100, spread=1000).collect()}
    assert len(got) == 6
    whole = {r.page_id: r for r in Q.statistics(df, "page_id", "content", words).collect()}
    assert got == whole
    assert got[1].word_count == got[2].word_count == got[3].word_count == 0 and got[1].kind is None
    assert (got[4].word_count, got[4].mean_word_length, got[4].punctuated_lines, got[4].common_words) == (5, 3.4, 0.5, 0.4)
    assert (got[5].word_count, got[5].mean_word_length) == (16000, 3.5)
    assert Q.statistics(df.limit(0), "page_id", "content", words).count() == 0
