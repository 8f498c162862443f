import random

import pytest

from quire.llm import split as S
from quire.llm.bpe import tokenizer


@pytest.fixture(scope="module")
def tok():
    return tokenizer()


def texts():
    rng = random.Random(2)
    bits = ["The mill was open. ", "Word", " word", "\n", "\n\n", "  ", "，中文字很多没有空格", "。", "é", "😀", "x" * 90, "a1-b2", "!\n", "3.14 "]
    for _ in range(60):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(0, 400)))
    yield "中" * 900
    yield "supercali" * 700
    yield "the " * 4000


def test_pieces(tok):
    for text in texts():
        for most, shared in ((60, 10), (128, 0), (512, 64)):
            found, total = S.split(tok, text, most, shared), len(tok.encode(text))
            assert bool(found) == (total > most)
            at = 0
            for i, p in enumerate(found):
                assert p.start <= at < p.end and (i == 0) == (p.shared == 0 and p.start == 0) or shared == 0 or p.start == at
                assert len(tok.encode(text[p.start : p.end])) <= p.tokens <= most
                assert len(tok.encode(text[p.start : at])) <= shared
                at = p.end
            assert not found or at == len(text)


def test_weakest_boundaries_go_first(tok):
    para = "One two three four five. Six seven eight nine ten.\nLine two of it here now."
    text = "\n\n".join([para] * 12)
    assert {p.cut for p in S.split(tok, text, 60, 8)} == {"paragraph", "end"}


def test_defined_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "short", 5), (4, "word " * 600, 5), (4, "word " * 600, 5), (None, "word " * 600, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = S.split_long(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {4, None} and len(got) == 3 * len([r for r in got if r.doc_id is None])
    first = [r for r in got if r.doc_id is None]
    assert "".join(r.piece_text[0 if r.piece == 0 else len(r.piece_text) - (r.end - first[r.piece - 1].end) :] for r in first) == "word " * 600
    assert S.split_long(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        S.split_long(df, "doc_id", "text", max_tokens=10, overlap=10)
