import random

import pytest

from quire.llm import bpe as B
from quire.llm.encode import decode, encode

ALPHABET = "aaa eeioouthns\n\t\x1c\x1f 'sé中国한😀​́.-_=*#123½²٣\x85\xa0　ﬁ"


@pytest.fixture(scope="module")
def tok():
    return B.tokenizer()


def merged(tok, text):
    return [tok.ranks[t] for p in B.pieces(text) for t in tok.merge(p.encode())]


def test_random_texts_against_the_merges(tok):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        assert "".join(B.pieces(text)) == text
        assert tok.encode(text) == merged(tok, text)
        assert tok.decode(tok.encode(text)) == text


def test_split_against_property_classes():
    import public_tokenizers as P
    import regex

    pattern, rng = regex.compile(P.PATTERN), random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        assert B.pieces(text) == pattern.findall(text)


def test_special_text_is_ordinary(tok):
    assert len(tok.encode("<|endoftext|>")) > 1


def test_reset_keeps_results(tok, monkeypatch):
    small = B.Bpe()
    monkeypatch.setattr(small, "STATES", 50)
    monkeypatch.setattr(small, "PAIRS", 20)
    monkeypatch.setattr(small, "PIECES", 5)
    text = "Vendale observed a pattern after the preliminary marsh, 更界定商风且程地增文积员正。 " * 3
    assert small.encode(text) == merged(tok, text)


def test_lookahead_is_bounded(tok):
    tok.encode("更界定商风且程地增文积员正 antidisestablishmentarianism " + "-" * 300)
    longest = max(map(len, tok.ranks))
    assert tok.states and max(s.read for s in tok.states.values()) <= longest


def test_utf8_machine():
    rng = random.Random(8)
    for _ in range(500):
        data = bytes(rng.choice((0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xED, 0xA0, 0xF0, 0x9F, 0xF4, 0x90, 0xFF, 0xE4, 0xB8, 0xAD)) for _ in range(rng.randint(0, 12)))
        machine, out, i = B.Utf8(), "", 0
        while i < len(data):
            n = rng.randint(1, 3)
            out += machine.feed(data[i : i + n])
            i += n
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x"), (None, "word " * 3000, "x"), (4, "<|endoftext|> a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    by = {r.doc_id: list(r.ids) for r in got.collect()}
    assert by[1] == by[2] == [] and len(by[3]) == 1 and got.count() == 6 and len(by[None]) == 3001
    back = {r.doc_id: r.text for r in decode(got, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode(df.limit(0), "doc_id", "text").count() == 0
