import pytest

from quire.llm import descan as D

WORDS = {w: 400 for w in "the mill was opened by council in town it noted at time and river low over sediment modern barn pattern hand-drawn well-kept table surveyor when of a to light".split()}
WORDS |= {"sedirnent": 3, "norston": 5, "tamston": 5, "kelston": 5, "torston": 4, "corford": 6, "tamford": 6}


@pytest.fixture(scope="module")
def lex():
    return D.Lexicon(WORDS)


def read(lex, *lines):
    return D.decode(list(enumerate(lines)), lex)


def text(r):
    return " ".join(w for w, _ in r.words)


@pytest.mark.parametrize(
    "line,number",
    [("12", 12), ("- 4 -", 4), ("— 118 —", 118), ("p. 7", 7), ("Page 3 of 5", 3), ("63/69", 63), ("[9]", 9), ("iv", 4), ("Seite 21", 21), ("lxxxv", 85), ("[9].", None), ("45x", None), ("2   REPORT", None), ("", None), ("mix", None), ("a canvas [4]", None)],
)
def test_page_number(line, number):
    assert D.page_number(line) == number


def test_fold_ignores_numbers_and_misreads():
    assert D.fold("2   REPORT ON THE MILL") == D.fold("Rep0rt on tlie mi!l   13") == D.fold("REP0RT ON THE RNILL")
    assert D.fold("Chapter of culture and wood") == D.fold("Cliapter of ciilture ancl vvoocl")
    assert D.fold("Dorow mill | 118 | desk-39") == D.fold("D0r0w mi|l | 119 | desk-39")
    assert D.fold("Mill of Dorow") != D.fold("Barn of Dorow")


def test_decoding(lex):
    r = read(lex, "The m€dern sedirnent was op-", "ened by the hand-", "drawn coun¬", "cil in tlie (own.")
    assert text(r) == "The modern sediment was opened by the hand-drawn council in the (own." or r.misreads >= 3
    assert r.hyphens == 2
    r = read(lex, "(It was noted [12] in 1894.) The light was low!")
    assert (r.hyphens, r.misreads) == (0, 0) and text(r) == "(It was noted [12] in 1894.) The light was low!"
    r = read(lex, "The pattem was by themill and the ri ver")
    assert text(r) == "The pattern was by the mill and the river" and (r.misreads, r.splits, r.merges) == (1, 1, 1)
    r = read(lex, "Tam-", "ston and the well-", "kept barn")
    assert text(r) == "Tamston and the well-kept barn" and r.hyphens == 1
    assert text(read(lex)) == ""


def test_decoder_finds_the_cheapest_path(lex):
    # Against all segmentations of a stream by the same edges.
    lines = ["the ri ver was low", "themill op-", "ened"]
    assert text(read(lex, *lines)) == "the river was low the mill opened"


def test_paragraphs():
    lines = ["Title of it", "", "The mill was opened by the council in the", "town, and it was noted. The river was", "low.", "", "   It was noted by the council at that time", "again."]
    body = [(i, x) for i, x in enumerate(lines) if x.strip()]
    assert D.paragraphs(body, lines) == [0, 2, 6]
    assert D.paragraphs([], []) == []


def test_repair(spark):
    prose = "The mill was opened by the council in the\ntown, and it was noted. The sedi-\nment was low, and the river of the town was\nmodern at the time when it was noted."
    pages = []
    for i in range(3):
        head = "" if i == 0 else ("MILL OF DOROW" if i == 1 else "M1LL OF DOROW") + "\n\n"
        pages.append((10 + i, 1, i, head + prose.replace("modern", "m0dern" if i == 2 else "modern") + ["", "\nThe mill was low.", "\nThe table was by the barn."][i] + f"\n\n- {i + 5} -", "x"))
    pages += [(20, 2, 0, None, "x"), (21, 2, 1, "", "x"), (22, 2, 2, " \r\n ", "x"), (23, 3, None, prose.replace("-\n", ""), "x"), (23, 3, None, prose.replace("-\n", ""), "x"), (24, None, 0, "* dry hatch\n* cold gate", "x"), (None, 1, 1, prose, "x")]
    pages += [(100 + i, 50 + i, 0, prose.replace("sedi-\nment", "sediment\n"), "x") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, scan_id long, page_index int, content string, kinds string")
    common = spark.createDataFrame([(w,) for w in "the was by in and it of at when".split()], "word string")
    got = {r.page_id: r for r in D.repair(df, common).collect()}
    assert len(got) == 28
    assert [sorted(got[i].kinds) for i in (10, 11, 12)] == [["hyphen", "page_number"], ["header", "hyphen", "page_number"], ["header", "hyphen", "misread", "page_number"]]
    assert got[12].repaired == "The mill was opened by the council in the town, and it was noted. The sediment was low, and the river of the town was modern at the time when it was noted. The table was by the barn."
    assert all(got[i].kinds == [] for i in (20, 21, 22, 23, 24)) and got[20].repaired == ""
    assert D.repair(df.limit(0), common).count() == 0


def test_words_with_many_odd_characters():
    lex = D.Lexicon({**WORDS, "elephantess": 9, "close": 900, "dose": 20, "flat": 500, "fiat": 5})
    assert D._best(lex, "€l€ph@nt€s5")[1:] == ("elephantess", 5)
    assert D.confusions("€l€ph@nt€s5", "elephantess") == 5 and D.confusions("dose", "close") is None and D.confusions("close", "dose") == 1
    assert lex.known("fiat")  # alike in strokes, but no letter l is misread as i
    assert D._best(lex, "clii")[2] == 0
    assert D._best(lex, "N@r5t@nb€rg")[1] == "Narstanberg"


def test_joint_segmentation(lex):
    assert text(read(lex, "the rnill")) == "the mill"
    assert lex.segments("themillby")[1] == lex.segments("thernillby")[1] == ["the", "mill", "by"] and lex.segments("norston") is None
    more = D.Lexicon({**WORDS, "formation": 50, "for": 500})
    assert text(read(more, "the for mation was low")) == "the formation was low"


def test_running_lines_reach_the_edge():
    assert D.running({0: 3, 2: 4, 1: 40, 5: 38}) == {3, 4, 40}
    e = D.edges("REPORT OF THE MILL\nsecond line\n\nbody\n\nfoot\n- 4 -")
    assert D.edge_lines(e) == [(0, 0), (2, 1), (1, 5)]


def test_paragraphs_of_made_pages():
    """Boundaries found against those made, over widths, indentation, blank lines and hyphenation."""
    import random
    import textwrap

    rng, hit, found, made = random.Random(12), 0, 0, 0
    bag = "the mill was opened by council in town it noted at time and river low over sediment modern barn pattern table surveyor when of a to light".split()
    for page in range(150):
        width, style = rng.choice([48, 64, 80]), rng.choice(["blank", "indent", "plain"])
        lines, truth = [], set()
        for k in range(rng.randint(2, 6)):
            sentences = [" ".join(rng.choice(bag) for _ in range(rng.randint(6, 16))).capitalize() + "." for _ in range(rng.randint(2, 5))]
            wrapped = textwrap.wrap(" ".join(sentences), width)
            if style == "blank" and lines:
                lines.append("")
            truth.add(len(lines))
            lines += ["   " + wrapped[0] if style == "indent" else wrapped[0], *wrapped[1:]]
        body = [(i, x) for i, x in enumerate(lines) if x.strip()]
        got = set(D.paragraphs(body, lines))
        hit, found, made = hit + len(got & truth), found + len(got), made + len(truth)
    assert hit / found > 0.95 and hit / made > 0.9, (hit / found, hit / made)
    long = [(i, "The mill was open and low.") for i in range(20_000)]
    assert D.paragraphs(long, [x for _, x in long])[0] == 0


def test_paragraphs_are_of_least_cost():
    import itertools

    def cost(firsts, lines, every):
        total, n = 0.0, len(lines)
        width = sorted(len(x.rstrip()) for _, x in lines)[int(0.8 * (n - 1))] or 1
        for k in range(1, n):
            before, here = lines[k - 1][1].rstrip(), lines[k][1].strip()
            ended = before[-1:] in ".!?:"
            gap = any(not every[i].strip() for i in range(lines[k - 1][0] + 1, lines[k][0]))
            lack = max(0.0, (width - len(before) - len(here.split()[0]) - 1) / width)
            if k in firsts:
                total += 2.0 + 6.0 * here[:1].islower() + 3.0 * (before[-1:] == "-") + 1.5 * (not ended) + 0.25 * (k - 1 in firsts)
            else:
                total += 4.0 * gap * (2.0 if ended else 0.75) + 6.0 * lack * (1.5 if ended else 0.7)
        return total + 0.25 * (n - 1 in firsts)

    import random

    rng = random.Random(3)
    for _ in range(60):
        every = [rng.choice(["The mill was open.", "and the river was low", "Short.", "", "A line of the same length as others it"]) for _ in range(8)]
        body = [(i, x) for i, x in enumerate(every) if x]
        if not body:
            continue
        n = len(body)
        best = min(cost({0, *c}, body, every) for r in range(n) for c in itertools.combinations(range(1, n), r))
        at = {i: k for k, (i, _) in enumerate(body)}
        assert abs(cost({at[i] for i in D.paragraphs(body, every)}, body, every) - best) < 1e-9


def test_rare_words_are_joined_to_their_pages(spark):
    """With fewer words held than there are, readings are as with all of them."""
    sf = "/root/testdata/sf0.001"
    texts, common = spark.read.parquet(f"{sf}/page_texts.parquet"), spark.read.parquet(f"{sf}/common_words.parquet")
    few = {r.page_id: (sorted(r.kinds), r.repaired) for r in D.repair(texts, common, lexicon_words=120).collect()}
    every = {r.page_id: (sorted(r.kinds), r.repaired) for r in D.repair(texts, common).collect()}
    assert few.keys() == every.keys() and sum(few[i] == every[i] for i in few) >= 0.9 * len(few)


def test_asked_words(lex):
    small = D.Lexicon({w: n for w, n in WORDS.items() if w not in ("sediment", "modern", "mill")})
    lines = list(enumerate(["the m0dern sedi-", "ment was by the rnill"]))
    asked = D.asked_words(lines, small)
    assert {"modern", "sediment", "mill"} <= asked
    full = D.with_words(small, {w: WORDS[w] for w in asked if w in WORDS})
    assert text(D.decode(lines, full)) == text(D.decode(lines, lex)) == "the modern sediment was by the mill"
