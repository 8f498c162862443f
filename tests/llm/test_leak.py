import random

import numpy as np

from quire.llm import leak as L


def test_words():
    assert L.words("A ﬁne Ｔest-\n case, x²") == ["a", "fine", "testcase", "x2"]
    assert L.words("well-known re-\r\nport­\nage") == ["well", "known", "reportage"]
    assert L.words(None) == L.words(" \n") == []


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = L.MATCH if a[i - 1] == b[j - 1] else L.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + L.GAP, h[i, j - 1] + L.GAP)
    return int(h.max())


def test_smith_waterman_against_the_plain_recurrence():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 4, rng.integers(0, 14)), rng.integers(0, 4, rng.integers(0, 14))) for _ in range(200)]
    want = [plain_smith_waterman(a, b) if len(a) and len(b) else 0 for a, b in pairs]
    assert [x[0] for x in L.smith_waterman(pairs)] == want
    assert [x[0] for x in L._aligned([(a, [b]) for a, b in pairs], cells=60)] == want
    assert L.smith_waterman([(np.arange(6), np.array([9, 0, 1, 2, 9, 3, 4, 5]))]) == [(11, 6)]


def test_found_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 14, 30])))) for i in range(12)]
    items += [(100, items[0][1]), (101, None), (102, ""), (None, items[3][1])]
    docs = []
    for d in range(40):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        src = (rng.choice(items)[1] or "").split()
        a = rng.randint(0, max(0, len(src) - 1))
        docs.append((d, " ".join(ws + src[a : a + rng.randint(9, 16)] + ws[:5])))
    docs += [(50, None), (51, ""), (None, "x y"), (3, docs[3][1])]

    def grams(t, n=12):
        w = L.words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t in docs for i, s in items if d is not None and i is not None and grams(t) & grams(s)}
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    for block in (L.BLOCK_WORDS, 20):
        got = L.leaks(dd, ii, "doc_id", "text", "item_id", "text", block_words=block)
        assert {(r.doc_id, r.item_id) for r in got.where("run_words >= 12").collect()} == want
    assert want and got.count() == got.select("doc_id", "item_id").distinct().count()
    assert L.leaks(dd.limit(0), ii, "doc_id", "text", "item_id", "text").count() == 0
    assert L.leaks(dd, ii.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def edited(rng, words, share, bag, kinds=("replace", "drop", "add")):
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
            continue
        kind = rng.choice(kinds)
        if kind == "replace":
            out.append(rng.choice(bag))
        elif kind == "add":
            out += [w, rng.choice(bag)]
    return out


def test_edited_copies(spark):
    """Recall and precision of the alignment on planted copies with 10, 20 and 30 % of the words changed, and every third to fifth."""
    rng = random.Random(31)
    # Words by rank, as in a language: few are frequent.
    bag = [f"w{int(3000 * rng.random() ** 3)}" for _ in range(40_000)]
    items = [(i, [rng.choice(bag) for _ in range(rng.randint(30, 60))]) for i in range(60)]
    docs, truth = [], {}
    for share in (0.1, 0.2, 0.3, "replace 0.3", 3, 4, 5):
        for i, ws in items:
            if isinstance(share, int):
                copy = [rng.choice(bag) if k % share == share - 1 else w for k, w in enumerate(ws)]
            elif isinstance(share, str):
                copy = edited(rng, ws, 0.3, bag, ("replace",))
            else:
                copy = edited(rng, ws, share, bag)
            d = len(docs)
            docs.append((d, " ".join([rng.choice(bag) for _ in range(rng.randint(50, 300))] + copy + [rng.choice(bag) for _ in range(50)])))
            truth[d, i] = share
    docs += [(len(docs) + k, " ".join(rng.choice(bag) for _ in range(400))) for k in range(300)]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(dd, ii, "doc_id", "text", "item_id", "text").where("leaked").collect()}
    for share in {str(s): s for s in truth.values()}.values():
        of = {k for k, s in truth.items() if s == share}
        assert len(got & of) >= 0.9 * len(of), (share, len(got & of), len(of))
    assert len(got & set(truth)) >= 0.99 * len(got)


def test_words_that_repeat_have_few_diagonals():
    import time

    item = L.Items([(1, ["the"] * 800)])
    seeds = item.seeds(np.zeros(len(item.grams), np.int64))
    ids = np.array([0] * 20_000 + [-1], np.int32)
    began = time.time()
    (d, k, diagonals), = L._pairs(item, seeds, ids, [0])
    assert (d, k) == (0, 0) and len(diagonals) < 21_000
    assert L.longest_run(ids[:-1], item.items[0][1], diagonals) == 800
    assert time.time() - began < 20


def test_short_items(spark):
    items = spark.createDataFrame([(1, "the old mill at Dorow"), (2, "mill at"), (3, "one two three four five six seven eight nine")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "They saw the old mill at Dorow again."), (2, "one two three four or so"), (3, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.leaked for r in L.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 1): True}
