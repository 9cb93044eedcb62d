import random
import unicodedata

import numpy as np
import pyarrow as pa

from corpusloom.llm import leakage as L

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


def plain_words(t):
    out = []
    for w in unicodedata.normalize("NFD", t or "").split():
        k = "".join(c for c in w if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd")
        if any(unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" for c in k):
            out.append(unicodedata.normalize("NFD", k.lower()))
    return out


def test_words():
    texts = ["One, two - THREE!", "one two three", "élan É", "élan é", None, "", "ড় ড়", "— ।", "x" * 70_000 + " y"]
    w, o = L.word_hashes(pa.array(texts))
    rows = [w[a:b].tolist() for a, b in zip(o, o[1:])]
    assert rows[0] == rows[1] and rows[2] == rows[3] and not rows[4] and not rows[5] and rows[6][0] == rows[6][1] and not rows[7] and len(rows[8]) == 2
    rng = random.Random(1)
    made = [" ".join("".join(rng.choices("ab১é'", k=rng.randint(1, 3))) for _ in range(20)) for _ in range(50)]
    w, o = L.word_hashes(pa.array(made))
    known = {}
    for t, a, b in zip(made, o, o[1:]):
        assert len(plain_words(t)) == b - a
        for x, y in zip(plain_words(t), w[a:b].tolist()):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)


def align_slowly(a, b):
    h, best, run = np.zeros((len(a) + 1, len(b) + 1), int), 0, 0
    r = np.zeros_like(h)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = L.MATCH if a[i - 1] == b[j - 1] else L.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + L.GAP, h[i, j - 1] + L.GAP)
            r[i, j] = r[i - 1, j - 1] + 1 if s == L.MATCH else 0
    return int(h.max()), int(r.max())


def test_alignment_against_cells():
    rng = random.Random(2)
    for _ in range(150):
        a, b = (np.array(rng.choices(range(4), k=rng.randint(0, 14))) for _ in "ab")
        got = L.align(a, b)
        assert (got["score"], got["run"]) == (align_slowly(a, b) if len(a) and len(b) else (0, 0))
        if got["score"]:
            part = L.align(a[got["a_from"] : got["a_to"]], b[got["b_from"] : got["b_to"]])
            assert part["score"] == got["score"] and got["matches"] <= got["a_to"] - got["a_from"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((4, 9, 10, 11, 30))))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        text = rng.choices(words, k=rng.randint(0, 60))
        item = rng.choice(items)[1]
        if item and rng.random() < 0.6:
            part = item.split()
            size = rng.choice((5, 8, 9, 10, 11, 30))
            a = rng.randrange(max(1, len(part) - size + 1))
            text[len(text) // 2 : len(text) // 2] = [x.upper() + "," for x in part[a : a + size]]
        docs.append((d, "  ".join(text)))
    docs += [(200, None), (201, ""), (202, "— " + "w1 " * 40_000 + items[3][1] if items[3][1] else "")]
    tens = lambda t: {tuple(w[i : i + 10]) for w in [plain_words(t)] for i in range(len(w) - 9)}
    want = {(i, d) for i, x in items for d, y in docs if tens(x) & tens(y)}
    got = {(r.item_id, r.doc_id) for r in L.leaks(spark.createDataFrame(docs, DOC), "doc_id", "text", spark.createDataFrame(items, ITEM), "item_id", "text").collect()}
    assert got == want and len(want) > 10


def test_edited_copies_are_scored(spark):
    item = " ".join(f"t{i}" for i in range(30))
    edited = item.replace("t7 ", "").replace("t20", "other")
    docs = spark.createDataFrame([(1, "before " + edited + " after"), (2, "something else")], DOC)
    got = L.alignments(docs, "doc_id", "text", spark.createDataFrame([(5, item)], ITEM), "item_id", "text").collect()
    assert [(r.doc_id, r.matches, r.run, r.score, r.item_from, r.item_to, r.doc_from, r.doc_to) for r in got] == [(1, 28, 12, 54, 0, 30, 1, 30)]


def test_defined_for_odd_tables(spark):
    none = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    one = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, "x")], DOC + ", i int, k string"), spark.createDataFrame([(1, "a b c d e f g h i j", 2)], ITEM + ", t int")
    find = lambda d, i: L.leaks(d, "doc_id", "text", i, "item_id", "text").count()
    assert find(*none) == find(none[0], one[1]) == find(one[0], none[1]) == 0 and find(*one) == 1
    assert L.leaks(one[0].unionByName(one[0]), "doc_id", "text", one[1], "item_id", "text").count() == 1


def test_copies_edited_every_few_words_are_aligned(spark):
    """Every pair with five words in a row in common is aligned, whatever else of the item the corpus holds."""
    item = [f"t{i}" for i in range(54)]
    docs = [(n, " ".join(f"x{n}" if i % n == n - 1 else t for i, t in enumerate(item))) for n in (5, 6, 7, 8, 9)]
    docs += [(20, " ".join(item[10:15])), (21, "b " + " ".join(item[12:17]) + " e"), (22, " ".join(item[30:34])), (23, " ".join(item))]
    for some in (docs, docs[:-1]):
        got = {r.doc_id: r for r in L.alignments(spark.createDataFrame(some, DOC), "doc_id", "text", spark.createDataFrame([(5, " ".join(item))], ITEM), "item_id", "text").collect()}
        assert set(got) == {d for d, _ in some} - {5, 22}
        assert all(got[n].run == n - 1 and got[n].matches == 54 - 54 // n for n in (6, 9)) and got[21].matches == 5


def test_recall_of_randomly_edited_copies(spark):
    """Items of 10 to 60 words with 1 to 5 edits anywhere: every pair that shares five words in a row is found, and scored as
    a comparison of all pairs scores it."""
    rng = random.Random(11)
    items = [(i, [f"i{i}w{rng.randrange(400)}" for _ in range(rng.randint(10, 60))]) for i in range(60)]
    docs = []
    for d in range(150):
        i, words = rng.choice(items)
        copy = list(words)
        for _ in range(rng.randint(1, 5)):
            at, how = rng.randrange(len(copy)), rng.random()
            copy[at : at + 1] = [f"new{rng.random()}"] if how < 0.4 else [] if how < 0.7 else [copy[at], f"more{rng.random()}"]
            copy = copy or ["x"]
        docs.append((d, ["before"] * rng.randint(0, 5) + copy + ["after"] * rng.randint(0, 5)))
    fives = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    want = {}
    for i, a in items:
        for d, b in docs:
            if fives(a) & fives(b):
                number = {w: n for n, w in enumerate(dict.fromkeys(a + b))}
                want[i, d] = align_slowly([number[w] for w in a], [number[w] for w in b])
    rows = L.alignments(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], DOC), "doc_id", "text", spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM), "item_id", "text").collect()
    assert {(r.item_id, r.doc_id): (r.score, r.run) for r in rows} == want and len(want) > 130
    size = {i: len(w) for i, w in items}
    assert all(r.kind == ("passage" if r.run >= 10 else "edited" if r.score >= size[r.item_id] else "phrase") for r in rows)
    assert {"passage", "edited"} <= {r.kind for r in rows}
