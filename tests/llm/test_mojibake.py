import random

import pytest

from corpusloom.llm import mojibake as M

SCHEMA = "doc_id bigint, source string, text string"
CLEAN = ["আমি ভালো আছি, তুমি কেমন আছো?", "“Quoted” — and ’24 is fine…", "café résumé naïve brûlée Ångström São", "n’était pas l’été", "31°C ±2% €12 £4½ № 5 ★★★☆☆ « note »", "हम लोग कल जाएंगे", "Ёлка её привет", "αβγ ≠ ∞"]


def garble(text, encoding):
    table = {b: c for c, b in M.to_byte(encoding).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())


def corpus(seed=1, n=400):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        text = " ".join(rng.choices(CLEAN[:2] + CLEAN, k=4))
        out = text
        if i % 5 == 0:
            words = text.split(" ")
            a = rng.randrange(len(words))
            b = min(len(words), a + rng.randint(1, 6))
            piece = " ".join(words[a:b])
            e = rng.choice(("cp1252", "latin-1", "cp1251", "mac_roman", "cp437"))
            bad = garble(piece, e)
            if rng.random() < 0.2:
                bad = garble(bad, "cp1252") if e in ("cp1252", "latin-1") else bad
            out = " ".join(words[:a] + [bad] + words[b:])
        if out != text:
            truth[i] = text
        rows.append((i, f"s{i % 3}", out))
    return rows, truth


def test_planted_stretches(spark):
    rows, truth = corpus()
    got = {r.doc_id: r for r in M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).collect()}
    assert set(got) == set(truth)
    assert sum(got[i].repaired == t for i, t in truth.items()) >= 0.95 * len(truth)


def test_lost_bytes(spark):
    rows, _ = corpus(2)
    lost = "আমি".encode().decode("ascii", "replace")
    half = garble("আমি সুন্দর", "cp1252").replace("\x81", "�")
    rows = [r for r in rows if r[0] % 5] + [(900, "s0", f"x {lost} y"), (901, None, half), (902, "s1", None), (903, "s1", "")]
    got = {r.doc_id: r for r in M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).collect()}
    assert set(got) == {900, 901}
    assert got[900].stretches == 0 and got[900].lost == 9 and got[900].repaired == f"x {lost} y"
    assert got[901].stretches > 0 and got[901].repaired.startswith("আমি স")


def test_defined_for_odd_tables(spark):
    assert M.repairs(spark.createDataFrame([], SCHEMA), "doc_id", "source", ["text"]).count() == 0
    rows, truth = corpus(3, 100)
    clash = spark.createDataFrame([(*r, 1, "x", None) for r in rows] + [(*rows[0], 1, "x", None)], SCHEMA + ", k int, t string, s string")
    got = M.repairs(clash, "doc_id", "source", ["text", "s"]).collect()
    assert sorted(r.doc_id for r in got) == sorted([*truth, 0]) and {r.field for r in got} == {"text"}


def test_long_text(spark):
    rows, _ = corpus(4)
    text = "আমি ভালো আছি " * 20_000
    rows = [r for r in rows if r[0] % 5] + [(999, "s0", text + garble("তুমি কেমন", "cp1252"))]
    got = M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).collect()
    assert [r.doc_id for r in got] == [999] and got[0].repaired == text + "তুমি কেমন"


RUSSIAN = ["привет, как твои дела сегодня", "мы пойдём завтра вместе гулять", "хорошая погода стоит здесь летом", "он читает интересную книгу вечером", "спасибо большое за помощь друзья"]


@pytest.mark.parametrize("read, written, least", [("latin-1", "cp1251", 0.8), ("cp1251", "koi8_r", 0.85), ("koi8_r", "cp1251", 0.85), ("cp866", "cp1251", 0.1)])
def test_single_byte_to_single_byte(spark, read, written, least):
    """Damaged texts are found, hardly any other is touched, and most of their words are restored; in cp866 many letters of
    cp1251 look like lines and boxes, so that few words are letters throughout."""
    rng, rows, truth = random.Random(7), [], {}
    back = {b: c for c, b in M.to_byte(read).items()}
    bad = {}
    for i in range(300):
        text = " ".join(rng.choices(RUSSIAN + CLEAN[1:5], k=3))
        if i % 6 == 0:
            text += " " + rng.choice(RUSSIAN)
            truth[i] = text
            text = " ".join("".join(back[M.to_byte(written)[c]] for c in w) if w.isalpha() and M._script(w[0]) == "CYRILLIC" and len(w) >= M.LETTERS else w for w in text.split(" "))
            bad[i] = text
        rows.append((i, f"s{i % 3}", text))
    got = {r.doc_id: r for r in M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).collect()}
    assert set(got) <= set(truth) and len(got) >= 0.95 * len(truth)
    words = [(a, b, c) for i, t in truth.items() if i in got for a, b, c in zip(t.split(" "), bad[i].split(" "), got[i].repaired.split(" ")) if a != b]
    assert sum(a == c for a, _, c in words) >= least * len(words)
    assert all(any(f"{read}={written}" in c.split("|") for c in r.chains) for r in got.values())


def test_clean_scripts_are_no_cases(spark):
    greek = ["καλημέρα σε όλους εσάς", "ευχαριστώ πολύ για όλα", "πού πηγαίνεις σήμερα φίλε"]
    arabic = ["السلام عليكم ورحمة الله", "شكرا جزيلا على المساعدة"]
    rng = random.Random(8)
    rows = [(i, f"s{i % 2}", " ".join(rng.choices(RUSSIAN + greek + arabic + CLEAN, k=4))) for i in range(300)]
    assert M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).count() == 0


def test_alike_chains_stand_together(spark):
    rows, _ = corpus(5)
    rows = [r for r in rows if r[0] % 5] + [(900 + i, "s0", "x " + garble("été", "latin-1")) for i in range(20)]
    got = M.repairs(spark.createDataFrame(rows, SCHEMA), "doc_id", "source", ["text"]).collect()
    assert len(got) == 20 and all("cp1252" in r.chains[0].split("|") and "latin-1" in r.chains[0].split("|") and r.evidence == "posterior" for r in got)
