import random

import numpy as np
import pytest

from corpusloom.llm import language as L

WORDS = {
    "bangla": "আমি তুমি ভালো আছি কেমন বাজার থেকে নতুন শহরে মানুষ কথা বলেছেন আজকে দুপুরে যাব".split(),
    "banglish": "ami tumi bhalo achi kemon bajar theke notun shohore manush kotha bolechen ajke dupure jabo".split(),
    "english": "the market people said that we will go there today before noon with new friends".split(),
    "french": "nous avons parlé avec la voisine mais elle était pas très contente depuis hier soir".split(),
    "hindi": "हम लोग कल जाकर पानी देखने वाले हैं बहुत महँगा बाज़ार नया रास्ता किताब दुकान".split(),
}
NAMES = ["Rohimpur", "Kutubganj", "Shonatola", "Nodihat"]


def sentence(rng, language, n=9):
    words = rng.choices(WORDS[language], k=n)
    words[rng.randrange(n)] = rng.choice(NAMES)
    return " ".join(words)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(1)
    texts = [(sentence(rng, x) + ".", x) for x in L.LANGUAGES for _ in range(60)]
    return L.train(texts)


def test_gradients():
    net = L.Network.new(L.LANGUAGES)
    ids, mask = L.batch([b"ami", "আমি".encode(), b"x"])
    target = np.eye(5, dtype=np.float32)[[1, 0, 2]]
    weight = np.array([1, 2, 0.5], np.float32)
    g, _ = net.gradients(ids, mask, target, weight)
    for k, w in net.w.items():
        at, o, e = np.unravel_index(np.abs(g[k]).argmax(), w.shape), None, 1e-2
        o = w[at]
        w[at] = o + e
        up = net.gradients(ids, mask, target, weight)[1]
        w[at] = o - e
        down = net.gradients(ids, mask, target, weight)[1]
        w[at] = o
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3


def test_reading_is_the_network(network):
    words = ["ami", "আমি", "a", "b" * 300, "très"]
    slow = []
    for w in words[:3] + words[4:]:
        ids, mask = L.batch([w.encode()])
        slow.append(network.positions(ids, mask)[0].mean(axis=0)[0])
    fast = network.words(words)
    assert np.abs(np.maximum(slow, L.FLOOR) - fast[[0, 1, 2, 4]]).max() < 1e-4


def test_held_out_accuracy(spark, network):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        some = sorted(rng.sample(L.LANGUAGES, rng.choice((1, 1, 2, 3))))
        parts = [sentence(rng, x) for x in some]
        rng.shuffle(parts)
        form = i % 4
        text = ". ".join(parts) + "." if form == 0 else "\n".join(parts) if form == 1 else " | ".join(f"{k}: {v}" for k, v in zip(("bn", "en", "bl"), parts)) if form == 2 else "! ".join(parts)
        rows.append((i, text, some))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "rid int, text string")
    got = {r.rid: r for r in L.languages_of(df, "rid", "text", network).collect()}
    right = sum(got[i].languages == some for i, _, some in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 < s.confidence <= 1 for r in got.values() for s in r.segments)


def test_change_without_punctuation(spark, network):
    rng = random.Random(3)
    text = sentence(rng, "bangla", 12) + " " + sentence(rng, "english", 12)
    one = sentence(rng, "english", 12) + " bazar " + sentence(rng, "english", 5)
    df = spark.createDataFrame([(1, text), (2, one), (3, "ＴＨＥ　ｍаrket people said that we will go")], "rid int, text string")
    got = {r.rid: r.languages for r in L.languages_of(df, "rid", "text", network).collect()}
    assert got == {1: ["bangla", "english"], 2: ["english"], 3: ["english"]}


def test_mislabelled(spark, network):
    rng = random.Random(4)
    e, b, f = sentence(rng, "english"), sentence(rng, "bangla"), sentence(rng, "french")
    rows = [(1, e, "english"), (2, e, " ENGLISH "), (3, e, "bangla"), (4, e, None), (5, e, "unknown"), (6, f"{e}. {b}", "code-mixed"), (7, f"{e}. {b}", "english"), (8, f, "english"), (9, None, None), (10, "!? 12", "x"), (11, "", None), (12, e, "code-mixed")]
    got = sorted(map(tuple, L.mislabelled(spark.createDataFrame(rows, "rid int, text string, bucket string"), "rid", "text", "bucket", network).collect()))
    assert got == [(3, "english"), (4, "english"), (5, "english"), (7, "bangla"), (7, "english"), (8, "french"), (12, "english")]


def test_defined_for_odd_tables(spark, network):
    schema = "rid int, text string, bucket string, k int, t string, key string"
    assert L.mislabelled(spark.createDataFrame([], schema), "rid", "text", "bucket", network).count() == 0
    rng = random.Random(5)
    long = ". ".join(sentence(rng, "banglish") for _ in range(3000))
    df = spark.createDataFrame([(1, long, "x", 1, "y", "z")] * 2, schema)
    assert [r.lang for r in L.mislabelled(df, "rid", "text", "bucket", network).collect()] == ["banglish"] * 2
    assert L.languages_of(df, "rid", "text", network).first().lang == "banglish"


def test_fit_ignores_wrong_labels(spark):
    rng = random.Random(6)
    rows = [(sentence(rng, x) + ".", x) for x in L.LANGUAGES for _ in range(40)] + [(sentence(rng, "bangla"), "english")] * 2 + [(None, "french"), ("x", "other")]
    net = L.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    ok = net.words(["আমি", "the", "hier"]).argmax(axis=1)
    assert [net.languages[i] for i in ok] == ["bangla", "english", "french"]


def test_a_session_fits_once(spark, monkeypatch):
    rows = [("আমি ভাত খাই", "bangla"), ("ami bhat khai", "banglish"), ("we eat rice", "english")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    number = []
    real = L.train
    monkeypatch.setattr(L, "train", lambda *a, **k: number.append(1) or real(*a, **{**k, "steps": 20}))
    first = L.fit(df, "text", "lang", seed=5)
    fits = len(number)
    again = L.fit(df.repartition(3), "text", "lang", seed=5)
    assert fits and len(number) == fits and all((first.w[k] == again.w[k]).all() for k in first.w)
    L.fit(df, "text", "lang", seed=6)
    assert len(number) > fits
