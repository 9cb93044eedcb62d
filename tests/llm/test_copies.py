import random
import unicodedata
from collections import Counter

import pyarrow as pa

from corpusloom.llm import copies as C
from corpusloom.runtime import Scratch

SCHEMA = "rid bigint, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def pairs(spark, texts):
    return {(r.rid_a, r.rid_b) for r in C.copy_pairs(frame(spark, texts), "rid", "text").collect()}


def test_forms(spark):
    texts = [
        "Café, one two", "CAFÉ one-two!", "café onetwo​", "cafe one two", "ｃafé one two", None, "", "  ", "!?", "5", "৫",
        '{"bn": "আমি", "en": "I am"}', "en: I am | bn: আমি", "EN=i am; BN=আমি।", "bn: আমি\nen: I, am", '{"en":"I \\u0061m","bn":"\\u0986\\u09ae\\u09bf"}', "en: আমি | bn: I am", "আমি I am", "title: I am | bn: আমি",
    ]
    assert pairs(spark, texts) == {(0, 1), (0, 2), (11, 12), (11, 13), (11, 14), (11, 15)}


def test_invariants_hold_for_copies():
    rng = random.Random(1)
    words = ["tumi", "আমি", "কোথায়", "élan", "Straße", "ΣΟΦΟΣ", "12", "ড়", "한국"]
    for _ in range(300):
        parts = rng.choices(words, k=5)
        a = " ".join(parts)
        b = unicodedata.normalize(rng.choice(["NFC", "NFD"]), rng.choice([", ", "", "  -"]).join(parts)).swapcase()
        if C.exact_key(a) == C.exact_key(b):
            n, h = C.invariants(pa.array([a, b]))
            assert n[0] == n[1] and h[0] == h[1]
    assert C.exact_key("ΣΟΦΟΣ") == C.exact_key("σοφος") == C.exact_key("σοφοσ")


def test_same_histogram_is_no_copy(spark):
    assert pairs(spark, ["abc def", "def abc", "fed cba", "abcdef"]) == {(0, 3)}


def test_hot_class_and_brute_force(spark):
    rng = random.Random(2)
    texts = ["same text"] * 100 + ["".join(rng.choices("ab ,", k=6)) for _ in range(200)]
    rng.shuffle(texts)
    keys = [C.exact_key(t) for t in texts]
    first = {}
    want = {(first.setdefault(k, i), i) for i, k in enumerate(keys) if k and first.setdefault(k, i) != i}
    assert pairs(spark, texts) == want
    got = {r.rid: r.n_copies for r in C.collapse(frame(spark, texts), "rid", "text").collect()}
    assert sum(got.values()) == 300 and set(got) == {i for i, k in enumerate(keys) if not k or first[k] == i}


def test_defined_for_odd_tables(spark):
    assert pairs(spark, []) == set()
    long = "word " * 100_000
    clash = spark.createDataFrame([(1, long, 0, "x", "y"), (2, long.upper(), 0, "x", "y")], "rid bigint, text string, k int, n string, class string")
    assert [tuple(r) for r in C.copy_pairs(clash, "rid", "text").collect()] == [(1, 2)]


def test_a_crowded_filter_only_costs_work(spark):
    """With a filter far too small every text may pass; the pairs are the same."""
    rng = random.Random(5)
    rows = [(i, rng.choice(("A b", "a-b!", "", None, "x")) if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "rid bigint, text string")
    classes = lambda most: {r.k: bytes(r["class"]) for r in C.copy_classes(df, "rid", "text", Scratch(spark, "t"), most=most).collect()}
    wide, narrow = classes(C.FILTER), classes(1 << 10)
    assert wide.items() <= narrow.items() and len(wide) < len(narrow)
    number = Counter(narrow.values())
    assert {k for k, c in wide.items() if number[c] > 1} == {k for k, c in narrow.items() if number[c] > 1} == {i for i, t in rows if t in ("A b", "a-b!", "x")}


def test_any_names_in_json(spark):
    rows = [(1, '{"name": "Ami", "city": "Dhaka"}'), (2, '{ "city":"dhaka", "name" : "ami" }'), (3, '{"name": "Dhaka", "city": "Ami"}'), (4, '{"n": 1}'), (5, "{"), (6, '{"a": ["x"]}')]
    assert [tuple(r) for r in C.copy_pairs(spark.createDataFrame(rows, "rid bigint, text string"), "rid", "text").collect()] == [(1, 2)]
