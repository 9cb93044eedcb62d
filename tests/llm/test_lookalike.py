import pyarrow as pa
import pytest

from corpusloom.llm import lookalike as L

SCHEMA = "field_name string, key string, text string"


def same(a, b):
    x = L.look(pa.array([a, b]))[0].to_pylist()
    return x[0] == x[1]


@pytest.mark.parametrize(
    "a, b",
    [("ｆｕｌｌ　１２，", "full 12,"), ("café", "café"), ("a​b­﻿", "ab"), ("a b c", "a b c"), ("сосоа", "cocoa"), ("ো", "ো"), ("য়", "য়"), ("অাম", "আম"), ("ΑΒΕ", "ABE"), ("ক‍খ", "কখ")],
)
def test_same_look(a, b):
    assert same(a, b)


@pytest.mark.parametrize("a, b", [("Ab", "ab"), ("a.", "a"), ("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("ক্‍খ", "ক্খ"), ("ক‌্খ", "ক্খ"), ("ক্‍খ", "ক্‌খ"), ("é", "e")])
def test_other_look(a, b):
    assert not same(a, b)


def test_pairs_against_all(spark):
    base = ["the cat", "the  cat", "তুমি", "café", "Café", "no letters 1", "ক্ষ"]
    variants = [base, [b.replace("a", "а") for b in base], [b + "​" for b in base], base, ["12", "12​", None, "", " ", "—"]]
    rows = [("f" if i % 3 else "g", f"{i}-{j}", t) for i, v in enumerate(variants) for j, t in enumerate(v)] + [("f", "long", "x" * 300_000), ("f", "long2", "x" * 300_000 + "⁠")]
    got = {tuple(r) for r in L.same_look_pairs(spark.createDataFrame(rows, SCHEMA), "field_name", "key", "text").collect()}
    looks = dict(zip([r[1] for r in rows], L.look(pa.array([r[2] for r in rows]))[0].to_pylist()))
    want = {(f, a, b) for f, a, x in rows for g, b, y in rows if f == g and a < b and x and y and x != y and looks[a] == looks[b] and any(c.isalpha() for c in x)}
    assert got == want and ("f", "long", "long2") in got


def test_defined_for_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.same_look_pairs(empty, "field_name", "key", "text").count() == 0
    clash = spark.createDataFrame([("f", "1", "a​", "x", "y"), ("f", "2", "a", "x", "y")], "field_name string, key string, text string, look string, F string")
    assert [tuple(r) for r in L.same_look_pairs(clash, "field_name", "key", "text").collect()] == [("f", "1", "2")]
    made = L.consistent(clash, ["field_name", "key"], "text").collect()
    assert [r.look for r in made] == ["a", "a"]
    nulls = L.consistent(spark.createDataFrame([(None, None, None)], SCHEMA), ["field_name", "key"], "text").first()
    assert nulls.look is None and not nulls.has_letter


def test_forms_keep_their_script():
    texts = ["Това е напълно ясно", "pаypal и още", "раураl", "ёлка ёж", "Ελλάδα ατα", "сор", None, "", "pay ｐal", "Њу a"]
    got = L.form(pa.array(texts)).to_pylist()
    assert got[0] == texts[0] and got[1] == "paypal и още" and got[2] == "paypal" and got[3] == "ёлка ёж" and got[4] == texts[4]
    # letters that all look Latin, in a text without any other of their script, can't be told from Latin ones
    assert got[5] == "cop" and got[6] is None and got[7] == "" and got[8] == "pay pal" and got[9] == "Њу a"


def test_many_copies_in_two_spellings_are_linear(spark):
    rows = spark.range(100_000).selectExpr("'x' as f", "cast(id as string) as k", "if(id % 2 = 0, 'pay pal', 'pаy pal') as t").unionByName(spark.createDataFrame([("x", "a", "other"), ("x", "b", "other"), ("x", "c", None)], "f string, k string, t string"))
    classes, members = L.look_classes(rows, "f", "k", "t")
    assert [(r.field_name, r.first_key, r.spellings, r.texts) for r in classes.collect()] == [("x", "0", 2, 100_000)]
    assert members.count() == 100_000 and members.select("spelling").distinct().count() == 2
