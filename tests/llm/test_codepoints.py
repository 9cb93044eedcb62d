import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import codepoints as cp
from corpusloom.llm.lookalike import look

texts = st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)), max_size=8)


def nulls(a):
    return a.is_null().to_numpy(zero_copy_only=False)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_decode_encode(rows):
    a = pa.array(rows, pa.string())
    assert cp.encode(*cp.decode(a), nulls(a)).to_pylist() == rows
    if len(rows) > 1:
        assert cp.encode(*cp.decode(a.slice(1)), nulls(a.slice(1))).to_pylist() == rows[1:]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_normal_forms(rows):
    rows = [r or "" for r in rows]
    cps, offsets = cp.expand(*cp.decode(pa.array(rows, pa.string())), cp.decomposed())
    cps = cp.reorder(cps, offsets)
    assert cp.encode(cps, offsets).to_pylist() == [unicodedata.normalize("NFD", r) for r in rows]
    assert cp.encode(*cp.compose(cps, offsets)).to_pylist() == [unicodedata.normalize("NFC", r) for r in rows]


def test_normal_forms_of_marks_and_syllables():
    rng = random.Random(1)
    signs = "éêậ̣ôेািোড়য়ঢ়ো각가힣각åÅabঅ়ি̣̂̈́üǘo"
    rows = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(5000)]
    cps, offsets = cp.expand(*cp.decode(pa.array(rows)), cp.decomposed())
    cps = cp.reorder(cps, offsets)
    assert cp.encode(*cp.compose(cps, offsets)).to_pylist() == [unicodedata.normalize("NFC", r) for r in rows]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_look_is_idempotent(rows):
    once, _ = look(pa.array(rows, pa.string()))
    again, _ = look(once)
    assert once.to_pylist() == again.to_pylist()
