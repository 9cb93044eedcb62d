import random
from functools import lru_cache

import pytest

from corpusloom.llm import tokenbudget as B

SCORE = {"a": -2.0, "b": -2.0, "ab": -2.5, "abc": -6.0, "bc": -2.2, "c": -9.0, "é": -3.0, "cab": -3.0}
SCHEMA = "rid bigint, text string, source string, bucket string"


def best(word):
    """All segmentations, by recursion: the best score and its tokens."""

    @lru_cache(None)
    def go(i):
        if i == len(word):
            return 0.0, 0
        size = len(word[i].encode())
        s, n = go(i + 1)
        found = [(s + B.BYTE * size, n + size)]
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in SCORE:
                s, n = go(j)
                found.append((s + SCORE[word[i:j]], n + 1))
        return max(found, key=lambda x: x[0])

    return go(0)[1]


def merged(word):
    """Merging by repeated search of the whole word, without queue or list."""
    symbols = list(word)
    while True:
        found = [(-SCORE[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in SCORE]
        if not found:
            return sum(1 if s in SCORE else len(s.encode()) for s in symbols)
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        w = "".join(rng.choices("abcéx☃", k=rng.randint(1, 9)))
        assert B.likeliest(w, SCORE, 3) == best(w)
        assert B.surviving(w, SCORE) == merged(w)


def test_public_tokenizer(spark):
    import base64

    import tiktoken

    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    rng = random.Random(2)
    texts = ["", None, "hello  world it's", "আমি ভালো\nআছি ১২", "x" * 500, " tail "] + ["".join(rng.choices("abe thing  আমিো é1!", k=40)) for _ in range(60)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    got = B.count_public(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", path).orderBy("i").collect()
    assert [r.n_tokens for r in got] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def test_texts(spark):
    rows = [(1, "ab  c\nab", "S: 1", "x"), (2, None, None, None), (3, "", "s", " ?"), (4, "é", "s:2", "X "), (5, "ab " * 50_000, "s", "x"), (5, "☃", "t", "x")]
    df = spark.createDataFrame([(*r, "y", 3) for r in rows], SCHEMA + ", domain string, n_tokens int")
    sources = spark.createDataFrame([("s", "d", 1), ("s", "e", 1), ("u", None, 1)], "source string, domain string, text int")
    pieces = spark.createDataFrame(list(SCORE.items()) + [("a", -5.0), ("", -1.0), ("z", None)], "piece string, score double")
    got = B.record_tokens(df, sources, pieces)
    want = {(1, "s", "x", "d", 5), (2, None, None, None, 0), (3, "s", None, "d", 0), (4, "s", "x", "d", 1), (5, "s", "x", "d", 99_999), (5, "t", "x", None, 3)}
    assert {(r.rid, r.source, r.bucket, r.domain, r.n_tokens) for r in got.collect()} == want
    totals = {(r.level, r.source, r.bucket, r.domain): (r.records, r.n_tokens) for r in B.budget(got).collect()}
    assert totals["all", None, None, None] == (6, 100_008) and totals["source", "s", None, None] == (4, 100_005)
    assert totals["slice", "s", "x", "d"] == (3, 100_005) and totals["domain", None, None, None] == (2, 3)


def test_defined_for_odd_tables(spark):
    pieces = spark.createDataFrame([], "piece string, score double")
    empty = spark.createDataFrame([], SCHEMA)
    sources = spark.createDataFrame([], "source string, domain string")
    assert B.record_tokens(empty, sources, pieces).count() == 0
    one = spark.createDataFrame([(1, "ab é", None, None)], SCHEMA)
    assert B.record_tokens(one, sources, pieces).first().n_tokens == 5
    with pytest.raises(ValueError):
        B.count_tokens(one, "text", SCORE, "other")
    assert B.count_tokens(one, "text", SCORE, "merges").first().n_tokens == 3
