import numpy as np
import pytest

from corpusloom.llm import mixing as M

SCHEMA, MIX = "doc_id bigint, source string, n_tokens bigint", "source string, target_share double, max_repeats int"


def test_pivot_keeps_tokens_and_expectations():
    sizes, parts = np.array([5.0, 3, 8, 1, 9, 2]), np.array([0.3, 0.9, 0.5, 0.0, 0.25, 1.0])
    total = np.zeros(6)
    for i in range(4000):
        made, left = M.pivot(list("fabced"), sizes, parts, str(i))
        assert abs((made * sizes).sum() - (parts * sizes).sum()) < 1e-6
        assert all(x in (0, 1) for j, x in enumerate(made) if j != left)
        total += made
    assert np.abs(total / 4000 - parts).max() < 0.03
    assert (M.pivot(list("abc"), sizes[:3], parts[:3], "x")[0] == M.pivot(list("abc"), sizes[:3], parts[:3], "x")[0]).all()


def data(spark, n=6000):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 == 0 else ["a", "b", None, "other"][i % 4], int(rng.integers(0, 200))) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bucket, fan", [(4_000, 256), (40, 3)])
def test_shares_and_caps(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "FAN", fan)
    rows, df = data(spark)
    mixture = spark.createDataFrame([("hot", 0.2, 1), ("a", 0.5, 3), ("b", 0.3, 4)], MIX)
    got = M.mix(df, "doc_id", "source", "n_tokens", mixture).collect()
    assert sorted(r.doc_id for r in got) == [i for i, s, _ in rows if s in ("hot", "a", "b")]
    assert max(r.uses for r in got if r.source == "a") <= 3 and max(r.uses for r in got if r.source == "hot") <= 1
    assert all(r.uses == 0 for r in got if r.n_tokens == 0)
    whole = sum(r.uses * r.n_tokens for r in got)
    for s, part in (("hot", 0.2), ("a", 0.5), ("b", 0.3)):
        # the last record of a source is whole or not: no source misses by more than one
        assert abs(sum(r.uses * r.n_tokens for r in got if r.source == s) - part * whole) <= 2 * 200
    a = sum(r.n_tokens for r in got if r.source == "a")
    assert abs(whole - min(3 * a / 0.5, 4 * sum(r.n_tokens for r in got if r.source == "b") / 0.3, sum(r.n_tokens for r in got if r.source == "hot") / 0.2)) <= 600
    again = M.mix(df.repartition(7), "doc_id", "source", "n_tokens", mixture).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_report_and_total(spark):
    _, df = data(spark, 2000)
    mixture = spark.createDataFrame([("hot", 0.5, 2), ("a", 0.5, 2), ("absent", 0.25, 1)], MIX)
    made = M.mix(df, "doc_id", "source", "n_tokens", mixture, total=10_000)
    assert abs(sum(r.uses * r.n_tokens for r in made.collect()) - 10_000) <= 400
    shares = {r.source: r for r in M.reached(made, "source", mixture).collect()}
    assert shares["absent"].reached_share == 0 and abs(shares["hot"].reached_share - 0.5) < 0.03


def test_defined_for_odd_tables(spark):
    mixture = spark.createDataFrame([("a", 1.0, 2)], MIX)
    assert M.mix(spark.createDataFrame([], SCHEMA), "doc_id", "source", "n_tokens", mixture).count() == 0
    one = spark.createDataFrame([(1, "a", 5, "x", 2), (2, "a", None, "x", 2), (3, None, 5, "x", 2)], SCHEMA + ", k string, p int")
    assert {(r.doc_id, r.uses) for r in M.mix(one, "doc_id", "source", "n_tokens", mixture).collect()} == {(1, 2), (2, 0)}
    with pytest.raises(ValueError):
        M.mix(one, "doc_id", "source", "n_tokens", mixture.unionByName(mixture))


def test_public_counts_are_the_tokenizers(spark):
    import tiktoken

    path = f"{M.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    texts = ["hello world", "  two  blanks ", "a\n\nb", "আমি ভালো আছি", None, "", "it's 12 o'clock…", "x y" * 3000, "a\tb c", "tail \nline", "e e"]
    got = M.public_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", path).collect()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    assert [r.n_tokens for r in got] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
