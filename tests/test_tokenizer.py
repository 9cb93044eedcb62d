import random

import pytest

from corpusloom.functions import tokenizer as K
from corpusloom.operators import tokenizers as O

UNIGRAM = [("আমি", -1), ("ভালো", -2), ("ami", -1), ("bhalo", -2), ("a", -1), ("ab", -2), ("bc", -0.1), ("c", -10)]
BPE = ([("a", 0), ("b", 0), ("c", 0), ("bc", 0), ("ab", 0)], [(1, 2, 3), (0, 1, 4)])
COUNTS = [("ami", 30.25), ("amra", 20.5), ("bhalo", 30.0), ("valo", 10.125), ("hello", 10.0), ("আমি", 30.0), ("ভালো", 20.0), ("aaaa", 7.75), ("abab", 7.75)]
TEXTS = ["", "ami bhalo", "আমি\tভালো\n", "a‍b ‌", "x y", "é e", "１２", "<unk> ▁ <0x20>", "🙂 a", "abab  abab"]


def counts(spark, rows):
    return spark.createDataFrame(rows, "word string, weight double")


def test_viterbi_and_ties():
    assert K.Model("unigram", UNIGRAM).encode("abc") == [264, 266]
    assert K.Model("unigram", [("a", -30), ("b", -1), ("ab", -31)]).encode("a ab 🙂") == [101, 36, 262, 36, 244, 163, 157, 134]


def test_bpe_ranks_and_checks():
    assert K.Model("bpe", *BPE).encode("abc") == [260, 263]
    with pytest.raises(ValueError, match="unreachable"):
        K.Model("bpe", [*BPE[0], ("abc", 0)], BPE[1])
    for pieces in ([("a", 1.0)], [("a", float("nan"))], [("a", 0), ("a", 0)], [("", 0)]):
        with pytest.raises(ValueError):
            K.Model("unigram", pieces)


def test_fusion():
    m = K.Model("bpe", [("a", 0), ("b", 0), ("ab", 0)], [(0, 1, 2)], [262, 244], version=2)
    assert m.vocab_size == 265 and m.encode("abab abab") == [262, 262, 263, 262]
    assert m.expand([262, 263]) == [262, 36, 262]
    for ids in ([264], [265], [-1], [0]):
        with pytest.raises(ValueError):
            m.decode(ids)
    for fusion in ([36], [262, 262], [3], [265]):
        with pytest.raises(ValueError):
            K.Model("bpe", [("a", 0), ("b", 0), ("ab", 0)], [(0, 1, 2)], fusion, version=2)


@pytest.mark.parametrize("model", [K.Model("unigram", UNIGRAM), K.Model("bpe", *BPE), K.Model("bpe", *BPE, [260, 97 + 4], version=2)])
def test_round_trips(model):
    for t in TEXTS:
        assert model.decode(model.encode(t)) == K.normalize(t)
    with pytest.raises(TypeError):
        model.encode(b"x")
    with pytest.raises(TypeError):
        model.encode_batch("x")
    with pytest.raises(TypeError):
        model.decode([True])


def test_saved_model_is_equal(tmp_path):
    m = K.Model("bpe", *BPE, [260], ["abc"], 2)
    m.save(str(tmp_path / "m"))
    assert K.Model.load(str(tmp_path / "m")).__dict__ == m.__dict__


def test_long_repeated_word_is_quick():
    m = K.Model("bpe", [("a", 0), ("aa", 0), ("aaaa", 0)], [(0, 0, 1), (1, 1, 2)])
    assert m.encode("a" * 100_001) == [262] * 25_000 + [260]


def test_posterior_sampling():
    import math

    m = K.Model("unigram", [("a", math.log(0.5)), ("aa", math.log(0.5))])
    rng = random.Random(1)
    one = sum(len(m.sample("aa", 1.0, rng)) == 1 for _ in range(3000)) / 3000
    assert abs(one - 2 / 3) < 0.04


def test_unigram_training(spark):
    model = O.train_unigram(counts(spark, COUNTS), 284, 310, 6, 3)
    assert len(model.pieces) == 24 and model.vocab_size == 284
    assert {c for w, _ in COUNTS for c in w} <= set(model.index)
    assert all(model.decode(model.encode(w)) == w for w, _ in COUNTS)


def test_training_leaves_fallback_out(spark):
    words = counts(spark, [("আমি", 2.5)])
    uses, loss = O._expected(words, [("আমি", -1000.0)])
    assert uses == [2.5] and loss == 2500


@pytest.mark.parametrize("rows", [[("a b", 1.0)], [("", 1.0)], [("a", 0.0)], [("a", float("inf"))], [("e\u0301", 1.0)], [], [(None, 1.0)]])
def test_training_refuses(spark, rows):
    with pytest.raises(ValueError):
        O.training_input(counts(spark, rows))


def test_bpe_training(spark):
    rows = [("low", 5.0), ("lower", 2.0), ("newest", 6.0), ("widest", 3.0)]
    model = O.train_bpe(counts(spark, rows), 280, 12)
    assert model.vocab_size == 280 and all(model.decode(model.encode(w)) == w for w, _ in rows)
    assert model.pieces[model.merges[0][2]][0] == "es"
    with pytest.raises(ValueError, match="no pair is left"):
        O.train_bpe(counts(spark, rows), 400, 12)


def test_bpe_training_against_recount(spark):
    """Each merge is the heaviest pair of a recount from scratch, ties by the earlier pieces."""
    from collections import Counter

    model = O.train_bpe(counts(spark, COUNTS), 290, 6)
    texts = sorted({c for w, _ in COUNTS for c in w})
    words, done = [([texts.index(c) for c in w], x) for w, x in COUNTS], set()
    for a, b, to in model.merges:
        total = Counter()
        for ids, x in words:
            for p in zip(ids, ids[1:]):
                total[p] += x
        while True:
            best = min((-x, p) for p, x in total.items() if p not in done and x > 0)[1]
            done.add(best)
            if len(texts[best[0]] + texts[best[1]]) <= 6:
                break
        assert best == (a, b)
        if texts[a] + texts[b] not in texts:
            texts.append(texts[a] + texts[b])
        new = []
        for ids, x in words:
            out, i = [], 0
            while i < len(ids):
                pair = ids[i : i + 2] == [a, b]
                out.append(to if pair else ids[i])
                i += 1 + pair
            new.append((out, x))
        words = new


def test_metrics(spark):
    m = K.Model("bpe", [("a", 0)], [], [244], version=2)
    row = O.metrics(spark.createDataFrame([("x", "a 🙂"), ("x", None)], "bucket string, text string"), "bucket", "text", m).first()
    # the blank and the first byte of the sign are one id
    assert (row.tokens, row.space_tokens, row.fallback_tokens, row.fertility, row.fallback_rate, row.used_ids) == (5, 1, 4, 2.5, 0.8, 5)


def test_columns(spark):
    m = K.Model("bpe", *BPE, [260], version=2)
    df = spark.createDataFrame([(1, "abc a"), (2, None)], "k int, t string").withColumn("ids", K.encoder(m)("t"))
    got = df.select("ids", K.expanded("ids", m).alias("base"), K.truncated("ids", 3).alias("cut"), K.padded("ids", 5).alias("wide"), K.decoder(m)("ids").alias("back")).collect()
    assert got[0].ids == m.encode("abc a") and got[0].base == m.expand(got[0].ids) and got[0].back == "abc a"
    assert got[0].cut == [2, got[0].ids[0], 3] and len(got[0].wide) == 5 and got[1].ids is None


def test_fingerprint_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(50)], "k int, ids array<int>")
    assert O.fingerprint(df, "k", "ids").collect() == O.fingerprint(df.repartition(7), "k", "ids").collect()
    assert O.fingerprint(df, "k", "ids").collect() != O.fingerprint(df.where("k > 0"), "k", "ids").collect()


def test_registered_training_reads_train_records(spark, monkeypatch):
    """Every word that only train records have is trained on, none that only held-out ones have, at production sizes."""
    from pyspark.sql import functions as F

    from corpusloom.functions import text as T
    from corpusloom.plans import corpus, tokenizer

    sf, seen = "/root/testdata/sf0.001", []
    for name in ("train_unigram", "train_bpe"):
        monkeypatch.setattr(O, name, lambda counts, *sizes: seen.append((counts, sizes)) or K.Model("bpe", *BPE))
    tokenizer.tok_train_unigram(spark, sf), tokenizer.tok_train_bpe(spark, sf)
    assert [sizes for _, sizes in seen] == [(32_000, 64_000, 12), (32_000, 12)]
    rows = corpus.prepared(spark, sf).where(F.col("bucket").isin(list(tokenizer.MIXTURE)))
    want = {r.w for r in rows.where("split = 'train'").select(F.explode(T.words("text")).alias("w")).distinct().collect() if len(r.w) <= 64}
    for counts, _ in seen:
        got = {r.word: r.weight for r in counts.collect()}
        assert set(got) == want and len(want) > 100 and 0.99e6 < sum(got.values()) <= 1e6 + 1


def test_batches_equal_single_texts():
    """Lattices and gathers give what one text after the other gives, for any blanks, nulls and models."""
    import pyarrow as pa

    rng = random.Random(9)
    letters = "abcআমিé🙂"
    made = ["".join(rng.choices(letters, k=rng.randint(1, 70 if rng.random() < 0.1 else 9))) for _ in range(300)]
    pieces = sorted({w[i : i + n] for w in made[:60] for i in range(len(w)) for n in (1, 2, 3)} - {"🙂"})
    unigram = K.Model("unigram", [(p, -float(rng.randint(1, 6))) for p in pieces])
    chars = [p for p in pieces if len(p) == 1]
    pairs = [p for p in pieces if len(p) == 2 and set(p) <= set(chars)]
    bpe = K.Model("bpe", [(p, 0.0) for p in chars + pairs], [(chars.index(p[0]), chars.index(p[1]), len(chars) + i) for i, p in enumerate(pairs)])
    fused = K.Model("bpe", bpe.pieces, bpe.merges, [K.PIECES, K.PIECES + len(chars), K.BYTES + 0xF0], version=2)
    blanks = [" ", "  ", "\n", " ", "\x1c", "　 "]
    texts = [None, "", " ", "é a"] + ["".join(w + rng.choice(blanks) for w in rng.choices(made, k=rng.randint(0, 12))) for _ in range(200)]
    for model in (unigram, bpe, fused):
        column = pa.array(texts, pa.string())
        ids = K.encode_batch(model, column)
        fresh = K.Model(model.algorithm, model.pieces, model.merges, model.space_fusion, version=model.version)
        fresh.learn = lambda words: None
        assert ids.to_pylist() == [None if t is None else fresh.encode(t) for t in texts]
        assert K.decode_batch(model, ids).to_pylist() == [None if t is None else K.normalize(t) for t in texts]
        assert K.encode_batch(model, column[5:9]).to_pylist() == ids.to_pylist()[5:9]
    for wrong in ([[K.BYTES + 0xE0]], [[1]], [[10**6]]):
        with pytest.raises(ValueError):
            K.decode_batch(unigram, pa.array(wrong, pa.list_(pa.int32())))


def test_expected_uses_against_all_segmentations():
    import numpy as np

    from corpusloom.functions import lattice as L

    pieces = {"a": -1.0, "b": -1.5, "ab": -1.2, "ba": -2.0, "aba": -3.0}
    names = list(pieces)
    lattice = L.Lattice(names, list(pieces.values()))

    def ways(w):
        return [[]] if not w else [[p, *rest] for p in names if w.startswith(p) for rest in ways(w[len(p) :])]

    words, weights = ["abab", "baba", "aaab", "abac"], np.array([2.0, 1.0, 0.5, 9.0])
    uses, loss = lattice.expected(L.code_points(words, 4), weights)
    want, lost = dict.fromkeys(names, 0.0), 0.0
    for w, x in zip(words, weights):
        parts = [(way, np.exp(sum(pieces[p] for p in way))) for way in ways(w)]
        total = sum(p for _, p in parts)
        if total:
            lost -= x * np.log(total)
        for way, p in parts:
            for piece in way:
                want[piece] += x * p / total
    assert np.allclose(uses, [want[p] for p in names]) and np.isclose(loss, lost)


def test_bpe_rounds_equal_one_merge_after_the_other(spark):
    """Several merges a round give the merges of a heap of one at a time, for weights with and without ties."""
    from collections import Counter

    rng = random.Random(12)
    for weigh in (lambda: float(rng.randint(1, 3)), rng.random):
        rows = sorted({"".join(rng.choices("abcd", (5, 3, 2, 1), k=rng.randint(1, 9))) for _ in range(60)})
        rows = [(w, weigh()) for w in rows]
        model = O.train_bpe(counts(spark, rows), K.PIECES + 60, 6)
        texts = sorted({c for w, _ in rows for c in w})
        words, merges, done = [([texts.index(c) for c in w], x) for w, x in rows], [], set()
        while len(texts) < 60:
            total = Counter()
            for ids, x in words:
                for p in zip(ids, ids[1:]):
                    total[p] += x
            a, b = min((-round(x, 9), p) for p, x in total.items() if p not in done)[1]
            done.add((a, b))
            made = texts[a] + texts[b]
            if len(made) > 6:
                continue
            if made not in texts:
                texts.append(made)
            merges.append((a, b, texts.index(made)))
            new = []
            for ids, x in words:
                out, i = [], 0
                while i < len(ids):
                    pair = ids[i : i + 2] == [a, b]
                    out.append(texts.index(made) if pair else ids[i])
                    i += 1 + pair
                new.append((out, x))
            words = new
        assert [tuple(m) for m in model.merges] == merges


def test_bpe_holds_words_in_few_bytes(spark):
    import tracemalloc

    counts = spark.range(20_000).selectExpr("concat('w', sha2(cast(id as string), 256)) as word", "cast(1 + id % 7 as double) as weight")
    tracemalloc.start()
    O.train_bpe(counts, K.PIECES + 30, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000 * 65 * 30  # bytes a symbol
