"""Benchmarks of intents, frozen decisions, guards, audits of failures and pools, anchored vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import benchmark as B
from corpusloom.operators import corpus as C
from corpusloom.operators import retrieval as V
from corpusloom.operators import statistics as S

MATERIAL = "id string, domain string, source_id string, source_group string, split string, en string, bn string, bl string, q_en string, q_bn string, q_bl string, q_bl_variants array<string>, author_origin string"


def intent(n, split="development", **other):
    row = dict(id=f"i{n}", domain="law", source_id=f"s{n}", source_group=f"g{n}", split=split, en=f"text number {n}", bn=f"লেখা নম্বর {n}", bl=f"lekha nombor {n}", q_en=f"which {n}", q_bn=f"কোনটা {n}", q_bl=f"konta {n}", q_bl_variants=[f"kon ta aage {n}"], author_origin="agent")
    return tuple((row | other).values())


def material(spark, *rows):
    return spark.createDataFrame(list(rows), MATERIAL)


def problems(df):
    return {(r.problem, r.what) for r in df.collect()}


def test_material(spark):
    good = material(spark, intent(1), intent(2, "test"))
    assert problems(B.material_problems(good)) == set()
    bad = material(spark, intent(1), intent(1), intent(2, "train"), intent(3, bn=" "), intent(4, q_en="Text, number 1"), intent(5, bl="lekha ক"), intent(6, source_group="g1", split="test"), intent(7, q_bl_variants=[]), intent(8, author_origin="human"), intent(9, domain="trade"))
    found = problems(B.material_problems(bad, domains=("law", "health")))
    assert found == {
        ("duplicate id", "i1"), ("unknown split", "i2"), ("empty text", "i3"), ("shared text", "textnumber1"), ("not banglish", "i5"), ("source group in both splits", "g1"), ("no variants", "i7"),
        ("other author", "i8"), ("domain without split", "trade"), ("unknown domain", "trade"), ("missing domain", "health"),
    }
    with pytest.raises(ValueError, match="missing domain"):
        B.require_material(good, domains=("law", "health"))
    assert problems(B.material_problems(good.limit(0))) == set()


def test_sources(spark):
    m = material(spark, intent(1), intent(2, "test"), intent(3))
    sources = spark.createDataFrame([("s1", "u"), ("s2", "u")], "source_id string, url string")
    assert problems(B.source_problems(m, sources)) == {("unknown source", "s3"), ("source in both splits", "u")}


def test_build(spark):
    documents, queries, qrels = B.build(material(spark, intent(1), intent(2), intent(3, "test")))
    assert documents.count() == 9 and queries.count() == 12
    made = qrels.collect()
    # development: two intents with 4 queries each, three directions by document language, two documents
    assert len([r for r in made if r.split == "development"]) == 2 * 4 * 3 * 2 and len([r for r in made if r.split == "test"]) == 4 * 3
    assert all((r.grade == 2) == (r.query_id.split(":")[0] == r.document_id) for r in made)
    with pytest.raises(ValueError, match="no positive"):
        B.build(material(spark, intent(1), intent(2, "test")), spark.createDataFrame([("i1", "i1", 2)], "q string, d string, grade int"))


def test_freeze(tmp_path):
    path = str(tmp_path / "d.json")
    h = B.freeze({"arm": "bpe", "frozen_before_test": True}, path)
    assert B.freeze({"arm": "bpe", "frozen_before_test": True}, path) == h
    assert B.require_frozen(path, h)["arm"] == "bpe"
    with pytest.raises(ValueError, match="differs"):
        B.freeze({"arm": "unigram"}, path)
    with pytest.raises(ValueError, match="changed"):
        B.require_frozen(path, "0" * 64)
    with pytest.raises(ValueError, match="evidence"):
        B.require_frozen(path, h, {str(tmp_path / "none"): "0"})


def scores(spark, arms=("new", "old"), queries=6):
    rows = [(a, r, d, f"q{i}", f"g{i}", "english", "law", 0.5 + 0.1 * (a == "new"), 0.4, 0.3) for a in arms for r in (1, 2) for d in ("bn-bn", "bn-en") for i in range(queries)]
    return spark.createDataFrame(rows, "arm string, run int, direction string, query_id string, group_id string, bucket string, domain string, recall_at_10 double, ndcg_at_10 double, mrr_at_10 double")


def test_confirm(spark, tmp_path):
    path = str(tmp_path / "d.json")
    h = B.freeze({"frozen_before_test": True}, path)
    split = spark.createDataFrame([(f"q{i}", "test") for i in range(6)], "query_id string, split string")
    made = B.confirm(path, h, scores(spark), split, {"new": ("old",)}, ("bn-bn", "bn-en"), repeats=40).collect()
    assert len(made) == 2 * 3 and all(abs(r.mean - (0.1 if r.metric == "recall_at_10" else 0)) < 1e-9 and r.runs == 2 for r in made)
    with pytest.raises(ValueError, match="reserved test"):
        B.confirm(path, h, scores(spark), split.where("query_id <> 'q1'"), {"new": ("old",)}, ("bn-bn", "bn-en"))
    with pytest.raises(ValueError, match="exactly the directions"):
        B.confirm(path, h, scores(spark), split, {"new": ("old",)}, ("bn-bn",))


def test_matrix(spark):
    runs = spark.createDataFrame([("a", "x", 1, "h", "h"), ("a", "x", 2, "h", "other"), ("a", "x", 2, "h", "h"), ("b", "x", 1, "h", "h")], "arm string, budget string, seed int, report_sha256 string, found_sha256 string")
    protocol = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "x", 3)], "arm string, budget string, seed int")
    assert {(r.arm, r.seed, r.problem) for r in B.matrix_problems(runs, protocol).collect()} == {("a", 3, "missing"), ("b", 1, "unknown"), ("a", 2, "twice"), ("a", 2, "changed")}


def test_split_guards(spark):
    df = spark.createDataFrame([("a b", "x", "train"), ("c", "x", " Train"), ("d", "x", "test"), ("e", "x", None)], "text string, bucket string, split string")
    assert {(r.split, r.records) for r in C.split_problems(df, ("train",)).collect()} == {("test", 1), ("", 1)}
    with pytest.raises(ValueError, match="not train"):
        C.word_counts(df, fitting=True)
    assert C.word_counts(df.limit(2), fitting=True).count() == 3
    with pytest.raises(ValueError, match="not validation or test"):
        C.require_splits(df, "validation", "test")


def test_expansion_suppresses_reserve(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    columns = "rid bigint, text string, bucket string, source string, group_id string, attribution string, split string"
    corpus = spark.createDataFrame([(1, words, "english", "web", "g1", None, "train"), (2, words + " more", "english", "web", "g1", None, "train"), (3, "something else entirely here", "english", "web", "g2", None, "train")], columns)
    forms = spark.createDataFrame([(7, "an imported form of text", "english", "forms", "f1", None, "train")], columns)
    kept = spark.createDataFrame([("m1", words.upper(), "never seen before text")], "id string, bn string, en string")
    made = {r.rid: (r.split, r.group_id) for r in C.expand(corpus, forms, kept, "id", ("bn", "en")).collect()}
    # the copy of reserved text keeps its place as the first of its key, in the test split; blockers are gone
    assert made == {1: ("test", "agent-domain:m1"), 2: ("test", "agent-domain:m1"), 3: ("train", "g2"), (1 << 56) + 7: ("train", "f1")}


def test_overlap_audit(spark):
    words = " ".join(f"w{i}" for i in range(20))
    texts = spark.createDataFrame([(1, words + " end", "nothing"), (2, "short", words)], "rid bigint, query string, document string")
    bench = spark.createDataFrame([("i1", words, "other words of it")], "id string, bn string, en string")
    made = {tuple(r) for r in C.overlap_audit({"pairs": texts}, "rid", ("text", "query", "document", "negative"), bench, "id", ("bn", "en")).collect()}
    assert made == {("pairs", "query", "1", "i1", "containment"), ("pairs", "document", "2", "i1", "containment"), ("pairs", "document", "2", "i1", "canonical")}


def test_rankings_are_checked(spark):
    queries = spark.createDataFrame([("q1", "g", "x y z", "english"), ("q2", "g", "অ আ ১", "bangla")], "id string, group_id string, text string, bucket string")
    documents = spark.createDataFrame([("d1", "first"), ("d2", "second")], "id string, text string")
    judged = spark.createDataFrame([("q1", "d1", 2), ("q2", "d1", 1)], "query_id string, document_id string, grade int")
    run = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], "query_id string, document_id string, rank int")
    audit = V.failure_audit(run, judged, queries, documents).collect()
    assert [(r.query_id, [p.id for p in r.reviewed_positives], [t.text for t in r.top_10], r.has_bengali, r.has_digit) for r in audit] == [("q2", ["d1"], ["second"], True, True)]
    bad = spark.createDataFrame([("q1", "d1", 1), ("q1", "d1", 2), ("q3", "d9", 1)], "query_id string, document_id string, rank int")
    assert {(r.query_id, r.problem) for r in V.ranking_problems(bad, queries, documents).collect()} == {("q1", "twice"), ("q3", "unknown query"), ("q2", "not ranked"), ("q3", "unknown document")}
    with pytest.raises(ValueError, match="unknown document"):
        V.score_rankings(run.unionByName(spark.createDataFrame([("q1", "d9", 2)], run.schema)), judged, queries, documents)
    views = {(r.view, r.slice, r.value, r.measure): r.x for r in V.analysis(run, judged, queries, documents).collect()}
    assert views["coverage", "all", "all", "unjudged"] == 1 and views["misses", "bucket", "bangla", "queries"] == 1 and views["exact", "all", "all", "recall_at_10"] == 1


def test_pool_needs_its_cohort(spark):
    queries = spark.createDataFrame([("q1",)], "id string")
    documents = spark.createDataFrame([(f"d{i}",) for i in range(12)], "id string")
    run = spark.createDataFrame([("q1", f"d{i}", i + 1) for i in range(10)], "query_id string, document_id string, rank int")
    known = spark.createDataFrame([("q1", "d0"), ("q1", "d1")], "query_id string, document_id string")
    assert V.expansion_pairs({"a": run, "b": run}, known, queries, documents, {"a", "b"}).count() == 8
    with pytest.raises(ValueError, match="needs the runs"):
        V.expansion_pairs({"a": run}, known, queries, documents, {"a", "b"})
    with pytest.raises(ValueError, match="size"):
        V.expansion_pairs({"a": run.where("rank < 10")}, known, queries, documents)


def test_audits_cover_originals(spark):
    pair = "query_id string, document_id string"
    a, b = spark.createDataFrame([("q", "d"), ("q", "e")], pair), spark.createDataFrame([("q", "d")], pair)
    assert V.require_covered(b, b).count() == 1
    with pytest.raises(ValueError, match="1 originals no audit"):
        V.require_covered(a, b)


def test_alignment_pairs(spark):
    lookup = spark.createDataFrame([("ami jabo na", "g", "banglish", "train"), ("আমি যাব না", "g", "bangla", "train"), ("tumi jabe ki", "h", "banglish", "validation"), ("তুমি যাবে কি", "h", "bangla", "validation")], "text string, group_id string, bucket string, split string")
    pairs = spark.createDataFrame([("1", "ami jabo na", "আমি যাব না"), ("2", "tumi jabe ki", "তুমি যাবে কি")], "id string, query string, document string")
    assert [(r.id, r.group_id) for r in V.alignment_pairs(pairs, lookup).collect()] == [("1", "g")]
    assert [(r.id, r.group_id) for r in V.pilot_pairs(pairs, lookup).collect()] == [("2", "h")]
    leaked = lookup.unionByName(spark.createDataFrame([("x y z", "g", "bangla", "test")], lookup.schema))
    with pytest.raises(ValueError, match="held out"):
        V.alignment_pairs(pairs, leaked)


def test_bm25_pruned_equals_scoring_all(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(["the"] * int(rng.integers(1, 4)) + ["of"] * int(rng.integers(0, 3)) + [f"w{int(x)}" for x in rng.zipf(1.3, 12) if x < 400])) for i in range(600)]
    asked = [(q, f"the of w{q} w{q * 3 + 1}") for q in range(12)] + [(50, "the"), (51, "the of"), (52, "unseen word")]
    got = V.bm25(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", queries := spark.createDataFrame(asked, "q bigint, t string"), "q", "t")
    split = [(i, t.split()) for i, t in docs]
    average = sum(len(w) for _, w in split) / len(split)
    want = {}
    for q, t in asked:
        scores = {}
        for term in set(t.split()):
            holding = [(i, w.count(term), len(w)) for i, w in split if term in w]
            idf = np.log1p((len(docs) - len(holding) + 0.5) / (len(holding) + 0.5))
            for i, f, n in holding:
                scores[i] = scores.get(i, 0) + idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / average))
        want[q] = [i for i, _ in sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:10]]
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append(r.d)
    assert found == {q: d for q, d in want.items() if d}
    assert [r.q for r in V.unmatched(queries, "q", got).collect()] == [52]


def test_anchored_vectors(spark):
    rng = np.random.default_rng(5)
    contexts = np.where(rng.random((9, 6)) < 0.6, rng.random((9, 6)), 0)
    contexts[8] = 0
    contexts[7] = contexts[0]
    contexts[3], contexts[3, 5], contexts[:3, 5] = 0, 1, 0  # meets no anchor
    unit = contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-12)
    old = rng.normal(size=(3, 4))
    rows = [(300 + i, c, float(x)) for i, v in enumerate(contexts) for c, x in enumerate(v) if x > 0]
    anchors = spark.createDataFrame([(300, 0), (301, 1), (302, 2)], "id int, old int")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(old)], "old int, vector array<double>")
    made = {r.id - 300: (np.array(r.vector), r.support) for r in S.anchored(spark.createDataFrame(rows, "id int, col int, value double"), anchors, vectors).collect()}
    assert set(made) == set(range(8))
    for i in range(8):
        if i < 3:
            want, support = old[i], 1
        else:
            s = np.sort(unit[i] @ unit[:3].T)[::-1]
            k = max(j for j in range(1, 4) if 1 + j * s[j - 1] > s[:j].sum())
            w = np.maximum(unit[i] @ unit[:3].T - (s[:k].sum() - 1) / k, 0)
            want, support = w @ old, (w > 0).sum()
        assert np.allclose(made[i][0], want) and made[i][1] == support, i


def test_packet_of_known_pairs(spark):
    from corpusloom.operators import review as W

    queries, documents = spark.createDataFrame([("q", "g", "t")], "id string, group_id string, text string"), spark.createDataFrame([("d", "t")], "id string, text string")
    pool = spark.createDataFrame([("q", "d"), ("q", "x")], "query_id string, document_id string")
    assert W.packet(pool, queries, documents).count() == 1
    with pytest.raises(ValueError, match="unknown document_id x"):
        W.packet(pool, queries, documents, strict=True)


def test_rates(spark):
    rows = spark.createDataFrame([(2.0, 4_000_000, 8)], "s double, b bigint, t bigint")
    r = S.throughput(rows, "s", "b", "t").first()
    assert (r.mb_per_second, r.texts_per_second, r.us_per_text) == (2.0, 4.0, 250_000.0)
    with pytest.raises(ValueError, match="positive"):
        S.throughput(rows.selectExpr("0D as s", "b", "t"), "s", "b", "t")


def test_model_side_car(spark, tmp_path):
    from corpusloom.functions import tokenizer as K
    from corpusloom.operators import tokenizers as O

    counts = spark.createDataFrame([("low", 5.0), ("lower", 2.0)], "word string, weight double")
    with pytest.raises(O.NoPairLeft) as short:
        O.train_bpe(counts, 300, 8)
    model = short.value.model
    assert model.encode("lower") == [model.vocab_size - 1]
    made = O.train_report(f"{tmp_path}/m", model, counts, {"vocab": 268}, None, 1.5)
    assert made["words"] == 2 and made["vocab_size"] == model.vocab_size and K.Model.load(f"{tmp_path}/m").merges == model.merges
    again = O.train_report(f"{tmp_path}/n", model, counts.repartition(3), {"vocab": 268}, None, 1.5)
    assert again["counts_hash"] == made["counts_hash"] and again["model_sha256"] == made["model_sha256"]
    with pytest.raises(FileExistsError):
        O.train_report(f"{tmp_path}/m", model, counts, {}, None, 1.0)


def test_closed_model():
    from corpusloom.functions import tokenizer as K

    with K.Model("unigram", [("a", -1.0)]) as m:
        assert m.decode(m.encode("a b")) == "a b"
    with pytest.raises(ValueError, match="closed"):
        m.encode("a")
