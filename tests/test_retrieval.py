import math
import random

import numpy as np
import pytest

from corpusloom.operators import ranking as R
from corpusloom.operators import retrieval as V
from corpusloom.operators import statistics as S
from corpusloom.runtime import Scratch

RANK, QREL = "query_id string, document_id string, rank int", "query_id string, document_id string, grade int"
SCORED = "query_id string, group_id string, bucket string, domain string, recall_at_10 double, ndcg_at_10 double, mrr_at_10 double"


def test_graded_metrics(spark):
    ranks = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("z", "x", 11)], RANK)
    judged = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("z", "x", 1), ("e", "a", 1)], QREL)
    got = {r.query_id: r for r in V.query_metrics(ranks, judged).collect()}
    assert math.isclose(got["q"].ndcg_at_10, (1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3))) and got["q"].recall_at_10 == 1
    assert got["z"].recall_at_10 == 0 and got["e"].ndcg_at_10 == 0


def test_metrics_refuse(spark):
    one = spark.createDataFrame([("q", "a", 1)], RANK)
    for judged in ([("q", "a", 0)], [("q", "a", -1), ("q", "b", 1)]):
        with pytest.raises(ValueError):
            V.query_metrics(one, spark.createDataFrame(judged, QREL))
    with pytest.raises(ValueError):
        V.query_metrics(one.unionByName(one), spark.createDataFrame([("q", "a", 1)], QREL))


def test_metrics_of_many_judgments(spark):
    rng = random.Random(2)
    judged = [("q", f"d{i}", rng.randrange(3)) for i in range(40)] + [("q", "x", 2)]
    ranked = rng.sample([d for _, d, _ in judged], 12)
    grades = {d: g for _, d, g in judged}
    gain = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs))
    want = gain([grades[d] for d in ranked[:10]]) / gain(sorted(grades.values(), reverse=True)[:10])
    got = V.query_metrics(spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranked)], RANK), spark.createDataFrame(judged, QREL)).first()
    assert math.isclose(got.ndcg_at_10, want)


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "ভালো ফোন"), ("b", "অন্য কিছু"), ("c", None)], "d string, t string")
    asked = spark.createDataFrame([("1", "ভালো"), ("2", "valo")], "q string, x string")
    assert [(r.q, r.d, r["rank"]) for r in V.bm25(docs, "d", "t", asked, "q", "x").collect()] == [("1", "a", 1)]
    with pytest.raises(ValueError):
        V.bm25(docs.where("d = 'c'"), "d", "t", asked, "q", "x")


def test_dense_with_ties_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 2, 6).astype(float).tolist(), i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, v array<double>, g int")
    m = np.array([v for _, v, _ in rows])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(unit @ unit.T, 9)
    got = {(r.q, r["rank"]): r.k for r in V.dense(df, "k", "v", df.where("k < 5").withColumnRenamed("k", "q"), "q", "v", 3).collect()}
    for q in range(5):
        want = sorted((i for i in range(80) if i != q), key=lambda i: (-s[q, i], i))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == want
    other = V.dense(df, "k", "v", df.where("k = 1").withColumnRenamed("k", "q"), "q", "v", 1, "g", "g").first()
    assert other.k == min((i for i in range(80) if i % 3 != 1), key=lambda i: (-s[1, i], i))


def rows_of(spark, values):
    return spark.createDataFrame([(f"q{i}", g, "b", "d", v, v, v) for i, (g, v) in enumerate(values)], SCORED)


def test_equal_group_weight(spark):
    got = S.summarize(rows_of(spark, [("one", 1.0), ("one", 1.0), ("two", 0.0)]), 200).collect()
    assert all(r["mean"] == 0.5 and r.low == 0 and r.high == 1 for r in got)
    with pytest.raises(ValueError):
        S.summarize(rows_of(spark, [("one", 1.0)]), 39)


def test_bootstrap_covers_normal_interval(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 400)
    got = S.summarize(rows_of(spark, [(f"g{i}", float(v)) for i, v in enumerate(x)]), 2000).first()
    half = 1.96 * x.std() / 20
    assert abs(got.high - (x.mean() + half)) < 0.02 and abs(got.low - (x.mean() - half)) < 0.02


def test_paired(spark):
    a = rows_of(spark, [("x", 0.2), ("y", 0.4), ("z", 0.6)])
    same = S.compare(a, a, (), 100).collect()
    assert all(r["mean"] == r.low == r.high == 0 for r in same)
    better = rows_of(spark, [("x", 1.2), ("y", 0.4), ("z", 0.6)])
    assert math.isclose(S.compare(a, better, (), 100).first()["mean"], 1 / 3)
    for bad in ([("x", 0.2), ("y", 0.4)], [("x", 0.2), ("y", 0.4), ("w", 0.6)], [("x", 0.2), ("y", 0.4), ("z", float("nan"))]):
        with pytest.raises(ValueError):
            S.differences(a, rows_of(spark, bad))


def test_crossed(spark):
    from pyspark.sql import functions as F

    base = rows_of(spark, [(f"g{i}", 0.5 + i / 100) for i in range(6)])
    runs = lambda shift: [base.withColumn("run", F.lit(r)).withColumns({m: F.col(m) + d for m in V.METRICS}) for r, d in zip((17, 29, 43), shift)]
    join = lambda x: x[0].unionByName(x[1]).unionByName(x[2])
    got = S.crossed(join(runs((0, 0, 0))), join(runs((0.1, 0.2, 0.3))), 300).first()
    assert math.isclose(got["mean"], 0.2, abs_tol=1e-9) and got.low < 0.2 < got.high
    with pytest.raises(ValueError):
        S.crossed(join(runs((0, 0, 0))), join(runs((0, 0, 0))).where("run < 43"), 300)


def test_distribution(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert tuple(S.distribution(df, "v").first())[1:] == (50.5, 95.0, 99.0)
    for bad in ([], [(0.0,)], [(-1.0,)], [(float("inf"),)], [(float("nan"),)], [(None,)]):
        with pytest.raises(ValueError):
            S.distribution(spark.createDataFrame(bad, "v double"), "v")


def test_sparsemax(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate((3.0, 1.0, 0.0))] + [(2, i, 0.0) for i in range(3)] + [(3, i, x + 7) for i, x in enumerate((0.5, 0.2, 0.1))], "r int, c int, s double")
    got = {}
    for x in S.sparsemax(df, "r", "c", "s").orderBy("r", "c").collect():
        got.setdefault(x.r, []).append(round(x.weight, 9))
    assert got[1] == [1, 0, 0] and got[2] == [round(1 / 3, 9)] * 3 and abs(sum(got[3]) - 1) < 1e-6


def test_gates(spark):
    schema = "arm string, budget string, mean double, low double, english double, latency double, memory double"
    rules = {"minimum_gain": 0.03, "interval_above": 0.0, "english_regression": 0.01, "latency": 1.25, "memory": 1.25}
    good = [("a", b, 0.05, 0.01, 0.0, 1.0, 1.0) for b in ("data", "compute")]
    decide = lambda rows: S.decide(S.gates(spark.createDataFrame(rows, schema), rules), 2, "data").first().arm
    assert decide(good) == "a" and decide(good[:1]) == "unchanged"
    assert decide([good[0], ("a", "compute", 0.05, 0.01, -0.02, 1.0, 1.0)]) == "unchanged"
    assert decide(good + [("b", b, 0.09, 0.01, 0.0, 1.0, 1.0) for b in ("data", "compute")]) == "b"


def test_pool_and_misses(spark):
    ranks = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 1)], RANK)
    judged = spark.createDataFrame([("1", "a", 0), ("1", "z", 2), ("2", "c", 1)], QREL)
    pool = {(r.query_id, r.document_id, r.known) for r in V.candidate_pool([ranks], judged).collect()}
    assert pool == {("1", "a", True), ("1", "b", False), ("1", "z", True), ("2", "c", True)}
    queries = spark.createDataFrame([("1", "g", "bangla", "আমি ৫"), ("2", "g", "english", "x")], "id string, group_id string, bucket string, text string")
    assert [(r.query_id, r.has_bengali, r.has_digit) for r in V.misses(ranks, judged, queries).collect()] == [("1", True, True)]


def test_disjoint_is_the_greedy_scan(spark):
    rng = random.Random(4)
    rows = [(f"{i:03}", f"g{rng.randrange(30)}", f"t{rng.randrange(60)}") for i in range(120)]
    taken, used = set(), set()
    for o, *keys in rows:
        if not used & set(keys):
            taken.add(o)
            used |= set(keys)
    got = R.disjoint(spark.createDataFrame(rows, "o string, a string, b string"), "o", ["a", "b"], Scratch(spark, "t"))
    assert {r.o for r in got.collect()} == taken


def test_select_pairs_quota(spark):
    rows = [(str(i), f"g{i % 40}", f"query {i}", f"document {i % 70}", "s" if i % 2 else "t") for i in range(100)]
    df = spark.createDataFrame(rows, "id string, group_id string, query string, document string, source string")
    got = V.select_pairs(df, {"s": 5, "t": 8}).collect()
    assert sum(r.source == "s" for r in got) == 5 and sum(r.source == "t" for r in got) == 8
    assert len({r.group_id for r in got}) == len({r.document for r in got}) == 13


def test_held_part(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(14)], "id int, d string")
    got = R.held_part(df, ["d"], "id").where("split = 'test'").groupBy("d").count().collect()
    assert {r.d: r["count"] for r in got} == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        R.held_part(df.where("id < 12"), ["d"], "id")


def test_archive(spark):
    from corpusloom.sources import files

    reviews = spark.createDataFrame([("q", "d", 1, "why", "r", "human", "the text")], "query_id string, document_id string, grade int, rationale string, reviewer_id string, reviewer_origin string, text string")
    kept = files.archive(reviews)
    assert "text" not in kept.columns
    packet = spark.createDataFrame([("q", "d", "the text"), ("q", "e", "other")], "query_id string, document_id string, text string")
    assert {(r.document_id, r.grade) for r in files.restore(packet, kept).collect()} == {("d", 1), ("e", None)}
    with pytest.raises(ValueError):
        files.archive(reviews.unionByName(reviews))
    with pytest.raises(ValueError):
        files.restore(packet.where("document_id = 'e'"), kept)


def test_registered_bootstraps_draw_two_thousand_times(spark, monkeypatch):
    import inspect

    from corpusloom.plans import retrieval

    drawn = {}
    for name in ("summarize", "compare", "crossed"):
        made = inspect.signature(getattr(S, name))

        def keep(*args, name=name, made=made, **kw):
            bound = made.bind(*args, **kw)
            bound.apply_defaults()
            drawn[name] = bound.arguments["repeats"]

        monkeypatch.setattr(retrieval.S, name, keep)
    for name in ("ret_bootstrap", "ret_compare", "ret_crossed"):
        getattr(retrieval, name)(spark, "/root/testdata/sf0.001")
    assert drawn == {"summarize": 2000, "compare": 2000, "crossed": 2000}


def shuffled(spark):
    """Bytes that the session's tasks have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(store.apply(i).totalShuffleWrite() for i in range(store.size()))


def test_bm25_does_not_shuffle_pairs(spark):
    docs = spark.range(3000).selectExpr("id as d", "concat('all of these w', id % 7, ' x', id % 11, ' y', id % 13) as t")
    asked = spark.range(400).selectExpr("id as q", "concat('these all w', id % 7, ' x', id % 11, ' y', id % 13) as t")
    before = shuffled(spark)
    got = V.bm25(docs, "d", "t", asked, "q", "t").collect()
    assert len(got) == 4000 and shuffled(spark) - before < 1_000_000  # there are 1.2 million pairs
    five = [(-r.score, r.d) for r in sorted(got, key=lambda r: r["rank"]) if r.q == 5]
    assert five == sorted(five)  # equal scores by document


def test_bm25_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (1, "apple pear"), (2, "apple fig fig"), (2, "plum"), (3, "plum nut")], "d bigint, t string")
    asked = spark.createDataFrame([("a", "apple fig"), ("a", "fig nut"), ("b", "plum plum")], "q string, t string")
    got = {(r.q, r.d): round(r.score, 6) for r in V.bm25(docs, "d", "t", asked, "q", "t").collect()}
    mean, score = 10 / 5, lambda n, f, size: math.log1p((5 - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / mean))  # rows of one document and size are one
    assert got == {("a", 1): round(score(2, 2, 2), 6), ("a", 2): round(score(2, 1, 3) + score(1, 2, 3), 6), ("a", 3): round(score(1, 1, 2), 6), ("b", 2): round(score(2, 1, 1), 6), ("b", 3): round(score(2, 1, 2), 6)}


@pytest.fixture(scope="module")
def judged_tables(spark, tmp_path_factory):
    """400 judged queries, each of which shares words with every one of 3000 documents."""
    sf = str(tmp_path_factory.mktemp("judged"))
    words = "all of these w', id % 7, ' x', id % 11, ' y', id % 13"
    spark.range(3000).selectExpr("id as doc_id", "concat('d', id) as id", f"concat('{words}) as text").write.parquet(f"{sf}/documents.parquet")
    spark.range(401).selectExpr("concat('q-', id) as id", f"if(id < 400, concat('{words}), 'nothing') as text", "concat('g', id % 20) as group_id", "'english' as bucket").write.parquet(f"{sf}/queries.parquet")
    spark.range(401).selectExpr("concat('q-', id) as query_id", "concat('d', id) as document_id", "2 as grade").write.parquet(f"{sf}/judgments.parquet")
    return sf


@pytest.mark.parametrize("name", ["ret_failure_audit", "ret_run_metrics", "ret_unmatched", "ret_misses", "ret_analysis"])
def test_rankings_of_judged_queries(spark, judged_tables, name):
    import __spark_entry__ as entry
    import oracle

    before = shuffled(spark)
    entry.queries()[name](spark, judged_tables).collect()
    assert shuffled(spark) - before < 2_000_000  # there are 1.2 million pairs
    assert not oracle.compare(spark, oracle.connect(judged_tables), judged_tables, entry.queries()[name], entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["ret_run_metrics", "ret_misses", "ret_analysis"])
def test_rankings_over_many_parts(spark, judged_tables, monkeypatch, name):
    """What is shuffled does not grow with the parts of the documents, nor does the result change."""
    import __spark_entry__ as entry
    import oracle

    spent = []
    for postings in (V.POSTINGS, 1000):
        monkeypatch.setattr(V, "POSTINGS", postings)
        before = shuffled(spark)
        entry.queries()[name](spark, judged_tables).collect()
        spent.append(shuffled(spark) - before)
    assert spent[1] - spent[0] < 300_000
    assert not oracle.compare(spark, oracle.connect(judged_tables), judged_tables, entry.queries()[name], entry.oracle_sql()[name])


def test_unmatched_queries_need_no_ranking(spark, judged_tables, monkeypatch):
    import __spark_entry__ as entry
    import oracle

    def refuse(*args, **kw):
        raise AssertionError("documents are ranked")

    monkeypatch.setattr(V, "bm25", refuse)
    assert not oracle.compare(spark, oracle.connect(judged_tables), judged_tables, entry.queries()["ret_unmatched"], entry.oracle_sql()["ret_unmatched"])
    docs = spark.createDataFrame([("a", "ভালো ফোন"), ("b", None), ("c", "")], "d string, t string")
    asked = spark.createDataFrame([("1", "ভালো"), ("1", "x"), ("2", "valo"), ("3", None), ("4", "!")], "q string, x string")
    assert [r.q for r in V.matched(docs, "t", asked, "q", "x").collect()] == ["1"]
    assert V.matched(docs.where("d <> 'a'"), "t", asked, "q", "x").isEmpty()


def test_complete_qrels_are_not_shuffled(spark):
    ids = spark.range(1200).selectExpr("'s' as split", "concat('i', id) as id")
    asked, docs = ids.withColumnRenamed("id", "query_id"), ids.selectExpr("split", "id as document_id").unionByName(spark.createDataFrame([("s", None), ("t", "i0")], "split string, document_id string"))
    grades = spark.createDataFrame([("i1", "i1", 2), ("i1", "i2", None), ("i3", "i9", 1), ("i4", "none", 1), ("none", "i4", 1)], QREL)
    before = shuffled(spark)
    made = V.complete_qrels(asked, docs, grades).groupBy("grade").count().collect()
    assert {r.grade: r["count"] for r in made} == {2: 1, 1: 1, 0: 1200 * 1201 - 2} and shuffled(spark) - before < 1_000_000


def test_complete_qrels_take_few_bytes(spark, tmp_path):
    ids = spark.range(2000).selectExpr("'s' as split", "concat('business-', lpad(id, 7, '0')) as id")
    grades = ids.selectExpr("id as query_id", "id as document_id", "2 as grade")
    V.complete_qrels(ids.withColumnRenamed("id", "query_id"), ids.withColumnRenamed("id", "document_id"), grades).write.parquet(str(tmp_path / "o"))
    made = spark.read.parquet(str(tmp_path / "o"))
    assert made.count() == 2000**2 and made.where("grade = 2 and query_id = document_id").count() == 2000 == made.where("grade <> 0").count()
    assert sum(p.stat().st_size for p in (tmp_path / "o").glob("*.parquet")) < 2000**2 // 4


@pytest.mark.parametrize("tile, line, lines", [(200, 50, 300), (7, 3, 2), (1, 1, 1)])
def test_complete_qrels_in_cells(spark, monkeypatch, tile, line, lines):
    """Whole with any cells: splits of all sizes, repeated and null ids, ids of two splits, grades of absent and of null ids."""
    for name, value in (("TILE", tile), ("LINE", line), ("LINES", lines), ("LEAST_PAIRS", 10)):
        monkeypatch.setattr(V, name, value)
    asked = [("s", f"i{k}") for k in range(40)] + [("t", "i1"), ("t", "i1"), ("t", None), ("u", "x"), (None, "i2"), ("alone", "y")]
    docs = [("s", f"i{k}") for k in range(33)] + [("s", None), ("s", "i5"), ("t", "i2"), ("t", "i1"), ("u", "i1"), (None, "i2"), ("other", "z")]
    grades = [(f"i{k}", f"i{k}", 2) for k in range(40)] + [("i1", "i2", None), ("i3", "i9", 1), ("none", "i4", 1), ("i4", "none", 1), (None, "i1", 1), ("i7", None, 1)]
    known = {(q, d): g or 0 for q, d, g in grades if q and d}
    want = sorted((s, q or "", d or "", known.get((q, d), 0)) for s, q in asked for s2, d in docs if s and s == s2)
    made = V.complete_qrels(spark.createDataFrame(asked, "split string, query_id string"), spark.createDataFrame(docs, "split string, document_id string"), spark.createDataFrame(grades, QREL))
    assert sorted((r.split, r.query_id or "", r.document_id or "", r.grade) for r in made.collect()) == want
    assert V.complete_qrels(spark.createDataFrame([], "split string, query_id string"), spark.createDataFrame(docs, "split string, document_id string"), spark.createDataFrame(grades, QREL)).isEmpty()
