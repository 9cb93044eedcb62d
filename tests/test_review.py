import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tokenizer as K
from corpusloom.operators import review as W
from corpusloom.operators import tokenizers as O

LABEL = "query_id string, document_id string, grade int, rationale string, reviewer_id string, reviewer_origin string"
DECISION = "query_id string, pair_correct boolean, privacy_review_passed boolean, reviewer string, reviewer_origin string, exclusion_reason string"


@pytest.fixture
def data(spark):
    queries = spark.createDataFrame([("1", "g", "x"), ("2", "h", "y"), ("3", "g", "z")], "id string, group_id string, text string")
    documents = spark.createDataFrame([("a", "g", "A"), ("b", "h", "B")], "id string, group_id string, text string")
    labels = spark.createDataFrame([(q, d, g, "why", "r", "agent") for q, d, g in (("1", "a", 2), ("1", "b", 0), ("2", "b", 1), ("3", "a", 1))], LABEL)
    decisions = spark.createDataFrame([(q, True, True, "r", "human", None) for q in "123"], DECISION)
    return queries, documents, labels, decisions


def test_import(data):
    queries, documents, labels, decisions = data
    q, d, r = W.import_review(labels, labels, decisions, queries, documents)
    assert q.count() == 3 and d.count() == 2 and {x.label_origin for x in r.collect()} == {"agent_reviewed"}


def test_privacy_removes_the_group_and_a_wrong_pair_its_query(data):
    queries, documents, labels, decisions = data
    private = decisions.withColumn("privacy_review_passed", F.col("query_id") != "3").withColumn("exclusion_reason", F.lit("because"))
    q, d, r = W.import_review(labels, labels, private, queries, documents)
    assert [x.id for x in q.collect()] == ["2"] and [x.id for x in d.collect()] == ["b"] and r.count() == 1
    wrong = decisions.withColumn("pair_correct", F.col("query_id") != "1").withColumn("exclusion_reason", F.lit("because"))
    assert sorted(x.id for x in W.import_review(labels, labels, wrong, queries, documents)[0].collect()) == ["2", "3"]


@pytest.mark.parametrize("change", ["null", "missing", "twice", "unknown", "blank", "origin", "decision", "reason", "positive"])
def test_refusals(data, change):
    queries, documents, labels, decisions = data
    expected, first = labels, F.col("query_id") == "2"
    if change == "null":
        labels = labels.withColumn("grade", F.when(~first, F.col("grade")))
    elif change == "missing":
        labels = labels.where(~first)
    elif change == "twice":
        labels = labels.unionByName(labels.where(first))
    elif change == "unknown":
        expected = labels.where(~first)
    elif change == "blank":
        labels = labels.withColumn("rationale", F.when(first, " ").otherwise("x"))
    elif change == "origin":
        labels = labels.withColumn("reviewer_origin", F.lit("nobody"))
    elif change == "decision":
        decisions = decisions.where(~first)
    elif change == "reason":
        decisions = decisions.withColumn("pair_correct", ~first)
    else:
        labels = labels.withColumn("grade", F.when(first, 0).otherwise(F.col("grade")))
    with pytest.raises(ValueError):
        W.import_review(expected, labels, decisions, queries, documents)


def test_packet_is_blinded(spark, data):
    queries, documents, labels, _ = data
    got = W.packet(labels, queries, documents, 1).collect()
    assert len(got) == 4 and all(r.grade is None and r.reviewer_id is None for r in got)
    assert len({r.group_id for r in got if r.calibration}) == 1


def test_pool_expansion(spark):
    pool = spark.createDataFrame([("q", f"d{i}") for i in range(10)], "query_id string, document_id string")
    new = pool.where("document_id <> 'd0'")
    labels = new.select("query_id", "document_id", F.lit(1).alias("grade"), F.lit("w").alias("rationale"), F.lit("r").alias("reviewer_id"), F.lit("human").alias("reviewer_origin"))
    previous = spark.createDataFrame([("q", "d0", 2, "x", "r", "w")], "query_id string, document_id string, grade int, label_origin string, reviewer_id string, rationale string")
    assert W.add_labels(previous, new, labels).count() == 10


def test_negatives(spark):
    mined = spark.createDataFrame([(f"g{i}", f"n{i}", "banglish" if i % 2 else "english") for i in range(40)], "group_id string, negative_group string, query_language string")
    reviews = spark.createDataFrame([(f"g{i}", f"n{i}", i != 3, 1 if i == 4 else 0) for i in range(40)], "group_id string, negative_group string, pair_correct boolean, negative_grade int")
    assert W.accepted_negatives(mined, reviews).count() == 38
    assert W.without_wrong_pairs(mined, reviews).count() == 39
    for bad in (reviews.where("group_id <> 'g1'"), reviews.withColumn("negative_group", F.lit("n0")), reviews.unionByName(reviews), reviews.withColumn("negative_grade", F.lit(3)), reviews.withColumn("negative_grade", F.lit(1))):
        with pytest.raises(ValueError):
            W.accepted_negatives(mined, bad)


def test_expansion(spark):
    prepared = spark.createDataFrame([(1, "Same Surface!", "s", "g", "train"), (2, "x", "benchmark-reserve", "h", "train"), (3, "y", "s", "g", "test")], "rid bigint, text string, source string, group_id string, split string")
    reserved = spark.createDataFrame([("same surface",), (None,)], "text string")
    assert {r.problem for r in W.expansion_problems(prepared, reserved).collect()} == {"reserved surface in train", "reserve row", "group in several splits"}


def test_pilot(spark):
    pairs = spark.createDataFrame([(str(i), f"g{i // 2}", f"q {i}", f"d {i}") for i in range(12)], "id string, group_id string, query string, document string")
    pool = spark.createDataFrame([(f"p{i}", "z", f"D {i}!") for i in range(20)], "id string, group_id string, text string")
    chosen, docs = W.pilot(pairs, pool, 4, 10)
    assert chosen.select("group_id").distinct().count() == 4 and docs.count() == 10
    with pytest.raises(ValueError, match="disjoint"):
        W.pilot(pairs, pool, 7, 10)
    with pytest.raises(ValueError, match="documents"):
        W.pilot(pairs, pool, 4, 30)


def test_transfer_and_gather(spark):
    pieces = spark.createDataFrame([("x", [1, 2]), ("y", []), ("z", [9])], "piece string, ids array<int>")
    vectors = spark.createDataFrame([(0, [5.0, 5.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    got = {r.piece: r.vector for r in W.transferred(pieces, "ids", vectors, "id", "v", 0).collect()}
    assert got == {"x": [2.0, 2.0], "y": [5.0, 5.0]}
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    assert {(r.k, r.encoded) for r in W.encode_once(df, "t", F.upper).collect()} == {(1, "A"), (2, "A"), (3, None)}


def test_quality_and_cache(spark):
    m = K.Model("unigram", [("a", -1.0), ("b", -1.0), ("ab", -1.5)])
    df = spark.createDataFrame([("ab a",), ("c c b",), (None,)], "t string")
    row = O.quality(df, "t", m, 4).first()
    assert (row.texts, row.round_trip, row.unknown, row.over, row.p95) == (2, 1.0, 0, 0.5, 5)
    assert O.frequent_words(df, "t", m, 2) == ["c"]
