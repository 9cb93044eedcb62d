"""Review of labels and datasets: blinded packets, imports checked as tables of problems, negatives, audits, pilots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ranking as R
from corpusloom.operators import retrieval as V
from corpusloom.runtime import Scratch, sized_join

PAIR = ["query_id", "document_id"]


def packet(pool: DataFrame, queries: DataFrame, documents: DataFrame, calibration: int = 30, seed: int = 17, strict: bool = False) -> DataFrame:
    """The blinded pairs with their texts, empty fields for labels, and whether their group is among the `calibration` first in
    a seeded shuffle. Pairs of unknown queries or documents are left out; strict raises for them."""
    if strict:
        for c, known in (("query_id", queries), ("document_id", documents)):
            for r in pool.select(c).distinct().join(known.select(F.col("id").alias(c)), c, "left_anti").orderBy(c).limit(1).collect():
                raise ValueError(f"the pool names the unknown {c} {r[0]}")
    q = queries.select(F.col("id").alias("query_id"), F.col("group_id"), F.col("text").alias("query"))
    d = documents.select(F.col("id").alias("document_id"), F.col("text").alias("document"))
    rows = pool.select(*PAIR).distinct().join(q, "query_id").join(d, "document_id")
    groups = rows.select("group_id").where("group_id is not null").distinct()
    first = groups.orderBy(R.shuffle_key("group_id", seed), "group_id").limit(calibration).withColumn("calibration", F.lit(True))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("grade", "int"), ("rationale", "string"), ("reviewer_id", "string"), ("reviewer_origin", "string"))]
    rows = rows.join(F.broadcast(first), "group_id", "left")  # at most `calibration` rows
    return rows.select(*PAIR, "group_id", "query", "document", *empty, F.coalesce("calibration", F.lit(False)).alias("calibration"))


def label_problems(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, document_id, problem): labels of unknown pairs, given twice, invalid, and pairs without label."""
    known = expected.select(*PAIR).distinct()
    twice = labels.groupBy(*PAIR).agg(F.count("*").alias("n")).where("n > 1").select(*PAIR, F.lit("twice").alias("problem"))
    unknown = labels.select(*PAIR).distinct().join(known, PAIR, "left_anti").withColumn("problem", F.lit("unknown"))
    invalid = labels.where(~V.valid_labels(labels)).select(*PAIR).distinct().withColumn("problem", F.lit("invalid"))
    missing = known.join(labels.select(*PAIR).distinct(), PAIR, "left_anti").withColumn("problem", F.lit("missing"))
    return twice.unionByName(unknown).unionByName(invalid).unionByName(missing)


def decision_problems(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """(query_id, problem): decisions on unknown queries, given twice, incomplete, exclusions without reason, and queries
    without decision."""
    ids = queries.select(F.col("id").alias("query_id"))
    excluded = ~F.col("pair_correct") | ~F.col("privacy_review_passed")
    full = F.col("pair_correct").isNotNull() & F.col("privacy_review_passed").isNotNull() & (F.trim("reviewer") != "") & F.col("reviewer_origin").isin("human", "agent")
    parts = [
        decisions.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("twice").alias("problem")),
        decisions.select("query_id").join(ids, "query_id", "left_anti").withColumn("problem", F.lit("unknown")),
        decisions.where(~F.coalesce(full, F.lit(False))).select("query_id", F.lit("incomplete").alias("problem")),
        decisions.where(F.coalesce(excluded & (F.trim(F.coalesce("exclusion_reason", F.lit(""))) == ""), F.lit(False))).select("query_id", F.lit("no reason").alias("problem")),
        ids.join(decisions, "query_id", "left_anti").withColumn("problem", F.lit("missing")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _refuse(problems: DataFrame) -> None:
    for r in problems.orderBy(*problems.columns).limit(1).collect():
        raise ValueError(f"review cannot be imported: {r.asDict()}")


def import_review(expected: DataFrame, labels: DataFrame, decisions: DataFrame, queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, documents and qrels after review.

    Raises for any problem of labels or decisions. A failed privacy decision removes all of its group, a wrong pair its query.
    Every query that stays needs a positive label.
    """
    _refuse(label_problems(expected, labels))
    _refuse(decision_problems(queries, decisions))
    decided = decisions.withColumnRenamed("query_id", "id")
    private = queries.join(decided.where("not privacy_review_passed").select("id"), "id", "left_semi").select("group_id").where("group_id is not null").distinct()
    kept = queries.join(decided.where("pair_correct and privacy_review_passed").select("id"), "id", "left_semi").join(private, "group_id", "left_anti").select(*queries.columns)
    docs = documents.join(private, "group_id", "left_anti").select(*documents.columns)
    qrels = labels.join(kept.select(F.col("id").alias("query_id")), "query_id", "left_semi").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    qrels = qrels.select(*PAIR, "grade", F.concat("reviewer_origin", F.lit("_reviewed")).alias("label_origin"), "reviewer_id", "rationale")
    if not kept.select(F.col("id").alias("query_id")).join(qrels.where("grade > 0"), "query_id", "left_anti").isEmpty():
        raise ValueError("a query is left without positive label")
    return kept, docs, qrels


def add_labels(previous: DataFrame, expected: DataFrame, labels: DataFrame) -> DataFrame:
    """Previous qrels and the new labels of every expected pair; raises for any problem."""
    _refuse(label_problems(expected, labels))
    new = labels.select(*PAIR, "grade", F.concat("reviewer_origin", F.lit("_reviewed")).alias("label_origin"), "reviewer_id", "rationale")
    return previous.select(*new.columns).unionByName(new)


def accepted_negatives(mined: DataFrame, reviews: DataFrame, least: int = 16, languages: tuple[str, ...] = ("banglish", "english")) -> DataFrame:
    """Mined pairs (group_id, negative_group, query_language, ...) whose review finds the pair right and the negative of grade 0.

    Raises unless every mined pair is reviewed once and unchanged, and each language keeps at least `least`.
    """
    both = mined.withColumn("m_", F.lit(1)).join(reviews.select("group_id", F.col("negative_group").alias("n_"), "pair_correct", "negative_grade", F.lit(1).alias("r_")), "group_id", "full_outer")
    good = F.coalesce(F.col("m_").isNotNull() & F.col("r_").isNotNull() & (F.col("n_") == F.col("negative_group")) & F.col("pair_correct").isNotNull() & F.col("negative_grade").isin(0, 1, 2), F.lit(False))
    found = both.agg(F.count_if(~good).alias("bad"), F.count("*").alias("n"), F.countDistinct("group_id").alias("groups")).first()
    if found.bad or found.n != found.groups:
        raise ValueError("reviews must cover the mined pairs, each once and unchanged")
    out = both.where("pair_correct and negative_grade = 0").drop("m_", "r_", "n_")
    counts = {r.query_language: r["count"] for r in out.groupBy("query_language").count().collect()}
    if any(counts.get(x, 0) < least for x in languages):
        raise ValueError(f"a language has fewer than {least} accepted negatives")
    return out


def without_wrong_pairs(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs without the groups that a review finds wrong; unreviewed pairs stay."""
    return pairs.join(reviews.where("not pair_correct").select("group_id").distinct(), "group_id", "left_anti").select(*pairs.columns)


def expansion_problems(prepared: DataFrame, reserved: DataFrame, reserve_source: str = "benchmark-reserve") -> DataFrame:
    """(problem, what): reserved surfaces (column text) in train, rows of the reserve's source, groups in several splits."""
    keys = reserved.select(T.key(T.normalize("text")).alias("k")).where("k <> ''").distinct()
    train = prepared.where("split = 'train'").select("rid", T.key(T.normalize("text")).alias("k"))
    surface = train.join(keys, "k", "left_semi").select(F.lit("reserved surface in train").alias("problem"), F.col("rid").cast("string").alias("what"))
    rows = prepared.where(F.col("source") == reserve_source).select(F.lit("reserve row").alias("problem"), F.col("rid").cast("string").alias("what"))
    across = prepared.where("group_id is not null").groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return surface.unionByName(rows).unionByName(across.select(F.lit("group in several splits").alias("problem"), F.col("group_id").alias("what")))


def pilot(pairs: DataFrame, pool: DataFrame, count: int, documents: int, seed: int = 17, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs and documents of a pilot: `count` pairs (id, group_id, query, document) that share no group and no canonical text,
    their documents, and others of the pool (id, group_id, text) with new canonical texts up to `documents`.

    strict raises if either number cannot be reached; otherwise what can be reached comes out. Both orders are seeded shuffles.
    """
    scratch = Scratch(pairs.sparkSession, "pilot")
    chosen = scratch.save(V.select_pairs(pairs.withColumn("source", F.lit("pilot")), {"pilot": count}, seed), "chosen")
    n = chosen.count()
    if strict and n != count:
        raise ValueError(f"{n} disjoint pairs, not {count}")
    mine = chosen.select("id", "group_id", F.col("document").alias("text"), T.key(T.normalize("document")).alias("k"))
    others = pool.select("id", "group_id", "text", T.key(T.normalize("text")).alias("k")).where("k <> ''").join(mine.select("k"), "k", "left_anti")
    others = others.withColumn("o_", F.struct(R.shuffle_key("id", seed), "id"))
    others = others.groupBy("k").agg(F.min_by(F.struct("id", "group_id", "text"), "o_").alias("x"), F.min("o_").alias("o_"))
    more = others.orderBy("o_").limit(max(documents - n, 0)).select("x.*")
    docs = scratch.save(mine.drop("k").unionByName(more), "documents")
    if strict and (n := docs.count()) != documents:
        raise ValueError(f"{n} documents, not {documents}")
    return chosen, docs


def encode_once(df: DataFrame, text: str, encode: Callable[[str], Column], out: str = "encoded") -> DataFrame:
    """df with a column computed from text, once for each distinct text; null for null."""
    scratch = Scratch(df.sparkSession, "once")
    made = scratch.save(df.where(F.col(text).isNotNull()).select(text).distinct().select(text, encode(text).alias(out)), "made")
    return sized_join(df, made, [text], "left")


def transferred(pieces: DataFrame, ids: str, vectors: DataFrame, key: str, vector: str, unknown: int) -> DataFrame:
    """(piece columns, vector): each piece's vector as the mean of those of its old ids (an array column); the unknown id's where
    it has none. Ids without a vector do not take part."""
    names = [c for c in pieces.columns if c != ids]
    parts = pieces.select(*names, F.explode(F.when(F.size(ids) > 0, F.col(ids)).otherwise(F.array(F.lit(unknown)))).alias(key))
    long = parts.join(vectors.select(key, vector), key).select(*names, F.posexplode(vector).alias("i_", "x_"))
    means = long.groupBy(*names, "i_").agg(F.avg("x_").alias("x_"))
    return means.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "x_"))), lambda p: p.x_).alias("vector"))
