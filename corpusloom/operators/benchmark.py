"""Benchmarks of intents: checks as tables of problems, documents, queries and qrels by direction, frozen decisions, reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval as V
from corpusloom.operators import statistics as S
from corpusloom.operators.corpus import digest

LANGUAGES = {"bn": "bangla", "bl": "banglish", "en": "english"}
SURFACES = ("bn", "bl", "en", "q_bn", "q_bl", "q_en")
SPLITS = ("development", "test")


def pure_banglish(c: str) -> Column:
    """Whether a text meant to be in Latin letters holds no Bengali character; null for null."""
    return ~F.col(c).rlike(r"[\x{0980}-\x{09FF}]")


def surfaces(material: DataFrame, fields: tuple[str, ...] = SURFACES, variants: str | None = "q_bl_variants") -> DataFrame:
    """(id, split, field, text): every filled surface of every intent, its spelling variants among them."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    if variants and variants in material.columns:
        more = F.transform(F.coalesce(F.col(variants), F.array().cast("array<string>")), lambda t: F.struct(F.lit(variants).alias("field"), t.alias("text")))
        parts = F.concat(parts, more)
    return material.select("id", "split", F.explode(parts).alias("x")).select("id", "split", "x.field", "x.text").where("text is not null")


def material_problems(material: DataFrame, domains: tuple[str, ...] | None = None, origin: str | None = "agent") -> DataFrame:
    """(problem, what): why intents cannot be a benchmark; empty if they can.

    duplicate id; unknown split; empty text: a surface missing or without canonical key; shared text: a surface of several
    intents; not banglish: Bengali script in bl or q_bl; source group in both splits; no variants; other author; missing
    domain, unknown domain; domain without split: a domain that lacks a split.
    """
    row = lambda problem, what: (F.lit(problem).alias("problem"), F.col(what).cast("string").alias("what"))
    faces = surfaces(material).select("id", "field", T.key(T.normalize("text")).alias("key"))
    parts = [
        material.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(*row("duplicate id", "id")),
        material.where(F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True))).select(*row("unknown split", "id")),
        faces.where("key = ''").select(*row("empty text", "id")),
        material.where(" or ".join(f"{f} is null" for f in SURFACES)).select(*row("empty text", "id")),
        faces.where("key <> ''").groupBy(digest("key").alias("d")).agg(F.min("key").alias("key"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(*row("shared text", "key")),
        material.where(~F.coalesce(pure_banglish("bl") & pure_banglish("q_bl"), F.lit(True))).select(*row("not banglish", "id")),
        material.where("source_group is not null").groupBy("source_group").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(*row("source group in both splits", "source_group")),
    ]
    if "q_bl_variants" in material.columns:
        parts.append(material.where(F.coalesce(F.size("q_bl_variants"), F.lit(0)) <= 0).select(*row("no variants", "id")))
    if origin is not None:
        parts.append(material.where(~F.col("author_origin").eqNullSafe(F.lit(origin))).select(*row("other author", "id")))
    per = material.groupBy("domain").agg(F.countDistinct(F.when(F.col("split").isin(*SPLITS), F.col("split"))).alias("splits"))
    parts.append(per.where(F.col("splits") < len(SPLITS)).select(*row("domain without split", "domain")))
    if domains is not None:
        wanted = material.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
        parts.append(per.join(wanted, "domain", "left_anti").select(*row("unknown domain", "domain")))
        parts.append(wanted.join(per, "domain", "left_anti").select(*row("missing domain", "domain")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def require_material(material: DataFrame, **rules) -> DataFrame:
    """material, if material_problems() has none; raises for the first one otherwise."""
    for r in material_problems(material, **rules).orderBy("problem", "what").limit(1).collect():
        raise ValueError(f"{r.problem}: {r.what}")
    return material


def source_problems(material: DataFrame, sources: DataFrame, source: str = "source_id", identity: str = "url") -> DataFrame:
    """(problem, what): unknown source: intents of a source that sources does not list; source in both splits: one identity
    (a canonical address) whose intents are in several splits. sources, (source, identity), is listed once for each source."""
    listed = sources.select(F.col(source), F.col(identity).alias("identity")).groupBy(source).agg(F.min("identity").alias("identity"))
    unknown = material.select(source).distinct().join(listed, source, "left_anti").select(F.lit("unknown source").alias("problem"), F.col(source).alias("what"))
    per = material.join(listed, source).where("identity is not null").groupBy("identity").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return unknown.unionByName(per.select(F.lit("source in both splits").alias("problem"), F.col("identity").alias("what")))


def _directions(languages: dict[str, str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("direction"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in languages for b in languages]))


def documents_of(material: DataFrame, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """(split, language, id, group_id, text, domain, bucket, source): the documents of each language."""
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.col(x).alias("text"), F.lit(b).alias("bucket")) for x, b in languages.items()]))
    rows = material.select("id", "split", F.col("source_group").alias("group_id"), "domain", F.col("source_id").alias("source"), parts.alias("x")).where("x.text is not null")
    return rows.select("split", "x.language", "id", "group_id", "x.text", "domain", "x.bucket", "source")


def queries_of(material: DataFrame, languages: dict[str, str] = LANGUAGES, variants: str | None = "q_bl_variants") -> DataFrame:
    """(split, language, id, intent, group_id, text, domain, bucket, variant): the queries of each language, Banglish ones in all
    their spellings. id: intent, language and place; group_id is the domain, so that variants and intents of one share a block.
    """
    def faces(x: str) -> Column:
        one = F.array(F.col(f"q_{x}"))
        if x == "bl" and variants and variants in material.columns:
            one = F.concat(one, F.coalesce(F.col(variants), F.array().cast("array<string>")))
        return F.transform(one, lambda t, i: F.struct(F.lit(x).alias("language"), i.alias("place"), t.alias("text"), F.lit(languages[x]).alias("bucket")))

    rows = material.select("id", "split", "domain", F.explode(F.concat(*[faces(x) for x in languages])).alias("x")).where("x.text is not null")
    return rows.select(
        "split", "x.language", F.concat_ws(":", "id", "x.language", F.col("x.place").cast("string")).alias("id"), F.col("id").alias("intent"), F.col("domain").alias("group_id"),
        "x.text", "domain", "x.bucket", F.when(F.col("x.place") == 0, "canonical").otherwise("spelling").alias("variant"),
    )


def build(material: DataFrame, grades: DataFrame | None = None, languages: dict[str, str] = LANGUAGES, **rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries, and the complete qrels (split, direction, query_id, document_id, grade) of checked material.

    grades: (query_intent, document_intent, grade) of reviewed pairs; without them a query's own intent has grade 2. Pairs of
    a split without grade have 0. Raises for problems of the material, and if a query would have no positive document.
    """
    require_material(material, **rules)
    documents, queries = documents_of(material, languages), queries_of(material, languages)
    if grades is None:
        grades = material.select(F.col("id").alias("query_intent"), F.col("id").alias("document_intent"), F.lit(2).alias("grade"))
    ids = material.select(F.col("id").alias("intent"), "split")
    matrix = V.complete_qrels(ids.withColumnRenamed("intent", "query_id"), ids.withColumnRenamed("intent", "document_id"), grades.toDF("query_id", "document_id", "grade"))
    if not ids.select(F.col("intent").alias("query_id")).join(matrix.where("grade > 0"), "query_id", "left_anti").isEmpty():
        raise ValueError("an intent has no positive document")
    pairs = queries.select(F.col("id").alias("q"), F.col("intent").alias("query_id"), F.col("language").alias("a")).join(matrix, "query_id")
    rows = pairs.select("split", "q", "a", "document_id", "grade", _directions(languages).alias("x")).where("x.a = a")
    present = documents.select(F.col("id").alias("document_id"), F.col("language").alias("b"))
    rows = rows.select("split", "x.direction", F.col("q").alias("query_id"), "document_id", "grade", F.col("x.b").alias("b")).join(present, ["document_id", "b"], "left_semi")
    return documents, queries, rows.select("split", "direction", "query_id", "document_id", "grade")


def freeze(decision: dict, path: str) -> str:
    """Write a decision once and return its hash; writing the same again is allowed, another one is refused."""
    text = json.dumps(decision, ensure_ascii=False, indent=2, sort_keys=True)
    if Path(path).exists():
        if Path(path).read_text("utf-8") != text:
            raise ValueError(f"{path} is frozen and differs")
    else:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()


def require_frozen(path: str, expected: str, evidence: dict[str, str] | None = None) -> dict:
    """The frozen decision, if its file exists unchanged, says it was frozen before the test, and its evidence (path: hash) is
    unchanged; raises otherwise. To be called before anything of a test split is scored."""
    if not Path(path).exists():
        raise ValueError(f"there is no frozen decision {path}")
    raw = Path(path).read_bytes()
    if hashlib.sha256(raw).hexdigest() != expected:
        raise ValueError("the frozen decision was changed")
    decision = json.loads(raw)
    if not decision.get("frozen_before_test"):
        raise ValueError("the decision was not frozen before the test")
    for p, h in (evidence or {}).items():
        if not Path(p).exists() or hashlib.sha256(Path(p).read_bytes()).hexdigest() != h:
            raise ValueError(f"the evidence {p} is missing or changed")
    return decision


def comparisons(scores: DataFrame, baselines: dict[str, tuple[str, ...]], repeats: int = 2000, seed: int = 17) -> DataFrame:
    """(arm, baseline, direction, metric, groups, runs, mean, low, high): crossed comparisons of arms with their baselines.

    scores: (arm, run, direction, query_id, group_id, bucket, domain, metrics), in which run is a training seed. baselines: arm
    to the arms it is compared with. Raises unless each pair has the same runs and queries in every direction.
    """
    directions = [r[0] for r in scores.select("direction").distinct().orderBy("direction").limit(1001).collect()]
    if len(directions) > 1000:
        raise ValueError("more than 1000 directions")
    out = None
    for arm, others in baselines.items():
        for other in others:
            for d in directions:
                side = lambda a, d=d: scores.where((F.col("arm") == a) & (F.col("direction") == d)).drop("arm", "direction")
                one = S.crossed(side(other), side(arm), repeats, seed)
                one = one.select(F.lit(arm).alias("arm"), F.lit(other).alias("baseline"), F.lit(d).alias("direction"), *one.columns)
                out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to compare")
    return out


def confirm(decision: str, expected: str, scores: DataFrame, split: DataFrame, baselines: dict[str, tuple[str, ...]], directions: tuple[str, ...], repeats: int = 2000, seed: int = 17) -> DataFrame:
    """The report of a reserved test, comparisons() of all arms in all directions, bound to an unchanged frozen decision.

    split: (query_id, split) of the scored queries, which must all be test. Every arm needs every direction.
    """
    require_frozen(decision, expected)
    if not scores.select("query_id").distinct().join(split.where("split = 'test'"), "query_id", "left_anti").isEmpty():
        raise ValueError("a scored query is not of the reserved test")
    found = {(r.arm, r.direction) for r in scores.select("arm", "direction").distinct().limit(100_000).collect()}
    arms = {a for a, _ in found}
    if found != {(a, d) for a in arms for d in directions}:
        raise ValueError("every arm needs exactly the directions " + ", ".join(directions))
    return comparisons(scores, baselines, repeats, seed)


def matrix_problems(runs: DataFrame, protocol: DataFrame) -> DataFrame:
    """(arm, budget, seed, problem) of a training matrix: missing and unknown runs, runs given twice, and reports that were
    changed. runs: (arm, budget, seed, report_sha256, found_sha256); protocol: (arm, budget, seed). Empty: it can be resumed
    or evaluated."""
    keys = ["arm", "budget", "seed"]
    mark = lambda df, p: df.select(*keys, F.lit(p).alias("problem"))
    have = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("report_sha256").eqNullSafe(F.col("found_sha256"))).alias("changed"))
    wanted = protocol.select(*keys).distinct()
    return mark(wanted.join(have, keys, "left_anti"), "missing").unionByName(mark(have.join(wanted, keys, "left_anti"), "unknown")).unionByName(mark(have.where("n > 1"), "twice")).unionByName(mark(have.where("changed > 0"), "changed"))
