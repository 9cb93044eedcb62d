"""Retrieval and statistics queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import tokenizer as K
from corpusloom.operators import ranking as R
from corpusloom.operators import retrieval as V
from corpusloom.operators import review as W
from corpusloom.operators import statistics as S

from corpusloom.plans.catalog import query
from corpusloom.plans.corpus import NORMAL, documents, key_sql
from corpusloom.plans.tokenizer import IDS, encoded, ids_sql
from corpusloom.runtime import Scratch, table

TERMS = r"list_filter(string_split(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: every query whose number is divisible by 50."""
    return table(spark, sf, "queries").where("cast(substring(id, 3) as int) % 50 = 0")


@query("ret_bm25", f"""with d as (select doc_id, coalesce({TERMS}, []) as w from documents), z as (select count(*) as total, avg(len(w)) as average from d),
  q as (select distinct id, unnest(list_distinct({TERMS})) as term from queries where substr(id, 3)::int % 50 = 0),
  p as (select doc_id, size, term, count(*) as f from (select doc_id, len(w) as size, unnest(w) as term from d) group by doc_id, size, term),
  n as (select term, count(*) as n from p group by term),
  s as (select id as query_id, doc_id, round(sum(ln(1 + (total - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / average))), 9) as score
    from q join n using (term) join p using (term), z group by id, doc_id),
  r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
  select query_id, doc_id, rank::int as rank, round(score, 6) as score from r where rank <= 10""")
def ret_bm25(spark: SparkSession, sf: str) -> DataFrame:
    queries = asked(spark, sf).withColumnRenamed("id", "query_id")
    out = V.bm25(documents(spark, sf), "doc_id", "text", queries, "query_id", "text")
    return out.withColumn("score", F.round("score", 6))


DENSE = """with e as (select vec_id, embedding::double[] as v, label from embeddings where embedding is not null),
  s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) as score, q.label <> e.label as other
    from e as q, e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"""


@query("ret_dense", f"""{DENSE}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
  select query_id, vec_id, rank::int as rank, round(score, 6) as score from r where rank <= 10""")
def ret_dense(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return V.dense(e, "vec_id", "embedding", queries, "query_id", "embedding").withColumn("score", F.round("score", 6))


@query("ret_hard_negatives", f"""{DENSE}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where other)
  select query_id, vec_id, rank::int as rank, round(score, 6) as score from r where rank = 1""")
def ret_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vector of another label."""
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return V.dense(e, "vec_id", "embedding", queries, "query_id", "embedding", 1, "label", "label").withColumn("score", F.round("score", 6))


QRELS = "g as (select query_id, document_id, max(grade) as grade from judgments where grade is not null group by query_id, document_id)"
FIRST = "a as (select query_id, document_id, row_number() over (partition by query_id order by first_at, document_id) as rank from (select query_id, document_id, min(judged_at) as first_at from judgments group by all))"


def shuffled_sql(name: str, seed: int, digits: int = 64) -> str:
    """Judged documents by a seeded shuffle; of its first digits only, and then by when they were judged."""
    return f"""{name} as (select query_id, document_id, row_number() over (partition by query_id order by substr(sha256('{seed}:' || query_id || document_id), 1, {digits}), first_at, document_id) as rank
    from (select query_id, document_id, min(judged_at) as first_at from judgments group by all))"""


SYSTEMS = f"{FIRST}, {shuffled_sql('b', 17)}"
SEEDS = (17, 29, 43)


def system(spark: SparkSession, sf: str, name: str, seed: int = 17) -> DataFrame:
    """Ways to rank the judged documents of a query: a, by when they were judged; b, by a seeded shuffle; c, by one digit of it
    and then by when they were judged."""
    from pyspark.sql import Window

    pairs = table(spark, sf, "judgments").groupBy("query_id", "document_id").agg(F.min("judged_at").alias("at"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), "query_id", "document_id"), 256)
    by = {"a": [F.col("at")], "b": [draw, F.col("at")], "c": [F.substring(draw, 1, 1), F.col("at")]}[name]
    order = Window.partitionBy("query_id").orderBy(*by, "document_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= V.TOP).select("query_id", "document_id", "rank")


def metrics_sql(name: str, judged: str = "g") -> str:
    return f"""(with o as (select *, row_number() over (partition by query_id order by grade desc) as i from {judged}),
    w as (select query_id, sum(case when i <= 10 then (pow(2, grade) - 1) / log2(i + 1) end) as ideal, count(*) filter (grade > 0) as positives from o group by query_id having count(*) filter (grade > 0) > 0),
    h as (select query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) as dcg, count(*) filter (grade > 0) as found, min(rank) filter (grade > 0) as first
      from {name} join {judged} using (query_id, document_id) where rank <= 10 group by query_id)
    select query_id, coalesce(found, 0) / positives as recall_at_10, coalesce(dcg, 0) / ideal as ndcg_at_10, coalesce(1 / first, 0) as mrr_at_10 from w left join h using (query_id))"""


ROUNDED = "query_id, round(recall_at_10, 9) as recall_at_10, round(ndcg_at_10, 9) as ndcg_at_10, round(mrr_at_10, 9) as mrr_at_10"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 9) for m in V.METRICS})


def measured(spark: SparkSession, sf: str, name: str, exact: bool = False, seed: int = 17) -> DataFrame:
    judged = V.qrels(table(spark, sf, "judgments"))
    return V.query_metrics(system(spark, sf, name, seed), V.exact_view(judged) if exact else judged, strict=False)


@query("ret_metrics", f"with {QRELS}, {SYSTEMS} select {ROUNDED} from {metrics_sql('a')}")
def ret_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(measured(spark, sf, "a"))


@query("ret_metrics_exact", f"""with {QRELS}, {SYSTEMS}, x as (select query_id, document_id, case grade when 2 then 2 else 0 end as grade from g) select {ROUNDED} from {metrics_sql('b', 'x')}""")
def ret_metrics_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(measured(spark, sf, "b", exact=True))


def scored(spark: SparkSession, sf: str, name: str, exact: bool = False, seed: int = 17) -> DataFrame:
    return V.scored(measured(spark, sf, name, exact, seed), table(spark, sf, "queries"))


MEANS = "avg(recall_at_10) as recall_at_10, avg(ndcg_at_10) as ndcg_at_10, avg(mrr_at_10) as mrr_at_10"


@query("ret_group_means", f"""with {QRELS}, {SYSTEMS}, m as (select m.*, group_id, bucket from {metrics_sql('a')} m join queries on id = query_id),
  s as (select 'all' as slice, 'all' as value, * from m union all select 'bucket', bucket, * from m),
  p as (select slice, value, group_id, count(*) as n, {MEANS} from s group by slice, value, group_id)
  select slice, value, sum(n)::bigint as queries, count(*) as groups, round(avg(recall_at_10), 9) as recall_at_10, round(avg(ndcg_at_10), 9) as ndcg_at_10, round(avg(mrr_at_10), 9) as mrr_at_10 from p group by slice, value""")
def ret_group_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.group_means(scored(spark, sf, "a"), ["bucket"]))


REPEATS = 2000
METRIC_LIST = ", ".join(V.METRICS)


def draws_sql(r: str, slot: str, n: str, seed: int) -> str:
    """The place that statistics.drawn() gives."""
    h = f"(({seed}::uhugeint * 281474976710656 + {r}::uhugeint * 4294967296 + {slot}::uhugeint) * {S.A}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    h = f"((xor({h}, {h} >> 32)::uhugeint * {S.B}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
    return f"(xor({h}, {h} >> 29) % {n}::ubigint)::bigint"


def boot_sql(rows: str, tag: str = "") -> str:
    """iv{tag} (slice, value, metric, groups, mean, low, high) of a table (slice, value, group_id, metrics) of queries."""
    means = ", ".join(f"avg({m}) as {m}" for m in V.METRICS)
    long = " union all ".join(f"select slice, value, r, '{m}' as metric, {m} as x from dr{tag}" for m in V.METRICS)
    middle = " union all ".join(f"select slice, value, '{m}' as metric, count(*) as groups, avg({m}) as mean from gm{tag} group by slice, value" for m in V.METRICS)
    return f"""gm{tag} as (select *, row_number() over (partition by slice, value order by group_id nulls first) - 1 as place, count(*) over (partition by slice, value) as n from (select slice, value, group_id, {means} from {rows} group by all)),
  sl{tag} as (select distinct slice, value, n from gm{tag}), dp{tag} as (select slice, value, r, {draws_sql('r', 'slot', 'n', 17)} as place from (select slice, value, n, unnest(range(n)) as slot from sl{tag}), range({REPEATS}) as q(r)),
  dr{tag} as (select slice, value, r, {means} from dp{tag} join gm{tag} using (slice, value, place) group by slice, value, r),
  nt{tag} as (select slice, value, metric, list_sort(list(x)) as xs from ({long}) group by all),
  iv{tag} as (select slice, value, metric, groups, mean, xs[{int(0.025 * REPEATS) + 1}] as low, xs[{int(0.975 * REPEATS) + 1}] as high from nt{tag} join ({middle}) using (slice, value, metric))"""


def sliced_sql(rows: str) -> str:
    return f"select 'all' as slice, 'all' as value, group_id, {METRIC_LIST} from {rows} union all select 'bucket', bucket, group_id, {METRIC_LIST} from {rows} where bucket is not null"


def difference_sql(candidate: str, reference: str, judged: str = "g") -> str:
    parts = ", ".join(f"x.{m} - y.{m} as {m}" for m in V.METRICS)
    return f"select query_id, group_id, bucket, {parts} from {metrics_sql(candidate, judged)} x join {metrics_sql(reference, judged)} y using (query_id) join queries on id = query_id"


def narrow(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


NARROW = "round(mean, 9) as mean, round(low, 9) as low, round(high, 9) as high"


@query("ret_bootstrap", f"""with {QRELS}, {SYSTEMS}, m as (select 'all' as slice, 'all' as value, group_id, x.* exclude (query_id) from {metrics_sql('a')} x join queries on id = query_id), {boot_sql('m')}
  select metric, groups, {NARROW} from iv""", narrow)
def ret_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return S.summarize(scored(spark, sf, "a"), REPEATS)


@query("ret_compare", f"""with {QRELS}, {SYSTEMS}, df as ({difference_sql('a', 'b')}), m as ({sliced_sql('df')}), {boot_sql('m')} select slice, value, metric, groups, {NARROW} from iv""", narrow)
def ret_compare(spark: SparkSession, sf: str) -> DataFrame:
    return S.compare(scored(spark, sf, "b"), scored(spark, sf, "a"), ("bucket",), REPEATS)


CROSSED = f"""{', '.join(shuffled_sql(f'b{s}', s) for s in SEEDS)}, {', '.join(shuffled_sql(f'c{s}', s, 1) for s in SEEDS)},
  m as ({' union all '.join(f"select {i} as k, * from ({difference_sql(f'c{s}', f'b{s}')})" for i, s in enumerate(SEEDS))}),
  gm as (select *, row_number() over (partition by k order by group_id nulls first) - 1 as place, count(*) over (partition by k) as n from (select k, group_id, {', '.join(f'avg({m}) as {m}' for m in V.METRICS)} from m group by all)),
  dp as (select r, {draws_sql('r', 'slot', 'n', 17)} as place from (select n, unnest(range(n)) as slot from (select distinct n from gm)), range({REPEATS}) as q(r)),
  dr as (select k, r, {', '.join(f'avg({m}) as {m}' for m in V.METRICS)} from dp join gm using (place) group by k, r),
  dk as (select r, {draws_sql('r', 'j', '3', 18)} as k from range({REPEATS}) as q(r), range(3) as z(j)),
  dx as (select r, {', '.join(f'avg({m}) as {m}' for m in V.METRICS)} from dk join dr using (r, k) group by r),
  nt as (select metric, list_sort(list(x)) as xs from ({' union all '.join(f"select '{m}' as metric, {m} as x from dx" for m in V.METRICS)}) group by metric),
  md as ({' union all '.join(f"select '{m}' as metric, max(n) as groups, avg({m}) as mean from gm" for m in V.METRICS)})"""


@query("ret_crossed", f"with {QRELS}, {CROSSED} select metric, groups, 3::bigint as runs, round(mean, 9) as mean, round(xs[{int(0.025 * REPEATS) + 1}], 9) as low, round(xs[{int(0.975 * REPEATS) + 1}], 9) as high from nt join md using (metric)", narrow)
def ret_crossed(spark: SparkSession, sf: str) -> DataFrame:
    """Three seeds of two ways to rank."""
    side = lambda name: [scored(spark, sf, name, seed=s).withColumn("run", F.lit(s)) for s in SEEDS]
    b, c = side("b"), side("c")
    return S.crossed(b[0].unionByName(b[1]).unionByName(b[2]), c[0].unionByName(c[1]).unionByName(c[2]), REPEATS)


@query("ret_paired", f"""with {QRELS}, {SYSTEMS}, x as (select * from {metrics_sql('a')}), y as (select * from {metrics_sql('b')})
  select query_id, round(x.recall_at_10 - y.recall_at_10, 9) as recall_at_10, round(x.ndcg_at_10 - y.ndcg_at_10, 9) as ndcg_at_10, round(x.mrr_at_10 - y.mrr_at_10, 9) as mrr_at_10, group_id
  from x join y using (query_id) join queries on id = query_id""")
def ret_paired(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.differences(scored(spark, sf, "b"), scored(spark, sf, "a"))).select("query_id", "group_id", *V.METRICS)


# fixed values: thresholds of the selection
RULES = {"minimum_gain": 0.03, "interval_above": 0.0, "english_regression": 0.01, "latency": 1.25, "memory": 1.25}


ARMS = (("a", 17), ("c", 29))
EXACT = "x as (select query_id, document_id, case grade when 2 then 2 else 0 end as grade from g)"
CASES = [(f"{a}{s}", b, a, s) for a, s in ARMS for b in ("graded", "exact")]


@query("ret_gates", f"""with {QRELS}, {EXACT}, {FIRST.replace('a as', 'a17 as', 1)}, {shuffled_sql('b17', 17)}, {shuffled_sql('c29', 29, 1)},
  {', '.join(f"df{i} as ({difference_sql(arm, 'b17', 'g' if view == 'graded' else 'x')}), m{i} as ({sliced_sql(f'df{i}')}), {boot_sql(f'm{i}', str(i))}" for i, (arm, view, _, _) in enumerate(CASES))},
  t as ({' union all '.join(f"select '{arm}' as arm, '{view}' as budget, * from iv{i} where metric = 'ndcg_at_10'" for i, (arm, view, _, _) in enumerate(CASES))}),
  r as (select arm, budget, max(mean) filter (slice = 'all') as mean, max(low) filter (slice = 'all') as low, coalesce(max(mean) filter (slice = 'bucket' and value = 'english'), 0) as english from t group by all)
  select arm, budget, round(mean, 9) as mean, round(low, 9) as low, round(english, 9) as english, mean >= 0.03 as gain, low > 0 as interval, english >= -0.01 as english_ok, true as latency_ok, true as memory_ok, mean >= 0.03 and low > 0 and english >= -0.01 as passes from r""")
def ret_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways to rank against a shuffle, by graded and by exact judgments; their costs are equal."""
    out = None
    for arm, view, name, seed in CASES:
        exact = view == "exact"
        rows = S.compare(scored(spark, sf, "b", exact), scored(spark, sf, name, exact, seed), ("bucket",), REPEATS).where("metric = 'ndcg_at_10'")
        one = rows.agg(F.max(F.when(F.col("slice") == "all", F.col("mean"))).alias("mean"), F.max(F.when(F.col("slice") == "all", F.col("low"))).alias("low"), F.coalesce(F.max(F.when(F.col("value") == "english", F.col("mean"))), F.lit(0.0)).alias("english"))
        one = one.select(F.lit(arm).alias("arm"), F.lit(view).alias("budget"), "*", F.lit(1.0).alias("latency"), F.lit(1.0).alias("memory"))
        out = one if out is None else out.unionByName(one)
    made = S.gates(out, RULES).drop("latency", "memory")
    return made.withColumns({c: F.round(c, 9) for c in ("mean", "low", "english")})


@query("ret_pool", f"""with {QRELS}, {SYSTEMS}, p as (select query_id, document_id from a where rank <= 10 union select query_id, document_id from b where rank <= 10 union select query_id, document_id from g where grade > 0)
  select query_id, document_id, g.grade is not null as known from p left join g using (query_id, document_id)""")
def ret_pool(spark: SparkSession, sf: str) -> DataFrame:
    return V.candidate_pool([system(spark, sf, "a"), system(spark, sf, "b")], V.qrels(table(spark, sf, "judgments")))


VALID = "grade in (0, 1, 2) and reviewer_origin in ('human', 'agent') and trim(reviewer_id) <> '' and trim(rationale) <> ''"


@query("ret_coverage", f"""with {SYSTEMS}, g as (select query_id, document_id, max(grade) as grade from judgments where {VALID} group by query_id, document_id)
  select count(*) as pairs, count(*) filter (grade is null) as unjudged, round(avg((grade is null)::int), 9) as part from b left join g using (query_id, document_id) where rank <= 10""")
def ret_coverage(spark: SparkSession, sf: str) -> DataFrame:
    judgments = table(spark, sf, "judgments")
    return V.coverage(system(spark, sf, "b"), V.qrels(judgments.where(V.valid_labels(judgments)))).withColumn("part", F.round("part", 9))


@query("ret_label_audit", """with l as (select original_grade, audit_grade from disagreements where audit_reviewer_id is not null
    qualify row_number() over (partition by query_id, document_id, audit_reviewer_id order by audited_at desc, audit_grade desc nulls last, original_grade desc) = 1),
  c as (select original_grade, audit_grade, count(*) as pairs from l where audit_grade is not null and original_grade is not null group by all)
  select *, round(pairs / sum(pairs) over (), 9) as part from c""")
def ret_label_audit(spark: SparkSession, sf: str) -> DataFrame:
    return V.confusion(V.latest_audits(table(spark, sf, "disagreements"))).withColumn("part", F.round("part", 9))


@query("ret_label_counts", "select reviewer_id, reviewer_origin, grade, count(*) as labels, count(distinct query_id) as queries from judgments group by all")
def ret_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "judgments").groupBy("reviewer_id", "reviewer_origin", "grade").agg(F.count("*").alias("labels"), F.countDistinct("query_id").alias("queries"))


@query("ret_excluded_groups", "select id, group_id from queries where group_id not in (select q.group_id from judgments j join queries q on q.id = j.query_id where j.rationale is null and q.group_id is not null)")
def ret_excluded_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A judgment without rationale fails its query's group."""
    queries = table(spark, sf, "queries").select("id", "group_id")
    failed = table(spark, sf, "judgments").where("rationale is null").join(queries.withColumnRenamed("id", "query_id"), "query_id").where("group_id is not null")
    return V.exclude_groups(queries, "group_id", failed).select("id", "group_id")


@query("ret_unjudged", """select id as query_id, 'left' as only_in from queries where id not in (select query_id from judgments)
  union all select distinct query_id, 'right' from judgments where query_id not in (select id from queries)""")
def ret_unjudged(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_either(table(spark, sf, "queries").withColumnRenamed("id", "query_id"), table(spark, sf, "judgments"), ["query_id"])


LOOKUP = f"""l as (select t as text, arg_max(g, rid) as group_id, arg_max(bucket, rid) as bucket from (select rid, {NORMAL} as t, coalesce(group_id, '') as g, coalesce(bucket, '') as bucket from records where text is not null) group by t)"""
PAIRS = f"""p as (select id, {NORMAL.replace('text', 'q_bl')} as query, {NORMAL.replace('text', 'bn')} as document, source_group from business where q_bl is not null and bn is not null)"""


def intent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "business").where("q_bl is not null and bn is not null").select("id", F.col("q_bl").alias("query"), F.col("bn").alias("document"), F.col("source_group").alias("group_id"), F.col("domain").alias("source"))


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each text."""
    rows = table(spark, sf, "records").where("text is not null").select("rid", T.normalize("text").alias("text"), F.coalesce("group_id", F.lit("")).alias("group_id"), F.coalesce("bucket", F.lit("")).alias("bucket"))
    last = rows.groupBy("text").agg(F.max(F.struct("rid", "group_id", "bucket")).alias("x"))
    return last.select("text", "x.group_id", "x.bucket")


@query("ret_pair_reasons", f"""with {LOOKUP}, {PAIRS}, j as (select p.*, a.group_id as ga, b.group_id as gb, a.bucket as ba, b.bucket as bb from p left join l a on a.text = query left join l b on b.text = document)
  select case when not coalesce(ga = gb, false) then 'not_same_training_group' when not coalesce(ba in ('banglish', 'code-mixed') and bb = 'bangla', false) then 'unexpected_language_bucket'
    when {key_sql('query')} = {key_sql('document')} then 'identity_pair' when len(string_split(query, ' ')) < 3 or len(string_split(document, ' ')) < 3 then 'short_pair' end as reason, count(*) as pairs from j group by 1""")
def ret_pair_reasons(spark: SparkSession, sf: str) -> DataFrame:
    pairs = intent_pairs(spark, sf).select("id", "query", "document")
    return V.pair_reasons(pairs, lookup(spark, sf), ("banglish", "code-mixed")).groupBy("reason").agg(F.count("*").alias("pairs"))


QUOTAS = {"banking": 60, "business": 60, "science": 60}


@query("ret_select_pairs", f"""with recursive p as (select id, {NORMAL.replace('text', 'q_bl')} as nq, {NORMAL.replace('text', 'bn')} as nd, q_bl as query, bn as document, source_group as group_id, domain as source from business where q_bl is not null and bn is not null and domain in ({', '.join(f"'{d}'" for d in QUOTAS)})),
  od as (select *, row_number() over (order by case source {' '.join(f"when '{d}' then {i}" for i, d in enumerate(QUOTAS))} end, sha256('17:' || id), id) as i, ['g:' || group_id, 't:' || {key_sql('query')}, 't:' || {key_sql('document')}] as ks from p),
  gr(i, taken, ids, src, n) as (select 0::bigint, []::varchar[], []::varchar[], '', 0::bigint union all
    select gr.i + 1, case when ok then list_concat(taken, ks) else taken end, case when ok then list_append(ids, id) else ids end, source, case when source <> src then 0 else n end + ok::int from
      (select gr.*, od.*exclude (i), not list_has_any(taken, ks) and (source <> src or n < 60) as ok from gr join od on od.i = gr.i + 1) gr)
  select id, query, document, group_id, source from od, (select ids from gr order by i desc limit 1) l where list_contains(l.ids, id)""")
def ret_select_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of intents that share neither source group nor text, up to a quota of each domain."""
    return V.select_pairs(intent_pairs(spark, sf), QUOTAS)


@query("ret_directed_qrels", """with d as (select id, split, a, b, [q_bn, q_bl, q_en][a] as q, [bn, bl, en][b] as d from business, range(1, 4) as x(a), range(1, 4) as y(b))
  select split, ['bn', 'bl', 'en'][a] || '-' || ['bn', 'bl', 'en'][b] as direction, id || ':' || ['bn', 'bl', 'en'][a] as query_id, id || ':' || ['bn', 'bl', 'en'][b] as document_id, 2 as grade from d where q is not null and d is not null""")
def ret_directed_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return V.directed_qrels(table(spark, sf, "business"))


@query("ret_domain_split", """select id, domain, case when row_number() over (partition by domain order by sha256('17:' || id), id) <= greatest(1, floor(count(*) over (partition by domain) * 0.3)) then 'test' else 'development' end as split from business""")
def ret_domain_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.held_part(table(spark, sf, "business").select("id", "domain"), ["domain"], "id")


@query("ret_stratified", "select doc_id, lang from documents qualify row_number() over (partition by lang order by sha256('17:' || doc_id::varchar), doc_id) <= 64")
def ret_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 64)


@query("ret_shuffle", "select id, row_number() over (order by sha256('17:' || id), id) as place from queries")
def ret_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return R.hash_rank(table(spark, sf, "queries").select("id"), [], "id").select("id", F.col("rank").alias("place"))


@query("ret_resample", """with o as (select id, row_number() over (order by sha256('17:' || id), id) as place, count(*) over () as n from queries)
  select s as slot, id from range(500) as r(s) join o on place = ('0x' || substr(sha256('17/' || s::varchar), 1, 15))::bigint % n + 1""")
def ret_resample(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_replacement(table(spark, sf, "queries").select("id"), "id", 500)


@query("ret_distribution", "select l_returnflag, count(*) as n, round(median(l_extendedprice), 6) as p50, round(quantile_disc(l_extendedprice, 0.95), 6) as p95, round(quantile_disc(l_extendedprice, 0.99), 6) as p99 from lineitem group by l_returnflag")
def ret_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = S.distribution(table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double")), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("ret_sparsemax", """with l as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as m from l group by label, i),
  p as (select label, vec_id, round(8 * sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 7) as score from l join m using (label, i) group by label, vec_id),
  o as (select *, row_number() over w as i, sum(score) over (w rows unbounded preceding) as c from p window w as (partition by label order by score desc, vec_id)),
  t as (select label, max(i) as i, max_by(c, i) as c from o where 1 + i * score > c group by label)
  select label, vec_id, round(greatest(score - (t.c - 1) / t.i, 0), 5) as weight from o join t using (label)""")
def ret_sparsemax(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's vectors weighted by the sparsemax of their cosines with its mean vector."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    means = Scratch(spark, "means").save(S.mean_vectors(e, "label", "v"), "means")
    unit = e.join(means, "label").select("label", "vec_id", S.l2("v").alias("v"), "vector")  # one row for each label, broadcast by AQE if small
    cosine = F.aggregate(F.zip_with("v", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scores = unit.select("label", "vec_id", F.round(8 * cosine, 7).alias("score"))
    return S.sparsemax(scores, "label", "vec_id", "score").withColumn("weight", F.round("weight", 5))


@query("ret_mean_vectors", """with l as (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as x from l group by label, i)
  select label, i, round(x / sqrt(sum(x * x) over (partition by label)), 7) as x from m""")
def ret_mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return S.mean_vectors(e, "label", "embedding").select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 7).alias("x"))


PPMI = f"""{IDS}, pl as (select ids, unnest(range(1, len(ids) + 1)) as i from enc), pr as (select ids[i] as a, ids[i + k] as b from pl, range(1, 3) as x(k) where i + k <= len(ids)),
  bo as (select a as id, b as n from pr union all select b, a from pr), ct as (select id, ((n::bigint * 2654435761) & 4294967295) % 512 as col, count(*) as c from bo group by all),
  ri as (select id, sum(c) as r from ct group by id), ci as (select col, sum(c) as k from ct group by col),
  pm as (select id, col, ln(greatest(c * (select sum(c) from ct) / greatest(r * k, 1), 1.0)) as value from ct join ri using (id) join ci using (col))"""


@query("ret_ppmi", f"with recursive {PPMI} select id, col, round(value, 9) as value from pm where value > 0")
def ret_ppmi(spark: SparkSession, sf: str) -> DataFrame:
    return S.ppmi(encoded(spark, sf), "ids").withColumn("value", F.round("value", 9))


@query("ret_overlap_surfaces", f"""with s as (select id, unnest([en, bn, bl, q_en, q_bn, q_bl]) as text from business), k as (select id, {key_sql(NORMAL)} as k from s where text is not null)
  select k, count(distinct id) as intents from k where k <> '' group by k having count(distinct id) > 1""")
def ret_overlap_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Surfaces that several intents share."""
    b = table(spark, sf, "business").select("id", F.explode(F.array("en", "bn", "bl", "q_en", "q_bn", "q_bl")).alias("text"))
    keys = b.select("id", T.key(T.normalize("text")).alias("k")).where("k <> ''")
    return keys.groupBy("k").agg(F.countDistinct("id").alias("intents")).where("intents > 1")


@query("ret_source_splits", "select source_id, count(distinct split) as splits, count(*) as intents from business group by source_id")
def ret_source_splits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "business").groupBy("source_id").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("intents"))


@query("ret_workload", f"""with t as (select min(id) as id, t as text from (select id, {NORMAL} as t from queries where text is not null) where t <> '' group by t), o as (select * from t order by sha256('17:' || id), id limit 10000)
  select id, n::int as n, array_to_string(list_slice(flatten([string_split(text, ' ') for i in range(n)]), 1, n), ' ') as text from o, (values (128), (512)) as z(n)""")
def ret_workload(spark: SparkSession, sf: str) -> DataFrame:
    return V.workload(table(spark, sf, "queries"), "id", "text")


@query("ret_throughput", """with d as (select lang, sum(strlen(text)) as bytes, count(text) as texts, sum(n_chars) / 1e6 + 1 as seconds from documents group by lang)
  select lang, round(bytes / 1e6 / seconds, 9) as mb_per_second, round(texts / seconds, 9) as texts_per_second, round(seconds * 1e6 / texts, 9) as us_per_text from d where texts > 0""")
def ret_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of a reading that takes a second and a microsecond for each character."""
    made = table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("texts"), (F.sum("n_chars") / 1e6 + 1).alias("seconds"))
    rates = S.throughput(made.where("texts > 0"), "seconds", "bytes", "texts")
    return rates.select("lang", *[F.round(c, 9).alias(c) for c in ("mb_per_second", "texts_per_second", "us_per_text")])


@query("rev_packet", """with p as (select distinct query_id, document_id from judgments), r as (select p.*, q.group_id, q.text as query, d.text as document from p join queries q on q.id = query_id join documents d on d.id = document_id),
  c as (select group_id from (select distinct group_id from r where group_id is not null) order by sha256('17:' || group_id), group_id limit 30)
  select query_id, document_id, r.group_id, query, document, c.group_id is not null as calibration from r left join c using (group_id)""")
def rev_packet(spark: SparkSession, sf: str) -> DataFrame:
    out = W.packet(table(spark, sf, "judgments"), table(spark, sf, "queries"), table(spark, sf, "documents"))
    return out.drop("grade", "rationale", "reviewer_id", "reviewer_origin")


@query("rev_label_problems", f"""with e as (select distinct query_id, document_id from disagreements), j as (select * from judgments)
  select query_id, document_id, 'twice' as problem from j group by all having count(*) > 1
  union all select distinct query_id, document_id, 'unknown' from j where (query_id, document_id) not in (select (query_id, document_id) from e)
  union all select distinct query_id, document_id, 'invalid' from j where not coalesce({VALID}, false)
  union all select query_id, document_id, 'missing' from e where (query_id, document_id) not in (select (query_id, document_id) from j)""")
def rev_label_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The first grades as labels of the audited pairs."""
    return W.label_problems(table(spark, sf, "disagreements"), table(spark, sf, "judgments"))


@query("rev_expansion_problems", f"""with k as (select distinct {key_sql(NORMAL)} as k from heldout), r as (select rid, source, group_id, split, {key_sql(NORMAL)} as k from records)
  select 'reserved surface in train' as problem, rid::varchar as what from r where split = 'train' and k <> '' and k in (select k from k)
  union all select 'reserve row', rid::varchar from r where source = 'duplicate'
  union all select 'group in several splits', group_id from r where group_id is not null group by group_id having min(split) <> max(split)""")
def rev_expansion_problems(spark: SparkSession, sf: str) -> DataFrame:
    return W.expansion_problems(table(spark, sf, "records"), table(spark, sf, "heldout"), "duplicate")


FACES = f"""fa as (select {NORMAL.replace('text', 'face')} as text, source_group as group_id, bucket, split, id from (select id, source_group, split, unnest([q_bl, bn]) as face, unnest(['banglish', 'bangla']) as bucket from business) where face is not null),
  lk as (select text, arg_max(group_id, id || bucket) as group_id, arg_max(bucket, id || bucket) as bucket, arg_max(split, id || bucket) as split from fa group by text)"""
COUNT, DOCUMENTS = 300, 2000


def pilot_sql(what: str) -> str:
    """Greedy choice of pairs that share no group and no key, and documents with new keys, both in seeded order."""
    return f"""with recursive {FACES}, {PAIRS}, dv as (select * from lk where lower(trim(split)) = 'development'),
  el as (select p.id, a.group_id, query, document from p join dv a on a.text = query join dv b on b.text = document where a.group_id = b.group_id and a.bucket in ('banglish', 'code-mixed') and b.bucket = 'bangla' and len(string_split(query, ' ')) >= 3 and len(string_split(document, ' ')) >= 3),
  od as (select *, row_number() over (order by sha256('17:' || id), id) as i, ['g:' || group_id, 't:' || {key_sql('query')}, 't:' || {key_sql('document')}] as ks from el),
  gr(i, taken, ids) as (select 0::bigint, []::varchar[], []::varchar[] union all select gr.i + 1, case when list_has_any(taken, ks) or len(ids) >= {COUNT} then taken else list_concat(taken, ks) end, case when list_has_any(taken, ks) or len(ids) >= {COUNT} then ids else list_append(ids, od.id) end from gr join od on od.i = gr.i + 1),
  ch as (select od.* from od, (select ids from gr order by i desc limit 1) l where list_contains(l.ids, od.id)),
  mine as (select id, group_id, document as text, {key_sql('document')} as k from ch),
  pool as (select rid::varchar as id, group_id, text, {key_sql(NORMAL)} as k from records where bucket = 'bangla'),
  oth as (select * from pool where k <> '' and k not in (select k from mine) qualify row_number() over (partition by k order by sha256('17:' || id), id) = 1),
  docs as (select id, group_id, text from mine union all select id, group_id, text from (select * from oth order by sha256('17:' || id), id limit {DOCUMENTS} - (select count(*) from ch))) {what}"""


def pilot(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The pilot of eligible intent pairs of the development split, as far as the tables reach."""
    b = table(spark, sf, "business")
    faces = F.explode(F.array(F.struct(F.col("q_bl").alias("text"), F.lit("banglish").alias("bucket")), F.struct(F.col("bn").alias("text"), F.lit("bangla").alias("bucket"))))
    rows = b.select("id", "source_group", "split", faces.alias("x")).where("x.text is not null").select(T.normalize("x.text").alias("text"), "source_group", "x.bucket", "split", "id")
    last = rows.groupBy("text").agg(F.max_by(F.struct(F.col("source_group").alias("group_id"), "bucket", "split"), F.concat("id", "bucket")).alias("x"))
    pairs = V.pilot_pairs(intent_pairs(spark, sf).select("id", "query", "document"), last.select("text", "x.*"), "development")
    pool = table(spark, sf, "records").where("bucket = 'bangla'").select(F.col("rid").cast("string").alias("id"), "group_id", "text")
    return W.pilot(pairs, pool, COUNT, DOCUMENTS, strict=False)


@query("rev_pilot", pilot_sql("select id, group_id, text from docs"))
def rev_pilot(spark: SparkSession, sf: str) -> DataFrame:
    return pilot(spark, sf)[1]


@query("rev_pilot_shortfall", pilot_sql(f"select 'pairs' as what, {COUNT}::bigint as wanted, count(*) as reached from ch union all select 'documents', {DOCUMENTS}::bigint, count(*) from docs"))
def rev_pilot_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    pairs, docs = pilot(spark, sf)
    count = lambda df, what, wanted: df.agg(F.count("*").alias("reached")).select(F.lit(what).alias("what"), F.lit(wanted).cast("bigint").alias("wanted"), "reached")
    return count(pairs, "pairs", COUNT).unionByName(count(docs, "documents", DOCUMENTS))


@query("rev_encode_once", f"with recursive {ids_sql('queries', 'id')} select id, text, array_to_string(ids, ' ') as ids from enc right join queries using (id)")
def rev_encode_once(spark: SparkSession, sf: str) -> DataFrame:
    encode = K.encoder(K.from_pieces(table(spark, sf, "pieces")))
    made = W.encode_once(table(spark, sf, "queries").select("id", "text"), "text", encode, "ids")
    return made.withColumn("ids", F.array_join("ids", " "))
