"""Corpus queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.plans.catalog import query
from corpusloom.runtime import spread, table

BLANK = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
PRIVATE = T.PRIVATE.replace("'", "''")
NORMAL = rf"trim(regexp_replace(nfc_normalize(text), '{BLANK}', ' ', 'g'))"


def key_sql(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'))"


def records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "records"), "rid")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


#: records in normal form with key and acceptance, the base of several statements
ROWS = rf"""
n as (select *, {NORMAL} as t from records),
r as (select *, {key_sql("t")} as key from n),
q as (select rid, t, key, bucket, source, attribution, nullif(trim(group_id), '') as g, lower(trim(split)) as s,
  coalesce(length(t) between 12 and 2000 and not contains(t, '{chr(0xFFFD)}') and key <> '' and not regexp_matches(t, '{PRIVATE}'), false) as ok from r)"""


@query("corpus_normalize", rf"""with {ROWS.strip()} select rid, t as text, key, length(t) as runes, strlen(t) as bytes,
  case when t = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end as words from q where t is not null""")
def corpus_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.normalized(records(spark, sf)).where("text is not null")
    return rows.select("rid", "text", "key", F.length("text").cast("bigint").alias("runes"), F.octet_length("text").cast("bigint").alias("bytes"), F.size(T.words("text")).cast("bigint").alias("words"))


@query("corpus_quality", f"with {ROWS.strip()} select ok, bucket, count(*) as records from q group by ok, bucket")
def corpus_quality(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalized(records(spark, sf)).groupBy("ok", "bucket").agg(F.count("*").alias("records"))


@query("corpus_features", r"""select rid, regexp_matches(text, '\p{Bengali}') as has_bengali, regexp_matches(text, '\p{Latin}') as has_latin,
  regexp_matches(text, '\p{Nd}') as has_digit, regexp_matches(text, '\p{Bengali}') and regexp_matches(text, '\p{Latin}') as mixed from records where text is not null""")
def corpus_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records").where("text is not null").select("rid", *[v.alias(k) for k, v in T.script_features("text").items()])


@query("corpus_hash_columns", """select id, 'article:' || substr(sha256(id), 1, 32) as group_hash,
  ('0x' || substr(sha256(id), 1, 2))::int % 5 = 0 as sampled,
  case when ('0x' || substr(sha256('bn-corpus-v1:' || coalesce(group_id, id)), 1, 16))::ubigint % 100 < 2 then 'test'
       when ('0x' || substr(sha256('bn-corpus-v1:' || coalesce(group_id, id)), 1, 16))::ubigint % 100 < 4 then 'validation' else 'train' end as split
  from documents""")
def corpus_hash_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("id", T.group_id("article", "id").alias("group_hash"), T.hash_byte_sample("id").alias("sampled"), T.hash_split(F.coalesce("group_id", "id")).alias("split"))


@query("corpus_first_links", f"""with {ROWS.strip()},
  a as (select rid as u, min(rid) over (partition by g) as v from q where g is not null),
  b as (select rid as u, min(rid) over (partition by key) as v from q where key <> '')
  select u, v, 'group' as kind from a where u <> v union all select u, v, 'key' as kind from b where u <> v""")
def corpus_first_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.normalized(records(spark, sf)).withColumn("group_id", C.blank_is_null("group_id"))
    return C.first_links(rows, "group_id").withColumn("kind", F.lit("group")).unionByName(C.first_links(rows, "key").withColumn("kind", F.lit("key")))


@query("corpus_dedupe", f"with {ROWS.strip()} select key, min(rid) as rid, count(*) as copies from q where ok group by key")
def corpus_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalized(records(spark, sf)).where("ok").groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))


HASH = """
w as (select rid, unnest(list_filter(string_split(lower(t), ' '), lambda x: x <> '')) as word from q where key <> ''),
b as (select distinct word, sha256(word) as h from w),
bits as (select word, i, (('0x' || substr(h, 2 * (i // 8) + 1, 2))::int >> (i % 8)) & 1 as bit from b, range(64) as x(i)),
v as (select rid, i, 2 * sum(bit) >= count(*) as up, count(*) as n from w join bits using (word) group by rid, i),
sim as (select rid, sum(case when up and i < 63 then 1::hugeint << i::int when up then -(1::hugeint << 63) else 0 end)::bigint as h from v where n >= 12 group by rid)"""


@query("corpus_simhash", f"with {ROWS.strip()}, {HASH.strip()} select rid, h from sim")
def corpus_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return C.hashed(C.normalized(records(spark, sf)))


@query("corpus_near_pairs", f"""with {ROWS.strip()}, {HASH.strip()}, d as (select distinct h from sim)
  select a.h as a, b.h as b from d a join d b on a.h < b.h where bit_count(xor(a.h, b.h)) <= 3""")
def corpus_near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs between classes of one hash; corpus_simhash has the members."""
    return C.near_hashes(C.hashed(C.normalized(records(spark, sf))))


RECURSIVE = f"""{ROWS.strip()}, {HASH.strip()}, d as (select h, min(rid) as f from sim group by h),
e as (select rid as u, min(rid) over (partition by g) as v from q where g is not null
  union all select rid, min(rid) over (partition by key) from q where key <> ''
  union all select sim.rid, d.f from sim join d using (h)
  union all select a.f, b.f from d a join d b on a.h < b.h where bit_count(xor(a.h, b.h)) <= 3),
e2 as (select distinct u, v from (select u, v from e union all select v, u from e) where u <> v),
cc(rid, root) using key (rid) as (select rid, rid from q
  union select e2.u, min(cc.root) from cc join e2 on e2.v = cc.rid join recurring.cc as old on old.rid = e2.u where cc.root < old.root group by e2.u),
c as (select root, max(case s when 'test' then 2 when 'validation' then 1 else 0 end) as held, coalesce(min(g), 'record:' || min(rid)) as name
  from q join cc using (rid) group by root),
k as (select min(rid) as rid from q where ok group by key),
p as (select q.rid, t as text, bucket, source, name as group_id, attribution, case held when 2 then 'test' when 1 then 'validation' else
  case when ('0x' || substr(sha256('bn-corpus-v1:' || name), 1, 16))::ubigint % 100 < 2 then 'test'
       when ('0x' || substr(sha256('bn-corpus-v1:' || name), 1, 16))::ubigint % 100 < 4 then 'validation' else 'train' end end as split
  from k join q using (rid) join cc using (rid) join c using (root))"""
PREPARE = f"with recursive {RECURSIVE}"


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return C.prepare(records(spark, sf))


@query("corpus_prepare", f"{PREPARE} select rid, text, bucket, source, group_id, attribution, split from p")
def corpus_prepare(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).drop("arrived_at")


@query("corpus_prepare_counts", f"{PREPARE} select split, bucket, count(*) as records, sum(length(text))::bigint as characters from p group by split, bucket")
def corpus_prepare_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_bucket_counts(prepared(spark, sf))


@query("corpus_prepare_rounds", f"{PREPARE} select rid, text, bucket, source, group_id, attribution, split from p")
def corpus_prepare_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """corpus_prepare with all rounds of label propagation distributed, as they are on more links than one task takes."""
    return C.prepare(records(spark, sf), few=0).drop("arrived_at")


@query("corpus_prepare_stats", f"""{PREPARE}, es as (
    select distinct u, v, greatest(u, v) as late, kind, least(u, v) as early from (
      select rid as u, min(rid) over (partition by g) as v, 0 as kind from q where g is not null
      union all select rid, min(rid) over (partition by key), 1 from q where key <> ''
      union all select sim.rid, d.f, 2 from sim join d using (h)
      union all select a.f, b.f, 2 from d a join d b on a.h < b.h where bit_count(xor(a.h, b.h)) <= 3) where u <> v),
  eo as (select *, row_number() over (order by late, kind, early) as w from es),
  two as (select u, v, w from eo union all select v, u, w from eo),
  reach(w, node) as (select w, u from eo where kind = 2 union select reach.w, two.v from reach join two on two.u = reach.node and two.w < reach.w),
  joined as (select eo.w from eo where kind = 2 and not exists (select 1 from reach where reach.w = eo.w and reach.node = eo.v))
  select count(*) as input_records, count(*) filter (not ok) as quality_rejected, count(*) filter (ok) - (select count(*) from p) as duplicates_removed, (select count(*) from joined) as near_duplicate_links from q""")
def corpus_prepare_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    return C.prepare_stats(rows, C.prepare(rows))


SURFACES = ("bn", "bl", "en", "q_bn", "q_bl", "q_en")


@query("corpus_expand", f"""with recursive combined as (select rid, text, bucket, source, group_id, attribution, split from records
    union all select (2::bigint << 56) + rank * 6 + i - 1, [bn, bl, en, q_bn, q_bl, q_en][i], 'english', 'benchmark-reserve', 'agent-domain:' || id, 'kept for evaluation', 'test'
      from (select *, row_number() over (order by sha256('17:' || id), id) as rank from business), range(1, 7) as x(i) where [bn, bl, en, q_bn, q_bl, q_en][i] is not null),
  {RECURSIVE.replace("from records", "from combined")} select rid, text, bucket, source, group_id, attribution, split from p where source is distinct from 'benchmark-reserve'""")
def corpus_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The records prepared together with the intent material, which only blocks."""
    rows = records(spark, sf).drop("arrived_at")
    return C.expand(rows, None, table(spark, sf, "business"), "id", SURFACES)


SPLIT = "coalesce(lower(trim(split)), '')"


@query("corpus_split_guard", f"""with r as (select {SPLIT} as split from records)
  select 'fitting' as use, split, count(*) as records from r where split <> 'train' group by split
  union all select 'evaluation', split, count(*) from r where split not in ('validation', 'test') group by split""")
def corpus_split_guard(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that fitting and evaluation refuse."""
    rows = table(spark, sf, "records")
    fit, held = C.split_problems(rows, ("train",)), C.split_problems(rows, ("validation", "test"))
    return fit.withColumn("use", F.lit("fitting")).unionByName(held.withColumn("use", F.lit("evaluation"))).select("use", "split", "records")


@query("corpus_required", """select rid, case when coalesce(group_id, '') = '' or coalesce(source, '') = '' or coalesce(bucket, '') = '' then 'incomplete' else 'unknown split' end as problem from records
  where coalesce(group_id, '') = '' or coalesce(source, '') = '' or coalesce(bucket, '') = '' or coalesce(split, '') not in ('', 'train', 'validation', 'test')""")
def corpus_required(spark: SparkSession, sf: str) -> DataFrame:
    return C.record_problems(table(spark, sf, "records"))


@query("corpus_audit", rf"""with {ROWS.strip()}, o as (select q.rid, key, group_id, split from q join records using (rid))
  select 'duplicate key' as problem, key as what, count(*) as records from o where key <> '' group by key having count(*) > 1
  union all select 'group in several splits', group_id, count(*) from o where group_id is not null group by group_id having min(split) <> max(split)
  union all select 'split', coalesce(split, ''), count(*) from o where coalesce(split not in ('train', 'validation', 'test'), true) group by split
  union all select 'empty group', '', count(*) from o where coalesce(group_id, '') = '' having count(*) > 0""")
def corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.audit(records(spark, sf))


@query("corpus_audit_counts", """select split, source, grouping_id(split, source)::bigint as level, count(*) as records, count(distinct group_id) as groups
  from records group by grouping sets ((split, source), (split), ())""")
def corpus_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.audit_counts(table(spark, sf, "records"))


@query("corpus_group_violations", "select group_id, count(distinct split) as splits from records where group_id is not null group by group_id having count(distinct split) > 1")
def corpus_group_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.group_violations(table(spark, sf, "records"), "group_id", "split")


KEYS = {t: f"select *, {key_sql(NORMAL)} as k from {t}" for t in ("documents", "heldout", "business")}


HELD = f"with r as (select rid, {SPLIT} as s, {key_sql(NORMAL)} as k from records)"


@query("corpus_holdout", f"""{HELD} select 'heldout:' || h.item_id as item, 'documents:' || d.doc_id as what from ({KEYS['documents']}) d join ({KEYS['heldout']}) h using (k) where k <> ''
  union all select 'records:' || h.rid, 'records:' || d.rid from r h join r d using (k) where k <> '' and h.s in ('validation', 'test') and d.s not in ('validation', 'test')""")
def corpus_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are a test item, and records that are not held out though a copy of them is."""
    items, rows = table(spark, sf, "heldout"), records(spark, sf)
    first = C.holdout_hits(documents(spark, sf), "doc_id", "text", items, "item_id", "text")
    held = F.coalesce(F.lower(F.trim("split")), F.lit("")).isin("validation", "test")
    second = C.holdout_hits(rows.where(~held), "rid", "text", rows.where(held).withColumnRenamed("rid", "item"), "item", "text")
    name = lambda df, a, x, b, y: df.select(F.concat(F.lit(f"{x}:"), F.col(a).cast("string")).alias("item"), F.concat(F.lit(f"{y}:"), F.col(b).cast("string")).alias("what"))
    return name(first, "item_id", "heldout", "doc_id", "documents").unionByName(name(second, "item", "records", "rid", "records"))


@query("corpus_word_counts", f"""with n as (select bucket, list_filter(string_split({NORMAL}, ' '), lambda x: x <> '') as w from records where text is not null and bucket is not null),
  r as (select * from n where len(w) > 0), per as (select bucket, count(*) as texts from r group by bucket),
  one as (select bucket, 1.0::double / len(w) as part, unnest(w) as word from r),
  s as (select bucket, word, sum(part) as part from one where length(word) <= 64 group by bucket, word)
  select word, round(sum(part * 1e6 / (select count(*) from per) / texts), 4) as weight from s join per using (bucket) group by word""")
def corpus_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.word_counts(records(spark, sf)).withColumn("weight", F.round("weight", 4))


MIXTURE = {"bangla": 0.4, "english": 0.25, "banglish": 0.25, "code-mixed": 0.1}


@query("corpus_mixture_counts", f"""with m(bucket, part) as (values {', '.join(f"('{b}', {x})" for b, x in MIXTURE.items())}),
  n as (select bucket, list_filter(string_split({NORMAL}, ' '), lambda x: x <> '') as w from records where text is not null and bucket is not null),
  r as (select * from n where len(w) > 0), per as (select bucket, count(*) as texts from r group by bucket),
  one as (select bucket, 1.0::double / len(w) as part, unnest(w) as word from r),
  s as (select bucket, word, sum(part) as x from one where length(word) <= 64 group by bucket, word)
  select word, round(sum(x * m.part * 1e6 / texts), 4) as weight from s join per using (bucket) join m using (bucket) group by word""")
def corpus_mixture_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.word_counts(records(spark, sf), MIXTURE).withColumn("weight", F.round("weight", 4))


@query("corpus_paragraphs", rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents),
  k as (select *, row_number() over (partition by doc_id order by place) as n from l
    where len(list_filter(string_split(trim(regexp_replace(paragraph, '{BLANK}', ' ', 'g')), ' '), lambda x: x <> '')) >= 8)
  select doc_id, place::int as place, paragraph from k where n <= 10""")
def corpus_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return C.paragraphs(documents(spark, sf), "doc_id", "text")


def words_sql(source: str, key: str) -> str:
    return rf"""select {key}, list_transform(list_filter(string_split({NORMAL}, ' '), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'))) as w from {source} where text is not null"""


def runs_sql(source: str, key: str, n: int) -> str:
    return f"select distinct {key}, array_to_string(w[i:i+{n - 1}], ' ') as run from ({words_sql(source, key)}), range(1, 100000) as x(i) where i <= len(w) - {n - 1}"


@query("corpus_overlap", rf"""with a as (select distinct doc_id, array_to_string(w[i:i+7], ' ') as run from (select doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) as i from ({words_sql("documents", "doc_id")}))),
  b as (select distinct item_id, array_to_string(w[i:i+7], ' ') as run from (select item_id, w, unnest(range(1, greatest(len(w) - 6, 1))) as i from ({words_sql("heldout", "item_id")}))),
  z as (select item_id, count(*) as size from b group by item_id),
  s as (select item_id, doc_id, count(*) as shared from a join b using (run) group by item_id, doc_id)
  select item_id, doc_id, 'containment' as kind from s join z using (item_id) where shared >= 3 and shared >= 0.8 * size
  union select h.item_id, d.doc_id, 'canonical' from ({KEYS['documents']}) d join ({KEYS['heldout']}) h using (k) where k <> ''""")
def corpus_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return C.overlaps(documents(spark, sf), "doc_id", "text", table(spark, sf, "heldout"), "item_id", "text")


RESERVED = """unnest([en, bn, bl, q_en, q_bn, q_bl]) as text from business where split = 'test' union all select unnest(q_bl_variants) from business where split = 'test'"""


@query("corpus_reserved_surfaces", f"""with k as (select distinct {key_sql(NORMAL)} as k from (select {RESERVED}) where text is not null),
  t as (select 'records' as source, rid::varchar as id, text from records union all select 'documents', doc_id::varchar, text from documents union all
    select 'development', id, unnest([en, bn, bl, q_en, q_bn, q_bl]) from business where split = 'development'),
  r as (select source, id, {key_sql(NORMAL)} as k from t where text is not null)
  select distinct source, id from r where k <> '' and k in (select k from k)""")
def corpus_reserved_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Records, documents and development intents that repeat a surface of the test intents, which are reserved."""
    b = table(spark, sf, "business")
    plain = F.array("en", "bn", "bl", "q_en", "q_bn", "q_bl")
    surfaces = b.where("split = 'test'").select(F.explode(F.concat(plain, F.coalesce("q_bl_variants", F.array().cast("array<string>")))).alias("text")).where("text is not null")
    surfaces = surfaces.distinct().withColumn("item", F.lit(1))
    rows = records(spark, sf).select(F.struct(F.lit("records").alias("source"), F.col("rid").cast("string").alias("id")).alias("at"), "text")
    rows = rows.unionByName(documents(spark, sf).select(F.struct(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id")).alias("at"), "text"))
    rows = rows.unionByName(b.where("split = 'development'").select(F.struct(F.lit("development").alias("source"), "id").alias("at"), F.explode(plain).alias("text")))
    return C.holdout_hits(rows, "at", "text", surfaces, "item", "text").select("at.source", "at.id").distinct()


AUDITED = (("documents", "doc_id", ("text",)), ("queries", "id", ("text",)), ("heldout", "item_id", ("text",)))


@query("corpus_overlap_audit", rf"""with f as (select id as intent, unnest([bn, bl, en]) as text, unnest([0, 1, 2]) as place from business),
  t as ({' union all '.join(f"select '{t}' as input, '{c}' as field, {k}::varchar as key, {c} as text from {t}" for t, k, cs in AUDITED for c in cs)} union all
    select 'intents', 'query', id, q_bl from business union all select 'intents', 'document', id, bn from business),
  a as (select distinct input, field, key, array_to_string(w[i:i+7], ' ') as run from (select *, unnest(range(1, greatest(len(w) - 6, 1))) as i from (
    select input, field, key, list_transform(list_filter(string_split({NORMAL}, ' '), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'))) as w from t where text is not null))),
  b as (select distinct intent, place, array_to_string(w[i:i+7], ' ') as run from (select *, unnest(range(1, greatest(len(w) - 6, 1))) as i from (
    select intent, place, list_transform(list_filter(string_split({NORMAL}, ' '), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'))) as w from f where text is not null))),
  z as (select intent, place, count(*) as size from b group by all), s as (select intent, place, input, field, key, count(*) as shared from a join b using (run) group by all)
  select distinct input, field, key, intent, 'containment' as kind from s join z using (intent, place) where shared >= 3 and shared >= 0.8 * size
  union select input, field, t.key, intent, 'canonical' from (select *, {key_sql(NORMAL)} as k from t) t join (select *, {key_sql(NORMAL)} as k from f) f using (k) where k <> ''""")
def corpus_overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, queries and documents of four tables that repeat a document of the intents."""
    b = table(spark, sf, "business")
    inputs = {"documents": documents(spark, sf).withColumnRenamed("doc_id", "key"), "queries": table(spark, sf, "queries").withColumnRenamed("id", "key"), "heldout": table(spark, sf, "heldout").withColumnRenamed("item_id", "key")}
    inputs = {k: v.select("key", "text") for k, v in inputs.items()}
    inputs["intents"] = b.select(F.col("id").alias("key"), F.col("q_bl").alias("query"), F.col("bn").alias("document"))
    return C.overlap_audit(inputs, "key", ("text", "query", "document", "negative"), b, "id", ("bn", "bl", "en"))
