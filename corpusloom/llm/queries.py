"""Queries p1_ to p9_ over the whole test tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import consensus, copies, language, leakage, lookalike, mixing, mojibake, splits, tokenbudget
from corpusloom.plans import tokenizer as core
from corpusloom.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def network(spark: SparkSession, sf: str) -> language.Network:
    """Fitted to the three texts of business, which are each in one language, and to documents labelled with the other two."""
    business, documents = table(spark, sf, "business"), table(spark, sf, "documents")
    parts = [business.select(F.col(c).alias("text"), F.lit(x).alias("lang")) for c, x in (("bn", "bangla"), ("bl", "banglish"), ("en", "english"))]
    parts.append(documents.where("lower(trim(lang)) in ('french', 'hindi')").select("text", "lang"))
    return language.fit(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "text", "lang")


def records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "records"), "rid")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(records(spark, sf), "rid", "text", "bucket", network(spark, sf))


def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages_of(records(spark, sf), "rid", "text", network(spark, sf)).select("rid", "lang", "languages", "confidence")


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    made = language.languages_of(records(spark, sf), "rid", "text", network(spark, sf))
    return made.select("rid", F.posexplode("segments").alias("segment", "s")).select("rid", "segment", "s.*")


PAIR, GRADES = ["query_id", "document_id"], (0, 1, 2)
AUDIT = ("audit_reviewer_id", "audit_grade", "audited_at", "original_grade")


def graded(spark: SparkSession, sf: str) -> consensus.Consensus:
    return consensus.fit(table(spark, sf, "disagreements"), PAIR, *AUDIT, GRADES)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    people = graded(spark, sf).annotators().where(F.col("annotator") != consensus.ORIGINAL)
    return people.where("items >= 15 and wrong > items / 2").select(F.col("annotator").alias("audit_reviewer_id"))


def p2_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).items()


def p2_reviewers(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).annotators()


def p2_agreement(spark: SparkSession, sf: str) -> DataFrame:
    votes = consensus.latest_grades(table(spark, sf, "disagreements"), PAIR, *AUDIT)
    return consensus.agreement(votes, PAIR, list(GRADES)).withColumn("alpha", F.round("alpha", 9))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.contradictory(table(spark, sf, "records"), "rid", "group_id", "source", "split")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf, "records"), "rid", "group_id", "source", "bucket")


def p3_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """How far the splits of p3_splits are from their shares of each bucket."""
    rows = table(spark, sf, "records")
    return splits.deviation(rows, "rid", "bucket", p3_splits(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_pairs(records(spark, sf), "rid", "text")


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapse(records(spark, sf), "rid", "text")


def looked_at(spark: SparkSession, sf: str) -> DataFrame:
    """(field_name, key, text) of the three fields of problem 5."""
    business = table(spark, sf, "business")
    parts = [records(spark, sf).select(F.lit("records.text").alias("field_name"), F.col("rid").cast("string").alias("key"), "text")]
    parts += [business.select(F.lit(f"business.{c}").alias("field_name"), F.col("id").alias("key"), F.col(c).alias("text")) for c in ("bn", "bl")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look_pairs(looked_at(spark, sf), "field_name", "key", "text")


def p5_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.consistent(looked_at(spark, sf), ["field_name", "key"], "text").select("field_name", "key", "look")


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they are to be stored: in the consistent form, but in their own script."""
    return lookalike.consistent(looked_at(spark, sf), ["field_name", "key"], "text").select("field_name", "key", "form")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_classes(looked_at(spark, sf), "field_name", "key", "text")[0].drop("class")


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    """Each member with the first key of its class."""
    classes, members = lookalike.look_classes(looked_at(spark, sf), "field_name", "key", "text")
    return members.join(classes.select("field_name", "class", "first_key"), ["field_name", "class"]).select("field_name", "key", "first_key")


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return tokenbudget.record_tokens(records(spark, sf), table(spark, sf, "sources"), table(spark, sf, "pieces"))


def p6_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokenbudget.budget(counted(spark, sf))


def p6_public_budget(spark: SparkSession, sf: str, tokenizer: str = f"{mixing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The same totals under a public tokenizer with merges, by the merge queue."""
    return tokenbudget.budget(tokenbudget.record_tokens(records(spark, sf), table(spark, sf, "sources"), tokenizer))


def p6_record_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(documents(spark, sf), "doc_id", "text", table(spark, sf, "heldout"), "item_id", "text")


def p7_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.alignments(documents(spark, sf), "doc_id", "text", table(spark, sf, "heldout"), "item_id", "text")


def mixed(spark: SparkSession, sf: str, tokenizer: str = f"{mixing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    sized = mixing.public_counts(documents(spark, sf).select("doc_id", "source", "text"), "text", tokenizer).drop("text")
    return mixing.mix(sized, "doc_id", "source", "n_tokens", table(spark, sf, "mixture"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(spark, sf)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.reached(mixed(spark, sf), "source", table(spark, sf, "mixture"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repairs(documents(spark, sf), "doc_id", "source", ["text"]).select("doc_id")


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repairs(documents(spark, sf), "doc_id", "source", ["text"])


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit()}


NAME = r"nullif(lower(regexp_replace({}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g')), '')"
SIGNS = r"lower(regexp_replace(nfc_normalize({}), '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g'))"
FIELD = r'(?i)(?:^[\s\x{FEFF}\x{200B}]*|[{,;|\n])\s*"?(bn|bl|en|title|body|note)"?\s*[:=]'


def words_sql(source: str, key: str) -> str:
    word = SIGNS.format("x")
    return rf"""select {key}, list_filter(list_transform(string_split_regex(text, '[\s\p{{Z}}]+'), lambda x: {word}), lambda x: regexp_matches(x, '[\p{{L}}\p{{Nd}}]')) as w from {source} where text is not null"""


def tens_sql(source: str, key: str) -> str:
    return f"select {key}, array_to_string(w[i:i+9], ' ') as run from (select {key}, w, unnest(range(1, greatest(len(w) - 8, 1))) as i from ({words_sql(source, key)}))"


def look_sql(x: str) -> str:
    """The look of a text for characters of the test tables: Latin, Bengali and Devanagari, and look-alikes without marks."""
    hasanta, joiners = r"\x{09CD}\x{094D}", ((0x200C, 0xE000), (0x200D, 0xE001))
    out = rf"regexp_replace({x}, '[\x{{AD}}\x{{200B}}\x{{200E}}\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    for joiner, stand_in in joiners:  # those beside a hasanta are kept aside
        out = rf"regexp_replace({out}, '([{hasanta}])\x{{{joiner:x}}}', '\1{chr(stand_in)}', 'g')"
        out = rf"regexp_replace({out}, '\x{{{joiner:x}}}([{hasanta}])', '{chr(stand_in)}\1', 'g')"
    out = rf"regexp_replace({out}, '[\x{{200C}}\x{{200D}}]', '', 'g')"
    alike = lookalike.CYRILLIC + lookalike.GREEK
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    blanks = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    old = alike[::2] + wide + blanks + "".join(chr(b) for _, b in joiners)
    new = alike[1::2] + "".join(chr(ord(c) - 0xFEE0) for c in wide) + " " * len(blanks) + "".join(chr(a) for a, _ in joiners)
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return f"nfc_normalize(translate({out}, {quote(old)}, {quote(new)}))"


LOOKED = f"""t as (select 'records.text' as field_name, rid::varchar as key, text from records union all select 'business.bn', id, bn from business union all select 'business.bl', id, bl from business),
      l as (select field_name, key, text, {look_sql('text')} as look from t)"""
MIXED = rf"""{LOOKED}, c as (select field_name, look, min(key) as first_key, count(distinct text) as spellings, count(*) as texts from l where regexp_matches(look, '\p{{L}}') group by field_name, look having count(distinct text) > 1)"""
CLASSES = rf"""k as (select rid, text, regexp_matches(text, '^[\s\x{{FEFF}}\x{{200B}}]*\{{?\s*"?(?i:bn|bl|en|title|body|note)"?\s*[:=]') as f from records where text is not null),
      c as (select rid, case when f then 'F' || array_to_string(list_sort(list_transform(list_zip(regexp_extract_all(text, '{FIELD}', 1), string_split_regex(text, '{FIELD}')[2:]),
        lambda x: lower(x[1]) || chr(3) || {SIGNS.format('x[2]')})), chr(1)) else {SIGNS.format('text')} end as key from k)"""
COLLECTION = r"nullif(regexp_extract(lower(regexp_replace(source, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g')), '^[^:]*'), '')"
SAYS = f"case when lower(trim(bucket)) not in ({', '.join(repr(x) for x in tokenbudget.PLACEHOLDERS)}) then lower(trim(bucket)) end"
TOKENS = f"""{core.ids_sql("records", "rid")}, sd as (select {COLLECTION} as source, min(domain) as domain from sources group by 1),
      tk as (select r.rid, r.source, r.bucket, domain, coalesce(len(ids), 0) as n_tokens from (select rid, {COLLECTION} as source, {SAYS} as bucket from records) r left join enc using (rid) left join sd on sd.source = r.source)"""
GRADED = """l as (select query_id, document_id, audit_grade as grade from disagreements where audit_reviewer_id is not null
        qualify row_number() over (partition by query_id, document_id, audit_reviewer_id order by audited_at desc nulls last, audit_grade desc nulls last) = 1
      union all select query_id, document_id, min(original_grade) from disagreements group by query_id, document_id)"""

SQL = {
    "p2_agreement": f"""with {GRADED}, p as (select query_id, document_id, count(*) as m, count(*) filter (grade = 0) as n0, count(*) filter (grade = 1) as n1, count(*) filter (grade = 2) as n2 from l where grade in (0, 1, 2) group by query_id, document_id having count(*) > 1),
      t as (select count(*) as items, sum(m) as votes, sum((n0 * (m - n0) + n1 * (m - n1) + n2 * (m - n2)) / (m - 1)) as seen, sum(n0) as n0, sum(n1) as n1, sum(n2) as n2 from p)
      select items, votes::bigint as votes, round(1 - seen / ((n0 * (votes - n0) + n1 * (votes - n1) + n2 * (votes - n2)) / (votes - 1)), 9) as alpha from t""",
    "p4_collapsed": f"""with {CLASSES}, g as (select min(rid) as rid, count(*) as n_copies from c where key <> '' group by key)
      select * from g union all select rid, 1 from records where rid not in (select rid from c where key <> '')""",
    "p5_consistent": f"with {LOOKED} select field_name, key, look from l",
    "p5_classes": f"with {MIXED} select field_name, first_key, spellings, texts from c",
    "p5_members": f"with {MIXED} select field_name, key, first_key from l join c using (field_name, look)",
    "p6_record_tokens": f"with recursive {TOKENS} select * from tk",
    "p6_budget": f"""with recursive {TOKENS}, g as (select source, bucket, domain, grouping_id(source, bucket, domain) as g, count(*) as records, sum(n_tokens)::bigint as n_tokens from tk group by grouping sets ((source, bucket, domain), (source), (bucket), (domain), ()))
      select case g when 0 then 'slice' when 3 then 'source' when 5 then 'bucket' when 6 then 'domain' else 'all' end as level, source, bucket, domain, records, n_tokens from g""",
    "p5_found": rf"""with {LOOKED}
      select a.field_name, a.key as key_a, b.key as key_b from l a join l b using (field_name, look) where a.key < b.key and a.text <> b.text and regexp_matches(look, '\p{{L}}')""",
    "p3_found": f"""with recursive n as (select rid, {NAME.format('group_id')} as g, {NAME.format('source')} as z, {NAME.format('split')} as p from records),
      r as (select rid, g, p, case when regexp_matches(z, '^[^:]+:.+') then z end as s from n),
      e as (select rid as u, min(rid) over (partition by g) as v from r where g is not null union all select rid, min(rid) over (partition by s) from r where s is not null),
      e2 as (select distinct u, v from (select u, v from e union all select v, u from e) where u <> v),
      cc(rid, root) using key (rid) as (select rid, rid from r
        union select e2.u, min(cc.root) from cc join e2 on e2.v = cc.rid join recurring.cc as old on old.rid = e2.u where cc.root < old.root group by e2.u)
      select rid from cc where root in (select root from cc join r using (rid) group by root having min(p) <> max(p))""",
    "p4_found": f"""with {CLASSES}
      select a.rid as rid_a, c.rid as rid_b from (select key, min(rid) as rid from c where key <> '' group by key) a join c using (key) where a.rid <> c.rid""",
    "p7_found": f"select distinct item_id, doc_id from ({tens_sql('heldout', 'item_id')}) a join ({tens_sql('documents', 'doc_id')}) b using (run)",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
