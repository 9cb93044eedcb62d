"""Tokenizer queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import tokenizer as K
from corpusloom.operators import corpus as C
from corpusloom.operators import review as R
from corpusloom.operators import tokenizers as O
from corpusloom.plans.catalog import query
from corpusloom.plans.corpus import MIXTURE, NORMAL, prepared, records
from corpusloom.runtime import Scratch, table

WORDS = f"select unnest(list_filter(string_split({NORMAL}, ' '), lambda x: x <> '')) as word from records where text is not null"
COUNTS = "w as (select word, count(*)::double as weight from q group by word)"


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Word weights of the records."""
    return O.word_frequency(records(spark, sf), "text").select("word", F.col("n").cast("double").alias("weight"))


#: Of training: ids in all, seeds, characters of a piece.
VOCAB, SEEDS, LONGEST = 32_000, 64_000, 12


def training_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted word counts of the prepared corpus's train records."""
    train = prepared(spark, sf).where("split = 'train'").select("text", "bucket", "split")
    return C.word_counts(Scratch(spark, "train").save(train, "train"), MIXTURE, fitting=True)


RECORD_WORDS = f"q as (select word from ({WORDS}) where strlen(word) <= 1024), {COUNTS}"


@query("tok_word_frequency", f"select word, count(*) as n from ({WORDS}) where strlen(word) <= 1024 group by word")
def tok_word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return O.word_frequency(records(spark, sf), "text")


@query("tok_seed_counts", f"""with {RECORD_WORDS}, s as (select word, weight, unnest(range(1, length(word) + 1)) as i from w),
  p as (select word, weight, i, unnest(range(1, least(6, length(word) - i + 1) + 1)) as n from s)
  select array_to_string(list_slice(string_split(word, ''), i, i + n - 1), '') as piece, sum(weight) as weight from p group by 1""")
def tok_seed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.seed_counts(counts(spark, sf), 6)


@query("tok_pair_totals", f"""with {RECORD_WORDS}, s as (select string_split(word, '') as c, weight, unnest(range(1, length(word))) as i from w)
  select c[i] as a, c[i + 1] as b, sum(weight) as weight from s group by 1, 2""")
def tok_pair_totals(spark: SparkSession, sf: str) -> DataFrame:
    return O.pair_totals(counts(spark, sf))


@query("tok_train_seed_counts")
def tok_train_seed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.seed_counts(training_counts(spark, sf), LONGEST)


@query("tok_train_pair_totals")
def tok_train_pair_totals(spark: SparkSession, sf: str) -> DataFrame:
    return O.pair_totals(training_counts(spark, sf))


def bytes_sql(c: str) -> str:
    return f"list_transform(range(0, strlen({c})), lambda i: ('0x' || substr(hex({c}), 2 * i::int + 1, 2))::int + 4)"


def pieces_sql() -> str:
    """p0: pieces with their ids, in order."""
    return "p0 as (select piece, score, (259 + row_number() over (order by piece_id))::int as id from pieces)"


def segments_sql(words: str) -> str:
    """seg (word, ids): the likeliest segmentation of each word of the statement `words`, by recursion over its places."""
    return f"""dw as (select distinct word from ({words}) where word <> ''),
  ch as (select distinct unnest(string_split(word, '')) as c from dw), {pieces_sql()},
  cand as (select piece, score, [id] as part, 2 * length(piece) as tie from p0 union all select c, -30.0 * strlen(c), {bytes_sql('c')}, 3 from ch where c <> ''),
  ls as (select unnest(range(1, 1 + (select max(length(piece)) from pieces))) as l),
  v(word, n, i, best, ids) as (select word, length(word), 0::bigint, [0.0::double], [[]::int[]] from dw
    union all select word, n, i + 1, list_append(any_value(best), max(best[i + 2 - l] + score)), list_append(any_value(ids), first(list_concat(ids[i + 2 - l], part) order by best[i + 2 - l] + score desc, tie desc))
      from (select v.*, l, substr(word, i + 2 - l, l) as sub from v, ls where l <= i + 1 and i < n) x join cand on cand.piece = x.sub group by word, n, i),
  seg as (select word, ids[n + 1] as ids from v where i = n)"""


def rows_sql(source: str, key: str, text: str = "text") -> str:
    """ws (key, pos, word) of the words of a table in order."""
    return f"ws as (select {key}, unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) as word, generate_subscripts(list_filter(string_split(t, ' '), lambda x: x <> ''), 1) as pos from (select {key}, {NORMAL.replace('text', text)} as t from {source} where {text} is not null))"


def ids_sql(source: str, key: str, text: str = "text") -> str:
    """enc (key, ids) of every text that is not null."""
    return f"""{rows_sql(source, key, text)}, {segments_sql('select word from ws')},
  enc as (select r.{key}, coalesce(e.ids, []) as ids from (select {key} from {source} where {text} is not null) r left join
    (select {key}, flatten(list(case when pos = 1 then ids else list_concat([36], ids) end order by pos)) as ids from ws join seg using (word) group by {key}) e using ({key}))"""


IDS = ids_sql("records", "rid")


def joined(ids: str, sep: str = " "):
    return F.array_join(ids, sep)


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    encode = K.encoder(K.from_pieces(table(spark, sf, "pieces")))
    return records(spark, sf).where("text is not null").select("rid", encode("text").alias("ids"))


@query("tok_encode", f"with recursive {IDS} select rid, array_to_string(ids, ' ') as ids from enc")
def tok_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("rid", joined("ids").alias("ids"))


@query("tok_round_trip", f"select rid, {NORMAL} as text from records where text is not null")
def tok_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they come back from their ids."""
    decode = K.decoder(K.from_pieces(table(spark, sf, "pieces")))
    return encoded(spark, sf).select("rid", decode("ids").alias("text"))


@query("tok_sample")
def tok_sample(spark: SparkSession, sf: str) -> DataFrame:
    draw = K.sampler(K.from_pieces(table(spark, sf, "pieces")), 0.5, 17)
    return records(spark, sf).select("rid", draw("text", "rid").alias("ids"))


@query("tok_sample_decoded", f"select rid, {NORMAL} as text from records where text is not null")
def tok_sample_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Whatever segmentation is drawn, it stands for its text."""
    decode = K.decoder(K.from_pieces(table(spark, sf, "pieces")))
    return tok_sample(spark, sf).where("ids is not null").select("rid", decode("ids").alias("text"))


RATES = ("fertility", "tokens_per_word", "truncation_rate", "fallback_rate", "utilization")


@query("tok_metrics", f"""with recursive {IDS}, b as (select rid, bucket, {NORMAL} as t from records where text is not null),
  o as (select rid, bucket, len(ids) as n, len(list_filter(ids, lambda i: i = 36)) as sp, len(list_filter(ids, lambda i: i >= 4 and i < 260 and i <> 36)) as fb, strlen(t) as bytes, length(t) as chars,
    case when t = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end as words from enc join b using (rid)),
  r as (select *, row_number() over (partition by bucket order by n) - 1 as k, count(*) over (partition by bucket) as m from o),
  u as (select bucket, count(distinct id) as used_ids from (select bucket, unnest(ids) as id from enc join b using (rid)) group by bucket),
  a as (select bucket, count(*) as examples, sum(n)::bigint as tokens, sum(n)::bigint as base_tokens, sum(words)::bigint as words, sum(bytes)::bigint as bytes, sum(chars)::bigint as characters, sum(sp)::bigint as space_tokens,
    sum(fb)::bigint as fallback_tokens, count(*) filter (n + 2 > 510) as truncated, max(case when k = (m - 1) * 50 // 100 then n end) as p50, max(case when k = (m - 1) * 95 // 100 then n end) as p95, max(case when k = (m - 1) * 99 // 100 then n end) as p99 from r group by bucket)
  select a.*, coalesce(used_ids, 0) as used_ids, round((base_tokens - space_tokens) / words, 9) as fertility, round(tokens / words, 9) as tokens_per_word, round(truncated / examples, 9) as truncation_rate,
    round(fallback_tokens / greatest(base_tokens - space_tokens, 1), 9) as fallback_rate, round(coalesce(used_ids, 0) / (260 + (select count(*) from pieces)), 9) as utilization from a left join u on a.bucket is not distinct from u.bucket""")
def tok_metrics(spark: SparkSession, sf: str) -> DataFrame:
    made = O.metrics(records(spark, sf), "bucket", "text", K.from_pieces(table(spark, sf, "pieces")))
    return made.withColumns({c: F.round(c, 9) for c in RATES})


@query("tok_after_space", f"""with recursive {IDS}, x as (select ids, unnest(range(2, len(ids) + 1)) as i from enc)
  select ids[i] as id, count(*) as n from x where ids[i - 1] = 36 group by 1""")
def tok_after_space(spark: SparkSession, sf: str) -> DataFrame:
    return O.after_space(encoded(spark, sf), "ids")


@query("tok_fingerprint", f"with recursive {IDS} select count(*) as rows, sum(('0x' || substr(sha256(rid::varchar || ':' || array_to_string(ids, ',')), 1, 15))::bigint::hugeint)::varchar as fingerprint from enc")
def tok_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return O.fingerprint(encoded(spark, sf), "rid", "ids")


@query("tok_inputs", f"""with recursive {IDS}, c as (select rid, list_concat(list_concat([2], ids[1:62]), [3]) as ids from enc), f as (select rid, list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda i: 0)) as ids, len(ids) as n from c)
  select rid, array_to_string(ids, ' ') as ids, array_to_string(list_transform(ids, lambda i: (i <> 0)::int), ' ') as mask, n::int as n from f""")
def tok_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model inputs: marks, truncation to 64, padding to the width, and the mask of what is not padding."""
    ids = encoded(spark, sf).withColumn("ids", K.truncated("ids", 64)).withColumn("n", F.size("ids")).withColumn("ids", K.padded("ids", 64))
    return ids.select("rid", joined("ids").alias("ids"), joined(K.attention_mask("ids")).alias("mask"), "n")


def bpe_of(pieces: DataFrame) -> K.Model:
    """A BPE model of the pieces that come of adding one character to another such piece, in order of length, then of id.

    The driver holds the pieces anyway; see from_pieces for their bound.
    """
    rows = [t for t, _ in K.from_pieces(pieces).pieces]
    texts = [t for t in rows if len(t) == 1]
    place, merges = {t: k for k, t in enumerate(texts)}, []
    for t in sorted((t for t in rows if len(t) > 1), key=len):
        if t[:-1] in place and t[-1] in place:
            place[t] = len(texts)
            merges.append((place[t[:-1]], place[t[-1]], place[t]))
            texts.append(t)
    return K.Model("bpe", [(t, 0.0) for t in texts], merges)


# two characters that no text of the tables holds stand around each symbol, so that replacing is merging from the left
A, Z = "chr(1)", "chr(2)"
BPE = f"""{rows_sql("records", "rid")}, {pieces_sql()}, dw as (select distinct word from ws),
  made(piece, id) as (select piece, id from p0 where length(piece) = 1 union all select p.piece, p.id from made m join p0 p on p.piece[:-2] = m.piece and length(p.piece) > 1 where p.piece[-1:] in (select piece from p0 where length(piece) = 1)),
  num as (select piece, (259 + row_number() over (order by length(piece), id))::int as id from made),
  mg as (select piece[:-2] as a, piece[-1:] as b, id as rank from num where length(piece) > 1),
  st(word, step, s) as (select word, 0, {A} || array_to_string(string_split(word, ''), {Z} || {A}) || {Z} from dw
    union all select word, step + 1, replace(s, {A} || first(a order by rank) || {Z} || {A} || first(b order by rank) || {Z}, {A} || first(a order by rank) || first(b order by rank) || {Z})
      from (select word, step, s, y, unnest(range(1, len(y))) as i from (select word, step, s, string_split(s[2:-2], {Z} || {A}) as y from st)) x join mg on mg.a = y[i] and mg.b = y[i + 1] group by word, step, s),
  last as (select word, arg_max(s, step) as s from st group by word),
  sym as (select word, unnest(string_split(s[2:-2], {Z} || {A})) as piece, generate_subscripts(string_split(s[2:-2], {Z} || {A}), 1) as j from last),
  seg as (select word, flatten(list(case when num.id is null then {bytes_sql('sym.piece')} else [num.id] end order by j)) as ids from sym left join num using (piece) group by word)"""


def assembled_sql(spaced: str) -> str:
    return f"""select r.rid, array_to_string(coalesce(e.ids, []), ' ') as ids from (select rid from records where text is not null) r left join
    (select rid, flatten(list(case when pos = 1 then ids else {spaced} end order by pos)) as ids from ws join seg using (word) group by rid) e using (rid)"""


@query("tok_bpe_encode", f"with recursive {BPE} {assembled_sql('list_concat([36], ids)')}")
def tok_bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    encode = K.encoder(bpe_of(table(spark, sf, "pieces")))
    return records(spark, sf).where("text is not null").select("rid", joined(encode("text")).alias("ids"))


@query("tok_fused_encode", f"""with recursive {BPE}, fu as (select id, (259 + (select count(*) from num) + row_number() over (order by n desc, id))::int as fused from (
    select ids[1] as id, count(*) as n from ws join seg using (word) where pos > 1 group by 1) where id <> 36 order by n desc, id limit 64)
  {assembled_sql("case when (select fused from fu where fu.id = ids[1]) is null then list_concat([36], ids) else list_concat([(select fused from fu where fu.id = ids[1])], ids[2:]) end")}""")
def tok_fused_encode(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 ids that follow a blank oftenest are one id together with it."""
    model, rows = bpe_of(table(spark, sf, "pieces")), records(spark, sf).where("text is not null")
    following = O.after_space(rows.select(K.encoder(model)("text").alias("ids")), "ids")
    return rows.select("rid", joined(K.encoder(O.fuse_spaces(model, following, 64))("text")).alias("ids"))


@query("tok_train_unigram")
def tok_train_unigram(spark: SparkSession, sf: str) -> DataFrame:
    model = O.train_unigram(training_counts(spark, sf), VOCAB, SEEDS, LONGEST)
    return spark.createDataFrame([(K.PIECES + i, t, s) for i, (t, s) in enumerate(model.pieces)], "piece_id int, piece string, score double")


@query("tok_train_bpe")
def tok_train_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """At full size; small tables give fewer merges than that."""
    try:
        model = O.train_bpe(training_counts(spark, sf), VOCAB, LONGEST)
    except O.NoPairLeft as e:
        model = e.model
    return spark.createDataFrame([(r, *m, model.pieces[m[2]][0]) for r, m in enumerate(model.merges)], "rank int, lhs int, rhs int, result int, piece string")


@query("tok_hash", "select piece_id, ((piece_id::bigint * 2654435761) & 4294967295) % 512 as hashed from pieces")
def tok_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pieces").select("piece_id", K.token_hash("piece_id").alias("hashed"))


@query("tok_length_percentiles", f"""with q as (select coalesce(bucket, '') as bucket, {NORMAL} as t from records where text is not null),
  s as (select bucket, case when t = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end as n from q),
  o as (select bucket, n, row_number() over (partition by bucket order by n) - 1 as k, count(*) over (partition by bucket) as m from s)
  select bucket, max(case when k = (m - 1) * 50 // 100 then n end)::int as p50, max(case when k = (m - 1) * 95 // 100 then n end)::int as p95,
    max(case when k = (m - 1) * 99 // 100 then n end)::int as p99 from o group by bucket""")
def tok_length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).where("text is not null").select(F.coalesce("bucket", F.lit("")).alias("bucket"), F.size(T.words(T.normalize("text"))).alias("n"))
    return O.floor_percentile(rows.groupBy("bucket", "n").agg(F.count("*").alias("c")), ["bucket"], "n", "c", {"p50": 50, "p95": 95, "p99": 99})


@query("tok_expand", f"with recursive {BPE} {assembled_sql('list_concat([36], ids)')}")
def tok_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Fused ids undone are the ids of the model without fusion."""
    model, rows = bpe_of(table(spark, sf, "pieces")), records(spark, sf).where("text is not null")
    following = O.after_space(rows.select(K.encoder(model)("text").alias("ids")), "ids")
    fused = O.fuse_spaces(model, following, 64)
    return rows.select("rid", K.encoder(fused)("text").alias("ids")).select("rid", joined(K.expanded("ids", fused)).alias("ids"))


@query("tok_expected_uses", f"""with recursive {RECORD_WORDS}, dw as (select word, weight, length(word) as n from w), pc as (select piece, exp(max(score)) as p from pieces group by piece),
  ls as (select unnest(range(1, 1 + (select max(length(piece)) from pieces))) as l),
  fw(word, n, i, a) as (select word, n, 0::bigint, [1.0::double] from dw
    union all select word, n, i + 1, list_append(any_value(a), sum(coalesce(a[i + 2 - l] * p, 0))) from (select fw.*, l, substr(word, i + 2 - l, l) as sub from fw, ls where l <= i + 1 and i < n) x left join pc on pc.piece = x.sub group by word, n, i),
  bw(word, n, i, b) as (select word, n, n, [1.0::double] from dw
    union all select word, n, i - 1, list_append(any_value(b), sum(coalesce(b[n - i - l + 2] * p, 0))) from (select bw.*, l, substr(word, i, l) as sub from bw, ls where i > 0 and i - 1 + l <= n) x left join pc on pc.piece = x.sub group by word, n, i),
  fb as (select dw.*, a, b from dw join (select word, a from fw where i = n) using (word) join (select word, b from bw where i = 0) using (word) where a[n + 1] > 0),
  ar as (select word, weight, n, a, b, s, l, substr(word, s + 1, l) as sub from (select *, unnest(range(n)) as s from fb), ls where s + l <= n)
  select piece, round(sum(weight * a[s + 1] * p * b[n - s - l + 1] / a[n + 1]), 4) as uses from ar join pc on pc.piece = sub group by piece having round(sum(weight * a[s + 1] * p * b[n - s - l + 1] / a[n + 1]), 4) > 0""")
def tok_expected_uses(spark: SparkSession, sf: str) -> DataFrame:
    """One E-step of the tokenizer in pieces over the words of the records: expected uses of each piece."""
    pieces = K.from_pieces(table(spark, sf, "pieces")).pieces
    uses, _ = O._expected(counts(spark, sf), pieces)
    made = [(t, x) for (t, _), x in zip(pieces, uses) if x > 0]
    return spark.createDataFrame(made, "piece string, uses double").select("piece", F.round("uses", 4).alias("uses")).where("uses > 0")


@query("tok_quality", f"""with recursive {ids_sql("records", "rid")}, n as (select len(ids) as n from enc)
  select count(*) as texts, 1.0::double as round_trip, 0::bigint as unknown, round(avg((n > 510)::int), 9) as over, quantile_disc(n, 0.95) as p95 from n""")
def tok_quality(spark: SparkSession, sf: str) -> DataFrame:
    return O.quality(records(spark, sf), "text", K.from_pieces(table(spark, sf, "pieces"))).withColumn("over", F.round("over", 9))


@query("tok_transfer", f"""with s as (select piece, (259 + row_number() over (order by piece_id))::int as id from pieces where length(piece) = 1),
  c as (select piece_id, unnest(string_split(piece, '')) as c from pieces), i as (select piece_id, unnest(case when s.id is null then {bytes_sql('c.c')} else [s.id] end) as id from c left join s on s.piece = c.c),
  l as (select piece_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as place from i join embeddings on vec_id = id)
  select piece_id, place::int as place, round(avg(x), 6) as x from l group by all""")
def tok_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of pieces from those of their ids in a second model, here the bytes' and characters' of the embeddings table."""
    pieces, e = table(spark, sf, "pieces"), table(spark, sf, "embeddings")
    small = K.Model("unigram", [(r.piece, r.score) for r in pieces.where("length(piece) = 1").orderBy("piece_id").collect()])
    ids = pieces.select("piece_id", K.encoder(small)("piece").alias("ids"))
    made = R.transferred(ids, "ids", e.withColumnRenamed("vec_id", "id"), "id", "embedding", K.UNK)
    return made.select("piece_id", F.posexplode("vector").alias("place", "x")).select("piece_id", (F.col("place") + 1).alias("place"), F.round("x", 6).alias("x"))
