"""Search queries over chunks, documents and vectors, with their SQL twins.

The tables have no questions: headings of chunks whose id is divisible by 100 ask, every chunk answers. Likewise vectors
whose id is divisible by 100 are asked against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmill.functions import text as T
from weftmill.operators import facts, guard, search
from weftmill.plans.registry import registered
from weftmill.shared import spread, staged, table

QUERIES, SQL = {}, {}
AS_OF = "2026-06-01 00:00:00"
#: The stored vectors carry no meaning, so the grade that counts as on topic is lower than ``search.THRESHOLD`` here.
ON_TOPIC = 0.1


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    return registered(QUERIES, SQL, sql)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
# The twin has no lookaround: dots of initials and separators of thousands are dropped by repeated replacement.
_JOINED = r"regexp_replace(lower({0}), '\b([a-z])\.([a-z]+\b)', '\1\2', 'g')"
for _ in range(3):
    _JOINED = rf"regexp_replace({_JOINED}, '([0-9])[,\s]([0-9]{{{{3}}}}\b)', '\1\2', 'g')"
_TOKENS = "list_filter(regexp_extract_all(" + _JOINED + ", '[a-z0-9]+|[^\\x00-\\x7F\\pP\\pS\\pZ\\p{{Nd}}\\pM\\pC]+'), lambda x: x not in (" + _STOP + ") and (length(x) > 1 or regexp_matches(x, '^[0-9]$')))"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks")).select("chunk_id", "source_id", "chunk_index", "heading", "text")


def _questions(chunks: DataFrame) -> DataFrame:
    return chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("heading").alias("query"))


_CORPUS = f"""
    docs as (select chunk_id, source_id, chunk_index, heading, text, {_TOKENS.format('text')} as ts from chunks where text is not null),
    post as (select chunk_id, len(ts) as len, unnest(ts) as term from docs), tf as (select term, chunk_id, len, count(*) as tf from post group by all),
    stats as (select count(*) as n, avg(len(ts)) as avg_len from docs), df as (select term, count(*) as df from tf group by term),
    raw as (select term, df, ln((n - df + 0.5) / (df + 0.5)) as raw from df, stats), idf as (select term, df, case when raw < 0 then (select 0.25 * avg(raw) from raw) else raw end as idf from raw),
    asked as (select query_id, term, count(*) as qn from (select chunk_id as query_id, unnest({_TOKENS.format('heading')}) as term from docs where chunk_id % 100 = 0) group by all),
    scores as (select query_id, chunk_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) as score from tf join idf using (term) join asked using (term), stats group by all having score > 0),
    bm as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scores qualify rank <= 12)
"""


@query(f"with {_CORPUS} select term, df, round(idf, 6) as idf from idf")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return search.KeywordIndex.build(c).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_CORPUS} select query_id, chunk_id, round(score, 6) as score, cast(rank as int) as rank from bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return search.bm25(_questions(c), c, 12).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
    with {_CORPUS}, q as (select chunk_id as query_id, list_distinct({_TOKENS.format('heading')}) as qs from docs where chunk_id % 100 = 0)
    select query_id, bm.chunk_id, round(case when len(qs) > 0 then len(list_intersect(qs, ts)) * 1.0 / len(qs) else 0 end, 6) as coverage from bm join q using (query_id) join docs on docs.chunk_id = bm.chunk_id
""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    hits = search.bm25(_questions(c), c, 12).join(_questions(c), "query_id").join(c.select("chunk_id", "text"), "chunk_id")
    return search.with_coverage(hits).select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"))


_VEC = """
    v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), q as (select vec_id as query_id, label as ql, e as qe from v where vec_id % 100 = 0),
    sim as (select query_id, vec_id, label, ql, round(list_cosine_similarity(qe, e), 9) as score from q, v)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label"), v


@query(f"with {_VEC} select query_id, vec_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from sim qualify rank <= 12")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.dense(q, v, 12).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_VEC} select query_id, vec_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from sim where label = ql qualify rank <= 5")
def vector_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.dense(q, v, 5, same="label").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_VEC} select query_id, arg_max(vec_id, (score, -vec_id)) as vec_id, round(max(score), 6) as score, max(score) >= 0.86 as direct, max(score) >= 0.72 as context from sim where vec_id <> query_id group by query_id")
def best_phrasing(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of each asked one, and whether it answers directly or as context."""
    q, v = _vectors(spark, d)
    best = search.dense(q, v, 2).filter("vec_id <> query_id").groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("m"))).alias("x"))
    return best.select("query_id", (-F.col("x.m")).alias("vec_id"), F.round("x.score", 6).alias("score"), (F.col("x.score") >= 0.86).alias("direct"), (F.col("x.score") >= 0.72).alias("context"))


_FUSED = f"""
    {_CORPUS}, {_VEC}, dense as (select query_id, vec_id as chunk_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from sim qualify rank <= 12),
    rrf as (select query_id, chunk_id, sum(1.0 / (60 + rank)) as rrf from (select query_id, chunk_id, rank from bm union all select query_id, chunk_id, rank from dense) group by all)
"""


def _described(spark: SparkSession, d: str, rrf: DataFrame) -> DataFrame:
    """Hits with what ranking needs; a chunk's vector is the one of its number."""
    c, v = _chunks(spark, d), table(spark, d, "embeddings")
    s = table(spark, d, "sources").select("source_id", "url", "content_type", "academic_year", "published_at")
    h = rrf.join(c, "chunk_id").join(_questions(c), "query_id").join(s, "source_id", "left")
    vec = lambda key, name: v.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))
    h = h.join(vec("query_id", "qe"), "query_id", "left").join(vec("chunk_id", "ce"), "chunk_id", "left")
    h = search.with_coverage(h).withColumn("cosine", F.coalesce(search.cosine(F.col("qe"), F.col("ce")), F.lit(0.0)))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    h = h.withColumn("age", search.age_days(F.col("url"), F.col("published_at"), F.col("academic_year"), as_of)).withColumn("year", search.content_year(F.col("academic_year"), F.col("published_at")))
    return h.withColumn("tokens", T.estimated_tokens(F.col("text")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Twelve candidates of either search."""
    c = _chunks(spark, d)
    q, v = _vectors(spark, d)
    rrf = search.fused(search.bm25(_questions(c), c, 12), search.dense(q, v, 12).withColumnRenamed("vec_id", "chunk_id"))
    return _described(spark, d, rrf).drop("qe", "ce")


@query(f"with {_FUSED} select query_id, chunk_id, round(rrf, 6) as rrf from rrf")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    q, v = _vectors(spark, d)
    return search.fused(search.bm25(_questions(c), c, 12), search.dense(q, v, 12).withColumnRenamed("vec_id", "chunk_id")).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"))


_AGE = f"""
    aged as (select source_id, case when length(regexp_replace(regexp_replace(url, '/+$', ''), '[^/]', '', 'g')) <= 2 then null else greatest(0, date_diff('second', least(published_at, case when regexp_extract(academic_year, '^(\\d{{4}})', 1) between '2000' and '2100'
      then make_timestamp(cast(left(academic_year, 4) as int), 6, 1, 0, 0, 0) end), timestamp '{AS_OF}') / 86400.0) end as age, url, content_type, academic_year, published_at from sources)
"""


@query(f"""
    with {_AGE} select source_id, round(age, 2) as age, round(coalesce(greatest(0, 1 - age / 730), 0), 6) as calm, round(coalesce(case when age <= 180 then 1 when age >= 540 then -1 else 1 - 2 * (age - 180) / 360 end, 0), 6) as urgent from aged
""")
def recency(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").withColumn("age", search.age_days(F.col("url"), F.col("published_at"), F.col("academic_year"), F.lit(AS_OF).cast("timestamp_ntz")))
    return s.select("source_id", F.round("age", 2).alias("age"), F.round(search.recency(F.col("age"), False), 6).alias("calm"), F.round(search.recency(F.col("age"), True), 6).alias("urgent"))


_GRADED = f"""
    {_FUSED}, {_AGE}, asks as (select chunk_id as query_id, list_distinct({_TOKENS.format('heading')}) as qs from docs where chunk_id % 100 = 0),
    hits as (select r.query_id, r.chunk_id, c.source_id, rrf, case when len(qs) > 0 then len(list_intersect(qs, c.ts)) * 1.0 / len(qs) else 0 end as coverage, coalesce(list_cosine_similarity(a.e, b.e), 0) as cosine, age, content_type,
      case when regexp_extract(academic_year, '^(\\d{{4}})', 1) <> '' then cast(left(academic_year, 4) as int) when month(published_at) >= 6 then year(published_at) else year(published_at) - 1 end as year
      from rrf r join docs c on c.chunk_id = r.chunk_id join asks on asks.query_id = r.query_id left join aged on aged.source_id = c.source_id left join v a on a.vec_id = r.query_id left join v b on b.vec_id = r.chunk_id),
    graded as (select *, round(cosine + 0.15 * coverage, 3) as grade, coalesce(case when age <= 180 then 1 when age >= 540 then -1 else 1 - 2 * (age - 180) / 360 end, 0) as hard, coalesce(greatest(0, 1 - age / 730), 0) as soft from hits)
"""


@query(f"with {_GRADED} select query_id, chunk_id, round(grade, 3) as grade, round(grade + 0.03 * hard, 6) as urgent_score, round(rrf + 0.0015 * soft + case when content_type = 'html' then 0.001 else 0 end, 6) as score from graded")
def graded_hits(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    a, b = search.graded(h, True), search.graded(h, False)
    b = b.select("query_id", "chunk_id", F.round("rank_score", 6).alias("score"))
    return a.select("query_id", "chunk_id", "grade", F.round("rank_score", 6).alias("urgent_score")).join(b, ["query_id", "chunk_id"])


@query(f"""
    with {_GRADED}
    select query_id, chunk_id from graded o where not exists (select 1 from graded n where n.query_id = o.query_id and ((n.year > o.year and n.coverage >= o.coverage and n.grade >= 0.1) or (o.age >= 540 and n.age <= 365 and n.grade >= o.grade - 0.03)))
""")
def freshness_drop(spark: SparkSession, d: str) -> DataFrame:
    return search.without_outdated(search.graded(_hits(spark, d), True), 0.1).select("query_id", "chunk_id")


@query(f"""
    with {_GRADED}
    select query_id, chunk_id, source_id from (select *, row_number() over (partition by query_id, source_id order by round(rrf + 0.0015 * soft + case when content_type = 'html' then 0.001 else 0 end, 9) desc, chunk_id) as n from graded) where n <= 2
""")
def diverse_cap(spark: SparkSession, d: str) -> DataFrame:
    return search.diverse(search.graded(_hits(spark, d), False)).select("query_id", "chunk_id", "source_id")


@query("""
    select c.chunk_id, n.id as next_id from chunks c left join (select source_id, chunk_index - 1 as i, min(chunk_id) as id from chunks group by all) m on m.source_id = c.source_id and m.i = c.chunk_index left join chunks x on x.chunk_id = m.id
      left join (select chunk_id as id from chunks) n on n.id = m.id and x.heading is not distinct from c.heading
""")
def next_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return search.next_chunks(c.select("chunk_id", "source_id", "chunk_index", "heading"), c).select("chunk_id", "next_id")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """People are the titles of pages about one person."""
    return table(spark, d, "extracted_pages").filter("title like '%, Department of %'").select(F.regexp_extract("title", "^([^,]*),", 1).alias("name")).distinct()


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """(name, chunk_id): chunks under a heading "About" a person."""
    return _chunks(spark, d).filter("heading like 'About %'").select(F.substring("heading", 7, 1000).alias("name"), "chunk_id")


_TITLES = ", ".join(f"'{w}'" for w in search.TITLES)
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: w not in (" + _TITLES + "))"
_NAMED = f"""
    people as (select distinct regexp_extract(title, '^([^,]*),', 1) as name from extracted_pages where title like '%, Department of %'),
    pw as (select name, {_WORDS.format('name')} as ws from people where len(list_distinct({_WORDS.format('name')})) >= 2),
    qw as (select query_id, list_distinct({_WORDS.format('query')}) as qs, regexp_matches(query, '{search.ADDRESSED.replace("'", "''")}') as addressed from questions),
    whole as (select query_id, name from qw, pw where list_has_all(qs, ws)),
    rare as (select ws[1] as w, name from pw where ws[1] in (select ws[1] from pw group by 1 having count(*) <= 3)),
    bynick as (select query_id, w, name from qw join rare on list_contains(qs, w) where addressed and query_id not in (select query_id from whole)),
    named as (select query_id, name from whole union all select distinct query_id, name from bynick join (select query_id, min(w) as w from bynick group by query_id) using (query_id, w))
"""
_URGENT = guard._any(guard.Rules().urgent)
_AFTER = "(select source_id, chunk_index - 1 as i, min(chunk_id) as next_id from chunks group by all)"
_GOES_ON = f"""
    len(list_filter(list_intersect(list_filter({_TOKENS.format('query')}, lambda w: not regexp_matches(w, '^[0-9]+$') and w not in ({", ".join(f"'{w}'" for w in guard.TOPICS)})), {_TOKENS.format('substr(text, greatest(length(text) - 299, 1), 300)')}),
      lambda w: not list_contains({_TOKENS.format('substr(text, 1, greatest(length(text) - 300, 0))')}, w))) > 0
"""
_CONTINUED = f"""
    pairs0 as (select m.query_id, m.chunk_id as first, a.next_id, rank from more m join (select source_id, chunk_index - 1 as i, chunk_id as next_id from chunks) a on a.source_id = m.source_id and a.i = m.chunk_index where {_GOES_ON}),
    pairs1 as (select query_id, first, min(next_id) as next_id, min(rank) as rank from pairs0 p where not exists (select 1 from more m where m.query_id = p.query_id and m.chunk_id = p.next_id) group by query_id, first),
    pairs as (select query_id, next_id, arg_min(first, rank) as first, min(rank) as rank from pairs1 group by query_id, next_id),
    placed as (select query_id, chunk_id, row_number() over (partition by query_id order by paired desc, rank, sub, chunk_id) as pos, paired from (
      select m.query_id, m.chunk_id, m.rank, p.first is not null as paired, 0 as sub from more m left join pairs p on p.query_id = m.query_id and p.first = m.chunk_id
      union all select query_id, next_id, rank, true, 1 from pairs))
"""
_HYBRID = f"""
    {_CORPUS}, {_VEC}, {_AGE}, questions as (select chunk_id as query_id, heading as query, coalesce(regexp_matches(heading, '{_URGENT}'), false) as urgent, list_distinct({_TOKENS.format('heading')}) as qs from chunks where chunk_id % 100 = 0), {_NAMED},
    lists as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scores union all select query_id, vec_id as chunk_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from sim),
    rrf2 as (select query_id, chunk_id, sum(1.0 / (60 + rank)) as rrf from lists join questions using (query_id) where rank <= case when urgent then 24 else 12 end group by all),
    told as (select c.*, content_type, age, case when regexp_extract(academic_year, '^(\\d{{4}})', 1) <> '' then cast(left(academic_year, 4) as int) when month(published_at) >= 6 then year(published_at) else year(published_at) - 1 end as year from chunks c left join aged using (source_id)),
    hits0 as (select r.query_id, r.chunk_id, urgent, rrf, case when len(qs) > 0 then len(list_intersect(qs, {_TOKENS.format('t.text')})) * 1.0 / len(qs) else 0 end as coverage, coalesce(list_cosine_similarity(a.e, b.e), 0) as cosine, t.age, t.year, t.content_type, t.source_id, t.text
      from rrf2 r join told t on t.chunk_id = r.chunk_id join questions q on q.query_id = r.query_id left join v a on a.vec_id = r.query_id left join v b on b.vec_id = r.chunk_id),
    hits1 as (select *, round(cosine + 0.15 * coverage, 3) as grade, coalesce(case when age <= 180 then 1 when age >= 540 then -1 else 1 - 2 * (age - 180) / 360 end, 0) as hard, coalesce(greatest(0, 1 - age / 730), 0) as soft from hits0),
    nasked as (select name, term, count(*) as qn from (select distinct name, unnest({_TOKENS.format('name')}) as term, generate_subscripts({_TOKENS.format('name')}, 1) as n from (select distinct name from named)) group by all),
    nscores as (select name, chunk_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) as score from tf join idf using (term) join nasked using (term), stats group by all having score > 0),
    profiles as (select substr(heading, 7) as name, chunk_id from chunks where heading like 'About %'),
    wanted as (select distinct query_id, chunk_id from named join (select name, chunk_id from nscores qualify row_number() over (partition by name order by score desc, chunk_id) <= 150 union all select name, chunk_id from profiles) using (name)),
    extra as (select w.query_id, w.chunk_id, q.urgent, 0.0 as coverage, round(coalesce(list_cosine_similarity(a.e, b.e), 0), 3) as grade, null::double as age, t.year, t.content_type, t.source_id, t.text from wanted w join told t on t.chunk_id = w.chunk_id join questions q on q.query_id = w.query_id
      left join v a on a.vec_id = w.query_id left join v b on b.vec_id = w.chunk_id where w.query_id in (select query_id from hits0) and not exists (select 1 from hits0 h where h.query_id = w.query_id and h.chunk_id = w.chunk_id)),
    hits2 as (select query_id, chunk_id, urgent, coverage, grade, age, year, content_type, source_id, text, round(case when urgent then grade + 0.03 * hard else rrf + 0.0015 * soft + case when content_type = 'html' then 0.001 else 0 end end, 9) as score from hits1
      union all select query_id, chunk_id, urgent, coverage, grade, age, year, content_type, source_id, text, grade as score from extra),
    ns as (select query_id, list(distinct lower(name)) as names from named group by query_id), own as (select distinct query_id, chunk_id from named join profiles using (name)),
    hits3 as (select h.*, case when names is null then null when o.chunk_id is not null then 1.0 when len(list_filter(names, lambda n: contains(lower(text), n) or contains(lower(text), array_to_string(list_reverse(string_split(n, ' ')), ' ')))) > 0 then case when content_type = 'html' then 0.5 else 0.1 end end as bonus
      from hits2 h left join ns using (query_id) left join own o on o.query_id = h.query_id and o.chunk_id = h.chunk_id),
    good as (select query_id, chunk_id, urgent, coverage, age, year, source_id, coalesce(bonus + grade, score) as score, case when bonus is not null then greatest(grade, {ON_TOPIC}) else grade end as grade from hits3 where case when bonus is not null then greatest(grade, {ON_TOPIC}) else grade end >= {ON_TOPIC * 0.9}),
    fresh as (select * from good o where not (urgent and exists (select 1 from good n where n.query_id = o.query_id and ((n.year > o.year and n.coverage >= o.coverage and n.grade >= {ON_TOPIC}) or (o.age >= 540 and n.age <= 365 and n.grade >= o.grade - 0.03))))),
    best as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select * from fresh qualify row_number() over (partition by query_id, source_id order by score desc, chunk_id) <= 2) qualify rank <= 3),
    after as (select b.query_id, a.next_id as chunk_id from best b join chunks c on c.chunk_id = b.chunk_id join {_AFTER} a on a.source_id = c.source_id and a.i = c.chunk_index join chunks x on x.chunk_id = a.next_id where rank = 1 and x.heading is not distinct from c.heading
      and not exists (select 1 from best o where o.query_id = b.query_id and o.chunk_id = a.next_id)),
    more as (select query_id, chunk_id, source_id, chunk_index, text, query, row_number() over (partition by query_id order by o) as rank from (select query_id, chunk_id, rank * 2 as o from best union all select query_id, chunk_id, 3 as o from after) join chunks using (chunk_id) join questions using (query_id)),
    {_CONTINUED}, sized as (select query_id, chunk_id, pos, cast(floor((length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) as int) + 1 as t from placed join chunks using (chunk_id)),
    spent(query_id, chunk_id, pos, used, kept) as (select query_id, chunk_id, pos, t, true from sized where pos = 1
      union all select s.query_id, s.chunk_id, s.pos, p.used + case when p.used + s.t <= 1100 then s.t else 0 end, p.used + s.t <= 1100 from spent p join sized s on s.query_id = p.query_id and s.pos = p.pos + 1)
"""


@query(f"with recursive {_HYBRID} select query_id, cast(row_number() over (partition by query_id order by pos) - 1 as int) as pos, chunk_id from spent where kept")
def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: 12 candidates of both searches, 24 where the newest must win, and the chunks about people who are named;
    graded, those people first, outdated ones dropped, two a source, the best three with what goes on after them, within the budget."""
    c = _chunks(spark, d)
    index = search.KeywordIndex.build(c)
    questions = staged(_questions(c).withColumn("urgent", guard.is_urgent(F.col("query"))), "questions")
    q, v = _vectors(spark, d)
    most = search.CANDIDATES_URGENT
    rrf = search.candidates(index.search(questions, most), search.dense(q, v, most).withColumnRenamed("vec_id", "chunk_id"), questions)
    h = _described(spark, d, rrf).join(questions.select("query_id", "urgent"), "query_id")
    h = search.graded(h, F.col("urgent"))
    named = staged(search.people_named(questions, _people(spark, d)), "named")
    s = table(spark, d, "sources").select("source_id", "url", "content_type", "academic_year", "published_at")
    chunks = c.join(s, "source_id", "left").withColumn("tokens", T.estimated_tokens(F.col("text"))).withColumn("year", search.content_year(F.col("academic_year"), F.col("published_at")))
    h = staged(search.with_named(h, named, _profiles(spark, d), index, chunks, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("ce"))).drop("qe", "ce"), "hits")
    own = named.join(_profiles(spark, d), "name").select("query_id", "chunk_id").distinct().withColumn("is_profile", F.lit(True))
    h = search.people_first(h.join(own, ["query_id", "chunk_id"], "left").withColumn("is_profile", F.coalesce("is_profile", F.lit(False))), named, ON_TOPIC)
    good = h.filter(F.col("grade") >= ON_TOPIC * 0.9)
    good = search.diverse(search.without_outdated(good, ON_TOPIC, only=F.col("urgent")))
    best = staged(search.top(good, search.TOP_K, "query_id", F.desc("rank_score"), F.col("chunk_id")), "best")
    more = search.with_neighbour(best, c).join(c, "chunk_id").join(questions, "query_id")
    placed = search.with_continuations(more, c, guard.TOPICS).withColumnRenamed("pos", "rank").join(c.select("chunk_id", T.estimated_tokens(F.col("text")).alias("tokens")), "chunk_id")
    return search.within_budget(placed).select("query_id", "pos", F.col("chunk_id").cast("long").alias("chunk_id"))


@query(f"with questions as (select chunk_id as query_id, text as query from chunks), {_NAMED} select query_id, name from named")
def people_named(spark: SparkSession, d: str) -> DataFrame:
    """Whom chunks name."""
    q = table(spark, d, "chunks").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    return search.people_named(q, _people(spark, d))


@query()
def guard_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each document's text as a message."""
    return table(spark, d, "documents").select("doc_id", guard.classified(F.col("text")).alias("g")).select("doc_id", "g.kind", "g.small_talk", "g.abusive")


@query(f"select doc_id, coalesce(regexp_matches(text, '{guard._any(guard.Rules().urgent)}'), false) as urgent from documents")
def urgent_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", guard.is_urgent(F.col("text")).alias("urgent"))


@query("select chunk_id, heading, prev from (select chunk_id, heading, lag(heading) over (partition by source_id order by chunk_index, chunk_id) as prev from chunks)")
def previous_question(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "heading", F.lag("heading").over(Window.partitionBy("source_id").orderBy("chunk_index", "chunk_id")).alias("prev"))


_TURN = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""
    with t as (select chunk_id, trim(heading, ' ') as q, lag(trim(heading, ' ')) over (partition by source_id order by chunk_index, chunk_id) as prev from chunks where heading is not null),
      w as (select *, {_TURN.format('q')} as ws, {_TURN.format("coalesce(prev, '')")} as ps from t),
      x as (select *, list_filter(ws, lambda w: w not in ({_IN(guard.EMPTY_WORDS)}) and w not in ({_IN(guard.TOPICS)})) as subject,
        array_to_string(list_concat(list_filter([{_IN(guard.TOPICS)}], lambda w: list_contains(ps, w) and not list_contains(ws, w)), list_filter(regexp_extract_all(coalesce(prev, ''), '\\b20[0-9]{{2}}\\s*[-–]\\s*[0-9]{{2,4}}\\b'), lambda y: not contains(q, y))), ' ') as borrowed from w)
    select chunk_id, case when coalesce(prev, '') = '' then q when regexp_matches(q, '{guard.PRONOUNS.replace("'", "''")}') or len(subject) = 0 then prev || ' ' || q when len(list_filter(subject, lambda w: w in ({_IN(guard.STANDALONE)}))) > 0 then q
      when (regexp_matches(q, '{guard.OPENER}') or len(ws) <= 3) and borrowed <> '' then q || ' ' || borrowed else q end as search from x
""")
def contextualized(spark: SparkSession, d: str) -> DataFrame:
    """Headings of a source as the turns of a conversation."""
    c = table(spark, d, "chunks").filter("heading is not null").withColumn("turn", F.struct("chunk_index", "chunk_id"))
    return guard.contextualized(c, "source_id", "turn", "heading").select("chunk_id", "search")


@query("select source_id, chunk_id from (select source_id, chunk_id, row_number() over (partition by source_id order by chunk_index desc, chunk_id desc) as n from chunks) where n <= 3")
def last_user_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").withColumn("turn", F.struct("chunk_index", "chunk_id"))
    return guard.last_turns(c, 3, "source_id", "turn", "heading", role=None).select("source_id", "chunk_id")


@query()
def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as an answer, its source's first chunk as the evidence."""
    c = _chunks(spark, d)
    first = c.groupBy("source_id").agg(F.min_by("text", F.struct("chunk_index", "chunk_id")).alias("context"))
    known = staged(first.select("source_id", facts.evidence(F.col("context")).alias("evidence")), "evidence")
    got = facts.checked(c.select("chunk_id", "source_id", F.col("text").alias("answer")).join(search._small(known, 10_000), "source_id"), 2026)
    return got.select("chunk_id", "check.ok", F.size("check.unsupported").alias("n_unsupported"), "check.kept")


@query("""
    select chunk_id, coalesce(regexp_matches(text, '""" + facts.NO_INFORMATION.replace("'", "''") + """') or contains(lower(text), 'don''t have that information'), false) as nothing from chunks
""")
def no_information(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", facts.says_nothing(F.col("text")).alias("nothing"))


_ADDRESS = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://[^\s<>\"'')\]]+"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_DIGITS = f"translate({{0}}, '{facts.NATIVE_DIGITS}', '{'0123456789' * (len(facts.NATIVE_DIGITS) // 10)}')"


@query(f"""
    with s as (select chunk_id, coalesce(text, '') as s, coalesce(heading, '') as t from chunks),
      i as (select *, list_transform(regexp_extract_all(s, '{_ADDRESS}'), lambda x: regexp_replace(x, '[.,;:]+$', '')) as links, list_transform(regexp_extract_all(regexp_replace({_DIGITS.format('s')}, '{_ADDRESS}', ' ', 'g'), '[0-9][0-9,.]*[0-9]|[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as numbers,
        regexp_replace({_DIGITS.format('t')}, '[^0-9]', '', 'g') as run from s)
    select chunk_id, array_to_string(list_concat(list_filter({_ONCE.format('links')}, lambda x: not contains(t, x)), list_filter({_ONCE.format('numbers')}, lambda x: not contains(run, x))), '|') as missing from i
""")
def translation_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What of a chunk's addresses and digits its heading lacks."""
    return table(spark, d, "chunks").select("chunk_id", F.array_join(facts.missing_items(F.col("text"), F.col("heading")), "|").alias("missing"))


@query(f"""
    with {_GRADED}, questions as (select chunk_id as query_id, heading as query from chunks where chunk_id % 100 = 0), {_NAMED}, ns as (select query_id, list(distinct lower(name)) as names from named group by query_id),
      scored as (select g.query_id, g.chunk_id, grade, round(rrf + 0.0015 * soft + case when content_type = 'html' then 0.001 else 0 end, 9) as score, case when names is null then null when coalesce(heading like 'About %', false) then 1.0
        when len(list_filter(names, lambda n: contains(lower(text), n) or contains(lower(text), array_to_string(list_reverse(string_split(n, ' ')), ' ')))) > 0 then case when content_type = 'html' then 0.5 else 0.1 end end as bonus from graded g join docs using (chunk_id) left join ns on ns.query_id = g.query_id)
    select query_id, chunk_id, case when bonus is not null then greatest(grade, 0.5) else grade end as grade, round(coalesce(bonus + grade, score), 6) as score from scored
""")
def people_first(spark: SparkSession, d: str) -> DataFrame:
    """Hits with those first that name whom the question's heading names."""
    h = search.graded(_hits(spark, d), False).withColumn("is_profile", F.coalesce(F.col("heading").startswith("About "), F.lit(False)))
    named = search.people_named(_questions(_chunks(spark, d)), _people(spark, d))
    return search.people_first(h, named).select("query_id", "chunk_id", "grade", F.round("rank_score", 6).alias("score"))


@query(f"with {_CORPUS}, more as (select query_id, bm.chunk_id, source_id, chunk_index, text, asker.heading as query, rank from bm join docs using (chunk_id) join (select chunk_id as query_id, heading from chunks) asker using (query_id)), {_CONTINUED} select query_id, chunk_id, cast(pos as int) as pos, paired from placed")
def continuations(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    hits = search.bm25(_questions(c), c, 12).join(_questions(c), "query_id").join(c, "chunk_id")
    return search.with_continuations(hits, c, guard.TOPICS)


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) >= 4 and w not in (" + ", ".join(f"'{w}'" for w in facts.EMPTY_WORDS) + ")))"


@query(f"""
    with {_CORPUS}, h as (select bm.query_id, bm.chunk_id, rank, len(list_intersect({_CONTENT.format('a.text')}, {_CONTENT.format('c.text')})) as shared from bm join docs c on c.chunk_id = bm.chunk_id join docs a on a.chunk_id = bm.query_id where bm.chunk_id <> bm.query_id)
    select query_id, chunk_id, cast(shared as int) as shared from h where shared > 0 qualify row_number() over (partition by query_id order by shared desc, rank, chunk_id desc) = 1
""")
def best_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of each asking chunk's hits other than itself the one that shares most of its words."""
    c = _chunks(spark, d)
    hits = search.bm25(_questions(c), c, 12).join(c.select("chunk_id", "text"), "chunk_id").join(c.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("answer")), "query_id")
    return facts.best_source(hits.filter("chunk_id <> query_id"))


@query(f"with {_GRADED} select query_id, round(min(age) + 365, 2) as age from graded where age is not null group by query_id having min(age) + 365 > 180")
def stale_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions all of whose dated hits are old, asked a year later."""
    return facts.stale_since(_hits(spark, d).withColumn("age", F.col("age") + 365)).select("query_id", F.round("age", 2).alias("age"))


@query(f"with {_VEC} select query_id, vec_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from sim qualify rank <= 12")
def vector_index_all(spark: SparkSession, d: str) -> DataFrame:
    """The index with all lists probed, which is exact."""
    q, v = _vectors(spark, d)
    index = search.VectorIndex.build(v)
    return index.search(q, 12, len(index.centres)).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 12 of the index with two thirds of its lists probed; the stored vectors have no clusters."""
    q, v = _vectors(spark, d)
    index = search.VectorIndex.build(v)
    return search.recall(index.search(q, 12, -(-2 * len(index.centres) // 3)), search.dense(q, v, 12))


@query("select chunk_id, coalesce(regexp_matches(text, '" + facts.NO_INFORMATION.replace("'", "''") + "') or contains(lower(text), 'don''t have that information'), false) and length(text) < 220 and not regexp_matches(text, '[0-9]') as refusal from chunks where text is not null")
def refusals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text is not null").select("chunk_id", facts.is_refusal(F.col("text")).alias("refusal"))


#: Short forms and their meanings, for the queries below.
MEANINGS = {"bca": "BCA Bachelor of Computer Applications", "bba": "BBA Bachelor of Business Administration", "bsc": "B.Sc Bachelor of Science", "msc": "M.Sc Master of Science", "pgdca": "Post Graduate Diploma in Computer Applications", "iqac": "IQAC Internal Quality Assurance Cell"}
_SHORT = "regexp_replace(regexp_replace(coalesce(heading, ''), '\\b([A-Za-z])\\.([A-Za-z])', '\\1\\2', 'g'), '\\b([A-Za-z])\\.([A-Za-z])', '\\1\\2', 'g')"
_FOUND = "list_filter([" + ", ".join(f"case when regexp_matches({_SHORT}, '(?i)\\b{k}\\b') then '{v}' end" for k, v in MEANINGS.items()) + "], lambda x: x is not null)"
_GLOSSED = "list_filter([" + ", ".join(f"case when regexp_matches({_SHORT}, '(?i)\\b{k}\\b') then '{k.upper()} = {v[len(k):].lstrip() if v.lower().startswith(k + ' ') else v}' end" for k, v in MEANINGS.items()) + "], lambda x: x is not null)"


@query(f"select chunk_id, case when len({_FOUND}) > 0 then heading || ' (' || array_to_string({_FOUND}, '; ') || ')' else heading end as search, array_to_string({_GLOSSED}, '; ') as glossary from chunks where heading is not null")
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Headings as questions, with the meanings of their short forms."""
    h = F.col("heading")
    return table(spark, d, "chunks").filter("heading is not null").select("chunk_id", guard.expanded(h, MEANINGS).alias("search"), F.array_join(guard.glossary(h, MEANINGS), "; ").alias("glossary"))


_TOPIC = guard._any(guard.Rules().topic).replace("'", "''")


@query(f"with t as (select doc_id, coalesce(text, '') as t from documents) select doc_id, coalesce(regexp_matches(t, '{_TOPIC}') or regexp_matches(t, '[^\\x00-\\x7F]'), false) as on_topic from t")
def topic_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", guard.on_topic(F.coalesce("text", F.lit(""))).alias("on_topic"))
