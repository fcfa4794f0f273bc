"""Keyword and vector search, fusion and ranking, for whole sets of queries at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmill.functions.text import coverage, tokens
from weftmill.shared import new_path, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, KEYWORD_WEIGHT, PAGE_BONUS = 60, 0.15, 0.001
FRESHNESS, FRESHNESS_URGENT, SAME_TOPIC = 0.0015, 0.03, 0.03
FRESH_DAYS, STALE_DAYS, NEWER_WITHIN = 180, 540, 365
PER_SOURCE, TOP_K, CONTEXT_TOKENS, THRESHOLD = 2, 3, 1100, 0.5
CANDIDATES, CANDIDATES_URGENT, NAMED_CHUNKS = 12, 24, 150
#: Rows of the smaller side of a join that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; it should be staged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class KeywordIndex:
    """A saved index of texts for keyword search: postings in order of their terms, inverse frequencies, and one row of statistics.

    It is built once, each text being tokenized once, and read by any number of searches: of the postings, only those of
    asked terms.
    """

    def __init__(self, spark: SparkSession, path: str, own: Sequence[str] = ()):
        self.path, self.own = path.rstrip("/"), tuple(own)
        read = lambda name: spark.read.parquet(f"{self.path}/{name}")
        self.postings, self.terms, self.stats = read("postings"), read("terms"), read("stats")

    @staticmethod
    def build(docs: DataFrame, key: str = "chunk_id", text: str = "text", own: Sequence[str] = (), path: str | None = None) -> KeywordIndex:
        """An index of all ``docs``; null texts have no terms. Without a path it lies among the staged tables."""
        spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "index")
        words = staged(docs.select(key, tokens(F.col(text), own).alias("ts")), "words")
        post = words.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))
        post.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        words.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(F.size("ts"), F.lit(0))).alias("avg_len")).coalesce(1).write.parquet(f"{path}/stats")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        inverse_frequencies(read("postings"), read("stats")).write.parquet(f"{path}/terms")
        return KeywordIndex(spark, path, own)

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query", key: str = "chunk_id") -> DataFrame:
        """(query_key, key, score, rank): the k best texts of each query by Okapi BM25; only scores above 0, ties by key.

        A repeated term of a query counts as often. Asked terms take their frequencies first and meet the postings in one
        join, broadcast if they are few; scores are summed partly before the shuffle.
        """
        asked = queries.select(query_key, F.explode(tokens(F.col(query), self.own)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qn"))
        asked = staged(self.terms.join(asked, "term").select("term", query_key, (F.col("qn") * F.col("idf")).alias("w")), "asked")
        hits = self.postings.join(_small(asked), "term").crossJoin(F.broadcast(self.stats))  # stats: one row
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        scores = hits.groupBy(query_key, key).agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")
        return top(scores, k, query_key, F.desc("score"), F.col(key)).select(query_key, key, "score", "rank")


def inverse_frequencies(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N - df + 0.5) / (df + 0.5)); below zero, a quarter of the mean over all terms instead."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # stats: one row
    mean = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def top(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "query_id", query: str = "query", key: str = "chunk_id", text: str = "text", own: Sequence[str] = ()) -> DataFrame:
    """``KeywordIndex.search`` over an index built for it; keep the index where there is more than one search."""
    return KeywordIndex.build(docs, key, text, own).search(queries, k, query_key, query, key)


def dense(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", query: str = "q", key: str = "vec_id", vector: str = "embedding", same: str | None = None, block: int = 512) -> DataFrame:
    """(query_key, key, score, rank): the k vectors of highest cosine to each query, exactly; ties by key.

    Queries go over the vectors in blocks: each task multiplies its share of the vectors with one block of queries at a
    time and keeps k candidates a query, so what is shuffled is k rows per query and task. ``same`` names a column in
    both sides that must be equal. A vector of zeros has cosine 0; null vectors are left out. Queries are a stated set;
    they are sent as blocks of at most ``block`` rows.
    """
    cols = [query_key, query] + ([same] if same else [])
    q = queries.select(*cols).filter(f"{query} is not null")
    n = q.count()
    blocks = max(1, -(-n // block))
    parts = [r.q for r in q.withColumn("b", F.pmod(F.xxhash64(query_key), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct(*cols)).alias("q")).toLocalIterator()] if n else []
    out = None
    kind = dict(vectors.dtypes)[key]
    qkind = dict(queries.dtypes)[query_key]
    for part in parts:
        ids = [r[query_key] for r in part]
        m = np.array([r[query] for r in part], dtype=np.float64)
        m /= np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
        want = np.array([r[same] for r in part], dtype=object) if same else None

        def score(it, ids=ids, m=m, want=want):
            best = None
            for pdf in it:
                if not len(pdf):
                    continue
                v = np.array(pdf[vector].tolist(), dtype=np.float64)
                v /= np.where((s := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, s)
                sim = np.round(m @ v.T, 9)
                if want is not None:
                    sim = np.where(want[:, None] == pdf[same].to_numpy(dtype=object)[None, :], sim, -np.inf)
                names = pdf[key].to_numpy()
                got = []
                for i, qid in enumerate(ids):
                    order = np.lexsort((names, -sim[i]))[:k]
                    got.append(pd.DataFrame({query_key: qid, key: names[order], "score": sim[i][order]}))
                best = pd.concat([*([best] if best is not None else []), *got]).sort_values([query_key, "score", key], ascending=[True, False, True]).groupby(query_key).head(k)
            if best is not None:
                yield best[np.isfinite(best["score"])]

        one = vectors.select(key, vector, *([same] if same else [])).filter(f"{vector} is not null").mapInPandas(score, f"{query_key} {qkind}, {key} {kind}, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{query_key} {qkind}, {key} {kind}, score double, rank int")
    return top(out, k, query_key, F.desc("score"), F.col(key)).select(query_key, key, "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def fused(*ranked: DataFrame, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query_key, key, rrf): reciprocal ranks 1 / (60 + rank) summed over ranked lists."""
    parts = [r.select(query_key, key, (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(query_key, key).agg(F.sum("part").alias("rrf"))


def age_days(url: Column, at: Column, academic_year: Column, as_of: Column) -> Column:
    """Age of what a source says: from its date or the June of its academic year, the older; null for home pages and the undated.

    Never below 0. ``as_of`` is a parameter, so results don't depend on when they are computed.
    """
    year = F.regexp_extract(academic_year, r"^(\d{4})", 1)
    june = F.when((year >= "2000") & (year <= "2100"), F.make_timestamp_ntz(year.try_cast("int"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    ts = F.least(at, june)  # ignores nulls
    home = F.length(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "[^/]", "")) <= 2
    days = F.timestamp_diff("SECOND", ts, as_of) / 86400.0
    return F.when(~F.coalesce(home, F.lit(False)), F.greatest(F.lit(0.0), days))


def recency(age: Column, urgent: bool | Column) -> Column:
    """From -1 to 1; the undated are neutral. Gentle over two years, or, if urgent, from full before 180 to -1 after 540 days."""
    soft = F.greatest(F.lit(0.0), 1 - age / 730)
    hard = F.when(age <= FRESH_DAYS, 1.0).when(age >= STALE_DAYS, -1.0).otherwise(1 - 2 * (age - FRESH_DAYS) / (STALE_DAYS - FRESH_DAYS))
    return F.coalesce(F.when(F.lit(urgent) if isinstance(urgent, bool) else urgent, hard).otherwise(soft), F.lit(0.0))


def content_year(academic_year: Column, at: Column) -> Column:
    """The stated academic year, else the June-to-May year of the date."""
    y = F.regexp_extract(academic_year, r"^(\d{4})", 1)
    return F.when(y != "", y.try_cast("int")).when(F.month(at) >= 6, F.year(at)).otherwise(F.year(at) - 1)


def graded(hits: DataFrame, urgent: bool | Column) -> DataFrame:
    """``hits`` (cosine, coverage, rrf, age, content_type) with grade and rank_score; urgency may differ by row."""
    urgent = F.lit(urgent) if isinstance(urgent, bool) else urgent
    grade = F.round(F.col("cosine") + KEYWORD_WEIGHT * F.col("coverage"), 3)
    fresh = recency(F.col("age"), urgent)
    calm = F.col("rrf") + FRESHNESS * fresh + F.when(F.col("content_type") == "html", PAGE_BONUS).otherwise(0.0)
    return hits.withColumn("grade", grade).withColumn("rank_score", F.round(F.when(urgent, F.col("grade") + FRESHNESS_URGENT * fresh).otherwise(calm), 9))


def without_outdated(hits: DataFrame, threshold: float, query_key: str = "query_id", key: str = "chunk_id", only: Column | None = None) -> DataFrame:
    """``hits`` (year, coverage, grade, age) without those that a newer hit of the same query replaces; with ``only``, of such queries.

    A hit goes if one of a later year covers as much and is graded at least ``threshold``; or if it is stale and one of
    the last 365 days is graded at most 0.03 lower. All are held against the full list: per query a maximum over later
    years decides, found by a window in order of year, so no pairs are formed.
    """
    good = F.when(F.col("grade") >= threshold, F.col("coverage"))
    later = Window.partitionBy(query_key).orderBy(F.desc("year")).rangeBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(query_key)
    new = F.max(F.when(F.col("age") <= NEWER_WITHIN, F.col("grade"))).over(all_)
    d = hits.withColumn("_best", F.when(F.col("year").isNotNull(), F.max(F.when(F.col("year").isNotNull(), good)).over(later))).withColumn("_new", new)
    gone = (F.col("_best") >= F.col("coverage")) | (F.col("age") >= STALE_DAYS) & (F.col("_new") >= F.col("grade") - SAME_TOPIC)
    gone = gone if only is None else gone & only
    return d.filter(~F.coalesce(gone, F.lit(False))).drop("_best", "_new")


def diverse(hits: DataFrame, most: int = PER_SOURCE, query_key: str = "query_id", key: str = "chunk_id", source: str = "source_id") -> DataFrame:
    """At most so many hits of a source for each query, in order of rank_score, then key; hits without a source are one group."""
    w = Window.partitionBy(query_key, source).orderBy(F.desc("rank_score"), key)
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def next_chunks(hits: DataFrame, chunks: DataFrame, source: str = "source_id", index: str = "chunk_index") -> DataFrame:
    """Each hit with the chunk that follows it in its source under the same heading, if there is one (smallest id of several)."""
    after = chunks.groupBy(F.col(source).alias("_s"), (F.col(index) - 1).alias("_i")).agg(F.min(F.struct("chunk_id", "heading")).alias("n"))
    same = (F.col(source) == F.col("_s")) & (F.col(index) == F.col("_i")) & F.col("heading").eqNullSafe(F.col("n.heading"))
    return hits.join(after, same, "left").withColumn("next_id", F.col("n.chunk_id")).drop("_s", "_i", "n")


def within_budget(hits: DataFrame, budget: int = CONTEXT_TOKENS, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query_key, key, pos): hits (tokens, rank) taken in order as long as they fit; one that does not fit is passed over, the first is always kept.

    A query has at most a few dozen hits, so its list is one array.
    """
    lists = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), F.col("tokens").cast("int").alias("t")))).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))
    fold = F.aggregate("xs", start, lambda s, x: F.when((F.size(s["out"]) == 0) | (s["used"] + x["t"] <= budget), F.struct((s["used"] + x["t"]).alias("used"), F.concat(s["out"], F.array(x["k"].cast("string"))).alias("out"))).otherwise(s))
    return lists.select(query_key, F.posexplode(fold["out"]).alias("pos", key))


def people_named(queries: DataFrame, people: DataFrame, query_key: str = "query_id", query: str = "query", name: str = "name") -> DataFrame:
    """(query_key, name): people of whose names the query has every word; else, if it addresses a person, by a first name that 1 to 3 people have.

    Found by joining on words and counting, with no pair of query and person formed that shares no word. Titles are no
    words of a name; names of one word are left out.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*TITLES)))
    p = people.select(name, words(F.col(name)).alias("ws")).filter("size(ws) >= 2").distinct()
    q = queries.select(query_key, words(F.col(query)).alias("qs"), F.col(query).rlike(ADDRESSED).alias("addressed"))
    asked = q.select(query_key, "addressed", F.explode("qs").alias("w"))
    full = asked.join(p.select(name, F.size("ws").alias("n"), F.explode("ws").alias("w")), "w").groupBy(query_key, name, "n").agg(F.count("*").alias("hit")).filter("hit = n").select(query_key, name)
    firsts = p.select(F.col("ws")[0].alias("w"), name)
    rare = firsts.join(firsts.groupBy("w").count().filter("count <= 3"), "w", "left_semi")
    some = asked.filter("addressed").join(rare, "w").join(full.select(query_key).distinct(), query_key, "left_anti")
    one = some.groupBy(query_key).agg(F.min("w").alias("w")).join(some.select(query_key, "w", name), [query_key, "w"]).select(query_key, name).distinct()
    return full.unionByName(one)


# Titles before names, and words that address a person.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "fr", "prof", "sr", "sj", "rev", "br"]
ADDRESSED = r"(?i)\b(sir|madam|ma'?am|mam|miss|teacher|professor|prof|dr|mr|mrs|ms|fr|who is|who's|contact|email|e-mail)\b"


def with_coverage(hits: DataFrame, query: str = "query", text: str = "text", own: Sequence[str] = (), spelled: Mapping[str, str] = {}) -> DataFrame:
    """``hits`` with ``coverage``; a short form of ``spelled`` counts as covered also where the text has all words of its meaning."""
    return hits.withColumn("coverage", coverage(F.col(query), F.col(text), own, spelled))


def candidates(keyword: DataFrame, vector: DataFrame, urgent: DataFrame, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query_key, key, rrf) of ranked lists: 12 of each for a query, 24 for one of ``urgent`` (query_key, urgent)."""
    most = F.when(F.coalesce("urgent", F.lit(False)), CANDIDATES_URGENT).otherwise(CANDIDATES)
    cut = lambda r: r.join(urgent.select(query_key, "urgent"), query_key, "left").filter(F.col("rank") <= most)
    return fused(cut(keyword), cut(vector), query_key=query_key, key=key)


def with_named(hits: DataFrame, named: DataFrame, profiles: DataFrame, index: KeywordIndex, chunks: DataFrame, vectors: DataFrame, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """``hits`` and, for queries that name people, also their profiles' chunks and up to 150 chunks that match a name.

    ``named`` has (query_key, name), ``profiles`` (name, key) of the chunks about a person, ``chunks`` what hits have of a
    chunk, ``vectors`` (key, e) and for queries (query_key, qe) in ``hits``' terms. Those added are graded by cosine alone.
    """
    names = staged(named.select("name").distinct().withColumn("_n", F.xxhash64("name")), "names")
    found = index.search(names, NAMED_CHUNKS, "_n", "name", key).join(names, "_n").select("name", key)
    wanted = named.join(found.unionByName(profiles.select("name", key)), "name").select(query_key, key).distinct()
    new = wanted.join(hits.select(query_key, key), [query_key, key], "left_anti").join(chunks, key)
    asked = hits.groupBy(query_key).agg(*[F.any_value(c).alias(c) for c in ("query", "qe", "urgent")])
    score = F.round(F.coalesce(cosine(F.col("qe"), F.col("ce")), F.lit(0.0)), 3)
    new = new.join(asked, query_key).join(vectors, key, "left").withColumn("cosine", score).withColumn("grade", score).withColumn("rank_score", score)
    new = new.withColumn("coverage", F.lit(0.0)).withColumn("rrf", F.lit(0.0)).withColumn("age", F.lit(None).cast("double"))
    return hits.unionByName(new.select(*hits.columns))


def with_neighbour(hits: DataFrame, chunks: DataFrame, k: int = TOP_K, query_key: str = "query_id") -> DataFrame:
    """(query_key, chunk_id, rank): the first k hits and, after the best of them, the chunk that goes on under the same heading.

    ``hits`` have a rank from 1. Nothing is added if that chunk is among them already.
    """
    kept = hits.filter(F.col("rank") <= k)
    first = kept.filter(F.col("rank") == 1).select(query_key, "source_id", "chunk_index", "heading")
    after = next_chunks(first, chunks).filter("next_id is not null").select(query_key, F.col("next_id").alias("chunk_id"))
    after = after.join(kept.select(query_key, "chunk_id"), [query_key, "chunk_id"], "left_anti")
    both = kept.select(query_key, "chunk_id", (F.col("rank") * 2).alias("o")).unionByName(after.select(query_key, "chunk_id", F.lit(3).alias("o")))
    return both.select(query_key, "chunk_id", F.row_number().over(Window.partitionBy(query_key).orderBy("o")).alias("rank"))


def people_first(hits: DataFrame, named: DataFrame, threshold: float = THRESHOLD, query_key: str = "query_id", profile: str = "is_profile", text: str = "text") -> DataFrame:
    """``hits`` (grade, rank_score, content_type, is_profile) with those first that name a person asked about.

    A profile gains 1, a page that names one 0.5, a file 0.1, on top of the grade, which rises to ``threshold``. A query
    names a few people, so their names are one array of its hits.
    """
    names = named.groupBy(query_key).agg(F.collect_set(F.lower("name")).alias("_names"))
    d = hits.join(names, query_key, "left")
    says = F.exists("_names", lambda n: F.lower(F.col(text)).contains(n) | F.lower(F.col(text)).contains(F.array_join(F.reverse(F.split(n, " ")), " ")))
    bonus = F.when(F.col("_names").isNull(), None).when(F.col(profile), 1.0).when(says & (F.col("content_type") == "html"), 0.5).when(says, 0.1)
    return d.withColumn("_b", bonus).withColumn("rank_score", F.coalesce(F.col("_b") + F.col("grade"), "rank_score")).withColumn("grade", F.when(F.col("_b").isNotNull(), F.greatest(F.col("grade"), F.lit(threshold))).otherwise(F.col("grade"))).drop("_b", "_names")


def ends_with_subject(query: Column, text: Column, topics: Sequence[str], common: Sequence[str] = (), tail: int = 300) -> Column:
    """Whether a subject word of the query stands only in the text's last characters, so that its table follows in the next chunk."""
    n = F.length(text)
    want = F.filter(F.array_distinct(tokens(query)), lambda w: ~w.rlike(r"^\d+$") & ~w.isin(*topics, *common, ""))
    end = tokens(F.substring(text, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))
    body = tokens(F.substring(text, F.lit(1), F.greatest(n - tail, F.lit(0))))
    return F.coalesce(F.size(F.array_except(F.array_intersect(want, end), body)) > 0, F.lit(False))


def with_continuations(hits: DataFrame, chunks: DataFrame, topics: Sequence[str], query_key: str = "query_id") -> DataFrame:
    """``hits`` (query, text, source_id, chunk_index, rank) with the chunk that goes on after those that end with the subject.

    Such pairs come first, in order; a chunk that is a hit already is not added. ``pos`` counts from 1.
    """
    goes_on = hits.filter(ends_with_subject(F.col("query"), F.col("text"), topics))
    after = chunks.select(F.col("source_id"), (F.col("chunk_index") - 1).alias("chunk_index"), F.col("chunk_id").alias("next_id"))
    pairs = goes_on.join(after, ["source_id", "chunk_index"]).select(query_key, F.col("chunk_id").alias("first"), "next_id", "rank")
    pairs = pairs.join(hits.select(query_key, F.col("chunk_id").alias("next_id")), [query_key, "next_id"], "left_anti").groupBy(query_key, "first").agg(F.min("next_id").alias("next_id"), F.min("rank").alias("rank"))
    pairs = pairs.groupBy(query_key, "next_id").agg(F.min_by("first", "rank").alias("first"), F.min("rank").alias("rank"))
    own = hits.join(pairs.select(query_key, F.col("first").alias("chunk_id"), F.lit(True).alias("paired")), [query_key, "chunk_id"], "left").select(query_key, "chunk_id", "rank", F.coalesce("paired", F.lit(False)).alias("paired"), F.lit(0).alias("sub"))
    added = pairs.select(query_key, F.col("next_id").alias("chunk_id"), "rank", F.lit(True).alias("paired"), F.lit(1).alias("sub"))
    w = Window.partitionBy(query_key).orderBy(F.desc("paired"), "rank", "sub", "chunk_id")
    return own.unionByName(added).withColumn("pos", F.row_number().over(w)).select(query_key, "chunk_id", "pos", "paired")


#: Vectors that centres are fitted on at most, and rounds of fitting.
SAMPLE_VECTORS, ROUNDS = 20_000, 8


class VectorIndex:
    """A saved index of vectors in lists around centres. Centres are fitted on a bounded sample; every row is in the list of its nearest.

    A list that holds many rows is cut into slices by the rows' hash, so that none is one task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.centres = np.array([r.c for r in spark.read.parquet(f"{self.path}/centres").orderBy("n").collect()])  # at most 4 * sqrt(rows), a few thousand

    @staticmethod
    def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, seed: int = 7, path: str | None = None) -> VectorIndex:
        """An index of all rows with a vector; ``lists`` centres, by default the square root of the number of rows, from 1 to 4,096."""
        spark, path = vectors.sparkSession, path or new_path(vectors.sparkSession, "vectors")
        d = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        n = d.count()
        k = lists or int(np.clip(np.sqrt(n), 1, 4096))
        sample = d.orderBy(F.xxhash64(F.lit(seed), "key")).limit(SAMPLE_VECTORS).collect() if n else []
        m = _unit(np.array([r.v for r in sample], dtype=np.float64)) if sample else np.zeros((1, 1))
        centres = m[np.random.default_rng(seed).choice(len(m), min(k, len(m)), replace=False)]
        for _ in range(ROUNDS):
            near = np.argmax(m @ centres.T, axis=1)
            centres = _unit(np.array([m[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))]))
        near = _nearest(spark, centres, 1)
        kind = dict(d.dtypes)["key"]
        rows = d.withColumn("list", near(F.col("v"))[0])
        rows.select(F.col("key").cast(kind), "v", "list").repartitionByRange("list", "key").sortWithinPartitions("list").write.parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "n int, c array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return VectorIndex(spark, path)

    def search(self, queries: DataFrame, k: int, probes: int = 8, query_key: str = "query_id", query: str = "q", key: str = "vec_id", slices: int = 8) -> DataFrame:
        """(query_key, key, score, rank): the k vectors of highest cosine among those in the ``probes`` lists nearest to each query; ties by key.

        Queries go to the lists by a join; cosines are computed in batches of rows of the join. With as many probes as lists
        it is exact; recall for fewer is measured by ``recall``.
        """
        near = _nearest(self.spark, self.centres, min(probes, len(self.centres)))
        q = queries.filter(F.col(query).isNotNull()).select(F.col(query_key), F.col(query).cast("array<double>").alias("q"))
        q = q.select("*", F.explode(near(F.col("q"))).alias("list"), F.lit(0).alias("_")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).drop("_")
        rows = self.rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))

        @F.pandas_udf("double")
        def cos(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype="float64")
            return pd.Series(np.round(np.einsum("ij,ij->i", _unit(np.array(a.tolist())), _unit(np.array(b.tolist()))), 9))

        scored = rows.join(q, ["list", "slice"]).select(query_key, F.col("key").alias(key), cos("q", "v").alias("score"))
        return top(scored, k, query_key, F.desc("score"), F.col(key)).select(query_key, key, "score", "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)


def _nearest(spark: SparkSession, centres: np.ndarray, n: int):
    """A function of a vector: the numbers of its n nearest centres, the nearest first."""
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        sim = _unit(np.array(v.tolist(), dtype=np.float64)) @ sent.value.T
        return pd.Series(np.argsort(-sim, axis=1, kind="stable")[:, :n].tolist())

    return near


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """One row: the share of the exact hits that were found."""
    hit = exact.join(found.select(query_key, key).distinct().withColumn("_f", F.lit(1)), [query_key, key], "left")
    return hit.agg(F.round(F.avg(F.coalesce("_f", F.lit(0))), 6).alias("recall"), F.count("*").alias("hits"))
