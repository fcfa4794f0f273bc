"""Queries over runs, sources and events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmill.operators import usage
from weftmill.plans.registry import registered
from weftmill.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    return registered(QUERIES, SQL, sql)


@query("select source_type, content_type, count(*) as n, coalesce(cast(sum(chunk_count) as bigint), 0) as total from sources where index_status = 'indexed' group by source_type, content_type")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return usage.counts_by(table(spark, d, "sources").filter("index_status = 'indexed'"), ["source_type", "content_type"], "chunk_count")


@query("select content_type, index_status, count(*) as n, coalesce(cast(sum(chunk_count) as bigint), 0) as total from sources group by content_type, index_status order by content_type, index_status")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.counts_by(table(spark, d, "sources"), ["content_type", "index_status"], "chunk_count").orderBy("content_type", "index_status")


@query("select count(*) filter (where index_status = 'pending') as pending, count(*) filter (where ocr_used) as scanned, count(*) filter (where published_at is null) as undated, count(distinct site) as sites from sources")
def scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").agg(F.count_if(F.col("index_status") == "pending").alias("pending"), F.count_if("ocr_used").alias("scanned"), F.count_if(F.col("published_at").isNull()).alias("undated"), F.countDistinct("site").alias("sites"))


@query("""
    with u as (select count(*) filter (where event_type = 'view') as views, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'none') as nothing from events where ts >= (select max(ts) from events) - interval 30 day)
    select views, errors, round(errors * 1.0 / nullif(views, 0), 6) as error_rate, round(errors * 1.0 / nullif(nothing, 0), 6) as no_rate from u
""")
def usage_rates(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the last 30 days and rates; null where there is nothing to divide by."""
    e = table(spark, d, "events")
    recent = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).filter("ts >= last - interval 30 days")  # one row
    u = recent.agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in (("view", "views"), ("error", "errors"), ("none", "nothing"))])
    return u.select("views", "errors", usage.share(F.col("errors"), F.col("views")).alias("error_rate"), usage.share(F.col("errors"), F.col("nothing")).alias("no_rate"))


@query("select count(*) as n, max(extracted_at) as latest from extracted_pages")
def cache_stamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").agg(F.count("*").alias("n"), F.max("extracted_at").alias("latest"))


@query("select count(*) as n from (select * from sources where lower(title) like '%merit list%' or url like '%merit-list%')")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(F.col("title").ilike("%merit list%") | F.col("url").like("%merit-list%"))
    return s.agg(F.count("*").alias("n"))


@query("select distinct content_type from sources order by content_type")
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("content_type").distinct().orderBy("content_type")


@query("select run_id, trigger_kind, status from crawl_runs order by (trigger_kind = 'cli'), started_at desc limit 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The last run not started by hand, else the last."""
    return table(spark, d, "crawl_runs").orderBy(F.col("trigger_kind") == "cli", F.desc("started_at")).limit(1).select("run_id", "trigger_kind", "status")


@query("select fetch_id, url, error from fetch_results where error is not null order by fetched_at desc, fetch_id desc limit 40")
def newest_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").filter("error is not null").orderBy(F.desc("fetched_at"), F.desc("fetch_id")).limit(40).select("fetch_id", "url", "error")


@query("""
    select source_id, title, published_at from sources where (title ilike '%admission%' or url ilike '%admission%' or section ilike '%admission%') and content_type = 'html' order by published_at desc nulls last, source_id desc limit 50 offset 50
""")
def source_search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a search in three fields with a filter."""
    s = table(spark, d, "sources")
    hit = F.col("title").ilike("%admission%") | F.col("url").ilike("%admission%") | F.col("section").ilike("%admission%")
    return s.filter(hit & (F.col("content_type") == "html")).orderBy(F.desc_nulls_last("published_at"), F.desc("source_id")).offset(50).limit(50).select("source_id", "title", "published_at")


@query("""
    select source_id from sources where content_type in ('pdf', 'docx', 'html') and index_status not in ('excluded', 'duplicate') and (last_seen_run_id is null or last_seen_run_id <> 10) and url like 'https://www.%' and not url like '%/wp-content/%'
    union all select source_id from sources where index_status is null
""")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    a = s.filter(F.col("content_type").isin("pdf", "docx", "html") & ~F.col("index_status").isin("excluded", "duplicate") & (F.col("last_seen_run_id").isNull() | (F.col("last_seen_run_id") != 10)) & F.col("url").startswith("https://www.") & ~F.col("url").contains("/wp-content/"))
    return a.select("source_id").unionByName(s.filter("index_status is null").select("source_id"))


@query("""
    select cast(ts as date) as day, count(*) filter (where event_type = 'view') as n_view, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'error') as n_error, round(sum(value), 2) as total_value from events group by 1
""")
def daily_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(table(spark, d, "events"), kinds=("view", "click", "error"))


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n from events group by 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""
    with p(event_type, price_in, price_out) as (values ('view', 0.5, 2.0), ('click', 3.0, 15.0)), u as (select event_type, user_id, cast(count(*) * 1000 as bigint) as input_tokens, cast(sum(cast(json_extract_string(props, '$.k') as int)) as bigint) as output_tokens from events group by 1, 2)
    select user_id, u.event_type, input_tokens, output_tokens, round(coalesce((input_tokens * price_in + output_tokens * price_out) / 1e6, 0), 6) as cost from u left join p using (event_type)
""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("event_type", "user_id").agg((F.count("*") * 1000).alias("input_tokens"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("output_tokens"))
    prices = spark.createDataFrame([("view", 0.5, 2.0), ("click", 3.0, 15.0)], "event_type string, price_in double, price_out double")
    return usage.priced(u, prices, "event_type")


@query("""
    select user_id, count(*) filter (where event_type <> 'error') as answered, count(*) filter (where event_type = 'error') as failed, cast(coalesce(sum(case when event_type = 'purchase' then 1 end), 0) as bigint) as bought, max(value) as best from events group by user_id having count(*) >= 3
""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("answered"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.max("value").alias("best"), F.count("*").alias("_n"))
    return e.filter("_n >= 3").drop("_n")


@query("select count(*) filter (where fetched_at < timestamp '2025-02-01') as gone, count(*) filter (where fetched_at >= timestamp '2025-02-01' or fetched_at is null) as kept from fetch_results")
def retention(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetch_results")
    now = F.lit("2025-02-06 00:00:00").cast("timestamp_ntz")
    kept = usage.retained(f, "fetched_at", now)
    return kept.agg(F.count("*").alias("kept")).crossJoin(f.agg(F.count("*").alias("all"))).select((F.col("all") - F.col("kept")).alias("gone"), "kept")  # one row each


@query("""
    with e as (select user_id, event_id, epoch_us(ts) as us from events), g as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= 1800000000 then 0 else 1 end as new from e),
      n as (select *, sum(new) over (partition by user_id order by us, event_id) as session from g)
    select user_id, cast(session as bigint) as session, make_timestamp(min(us)) as started, make_timestamp(max(us)) as ended, cast(count(*) as bigint) as n from n group by user_id, session
""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return usage.sessions(table(spark, d, "events"))


@query("""
    with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
      w(user_id, us, n, session, start, last) as (select user_id, us, n, 1, us, us from e where n = 1
        union all select e.user_id, e.us, e.n, case when e.us - last > 7200000000 or e.us - start >= 14400000000 then session + 1 else session end, case when e.us - last > 7200000000 or e.us - start >= 14400000000 then e.us else start end, e.us from w join e on e.user_id = w.user_id and e.n = w.n + 1)
    select user_id, cast(session as bigint) as session, make_timestamp(min(us)) as started, make_timestamp(max(us)) as ended, count(*) as n from w group by user_id, session
""")
def login_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after two idle hours, and after four hours at the latest."""
    return usage.login_sessions(table(spark, d, "events"), idle_minutes=120, most_minutes=240)


@query("""
    select event_id, count(*) over (partition by user_id order by ts range between interval 899999999 microsecond preceding and current row) as recent from events where event_type = 'error'
""")
def recent_failures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'")
    return usage.recent_failures(e, "user_id", "ts").select("event_id", "recent")


@query("""
    with recursive e as (select cast(user_id as varchar) as key, event_id as id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
      w(key, id, us, n, seen, decision) as (select key, id, us, n, [us], 'allow' from e where n = 1
        union all select e.key, e.id, e.us, e.n, case when len(list_filter(seen, lambda t: e.us - t < 86400000000)) < 3 and len(list_filter(seen, lambda t: e.us - t < 60000000)) < 1 then list_append(seen, e.us) else seen end,
          case when len(list_filter(seen, lambda t: e.us - t < 86400000000)) >= 3 then 'day' when len(list_filter(seen, lambda t: e.us - t < 60000000)) >= 1 then 'minute' else 'allow' end from w join e on e.key = w.key and e.n = w.n + 1)
    select key, id, decision from w
""")
def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's requests against small limits, in order."""
    return usage.allowed_requests(table(spark, d, "events"), "user_id", "ts", "event_id", per_minute=1, per_day=3)


@query("""
    with recursive e as (select cast(user_id as varchar) as key, event_id as id, epoch_us(ts) as us, coalesce(event_type <> 'error', false) as ok, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
      w(key, id, n, fails, until, state) as (select key, id, n, case when ok then 0 else 1 end, 0::bigint, case when ok then 'ok' else 'failed' end from e where n = 1
        union all select e.key, e.id, e.n, case when e.us < until then fails when ok or fails >= 4 then 0 else fails + 1 end, case when e.us >= until and not ok and fails >= 4 then e.us + 900000000 else until end,
          case when e.us < until then 'locked' when ok then 'ok' when fails >= 4 then 'locks' else 'failed' end from w join e on e.key = w.key and e.n = w.n + 1)
    select key, id, state from w
""")
def lockout_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user's attempts, an error event being a failure."""
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return usage.lockouts(e, "user_id", "ts", "event_id")


@query("""
    with r as (select c.chunk_id, c.heading as q, s.url from chunks c left join sources s using (source_id)),
      g as (select q, list(distinct url) filter (where url is not null) as urls from r group by q)
    select q, case when q is null then 'review' when length(q) < 12 then case when len(coalesce(urls, [])) > 0 then 'fail' else 'pass' end when len(list_filter(coalesce(urls, []), lambda u: contains(u, 'admission'))) > 0 then 'pass' else 'fail' end as verdict from g
""")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each heading as a question: passed if a source of its chunks names admissions."""
    r = table(spark, d, "chunks").join(table(spark, d, "sources").select("source_id", "url"), "source_id", "left")
    g = r.groupBy(F.col("heading").alias("q")).agg(F.collect_set("url").alias("urls"))
    expect = F.when(F.col("q").isNull(), F.lit(None).cast("array<string>")).when(F.length("q") < 12, F.array().cast("array<string>")).otherwise(F.array(F.lit("admission")))
    return usage.passed(g.withColumn("expect", expect).withColumn("relevant", F.size("urls") > 0)).select("q", "verdict")


@query("select n_name, r_name, count(*) as suppliers, round(avg(s_acctbal), 4) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


@query("""
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2
""")
def price_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
    select source_id, chunk_id, row_number() over (partition by source_id order by chunk_index, chunk_id) as pos, lead(chunk_id) over (partition by source_id order by chunk_index, chunk_id) as next_id, max(length(text)) over (partition by source_id) as longest from chunks
""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_id")
    o = w.orderBy("chunk_index", "chunk_id")
    return table(spark, d, "chunks").select("source_id", "chunk_id", F.row_number().over(o).alias("pos"), F.lead("chunk_id").over(o).alias("next_id"), F.max(F.length("text")).over(w).alias("longest"))
