"""Usage analytics and state rules: roll-ups, limits, sessions, lockouts, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits a minute and a day, failures before a lock and its minutes, idle and absolute minutes of a session, days kept.
PER_MINUTE, PER_DAY, FAILURES, LOCK_MINUTES, IDLE_MINUTES, SESSION_MINUTES, KEPT_DAYS = 10, 100, 5, 15, 30, 480, 5


def counts_by(df: DataFrame, by: list[str], amount: str | None = None) -> DataFrame:
    """Rows, and the sum of ``amount``, by the given columns."""
    aggs = [F.count("*").alias("n")] + ([F.coalesce(F.sum(amount), F.lit(0)).alias("total")] if amount else [])
    return df.groupBy(*by).agg(*aggs)


def share(part: Column, whole: Column) -> Column:
    """A rounded ratio; null if there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def daily(events: DataFrame, at: str = "ts", kind: str = "event_type", kinds: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """(day, one count for each kind, total value): a row for each day with events."""
    return events.groupBy(F.to_date(at).alias("day")).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.round(F.sum(value), 2).alias("total_value"))


def priced(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``usage`` (input_tokens, output_tokens) with its cost by the price of each model in millions; unknown ones cost nothing."""
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return usage.join(F.broadcast(prices), model, "left").withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6)).drop("price_in", "price_out")


def allowed_requests(requests: DataFrame, key: str = "key", at: str = "ts", order: str = "id", per_minute: int = PER_MINUTE, per_day: int = PER_DAY) -> DataFrame:
    """(key, id, decision): allow, day or minute for each request in order of time, then id.

    Only allowed requests count. A request is refused for the day if ``per_day`` were allowed in the 24 hours before it,
    then for the minute. A limit of 0 is none. A key's requests are cut where 24 hours pass without any, after which all is
    forgotten, and each stretch is walked in order by one task, in batches of any size; what is kept of it is at most
    ``per_day`` times (its allowed requests of a day), however many requests it has.
    """
    sorted_ = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("id")).filter("key is not null and us is not null")
    sorted_ = _stretched(sorted_, 86_400_000_000).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "us", "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = None, []
        for pdf in batches:
            out = []
            for k, part, us in zip(pdf["key"], pdf["stretch"], pdf["us"]):
                if (k, part) != now:
                    now, seen = (k, part), []
                seen = [t for t in seen if us - t < 86_400_000_000] if seen and us - seen[0] >= 86_400_000_000 else seen
                if per_day and len(seen) >= per_day:
                    out.append("day")
                elif per_minute and sum(1 for t in reversed(seen[-per_minute:]) if us - t < 60_000_000) >= per_minute:
                    out.append("minute")
                else:
                    seen.append(us)
                    if not per_day:
                        seen = seen[-per_minute:] if per_minute else []
                    out.append("allow")
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "decision": out})

    return sorted_.mapInPandas(walk, "key string, id long, decision string")


def _stretched(rows: DataFrame, gap: int) -> DataFrame:
    """``rows`` (key, us) with ``stretch``, a number that grows wherever at least ``gap`` microseconds pass without a row of the key.

    Rows are first counted by key and slot of that length; slots, few for a key, tell where a gap may lie, so that no task
    orders all rows of a key.
    """
    slots = rows.groupBy("key", F.floor(F.col("us") / gap).alias("slot")).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    w = Window.partitionBy("key").orderBy("slot")
    new = F.when(F.col("a") - F.lag("b").over(w) < gap, 0).otherwise(1)
    slots = slots.withColumn("new", new).withColumn("stretch", F.sum("new").over(w)).select("key", "slot", "stretch")
    return rows.withColumn("slot", F.floor(F.col("us") / gap)).join(slots, ["key", "slot"]).drop("slot")


def lockouts(attempts: DataFrame, key: str = "key", at: str = "ts", order: str = "id", ok: str = "ok") -> DataFrame:
    """(key, id, state) of each attempt: ok, failed, locks (the fifth failure in a row) or locked (within 15 minutes of that)."""
    sorted_ = attempts.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("id"), F.coalesce(ok, F.lit(False)).alias("ok")).filter("key is not null and us is not null")
    sorted_ = sorted_.repartition("key").sortWithinPartitions("key", "us", "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fails, until = None, 0, 0
        for pdf in batches:
            out = []
            for k, us, good in zip(pdf["key"], pdf["us"], pdf["ok"]):
                if k != now:
                    now, fails, until = k, 0, 0
                if us < until:
                    out.append("locked")
                elif good:
                    fails = 0
                    out.append("ok")
                else:
                    fails += 1
                    out.append("locks" if fails >= FAILURES else "failed")
                    if fails >= FAILURES:
                        fails, until = 0, us + LOCK_MINUTES * 60_000_000
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "state": out})

    return sorted_.mapInPandas(walk, "key string, id long, state string")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """(key, session, started, ended, n): runs of events with gaps of at most ``idle_minutes``, numbered from 1 for each key.

    Keys are split into days first: a run's pieces are found within each key and day and only the pieces, few for a key,
    are put together, so a key with a third of all events is no single task.
    """
    gap = idle_minutes * 60_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    d = events.select(key, us.alias("us"), F.col(order).alias("o")).filter(f"{key} is not null and us is not null").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    w = Window.partitionBy(key, "day").orderBy("us", "o")
    d = d.withColumn("new", F.when(F.col("us") - F.lag("us").over(w) <= gap, 0).otherwise(1)).withColumn("piece", F.sum("new").over(w))
    pieces = d.groupBy(key, "day", "piece").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))
    v = Window.partitionBy(key).orderBy("a", "day", "piece")
    pieces = pieces.withColumn("new", F.when(F.col("a") - F.lag("b").over(v) <= gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(v))
    out = pieces.groupBy(key, "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return out.select(key, "session", F.timestamp_micros("a").cast("timestamp_ntz").alias("started"), F.timestamp_micros("b").cast("timestamp_ntz").alias("ended"), "n")


def login_sessions(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", idle_minutes: int = IDLE_MINUTES, most_minutes: int = SESSION_MINUTES) -> DataFrame:
    """(key, session, started, ended, n): as ``sessions``, but a session also ends ``most_minutes`` after it began; the next event begins another.

    A run of events is cut where the event lies at least ``most_minutes`` after its session's start. Runs are walked each by
    itself, so what one task holds is one run without a gap, and of it only the start of its last session.
    """
    gap, most = idle_minutes * 60_000_000, most_minutes * 60_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    kind = dict(events.dtypes)[key]
    runs = sessions(events, key, at, order, idle_minutes).select(F.col(key).alias("_k"), F.col("session").alias("run"), F.unix_micros(F.col("started").cast("timestamp")).alias("a"), F.unix_micros(F.col("ended").cast("timestamp")).alias("b"))
    d = events.select(F.col(key).alias("_k"), us.alias("us"), F.col(order).alias("o")).filter("_k is not null and us is not null")
    # only runs longer than a session can be are walked
    long_ = runs.filter(F.col("b") - F.col("a") >= most)
    inside = d.join(long_, (d["_k"] == long_["_k"]) & d["us"].between(F.col("a"), F.col("b"))).select(d["_k"], "run", "us", "o").repartition("_k", "run").sortWithinPartitions("_k", "run", "us", "o")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start = None, 0
        for pdf in batches:
            starts = []
            for k, run, t in zip(pdf["_k"], pdf["run"], pdf["us"]):
                if (k, run) != now:
                    now, start = (k, run), t
                elif t - start >= most:
                    start = t
                starts.append(start)
            yield pd.DataFrame({"_k": pdf["_k"], "s": starts, "us": pdf["us"]})

    cut = inside.mapInPandas(walk, f"_k {kind}, s long, us long").groupBy("_k", "s").agg(F.max("us").alias("b"), F.count("*").alias("n")).select("_k", F.col("s").alias("a"), "b", "n")
    whole = sessions(events, key, at, order, idle_minutes).select(F.col(key).alias("_k"), F.unix_micros(F.col("started").cast("timestamp")).alias("a"), F.unix_micros(F.col("ended").cast("timestamp")).alias("b"), "n").filter(F.col("b") - F.col("a") < most)
    both = whole.unionByName(cut).withColumn("session", F.row_number().over(Window.partitionBy("_k").orderBy("a")))
    return both.select(F.col("_k").alias(key), F.col("session").cast("long").alias("session"), F.timestamp_micros("a").cast("timestamp_ntz").alias("started"), F.timestamp_micros("b").cast("timestamp_ntz").alias("ended"), "n")


def recent_failures(attempts: DataFrame, key: str, at: str, seconds: int = 900) -> DataFrame:
    """Each attempt with the number of its key's attempts in the time before it, itself included: less than ``seconds`` ago.

    Keys are cut into slots of that time; an attempt is counted in its own slot and lent to the next, so that no task orders
    all attempts of a key.
    """
    span = seconds * 1_000_000
    d = attempts.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_s", F.floor(F.col("_us") / span))
    both = d.withColumn("_own", F.lit(True)).unionByName(d.withColumn("_own", F.lit(False)).withColumn("_s", F.col("_s") + 1))
    w = Window.partitionBy(key, "_s").orderBy("_us").rangeBetween(-(span - 1), 0)
    return both.withColumn("recent", F.count("*").over(w)).filter("_own").drop("_us", "_s", "_own")


def retained(rows: DataFrame, at: str, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """Rows not older than so many days; null times are kept."""
    return rows.filter(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(F.lit(days))))


def passed(results: DataFrame, expected: str = "expect", urls: str = "urls", relevant: str = "relevant") -> DataFrame:
    """``results`` with ``verdict``: pass if relevant and a url holds an expected part; null expectation is for review, an
    empty one demands a refusal."""
    hit = F.exists(expected, lambda e: F.exists(urls, lambda u: u.contains(e)))
    return results.withColumn("verdict", F.when(F.col(expected).isNull(), "review").when(F.size(expected) == 0, F.when(F.col(relevant), "fail").otherwise("pass")).when(F.col(relevant) & hit, "pass").otherwise("fail"))


def without_thinking(text: Column) -> Column:
    """Text without <think> parts; an open one cuts the rest, a stray end tag is dropped with what precedes it."""
    t = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?is)^.*</think>", "")
    return F.trim(F.regexp_replace(t, r"(?is)<think>.*$", ""))
