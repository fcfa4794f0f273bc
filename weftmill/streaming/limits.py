"""Stateful streams: request limits, sessions and roll-ups, with the rules of their batch twins in ``operators.usage``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftmill.operators.usage import PER_DAY, PER_MINUTE

DAY, MINUTE = 86_400_000_000, 60_000_000


def decided(requests: DataFrame, key: str = "key", at: str = "ts", order: str = "id", per_minute: int = PER_MINUTE, per_day: int = PER_DAY, forget: bool = False) -> DataFrame:
    """(key, id, decision) of each request of a stream, in order of time within each Arrow batch of a micro-batch.

    The state of a key is the times of its allowed requests of a day, ``per_day`` at most. Requests older than what a key
    has seen are decided against the state as it is.
    With ``forget``, a key without a request for a day loses its state; such a query goes on by itself, so it does not end
    under a trigger that stops when all is read.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("id")).filter("key is not null and us is not null")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing for a day: all is forgotten
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        for pdf in batches:  # one Arrow batch at a time, whatever the key's share of the micro-batch
            pdf = pdf.sort_values(["us", "id"])
            out = []
            for us in pdf["us"]:
                seen = [t for t in seen if us - t < DAY]
                if per_day and len(seen) >= per_day:
                    out.append("day")
                elif per_minute and sum(us - t < MINUTE for t in seen) >= per_minute:
                    out.append("minute")
                else:
                    seen.append(int(us))
                    out.append("allow")
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "decision": out})
        state.update((seen,))
        if forget:
            state.setTimeoutDuration(DAY // 1000)

    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, decision string", "seen array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, at: str = "ts", late: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """(hour, kind, n): counts of each hour, closed once the watermark has passed it; later events are dropped."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): sessions that end after an idle time."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    s = e.groupBy(F.session_window(at, idle).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def without_thinking(pieces: DataFrame, key: str = "stream", order: str = "n", text: str = "text") -> DataFrame:
    """(key, order, text): each piece of a stream without what stands between <think> marks, as soon as it is decided.

    What may be the beginning of a mark is held back until the next piece, so a mark that pieces cut is found; the state is
    whether a part is open and at most six held characters. A stream's last piece is told by a null text, which gives what
    is held. White space after a part is dropped.
    """
    rows = pieces.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("n"), F.col(text).alias("text"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held, fresh = state.get if state.exists else (False, "", True)
        for pdf in batches:
            pdf = pdf.sort_values("n")
            out = []
            for t in pdf["text"]:
                end = t is None or t != t
                data, shown, held = held + ("" if end else t), "", ""
                while data:
                    mark = "</think>" if inside else "<think>"
                    at = data.lower().find(mark)
                    if at >= 0:
                        shown += "" if inside else data[:at]
                        data, inside, fresh = data[at + len(mark) :], not inside, True
                        continue
                    keep = 0 if end else next((n for n in range(min(len(mark) - 1, len(data)), 0, -1) if mark.startswith(data[-n:].lower())), 0)
                    shown += "" if inside else data[: len(data) - keep]
                    held, data = data[len(data) - keep :], ""
                if fresh and not inside:
                    shown = shown.lstrip()
                    fresh = not shown
                out.append(shown)
            yield pd.DataFrame({"key": pdf["key"], "n": pdf["n"], "text": out})
        state.update((inside, held, fresh))

    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, text string", "inside boolean, held string, fresh boolean", "append", GroupStateTimeout.NoTimeout).select(F.col("key").alias(key), F.col("n").alias(order), F.col("text").alias(text))
