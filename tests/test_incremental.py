import datetime as dt

import pytest

from weftmill.functions.dates import etag_value, instant_micros
from weftmill.operators import incremental as I
from weftmill.shared import new_path
from pyspark.sql import functions as F

T = dt.datetime


@pytest.mark.parametrize("text", ["2024-05-28T08:19:17Z", "2024-05-28 08:19:17", "2024-05-28T13:49:17+05:30", "Tue, 28 May 2024 08:19:17 GMT", "Tuesday, 28-May-24 08:19:17 GMT", "Tue May 28 08:19:17 2024", " 2024-05-28T08:19:17 ", "2024-05-28T08:19:17.000Z"])
def test_one_instant_in_many_notations(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(instant_micros(F.col("t"))).first()[0]
    assert got == 1716884357000000


@pytest.mark.parametrize("text", [None, "", "0", "-1", "n/a", "Invalid Date", "2024-13-40T00:00:00Z", "99:99"])
def test_unreadable_dates_are_null(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(instant_micros(F.col("t"))).first()[0] is None


def test_zone_of_session_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert spark.createDataFrame([("2024-07-10",)], "t string").select(instant_micros(F.col("t"))).first()[0] == 1720569600000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_etags_name_the_same_tag(spark):
    tags = ['"a-1"', 'W/"a-1"', "a-1", ' "a-1"', 'w/"a-1"', '""', "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tags], "t string").select(etag_value(F.col("t"))).collect()]
    assert got == ["a-1"] * 5 + [None] * 3


def _rows(spark, rows):
    return spark.createDataFrame(rows, "url string, etag string, last_modified long, remote_modified long")


def test_store_gives_new_and_changed_records_only(spark):
    store = I.MerkleStore(spark, new_path(spark, "t"))
    urls = lambda df: sorted(r.url for r in df.collect())
    assert urls(store.process(_rows(spark, [("a", "1", None, None), ("b", None, 5, None), ("c", None, None, None)]), 1)) == ["a", "b", "c"]
    # c has nothing to compare, b changed its date, a is the same; d is new
    second = [("a", "1", 9, None), ("b", None, 6, None), ("c", None, None, None), ("d", None, None, 1)]
    assert urls(store.process(_rows(spark, second), 2)) == ["b", "c", "d"]
    # the same run again gives what was published, not nothing
    assert urls(store.process(_rows(spark, second), 2)) == ["b", "c", "d"]
    # urls that are not seen keep their record
    assert urls(store.process(_rows(spark, [("d", None, None, 1)]), 3)) == []
    assert urls(store.process(_rows(spark, [("b", None, 6, None), ("a", "2", 9, None)]), 4)) == ["a"]
    assert urls(store.process(_rows(spark, []), 5)) == []


def test_moved_value_between_fields_is_a_change(spark):
    store = I.MerkleStore(spark, new_path(spark, "t"))
    store.process(_rows(spark, [("a", None, 7, None)]), 1)
    assert [r.url for r in store.process(_rows(spark, [("a", None, None, 7)]), 2).collect()] == ["a"]


def test_a_run_that_breaks_off_is_repeated_whole(spark, monkeypatch):
    path = new_path(spark, "t")
    store = I.MerkleStore(spark, path)
    store.process(_rows(spark, [("a", "1", None, None)]), 1)
    with monkeypatch.context() as m:
        m.setattr(I.MerkleStore, "_publish", lambda self, c: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.process(_rows(spark, [("a", "2", None, None), ("b", "1", None, None)]), 2)
    again = I.MerkleStore(spark, path)
    assert len(again.commits()) == 1
    assert sorted(r.url for r in again.process(_rows(spark, [("a", "2", None, None), ("b", "1", None, None)]), 2).collect()) == ["a", "b"]


def test_two_writers_of_one_number_cannot_both_publish(spark):
    path = new_path(spark, "t")
    a, b = I.MerkleStore(spark, path), I.MerkleStore(spark, path)
    a.process(_rows(spark, [("a", "1", None, None)]), 1)
    with pytest.raises(RuntimeError):
        b._publish({"seq": 1, "run": 9})


def test_changed_by_run_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    runs = [(1, "completed", T(2025, 1, 1), T(2025, 1, 1, 9)), (2, "failed", T(2025, 1, 2), T(2025, 1, 2, 3)), (3, "completed", T(2025, 1, 3), T(2025, 1, 3, 9)), (4, "interrupted", T(2025, 1, 4), None), (5, "completed", T(2025, 1, 5), T(2025, 1, 5, 9))]
    fetches, seeds = [], []
    for i in range(600):
        run = rnd.choice(runs)
        at = run[2] + dt.timedelta(hours=rnd.randint(0, 30))
        fetches.append((i, run[0], f"u{rnd.randint(0, 40)}", rnd.choice([200, 200, 304, 404]), rnd.choice([None, '"x"', 'W/"x"', "y", ""]), rnd.choice([None, "Tue, 28 May 2024 08:19:17 GMT", "2024-05-28T08:19:17Z", "0", "2024-05-29"]), rnd.choice([None, None, None, "HTTP 500"]), at))
        seeds.append((i, run[0], f"u{rnd.randint(0, 40)}", rnd.choice([None, "n/a", "2024-05-28", "2024-05-28T00:00:00Z", "2024-06-01"]), at))
    f = spark.createDataFrame(fetches, "fetch_id long, run_id long, url string, status int, etag string, last_modified string, error string, fetched_at timestamp_ntz")
    s = spark.createDataFrame(seeds, "seed_id long, run_id long, url string, remote_modified string, listed_at timestamp_ntz")
    r = spark.createDataFrame(runs, "run_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = sorted(map(tuple, I.changed_by_run(spark, f, s, r).collect()))

    date = {None: None, "0": None, "n/a": None, "": None, "Tue, 28 May 2024 08:19:17 GMT": 1, "2024-05-28T08:19:17Z": 1, "2024-05-29": 2, "2024-05-28": 3, "2024-05-28T00:00:00Z": 3, "2024-06-01": 4}
    tag = {None: None, "": None, '"x"': "x", 'W/"x"': "x", "y": "y"}
    by = {x[0]: x for x in runs}
    best = {}
    for i, run, url, status, etag, lm, error, at in fetches:
        if error or status not in (200, 304):
            continue
        end = by[run][3]
        if end and at > end:
            run = next((x[0] for x in runs if x[2] >= at), None)
        if run and ((run, url) not in best or best[run, url][0] < (at, i)):
            best[run, url] = ((at, i), tag[etag], date[lm])
    listed = {}
    for i, run, url, rm, at in seeds:
        if (run, url) not in listed or listed[run, url][0] < (at, i):
            listed[run, url] = ((at, i), date[rm])
    want, last = [], {}
    for run, status, _, _ in runs:
        if status != "completed":
            continue
        for (k, url), (_, e, lm) in best.items():
            if k != run:
                continue
            new = (e, lm, listed.get((run, url), (0, None))[1])
            old = last.get(url)
            both = [(a, b) for a, b in zip(new, old or ()) if a is not None and b is not None]
            if not both or both[0][0] != both[0][1]:
                want.append((run, url))
            last[url] = new
    assert got == sorted(want)


def test_empty_tables_and_null_rows(spark):
    f = spark.createDataFrame([(1, None, None, 200, None, None, None, None)], "fetch_id long, run_id long, url string, status int, etag string, last_modified string, error string, fetched_at timestamp_ntz")
    s = spark.createDataFrame([], "seed_id long, run_id long, url string, remote_modified string, listed_at timestamp_ntz")
    r = spark.createDataFrame([(1, "completed", T(2025, 1, 1), T(2025, 1, 2))], "run_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    assert I.changed_by_run(spark, f, s, r).count() == 0
    assert I.changed_by_run(spark, f, s, r.limit(0)).count() == 0
