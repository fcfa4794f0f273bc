import io as stdio
import zipfile

import pytest
from pyspark.sql import functions as F

from weftmill.functions import html as H
from weftmill.operators import clean, crawl, search, usage
from weftmill.operators import incremental as I
from weftmill.shared import new_path
from weftmill.sources import documents as D
from weftmill.sources import io, web

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(body: str, title: str = "Fees") -> bytes:
    out = stdio.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", f'<c:coreProperties xmlns:c="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c:coreProperties>')
    return out.getvalue()


def _p(text: str, style: str = "") -> str:
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=%s/></w:pPr>' % repr(style).replace(chr(39), chr(34)) if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def _table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_word_processor_files():
    data = _docx(_p("Fees", "H2") + _p("") + _p("Paid twice.") + _table([["Course", ""], ["BCA", "500"], ["", ""]]))
    assert D.docx(data) == ("## Fees\n\nPaid twice.\n\nCourse: BCA; 500", "Fees", None)
    assert D.docx(None)[0] == "" and D.docx(b"PK\x03\x04word/ broken")[2] and D.docx(b"")[2]


def test_files_are_read_by_their_bytes(spark):
    rows = [(1, bytearray(_docx(_p("Hello there"))), "txt"), (2, bytearray("café".encode()), "txt"), (3, bytearray(b"%PDF-1.7"), "docx"), (4, None, None)]
    got = {r.i: (r.kind, r.text, r.needs_ocr) for r in D.read(spark.createDataFrame(rows, "i int, content binary, kind string")).collect()}
    assert got == {1: ("docx", "Hello there", False), 2: ("txt", "café", False), 3: ("pdf", "", True), 4: ("txt", "", False)}


def test_tables_and_recognised_words(spark):
    d = spark.createDataFrame([([["A", ""], ["1", "x\ny"], ["", ""]],), ([["only"]],), (None,)], "t array<array<string>>")
    assert [r[0] for r in d.select(D.table_text(F.col("t"))).collect()] == ["A: 1; x y", None, None]
    t = spark.createDataFrame([("one two three four five six seven eight",), ("one two three four five six seven ab 12",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(D.recognised(F.col("t"))).collect()] == ["one two three four five six seven eight", "", "", ""]


def test_robots(spark):
    files = [("a.org", "User-agent: x\nUser-agent: bot\nDisallow: /p\nAllow: /\n\nUser-agent: *\nDisallow: /"), ("b.org", "User-agent: *\nDisallow:\n"), ("c.org", "User-agent: *\nAllow: /ok\nDisallow: / # rest"), ("d.org", None)]
    rules = web.robots_rules(spark.createDataFrame(files, "host string, text string"), "Bot/2")
    urls = ["https://a.org/p/1", "https://a.org/q", "https://b.org/x", "https://c.org/ok/1", "https://c.org/no", "https://c.org", "https://d.org/", "https://e.org/"]
    got = {r.url: r.allowed for r in web.allowed_by_robots(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == [False, True, True, True, False, False, True, True]
    one = web.allowed_by_robots(spark.createDataFrame([("https://c.org/no",)], "url string"), rules, ignored=["c.org"]).first()
    assert one.allowed


def test_turns_of_a_host(spark):
    rows = [(1, "a", 0), (2, "a", 10), (3, "a", 500), (4, "a", 505), (5, "b", 3), (6, "a", 10)]
    got = {r.id: r.start for r in web.turns(spark.createDataFrame(rows, "id int, host string, us long"), 100).collect()}
    assert got == {1: 0, 2: 100, 6: 200, 3: 500, 4: 600, 5: 3}


def test_many_turns_of_a_host(spark):
    got = web.turns(spark.range(9000).selectExpr("id", "'a' as host", "0L as us"), 250_000).selectExpr("max(start)", "count(distinct start)").first()
    assert tuple(got) == (8999 * 250_000, 9000)


def test_sitemaps_of_sitemaps(spark):
    site = "https://a.org"
    body = {
        f"{site}/sitemap.xml": f"<sitemapindex><sitemap><loc>{site}/one.xml</loc></sitemap><sitemap><loc>{site}/sitemap.xml</loc></sitemap></sitemapindex>",
        f"{site}/one.xml": f"<urlset><url><loc>{site}/x?utm_source=1&amp;b=2</loc><lastmod>2024</lastmod></url><url><loc><![CDATA[{site}/y]]></loc></url><url><loc>{site}/x?b=2</loc><lastmod>2025</lastmod></url></urlset>",
        f"{site}/wp-sitemap.xml": "not found",
    }
    files = spark.createDataFrame(list(body.items()), "url string, body string")
    got = web.sitemap_seeds(spark.createDataFrame([(site + "/page",)], "site string"), lambda edge: files.join(edge, "url"))
    assert {tuple(r) for r in got.collect()} == {(f"{site}/x?b=2", "2025"), (f"{site}/y", None)}


def test_listings_end_with_an_empty_page(spark, tmp_path):
    def fetch(n):
        (tmp_path / str(n)).write_text("")
        return [{"i": n * 10 + k} for k in range(2)] if n <= 5 else []

    assert sorted(r.i for r in io.pages(spark, fetch, "i long").collect()) == [10 * n + k for n in range(1, 6) for k in range(2)]
    assert max(int(p.name) for p in tmp_path.iterdir()) <= 7


def test_headers_and_addresses(spark):
    d = spark.createDataFrame([('"a"', None), ("", " "), (None, "Tue")], "e string, m string").select(web.request_headers(F.col("e"), F.col("m")))
    assert [r[0] for r in d.collect()] == [{"If-None-Match": '"a"'}, {}, {"If-Modified-Since": "Tue"}]
    hosts = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "2001:4860::1"), ("c", "::1"), ("d", None), ("e", "fe80::1")], "host string, ip string")
    assert {r.host: r.public for r in web.safe_hosts(hosts).collect()} == {"a": False, "b": True, "c": False, "d": False, "e": False}


def test_store_writes_touched_parts_only(spark):
    store = io.VectorStore(spark, new_path(spark, "store"), parts=8)
    rows = lambda xs: spark.createDataFrame(xs, "chunk_id long, source_id long, text string")
    store.add(rows([(i, i % 20, "x") for i in range(200)]))
    before = store._state()["folders"]
    store.add(rows([(7, 7, "new")]))
    after = store._state()["folders"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.count() == 200
    store.add(rows([(7, 3, "moved")]))
    assert [(r.source_id, r.text) for r in store.get(rows([(7, 0, "")])).collect()] == [(3, "moved")] and store.count() == 200
    assert store.delete_source(rows([(0, 3, "")])).count() == 189


def test_streamed_answers_without_thinking(spark, tmp_path):
    from weftmill.streaming import limits

    pieces = [("a", 1, "Hi <thi"), ("a", 2, "nk>secret</th"), ("a", 3, "ink> there"), ("a", 4, " <b"), ("a", 5, None), ("b", 1, "x <"), ("b", 2, "y"), ("b", 3, None)]
    d = spark.createDataFrame(pieces, "stream string, n long, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limits.without_thinking(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("shown").orderBy("stream", "n").collect()
    assert "".join(r.text for r in got if r.stream == "a") == "Hi there <b" and "".join(r.text for r in got if r.stream == "b") == "x <y"
    assert got[0].text == "Hi "


def test_names_alike_at_both_ends_meet(spark):
    names = ["anti ragging policy of the whole campus", "xnti ragging policy of the whole campux", "student handbook", "student handbok", "other calendar", "fee structure arts", "fee structure art"]
    got = {r.series: r.merged for r in clean.merged_keys(spark.createDataFrame([(n,) for n in [*names, names[0]]], "series string")).collect()}
    assert got["xnti ragging policy of the whole campux"] == names[0] and got["student handbook"] == "student handbok" and got["other calendar"] == "other calendar" and len(got) == 7
    import difflib

    for a in names:  # no like pair is lost
        for b in names:
            if a < b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.93:
                assert got[b] == got[a] == a
    assert clean.merged_keys(spark.createDataFrame([], "series string")).count() == 0


def test_names_of_a_series_form_no_pairs(spark, monkeypatch):
    import difflib
    import itertools

    ends = ["".join(x) for x in itertools.product("abcdefgh", repeat=2)]
    names = [f"handbook of {x} {a} {b}" for x in ("bba", "botany") for a, b in ends] + ["", "p" * 300 + " policy", "p" * 301 + " policy", "émigré policy of the campus", "emigré policy of the campus"]
    rows = spark.createDataFrame([(n,) for n in names], "series string")
    like = lambda n: min((a for a in names if a < n and difflib.SequenceMatcher(None, a, n).ratio() >= 0.93), default=None)
    first = {n: like(n) for n in names}
    want = {n: n if first[n] is None else first[first[n]] or first[n] for n in names}
    sizes, staged = [], clean.staged
    monkeypatch.setattr(clean, "KEYS", 50, raising=False)  # several blocks
    monkeypatch.setattr(clean, "staged", lambda df, name: (x := staged(df, name), sizes.append(x.count()))[0])
    assert {r.series: r.merged for r in clean.merged_keys(rows).collect()} == want
    assert max(sizes) <= len(names)
    assert sum(n is not None for n in first.values()) > 80


def test_deep_pages_are_read():
    page = "<html><body>" + "<div>" * 3000 + "deep words" + "</div>" * 3000 + "<p>after</p></body></html>"
    assert H.extract(page, "https://a.org/x")["text"].split("\n")[0].startswith("deep words")


def test_documents_take_the_words_of_the_page_that_links_to_them(spark):
    pages = spark.createDataFrame([(2, "About", "Fees", [("u1", "")]), (1, None, "Home", [("u1", ""), ("u2", "")]), (3, None, None, None)], "page_id int, section string, title string, links array<struct<url:string,text:string>>")
    got = {r.url: r.section for r in crawl.page_context(spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u3",)], "url string"), pages).collect()}
    assert got == {"u1": "Home", "u2": "Home", "u3": ""}


def test_redirects_off_the_domain(spark):
    f = spark.createDataFrame([("https://a.org/x", "https://b.org/x"), ("https://a.org/x", None), (None, None)], "url string, final_url string")
    got = [r.off_domain for r in crawl.outcomes_after_redirect(f, spark.createDataFrame([("a.org",), ("a.org",)], "host string")).orderBy("final_url", "url").collect()]
    assert sorted(got) == [False, True, True]


def test_vector_index_is_exact_with_all_lists(spark):
    import random

    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = search.VectorIndex.build(v)
    exact = search.dense(q, v, 5)
    assert sorted(map(tuple, index.search(q, 5, len(index.centres)).collect())) == sorted(map(tuple, exact.collect()))
    assert index.rows.count() == 301
    assert search.recall(index.search(q, 5, len(index.centres) // 2), exact).first().recall > 0.6


def test_saved_keyword_index_is_read_again(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None), (4, "")], "chunk_id long, text string")
    path = search.KeywordIndex.build(d, path=new_path(spark, "kept")).path
    q = spark.createDataFrame([(1, "red fox"), (2, "nothing"), (3, None)], "query_id long, query string")
    again = search.KeywordIndex(spark, path)
    assert sorted(map(tuple, again.search(q, 5).collect())) == sorted(map(tuple, search.bm25(q, d, 5).collect()))
    assert again.stats.first().n_docs == 4


def test_partial_run_without_changes_opens_and_writes_nothing(spark, monkeypatch):
    store = I.MerkleStore(spark, new_path(spark, "t"))
    rows = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("e").alias("etag"), F.lit(None).cast("long").alias("last_modified"), F.lit(None).cast("long").alias("remote_modified"))
    assert store.process(rows, 1).count() == 20_000
    assert store.process(rows.filter("substr(url, -1) <> '7'"), 2).count() == 0
    last = store.commits()[-1]
    assert last["rows"] is None and last["touched"] == [] and last["keys"] == 20_000
    changed = rows.filter("url in ('u5', 'u15')").withColumn("etag", F.lit("f"))
    assert sorted(r.url for r in store.process(changed, 3).collect()) == ["u15", "u5"] and len(store.commits()[-1]["touched"]) <= 2
    gone = store.vacuum(keep=1)
    assert gone and store.process(rows.filter("url = 'u5'"), 4).count() == 1  # u5 has had another tag since


def test_a_grown_store_is_cut_into_more_ranges(spark):
    store = I.MerkleStore(spark, new_path(spark, "t"), range_keys=10)
    rows = lambda a, b, tag: spark.range(a, b).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(tag).alias("etag"), F.lit(None).cast("long").alias("last_modified"), F.lit(None).cast("long").alias("remote_modified"))
    store.process(rows(0, 30, "a"), 1)
    store.process(rows(30, 900, "a"), 2)
    assert store.process(rows(0, 3, "b"), 3).count() == 3
    assert store.commits()[-1]["range_bits"] > store.commits()[0]["range_bits"] and store.commits()[-1]["keys"] == 900
    assert store.process(rows(0, 900, "b"), 4).count() == 897 and store.process(rows(0, 900, "b"), 5).count() == 0


@pytest.mark.parametrize("most", [60, 600])
def test_login_sessions_end_at_the_latest(spark, most):
    import datetime as dt

    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", i, at(20 * i)) for i in range(8)] + [("a", 50, at(400)), ("b", 99, at(0)), (None, 100, at(0))]
    d = spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp")
    got = sorted((r.user_id, r.session, r.n) for r in usage.login_sessions(d, most_minutes=most).collect())
    assert got == ([("a", 1, 3), ("a", 2, 3), ("a", 3, 2), ("a", 4, 1), ("b", 1, 1)] if most == 60 else [("a", 1, 8), ("a", 2, 1), ("b", 1, 1)])
