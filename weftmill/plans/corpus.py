"""Queries over urls, texts and corpus cleaning, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.functions import html as H
from weftmill.functions import meta as M
from weftmill.functions import text as T
from weftmill.functions import urls as U
from weftmill.operators import chunk, clean, crawl
from weftmill.plans.registry import registered
from weftmill.sources import documents as D
from weftmill.sources import web as W
from weftmill.shared import staged, table

_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ALLOWED, _BLOCKED = ("www.lojobha-college.example", "blog.niolturmo-science.example"), ("portal.thekosunlo-arts.example",)

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    return registered(QUERIES, SQL, sql)


@query(f"""
    select source_id, {_HOST.format('url')} as host, regexp_extract(lower({_PATH.format('url')}), '\\.([a-z0-9]{{2,5}})$', 1) as ext,
      try_cast(nullif(regexp_extract(url, '/wp-content/uploads/(\\d{{4}})/(\\d{{2}})/', 1), '') as int) as upload_year,
      case when regexp_extract(lower({_PATH.format('url')}), '\\.([a-z0-9]{{2,5}})$', 1) in ('jpg', 'jpeg', 'png') then 'image'
        when regexp_extract(lower({_PATH.format('url')}), '\\.([a-z0-9]{{2,5}})$', 1) in ('pdf', 'docx', 'txt') then regexp_extract(lower({_PATH.format('url')}), '\\.([a-z0-9]{{2,5}})$', 1)
        when regexp_matches({_PATH.format('url')}, '(/wp-admin|/wp-json|/feed/?$|/tag/|/login|/register|/cart)') then null else 'html' end as kind
    from sources where url is not null
""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "sources").filter("url is not null").select("source_id", U.host(u).alias("host"), U.extension(u).alias("ext"), U.upload_year(u).alias("upload_year"), U.kind(u).alias("kind"))


_KEPT = "array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(regexp_extract(p, '^([^=]*)', 1), '" + U.TRACKING + "')), '&')"


@query(f"""
    with l as (select page_id, url as whole, trim(url) as url from (select page_id, unnest(links).url as url from extracted_pages)),
      p as (select page_id, whole, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, {_HOST.format('url')} as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]*:([0-9]*)', 1) as port, regexp_replace({_PATH.format('url')}, '/{{2,}}', '/', 'g') as path, {_KEPT} as kept from l)
    select page_id, whole as url, case when scheme in ('http', 'https') and host <> '' then scheme || '://' || host || case when port in ('', '80', '443') then '' else ':' || port end || case when path = '' then '/' else path end || case when kept = '' then '' else '?' || kept end end as normal from p
""")
def url_normalized(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "extracted_pages").select("page_id", F.explode("links").alias("l")).select("page_id", "l.url")
    return links.select("page_id", "url", U.normal_absolute(F.col("url")).alias("normal"))


@query()
def url_normalized_full(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "extracted_pages").select("page_id", F.col("url").alias("base"), F.explode("links").alias("l"))
    return links.select("page_id", F.col("l.url").alias("url"), U.normal(F.col("l.url"), F.col("base")).alias("normal"))


@query(f"""
    select source_id, coalesce(not ({_HOST.format('url')} = '{_BLOCKED[0]}' or {_HOST.format('url')} like '%.{_BLOCKED[0]}')
      and {_HOST.format('url')} in ({', '.join(f"'{x}', 'www.{x}'" for x in _ALLOWED)}), false) as allowed from sources
""")
def domain_allowed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", U.domain_allowed(F.col("url"), _ALLOWED, _BLOCKED).alias("allowed"))


@query("""
    with l as (select page_id, unnest(links) as l, generate_subscripts(links, 1) as n from extracted_pages)
    select l.url as url, count(*) as times, arg_min(l.text, (page_id, n)) filter (where coalesce(l.text, '') <> '') as label from l where l.url is not null group by l.url
""")
def link_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each link once, with its first label that is not empty."""
    l = table(spark, d, "extracted_pages").select("page_id", F.posexplode("links").alias("n", "l"))
    first = F.min_by("l.text", F.when(F.coalesce("l.text", F.lit("")) != "", F.struct("page_id", "n")))
    return l.filter("l.url is not null").groupBy(F.col("l.url").alias("url")).agg(F.count("*").alias("times"), first.alias("label"))


def _of(text: str, a: int, b: int) -> str:
    return f"length({text}) - length(regexp_replace({text}, '[{chr(a)}-{chr(b)}]', '', 'g'))"


def _script(text: str) -> str:
    """(number of letters, precedence, language) of the script with most letters."""
    return "list_max([" + ", ".join(f"{{'n': {_of(text, a, b)}, 'at': {-i}, 'lang': '{lang}'}}" for i, (lang, (a, b)) in enumerate(T.SCRIPTS.items())) + "])"


@query(f"""
    with h as (select doc_id, substr(text, 1, 5000) as t from documents where text is not null), c as (select doc_id, {_script('t')} as top, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as latin from h)
    select doc_id, case when top.n > 0 and top.n >= latin * 0.3 then top.lang else 'en' end as script from c
""")
def script_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.script_language(F.col("text")).alias("script"))


@query("""
    with f as (select doc_id, list_filter(regexp_extract_all(substr(text, 1, 4000), '\\b(20\\d{2}\\s*[-–/]\\s*(?:20)?\\d{2})\\b', 1), lambda x: (cast(left(x, 4) as int) + 1) % 100 = cast(right(x, 2) as int)) as ys from documents)
    select doc_id, case when len(ys) > 0 then left(ys[1], 4) || '-' || right(ys[1], 2) end as year from f
""")
def academic_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.academic_year(F.col("text")).alias("year"))


@query("""
    select chunk_id, cast(floor((length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) as int) + 1 as tokens from chunks
""")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, sha256(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g'), ' ')) as hash from documents")
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


_FORM = "lower(trim(regexp_replace(regexp_replace({0}, '^#{{1,6}}\\s+', ''), '\\s+', ' ', 'g')))"
_FORMS = f"""
    lines as (select page_id, site, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from extracted_pages),
    forms as (select site, form, count(distinct page_id) as pages from (select page_id, site, {_FORM.format('line')} as form from lines) where length(form) >= 3 group by site, form),
    bad as (select f.site, f.form, f.pages from forms f join (select site, count(*) as n from extracted_pages group by site) s using (site) where f.pages >= greatest(6, floor(s.n * 0.15)))
"""


def _bad(spark: SparkSession, d: str) -> DataFrame:
    return clean.repeated_lines(table(spark, d, "extracted_pages"), "page_id", by=["site"])


@query(f"with {_FORMS} select site, form, pages from bad")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return _bad(spark, d)


@query(f"""
    with {_FORMS},
    kept as (select l.page_id, l.pos, l.line, length(regexp_extract(l.line, '^(#{{1,6}})\\s', 1)) as level, trim(l.line) = '' as blank from lines l left join bad b on b.site = l.site and b.form = {_FORM.format('l.line')} where b.form is null),
    next as (select *, (select min(k.pos) from kept k where k.page_id = kept.page_id and k.pos > kept.pos and not k.blank) as after from kept),
    body as (select n.page_id, n.pos, n.line from next n left join kept a on a.page_id = n.page_id and a.pos = n.after where n.level = 0 or (n.after is not null and (a.level = 0 or a.level > n.level)))
    select p.page_id, trim(regexp_replace(coalesce(string_agg(b.line, chr(10) order by b.pos), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as clean
    from extracted_pages p left join body b using (page_id) where p.text is not null group by p.page_id
""")
def boilerplate_stripped(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages")
    return clean.without_repeated(pages.filter("text is not null"), _bad(spark, d), "page_id", by=["site"])


@query(f"""
    with {_FORMS}, all_bad as (select distinct form from bad),
    f as (select {_FORM.format('l.line')} as form, l.page_id, l.pos, l.line, row_number() over (partition by {_FORM.format('l.line')} order by page_id, pos, line) as n from lines l)
    select f.form, trim(regexp_replace(f.line, '^#{{1,6}}\\s+', '')) as line, f.page_id, cast(f.pos as int) as pos from f join all_bad using (form) where n = 1
""")
def common_information(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").withColumn("text", F.coalesce("text", F.lit("")))
    return clean.common_information(pages, _bad(spark, d).select("form").distinct(), "page_id")


@query("""
    select footer, count(*) as n, min(page_id) as first_seen from extracted_pages where footer is not null and footer <> '' group by footer order by n desc, first_seen limit 1
""")
def modal_footer(spark: SparkSession, d: str) -> DataFrame:
    return clean.modal_value(table(spark, d, "extracted_pages"), "footer", "page_id")


@query(f"""
    with {_FORMS}, f as (select site, arg_max(footer, (n, footer)) as footer from (select site, footer, count(*) as n from extracted_pages where footer is not null group by all) group by site),
      c as (select site, string_agg(form, chr(10) order by form) as common from bad group by site), r as (select f.site, common, list_filter(string_split(footer, chr(10)), lambda x: trim(x, ' ') <> '') as rows from f left join c on c.site is not distinct from f.site)
    select site, concat_ws(chr(10) || chr(10), case when len(list_filter(rows, lambda x: contains(x, ' — '))) > 0 then '## Leadership' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(rows, lambda x: contains(x, ' — ')), lambda x: regexp_replace(x, '^(.*?) — (.*)$', '\\2: \\1')), chr(10)) end,
      case when len(list_filter(rows, lambda x: not contains(x, ' — '))) > 0 then '## Address and contact' || chr(10) || chr(10) || array_to_string(list_filter(rows, lambda x: not contains(x, ' — ')), chr(10)) end, case when coalesce(common, '') <> '' then '## Shown across the site' || chr(10) || chr(10) || common end) as information from r
""")
def site_information(spark: SparkSession, d: str) -> DataFrame:
    """Each site's most frequent footer and its repeated lines."""
    pages = table(spark, d, "extracted_pages")
    footers = pages.filter("footer is not null").groupBy("site", "footer").count().groupBy("site").agg(F.max(F.struct("count", "footer")).alias("x"))
    lines = _bad(spark, d).groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("form")), "\n").alias("common"))
    return footers.join(lines, "site", "left").select("site", clean.site_information(F.col("x.footer"), F.col("common")).alias("information"))


@query("""
    select doc_id, case when length(text) > 1500000 then 'too_long'
      when len(regexp_extract_all(text, '(?i)strongly agree')) >= 20 or regexp_matches(substr(text, 1, 1500), '(?i)curriculum feedback|feedback from (the )?students|student feedback') then 'feedback'
      when (regexp_matches(substr(text, 1, 1500), '(?i)this is to certify that') and regexp_matches(substr(text, 1, 1500), '(?i)\\b(student|studying|semester|internship|training|project)')) then 'student_work' end as reason from documents
""")
def junk_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean.junk_reason(F.col("text")).alias("reason"))


_NAME = "regexp_extract({0}, '([^/]*)$', 1)"
#: Editions, as the tables have none: (source_id, url, academic_year).
EDITIONS = [
    (-1, "https://a.example/f/Student-Handbook-2023-24.pdf", None), (-2, "https://a.example/f/student_handbook_2024-25_final.pdf", None), (-3, "https://a.example/f/student-handbok-2022-23.pdf", None), (-4, "https://a.example/f/Fee-Structures-24-25.pdf", None),
    (-5, "https://a.example/f/fee-structure-2025-26.pdf", None), (-6, "https://a.example/f/Annual-Report-2020.pdf", None), (-7, "https://a.example/f/academic-calendar.pdf", "2021-22"), (-8, "https://a.example/f/Academic%20Calendar%202023.pdf", None),
    (-9, "https://a.example/f/prospectus.pdf", None), (-10, "https://a.example/f/anti-ragging-policy-2019.docx", None), (-11, "https://a.example/f/xanti-ragging-policyx-2021.docx", None), (-12, None, "2021-22"),
]
_EDITIONS = "editions as (select source_id, url, academic_year from sources where content_type <> 'html' union all select * from (values " + ", ".join(f"({i}, " + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for i, *r in EDITIONS) + ") t(source_id, url, academic_year))"
_NAMES = f"""
    {_EDITIONS}, named as (select source_id, url, academic_year, coalesce(url_decode({_NAME.format("regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)")}), '') as name from editions),
"""


_SERIES = _NAMES + r"""
    keyed as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\.(pdf|docx?)$', ''), '(19|20)\d{2}(\s*[-–_]\s*(19|20)?\d{2})?|\b\d{2}\s*[-–_]\s*\d{2}\b', ' ', 'g'), '[^a-z]+', ' ', 'g'),
      '\b(final|new|updated|revised|latest|compressed|copy|only|printed|pages|st|college|of|the|and|for|ay|a\s?y|pdf|v\d|\d+)\b', ' ', 'g'), ' +', ' ', 'g')) as k from named),
    series as (select source_id, case when regexp_matches(k, 'handbook|prospectus|calendar|fees structure|fee structure|brochure|information bulletin|policy')
        then array_to_string(list_transform(string_split(k, ' '), lambda w: case when length(w) > 4 and w like '%s' and w not like '%us' then left(w, -1) else w end), ' ') end as series,
      coalesce(try_cast(nullif(regexp_extract(name, '(20\d{2})\s*[-–_]\s*(?:20)?\d{2}(?:\D|$)', 1), '') as int),
        case when try_cast(nullif(regexp_extract(name, '(?:^|\D)(\d{2})\s*[-–_]\s*(\d{2})(?:\D|$)', 2), '') as int) = try_cast(nullif(regexp_extract(name, '(?:^|\D)(\d{2})\s*[-–_]\s*(\d{2})(?:\D|$)', 1), '') as int) + 1
          then 2000 + try_cast(regexp_extract(name, '(?:^|\D)(\d{2})\s*[-–_]\s*(\d{2})(?:\D|$)', 1) as int) end,
        try_cast(nullif(regexp_extract(name, '(?:^|\D)(20\d{2})(?:\D|$)', 1), '') as int), try_cast(nullif(regexp_extract(academic_year, '^(\d{4})', 1), '') as int)) as year from keyed)
"""


def _editions(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "sources").filter("content_type <> 'html'").select("source_id", "url", "academic_year")
    return stored.unionByName(spark.createDataFrame(EDITIONS, "source_id long, url string, academic_year string"))


@query(f"with {_SERIES}, s as (select * from series where series is not null and year is not null), m as (select series, max(year) as newest from s group by series) select source_id, series, year, newest from s join m using (series) where year < newest")
def superseded_editions(spark: SparkSession, d: str) -> DataFrame:
    return clean.superseded(_editions(spark, d), "source_id")


@query()
def superseded_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return clean.superseded(_editions(spark, d), "source_id", fuzzy=True)


@query("""
    with h as (select doc_id, length(trim(coalesce(text, ''), ' ')) >= 40 as body, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h from documents), f as (select h, min(doc_id) as survivor from h where body group by h)
    select doc_id, case when not body then 'empty' when doc_id <> survivor then 'duplicate' else 'index' end as status, case when body and doc_id <> survivor then survivor end as duplicate_of from h left join f on h.h = f.h
""")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return clean.index_status(table(spark, d, "documents"), "doc_id")


@query()
def set_aside(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_docs").filter("text is not null").withColumn("academic_year", F.lit(None).cast("string"))
    return clean.set_aside(docs.groupBy("file_id", "url").agg(F.max("text").alias("text"), F.max("academic_year").alias("academic_year")), "file_id")


@query()
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the files' texts under their titles."""
    return chunk.chunked(table(spark, d, "extracted_docs"), "file_id", title="title")


@query("""
    select coalesce(a.url, b.url) as url, case when b.url is null then 'new' when a.url is null then 'missing' when a.title is not distinct from b.title and a.remote_modified is not distinct from b.remote_modified then 'unchanged' else 'updated' end as change
    from (select url, max(title) as title, max(remote_modified) as remote_modified from seeds where run_id = 10 group by url) a
    full outer join (select url, max(title) as title, max(remote_modified) as remote_modified from seeds where run_id = 9 group by url) b on a.url = b.url
""")
def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Listings of the last run held against those of the run before."""
    of = lambda run: table(spark, d, "seeds").filter(F.col("run_id") == run).groupBy("url").agg(F.max("title").alias("title"), F.max("remote_modified").alias("remote_modified"))
    return crawl.changes(of(10), of(9), "url", ["title", "remote_modified"])


@query("""
    select source_id, url from sources where source_type = 'website' and (last_seen_run_id is null or last_seen_run_id <> 10) and url not like 'site://%' and coalesce(index_status <> 'blocked', true)
""")
def removal_candidates(spark: SparkSession, d: str) -> DataFrame:
    return crawl.removal_candidates(table(spark, d, "sources"), 10).select("source_id", "url")


@query("""
    select case when coalesce(not_modified, false) or status = 304 then 'touch' when status in (404, 410) then 'delete' when error is not null or status >= 400 or status = 0 then 'error' else 'store' end as outcome, count(*) as n
    from fetch_results group by 1
""")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = crawl.outcome(F.col("status"), F.col("not_modified"), F.col("error"))
    return table(spark, d, "fetch_results").groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
    with recursive l as (select distinct url, unnest(links).url as target from extracted_pages), seeds0 as (select distinct parent_url as url from sources where parent_url is not null),
      step(url, depth) as (select url, 0 from seeds0 union select l.target, s.depth + 1 from step s join l on l.url = s.url where s.depth < 3 and l.target is not null)
    select url, cast(min(depth) as int) as depth from step group by url
""")
def link_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What links reach within three steps from the parents of sources, at its least depth."""
    pages = table(spark, d, "extracted_pages").select("url", F.explode("links.url").alias("target")).distinct()
    links = lambda edge: pages.join(edge, "url").select(F.col("target").alias("url"))
    return crawl.frontier(table(spark, d, "sources").select(F.col("parent_url").alias("url")), links, 3)


@query("""
    select s.source_id, coalesce(c.n, 0) as n from sources s left join (select source_id, count(*) as n from chunks group by source_id) c using (source_id)
""")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.chunk_counts(table(spark, d, "sources"), table(spark, d, "chunks"))


@query("""
    select chunk_id, source_id, text from chunks where source_id not in (select source_id from chunks where chunk_index = 3)
    union all select chunk_id + 1000000 as chunk_id, source_id, upper(heading) as text from chunks where chunk_index = 3
""")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with those of some sources replaced by new ones."""
    c = table(spark, d, "chunks")
    fresh = c.filter("chunk_index = 3").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "source_id", F.upper("heading").alias("text"))
    return crawl.replaced_by_source(c.select("chunk_id", "source_id", "text"), fresh)


@query("""
    select source_id, run_id, title from (select s.source_id, e.run_id, e.title, row_number() over (partition by s.source_id order by e.run_id desc, e.seed_id desc) as n from sources s join seeds e using (url)) where n = 1
""")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest listing of each source, from the append-only log of listings."""
    log = table(spark, d, "sources").select("source_id", "url").join(table(spark, d, "seeds").select("url", "run_id", "seed_id", "title"), "url")
    return crawl.current_state(log, "source_id", "run_id", "seed_id", "title").select("source_id", "run_id", "title")


@query(f"""
    with a as (select url, max(remote_modified) as rm from seeds where run_id = 10 and url is not null group by url), b as (select url, max(remote_modified) as rm, any_value(s.index_status) as st from seeds join (select url, index_status from sources) s using (url) where run_id = 9 group by url),
      k as (select a.url, a.rm, b.rm as old, b.st, b.url is not null as known, {_HOST.format('a.url')} as host, regexp_extract(lower({_PATH.format('a.url')}), '\\.([a-z0-9]{{2,5}})$', 1) as ext, {_PATH.format('a.url')} as path, regexp_extract(a.url, '^[^?#]*\\?([^#]*)', 1) as q from a left join b using (url)),
      t as (select *, case when ext in ('pdf', 'docx', 'txt', 'jpg', 'jpeg', 'png') then 'file' when ext in ({', '.join(f"'{x}'" for x in U.SKIPPED)}) or regexp_matches(path, '{U.SKIPPED_PATHS}') or regexp_matches(q, '{U.SKIPPED_QUERIES}') then null else 'html' end as kind from k),
      hosts as (select unnest([site, 'www.' || site]) as host from (select distinct site from sources where site is not null))
    select url, case when kind is null then 'skip_kind' when host not in (select host from hosts) or host = 'ads.example' or host like '%.ads.example' then 'skip_domain' when st = 'blocked' then 'skip_blocked' when known and rm is not null and rm = old then 'skip_unchanged' when known and kind <> 'html' then 'conditional' else 'fetch' end as action from t
""")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """The last run's listings, planned against those of the run before; every site of sources is allowed."""
    seeds = table(spark, d, "seeds").filter("run_id = 10 and url is not null").groupBy("url").agg(F.max("remote_modified").alias("remote_modified"))
    stored = table(spark, d, "seeds").filter("run_id = 9").groupBy("url").agg(F.max("remote_modified").alias("remote_modified")).join(table(spark, d, "sources").select("url", F.col("index_status").alias("status")), "url")
    return crawl.fetch_plan(seeds, stored, table(spark, d, "sources").select("site").distinct(), ["ads.example"])


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_LAST = "regexp_extract(regexp_replace({0}, '/+$', ''), '([^/]*)$', 1)".format(_PATH.format("url"))
_BARE = "trim(regexp_replace(regexp_replace(coalesce(url_decode(" + _LAST + "), ''), '\\.[A-Za-z0-9]{2,5}$', ''), '[-_\\s]+', ' ', 'g'), ' ')"
_TITLE = "trim(regexp_replace(trim(regexp_replace(trim(coalesce({0}, ''), ' '), '(?i)^Microsoft (Word|Excel|PowerPoint)\\s*-\\s*', ''), ' '), '(?i)\\.(docx?|xlsx?|pptx?|pdf)$', ''), ' ')"
_GOOD = "case when length({0}) >= 6 and not regexp_matches({0}, '" + M.GENERIC_TITLES + "') and regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(name), '[^a-z0-9]', '', 'g') and not regexp_matches({0}, '(?i)^(untitled|document[0-9]*)\\b') then substr({0}, 1, 300) end"


@query(f"""
    with e as (select file_id, e.url, s.title as listed, e.title from extracted_docs e left join sources s using (source_id)), f as (select *, {_BARE} as bare from e),
      n as (select *, array_to_string(list_transform(string_split(bare, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as name, {_TITLE.format('listed')} as a, {_TITLE.format('title')} as b from f)
    select file_id, coalesce({_GOOD.format('a')}, {_GOOD.format('b')}, name) as title from n
""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "extracted_docs").join(table(spark, d, "sources").select("source_id", F.col("title").alias("listed")), "source_id", "left")
    return files.select("file_id", M.document_title(F.col("url"), F.col("listed"), F.col("title")).alias("title"))


@query(f"""
    select source_id, coalesce(epoch_us(published_at), case when regexp_extract(url, '/wp-content/uploads/(\\d{{4}})/(\\d{{2}})/', 1) <> ''
      then epoch_us(make_timestamp(cast(regexp_extract(url, '/wp-content/uploads/(\\d{{4}})/(\\d{{2}})/', 1) as int), cast(regexp_extract(url, '/wp-content/uploads/(\\d{{4}})/(\\d{{2}})/', 2) as int), 1, 0, 0, 0)) end) as us from sources
""")
def best_dates(spark: SparkSession, d: str) -> DataFrame:
    """The stated date of each source, else that of its upload path."""
    stated = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, d, "sources").select("source_id", M.best_micros(stated, F.col("url"), F.lit("")).alias("us"))


@query("""
    select page_id, case when trim(coalesce(section, ''), ' ') = '' then trim(coalesce(title, ''), ' ') when trim(coalesce(title, ''), ' ') = '' or contains(trim(section, ' '), trim(title, ' ')) then trim(section, ' ') else trim(section, ' ') || ' › ' || trim(title, ' ') end as header from extracted_pages
""")
def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").select("page_id", M.chunk_header(F.col("section"), F.col("title")).alias("header"))


_LINKED = "trim(regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\\b(click here( to)?|view|download|read more)\\b', '', 'g'), '\\s+', ' ', 'g'), ' ')"


@query(f"""
    with t as (select source_id, {_LINKED} as t, trim(string_split(coalesce(section, ''), '›')[-1], ' ') as part, coalesce(academic_year, '') as year, url, content_type from sources),
      u as (select *, upper(substr(t, 1, 1)) || substr(t, 2) as t1 from t), v as (select *, case when t1 <> '' and regexp_replace(t1, '(?i)academic|year|[0-9\\s–—/-]', '', 'g') = '' and part <> '' then trim(part || ' ' || case when year <> '' then year else t1 end, ' ') else t1 end as t2 from u),
      w as (select *, case when t2 <> '' and year <> '' and not regexp_matches(t2, '(19|20)[0-9]{{2}}') then t2 || ' ' || year else t2 end as t3 from v)
    select source_id, case when content_type = 'html' and t3 <> '' then t3 || ' page, ' || {_HOST.format('url')} else t3 end as label from w
""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("title", "section", "academic_year", "url", "content_type")]
    return table(spark, d, "sources").select("source_id", M.source_label(*c).alias("label"))


@query(f"""
    with c as (select doc_id, lang, text, {_script("coalesce(text, '')")} as top, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\\pL', '', 'g')) as letters from documents),
      y as (select *, case when letters = 0 or top.n < greatest(2, letters * 0.3) then 'en' when top.lang = 'hi' and lang = 'mr' then 'mr' else top.lang end as typed from c)
    select doc_id, case when typed <> 'en' then typed else coalesce(lang, 'en') end as language from y
""")
def typed_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.answer_language(F.col("lang"), F.col("text")).alias("language"))


@query()
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Extracted pages written as HTML and read again, as the tables hold no HTML."""
    p = table(spark, d, "extracted_pages").filter("text is not null")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "\n", "</p><p>")
    anchors = F.array_join(F.transform("links", lambda l: F.concat(F.lit('<a href="'), l["url"], F.lit('">'), F.coalesce(l["text"], F.lit("")), F.lit("</a>"))), " ")
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav>"), F.coalesce(anchors, F.lit("")), F.lit("</nav><article><p>"), body, F.lit("</article><footer>"), F.coalesce("footer", F.lit("")), F.lit("</footer></body></html>"))
    return p.select("page_id", H.extracted(page, F.col("url")).alias("x")).select("page_id", "x.title", "x.text", F.size("x.links").alias("n_links"))


@query("""
    with f as (select fetch_id, site, run_id, epoch_us(fetched_at) as us from fetch_results where site is not null and fetched_at is not null), n as (select *, row_number() over (partition by site, run_id order by us, fetch_id) * 250000 as n from f)
    select fetch_id, max(us - n) over (partition by site, run_id order by us, fetch_id rows between unbounded preceding and current row) + n as start from n
""")
def host_turns(spark: SparkSession, d: str) -> DataFrame:
    """When each fetch of a run may begin with a quarter of a second between those of a site."""
    f = table(spark, d, "fetch_results").filter("site is not null and fetched_at is not null").select("fetch_id", "site", "run_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("us"))
    return W.turns(f, 250_000, "site", "us", "fetch_id", "run_id").select("fetch_id", "start")


#: Robots files of two sites, as the tables have none.
ROBOTS = [
    ("www.lojobha-college.example", "User-agent: *\nDisallow: /wp-content/uploads/2021/\nAllow: /downloads/\nDisallow: /d # all else\n\nUser-agent: other\nDisallow: /"),
    ("blog.niolturmo-science.example", "User-agent: weftbot\nUser-agent: another\nDisallow: /wp-content/\n\nUser-agent: *\nDisallow:"),
]


@query(f"""
    with r(host, n, allow, path) as (values ('{ROBOTS[0][0]}', 1, false, '/wp-content/uploads/2021/'), ('{ROBOTS[0][0]}', 2, true, '/downloads/'), ('{ROBOTS[0][0]}', 3, false, '/d'), ('{ROBOTS[1][0]}', 1, false, '/wp-content/')),
      u as (select source_id, {_HOST.format('url')} as host, case when {_PATH.format('url')} = '' then '/' else {_PATH.format('url')} end as path from sources)
    select source_id, coalesce((select arg_min(allow, n) from r where r.host = u.host and starts_with(u.path, r.path)), true) as allowed from u
""")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    rules = W.robots_rules(spark.createDataFrame(ROBOTS, "host string, text string"), "weftbot/1.0")
    return W.allowed_by_robots(table(spark, d, "sources").select("source_id", "url"), rules).select("source_id", "allowed")


#: Addresses of every kind.
ADDRESSES = ["10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.255.255", "192.168.0.1", "192.169.0.1", "8.8.8.8", "127.0.0.1", "169.254.1.1", "224.0.0.1", "255.255.255.255", "1.1.1.1", "300.1.1.1", "not an address", "0.0.0.0", "198.18.5.5", "203.0.113.9", "100.64.0.1"]


@query("with a(ip) as (values " + ", ".join(f"('{x}')" for x in ADDRESSES) + """), n as (select ip, case when regexp_matches(ip, '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$') then list_reduce(list_transform(string_split(ip, '.'), lambda x: cast(x as bigint)), lambda s, x: s * 256 + x) end as n from a)
    select ip, n is not null and not (""" + " or ".join(f"n between {a} and {a + (1 << (32 - bits)) - 1}" for a, bits in ((sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split("."))), bits) for base, bits in W.PRIVATE_V4)) + ") as public from n")
def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ADDRESSES], "ip string").select("ip", W.public_address(F.col("ip")).alias("public"))


@query("select file_id, case when len(regexp_extract_all(text, '[\\pL\\pN_]{3,}')) >= 8 then text else '' end as text from extracted_docs where text is not null")
def recognised_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_docs").filter("text is not null").select("file_id", D.recognised(F.col("text")).alias("text"))


@query("""
    with g as (select source_id, list([heading, cast(chunk_index as varchar), text] order by chunk_index, chunk_id) as rows from chunks where length(coalesce(text, '')) < 400 group by source_id),
      c as (select source_id, list_filter(list_transform(list_prepend(['Heading', '', 'Text'], rows), lambda r: list_transform(r, lambda x: trim(replace(coalesce(x, ''), chr(10), ' '), ' '))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) as t from g)
    select source_id, array_to_string(list_transform(t[2:], lambda r: array_to_string(list_filter([case when r[1] <> '' then 'Heading: ' || r[1] end, case when r[2] <> '' then r[2] end, case when r[3] <> '' then 'Text: ' || r[3] end], lambda x: x is not null), '; ')), chr(10)) as lines from c where len(t) >= 2
""")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short chunks of a source as the rows of a table with one nameless column."""
    c = table(spark, d, "chunks").filter("length(coalesce(text, '')) < 400")
    row = F.struct("chunk_index", "chunk_id", F.array("heading", F.col("chunk_index").cast("string"), "text").alias("r"))
    rows = c.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    head = F.array(F.array(F.lit("Heading"), F.lit(""), F.lit("Text")))
    return rows.select("source_id", D.table_text(F.concat(head, F.col("rows"))).alias("lines")).filter("lines is not null")


@query("""
    with d as (select distinct url from sources where content_type <> 'html' and url is not null), l as (select page_id, concat_ws(' › ', nullif(trim(section, ' '), ''), nullif(trim(title, ' '), '')) as said, unnest(links).url as url from extracted_pages)
    select d.url, coalesce(arg_min(said, (page_id, said)), '') as section from d left join l using (url) group by d.url
""")
def document_context(spark: SparkSession, d: str) -> DataFrame:
    """What the first page that links to a file says of itself."""
    return crawl.page_context(table(spark, d, "sources").filter("content_type <> 'html' and url is not null"), table(spark, d, "extracted_pages"))


@query("""
    select lang, text_hash, case when min(known) = 0 then null else max(value) end as value from (
      select lang, sha256(text) as text_hash, case when doc_id % 2 = 0 then 1 else 0 end as known, null as value from documents where false
      union all select r.lang, r.h, case when c.h is null then 0 else 1 end, c.value from (select distinct lang, sha256(text) as h from documents where text is not null and lang is not null) r
        left join (select lang, sha256(text) as h, max(cast(doc_id as varchar)) as value from documents where doc_id % 3 = 0 and text is not null and lang is not null group by all) c on c.lang = r.lang and c.h = r.h) group by all
""")
def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each different text to be translated, with what is known of it; those of a third of the documents are."""
    docs = table(spark, d, "documents").filter("text is not null and lang is not null").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return crawl.cached(docs, docs.filter("doc_id % 3 = 0").select("lang", "text_hash", F.col("doc_id").cast("string").alias("value")), ["lang", "text_hash"], "value")


@query("select doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 20 and length(regexp_replace(text, '\\s+', '', 'g')) - length(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[�-]', '', 'g')) > 0.3 * length(regexp_replace(text, '\\s+', '', 'g')) as unreadable from documents where text is not null")
def unreadable_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.unreadable(F.col("text")).alias("unreadable"))


@query("""
    with a as (select doc_id, regexp_replace(text, '[​-‏‪-‮⁠﻿­]', '', 'g') as t from documents where text is not null), b as (select doc_id, regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t ]+', ' ', 'g') as t from a)
    select doc_id, sha256(trim(regexp_replace(regexp_replace(t, ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) as hash from b
""")
def sanitized_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(T.sanitized(F.col("text")), 256).alias("hash"))


@query(f"select source_id, {_HOST.format('url')} as host, regexp_matches(url, '(/file/d/|[?&]id=)[A-Za-z0-9_-]{{20,}}') and {_HOST.format('url')} in ('drive.google.com', 'docs.google.com') as drive, trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') as title from sources where url is not null and not coalesce(contains(title, '&'), false)")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without tags; those with entities are tested apart."""
    s = table(spark, d, "sources").filter("url is not null and not coalesce(contains(title, '&'), false)")
    return s.select("source_id", U.host(F.col("url")).alias("host"), U.is_drive(F.col("url")).alias("drive"), M.clean_title(F.col("title")).alias("title"))
