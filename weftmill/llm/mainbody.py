"""The main body of web pages by tag-path ratios.

The pages come as text, so a line's path is read off what the markup left: its mark (heading, list item, paragraph) and
whether it holds no sentence, one, or several. Text length and punctuation are summed for each path over all pages and over
each site, divided by the number of nodes and fused; lines that a site repeats on many of its urls, or many sites but for
their own name, are paths of their own and have no text. Ratios are then smoothed along the tree that the page's lines stand in: a heading with
what it is the heading of, a list with the paragraph it hangs on, a single sentence with the paragraphs beside it, if the page has any of several. Lines
below a threshold are what the template adds. No words or phrases are looked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from weftmill.llm.repeats import MIN_SHARE, MIN_URLS
from weftmill.llm.skeleton import Letters, skeleton
from weftmill.shared import staged

_LETTERS = Letters(None)
_MARK = regex.compile(r"^\s*(#+|[-*•»›]|\d+[.)])\s+")
_DECOR = regex.compile(r"\s*(?:\.\.\.|…|»)\s*$")
_MARKS = ".,;:!?()-'\"/।"
_SENTENCES = regex.compile(r"[.!?।][\"”’)\]]*(?:\s|$)")

#: Words of a sentence at least, and of a prose line; the ratio below which a line is the template's. Where no path of the
#: corpus has twice that ratio, half of the largest takes its place.
PROSE_WORDS, THRESHOLD = 8, 120.0
#: The share of all urls on which a line without or with one sentence counts as repeated, whatever the site; also at least MIN_URLS.
ALL_SHARE = 0.002
#: Lines of a site that count as much as the whole corpus in a path's ratio.
WEIGHT = 50.0
#: Sites whose ratios are broadcast at most (each has nine paths and few repeated lines); beyond that they are joined by shuffling.
BROADCAST_SITES = 20_000

MARKS, SHAPES = ["p", "h", "li"], ["line", "sentence", "prose"]
#: A path's code is 3 * mark + shape, and 9 more for the page's title.
_P, _H, _LI, _SENTENCE, _PROSE, _TITLE = 0, 1, 2, 1, 2, 9

_NAMES = ("nos", "codes", "near", "up", "down", "chars", "puncts", "keys")
_LINES = StructType([StructField(n, ArrayType(LongType() if n == "keys" else IntegerType())) for n in _NAMES])


_OTHER = bytes(i for i in range(128) if not chr(i).isalpha())


def _key(line: str) -> str:
    """Letters of a line in its consistent form, in lower case."""
    return line.encode().translate(None, _OTHER).decode().lower() if line.isascii() else line.lower().translate(_LETTERS)


@functools.lru_cache(100_000)
def _parsed(raw: str) -> tuple[int, int, str, str, int, int] | None:
    """(mark, shape, body, key, words, punctuation) of a line; None if it is blank."""
    line = skeleton(raw).strip()
    if not line:
        return None
    m = _MARK.match(line)
    body = line[m.end() :] if m else line
    if line[-1] in ".…»":
        body = _DECOR.sub("", body)
    words = len(body.split())
    shape = min(2, len(_SENTENCES.findall(body))) if words >= PROSE_WORDS else 0
    mark = _P if not m else _H if m.group(1)[0] == "#" else _LI
    return mark, shape, body, _key(body), words, sum(map(body.count, _MARKS))


def page_lines(text: str, title: str | None) -> tuple[list[int], list[tuple], list[int], list[int], list[int], int]:
    """(line numbers, parsed lines, and for each the place of the line it is smoothed with, of the paragraphs above and
    below it, -1 where there is none; place of the title) of the non-blank lines of a page."""
    nos, rows = [], []
    for i, x in enumerate(text.split("\n")):
        r = _parsed(x)
        if r is not None:
            nos.append(i)
            rows.append(r)
    n = len(rows)
    own = _key(skeleton(title or "").strip())
    prose = next((k for k, r in enumerate(rows) if r[0] == _P and r[1]), n)
    title_at = next((k for k, r in enumerate(rows) if own and r[3] == own and (r[0] == _H or r[0] == _P and k < prose)), -1)
    tied = [0 < k < n and nos[k - 1] == nos[k] - 1 for k in range(n + 1)]  # directly below another line
    up, down, near = [-1] * n, [-1] * n, [-1] * n
    for k in range(n):  # a list hangs on the paragraph above its first item, and what follows the list on the same
        if tied[k]:
            up[k] = {_P: k - 1, _LI: near[k - 1], _H: -1}[rows[k - 1][0]]
        if rows[k][0] == _LI:
            near[k] = up[k]
    for k in reversed(range(n)):  # a heading is that of the first line below it that is none
        if tied[k + 1]:
            down[k] = {_P: k + 1, _LI: -1, _H: near[k + 1]}[rows[k + 1][0]]
        if rows[k][0] == _H:
            near[k] = down[k]
    return nos, rows, near, up, down, title_at


def _page_lines(judge: Callable | None):
    """The function that reads pages; ``judge`` makes what labels a paragraph with two numbers, once in each worker."""
    more = ["first", "second", "words"] if judge else []
    kinds = StructType([*_LINES.fields, *[StructField(n, ArrayType(IntegerType())) for n in more]])

    @F.pandas_udf(kinds)
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        label = functools.lru_cache(50_000)(judge()) if judge else None

        @functools.lru_cache(100_000)
        def hashed(body: str, host: str) -> int:
            """Of the letters of a line of at most one sentence, without words of the site's name."""
            words = map(_key, body.split())
            return xxhash.xxh3_64_intdigest("".join(w for w in words if len(w) < 4 or w not in host)) - (1 << 63)

        def key(r: tuple, host: str) -> int:
            return 0 if r[4] < PROSE_WORDS else hashed(r[2], host) if r[1] < _PROSE else xxhash.xxh3_64_intdigest(r[3]) - (1 << 63)

        for texts, titles, sites in parts:
            out = []
            for text, title, site in zip(texts, titles, sites):
                host = _key(site)
                nos, rows, near, up, down, title_at = page_lines(text, title) if text else ([], [], [], [], [], -1)
                codes = [3 * r[0] + r[1] + (_TITLE if k == title_at else 0) for k, r in enumerate(rows)]
                got = [nos, codes, near, up, down, [len(r[2]) for r in rows], [r[5] for r in rows], [key(r, host) for r in rows]]
                if label:
                    said = [label(r[2]) if r[0] == _P and r[4] >= PROSE_WORDS else (-1, 0) for r in rows]
                    got += [[a for a, _ in said], [b for _, b in said], [r[4] for r in rows]]
                out.append(got)
            yield pd.DataFrame(out, columns=[*_NAMES, *more])

    return read


def line_ratios(codes: list[int], own: list[bool], near: list[int], up: list[int], down: list[int], ratios: list[float]) -> list[float]:
    """Smoothed ratio of every line of a page. ``ratios`` are those of the nine paths; the page's title has twice THRESHOLD at least."""
    plain = [ratios[c % _TITLE] if o else 0.0 for c, o in zip(codes, own)]
    prose = any(o and c == _PROSE for c, o in zip(codes, own))
    out = plain[:]
    for k, c in enumerate(codes):
        if c == _SENTENCE and own[k] and prose:
            out[k] = (plain[k] + max(plain[i] if i >= 0 else 0.0 for i in (up[k], down[k]))) / 2
    paragraphs = out[:]
    for k, c in enumerate(codes):
        if c % _TITLE >= 3 and own[k]:
            out[k] = (plain[k] + (paragraphs[near[k]] if near[k] >= 0 else 0.0)) / 2
        if c >= _TITLE:
            out[k] = max(out[k], 2 * THRESHOLD)
    return out


def measured_pages(pages: DataFrame, keep: list[str] = (), judge: Callable | None = None) -> DataFrame:
    """A row for each page with its lines as arrays: numbers, codes of paths, places of neighbours, whether a line's text is
    its own, and the ratios and limit of its site; what ``line_ratios`` needs.

    With ``judge``, the lines also have two numbers (first, second) that its function gives each paragraph of at least
    eight words, read in the same pass, and their words. Only sums by site and path and hashes of lines are shuffled.
    """
    site = F.coalesce("site", F.lit(""))
    rows = pages.select("page_id", *keep, F.xxhash64("url").alias("u"), F.col("url").isNotNull().alias("has_url"), site.alias("site"), _page_lines(judge)(F.col("text"), F.coalesce(F.col("title"), F.lit("")), site).alias("l"))
    rows = staged(rows.select("page_id", *keep, "u", "has_url", "site", "l.*"), "pagelines")
    urls = staged(rows.filter("has_url").select("site", "u").distinct().groupBy("site").agg(F.count("*").alias("urls")), "urls")
    keys = rows.filter("has_url").select("site", "u", F.explode(F.array_distinct(F.transform(F.arrays_zip("keys", "codes"), lambda x: F.struct(x["keys"].alias("key"), (x["codes"] % _TITLE < 2).alias("short"))))).alias("x"))
    on = staged(keys.filter("x.key <> 0").select("site", "u", "x.*").distinct().groupBy("site", "key").agg(F.count("*").alias("on"), F.max("short").alias("short")), "keys")
    # a site has few such lines: at most 1 / MIN_SHARE times the lines of a page; all sites, 1 / ALL_SHARE times
    often = on.filter(f"on >= {MIN_URLS}").join(urls, "site").filter(F.col("on") >= MIN_SHARE * F.col("urls")).select("site", "key")
    wide = on.filter("short").groupBy("key").agg(F.sum("on").alias("n")).filter(f"n >= {MIN_URLS}").crossJoin(F.broadcast(urls.agg(F.sum("urls").alias("all")))).filter(F.col("n") >= ALL_SHARE * F.col("all"))  # one row beside each
    often = often.unionByName(on.join(wide.select("key"), "key", "left_semi").select("site", "key"))
    common = staged(often.groupBy("site").agg(F.collect_set("key").alias("common")), "common")
    small = urls.count() <= BROADCAST_SITES
    near = F.broadcast if small else (lambda df: df)
    rows = rows.join(near(common), "site", "left").withColumn("hits", F.coalesce(F.array_intersect("keys", "common"), F.array().cast("array<bigint>"))).drop("common")
    rows = rows.withColumn("own", F.transform("keys", lambda k: ~F.array_contains("hits", k)))
    own = F.filter(F.arrays_zip("codes", "chars", "puncts", "own"), lambda x: x["own"])
    per = rows.select("site", F.explode(own).alias("x")).groupBy("site", (F.col("x.codes") % _TITLE).alias("code")).agg(F.sum("x.chars").alias("c"), F.sum("x.puncts").alias("p"), F.count("*").alias("n"))
    per = staged(per, "paths")
    all_ = per.groupBy("code").agg((F.sum("c") / F.sum("n")).alias("mc"), (F.sum("p") / F.sum("n")).alias("mp"))  # nine rows
    fused = (F.col("c") + WEIGHT * F.col("mc")) / (F.col("n") + WEIGHT) * (F.col("p") + WEIGHT * F.col("mp")) / (F.col("n") + WEIGHT)
    limit = all_.agg(F.least(F.lit(THRESHOLD), F.max(F.col("mc") * F.col("mp")) / 2).alias("limit"))  # one row
    by = per.join(F.broadcast(all_), "code").groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("code", fused))).alias("m"))  # nine paths a site
    by = by.select("site", F.array(*[F.coalesce(F.try_element_at("m", F.lit(c).cast("int")), F.lit(0.0)) for c in range(_TITLE)]).alias("ratios"))
    sites = staged(by.crossJoin(F.broadcast(limit)), "ratios")
    scored = rows.join(near(sites), "site", "left")
    none = F.array_repeat(F.lit(0.0), F.lit(_TITLE))
    more = ["first", "second", "words"] if judge else []
    return scored.select("page_id", *keep, "nos", "codes", "own", "near", "up", "down", F.coalesce("ratios", none).alias("ratios"), F.coalesce("limit", F.lit(THRESHOLD)).alias("limit"), *more)


_SCORED = StructType([StructField("ratios", ArrayType(DoubleType())), StructField("template", ArrayType(IntegerType()))])


@F.pandas_udf(_SCORED)
def _scored(nos: pd.Series, codes: pd.Series, own: pd.Series, near: pd.Series, up: pd.Series, down: pd.Series, ratios: pd.Series, limit: pd.Series) -> pd.DataFrame:
    out = []
    for n, c, o, a, u, d, r, t in zip(nos, codes, own, near, up, down, ratios, limit):
        got = line_ratios(c.tolist(), o.tolist(), a.tolist(), u.tolist(), d.tolist(), r.tolist())
        out.append((got, [i for i, x in zip(n.tolist(), got) if x < t]))
    return pd.DataFrame(out, columns=_SCORED.names)


def scored_pages(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(page_id, *keep, nos, codes, ratios, template) of every page: numbers, paths and ratios of its non-blank lines, and the numbers of the template's.

    A path's ratio is characters per node times punctuation marks per node over all pages, mixed with the same over the
    page's site. A line of at least eight words that stands on at least 6 and 15 % of its site's urls is the template's, and
    so is a paragraph of at most one sentence that, without words of the site's name, stands on at least 6 and 0.2 % of all
    urls. Smoothing takes the mean of a line's ratio and that of the line it belongs to. The line that repeats the page's
    stored title is content. Null and empty texts have no lines; a null title or site only takes away a hint. Pages that
    repeat an id are scored each.
    """
    s = _scored("nos", "codes", "own", "near", "up", "down", "ratios", "limit")
    return measured_pages(pages, keep).select("page_id", *keep, "nos", "codes", s.alias("s")).select("page_id", *keep, "nos", "codes", "s.ratios", "s.template")


def scored_lines(pages: DataFrame) -> DataFrame:
    """``scored_pages`` with a row for each line: (page_id, line_no, path, ratio, template)."""
    names = F.array(*[F.lit(f"{m}/{s}{t}") for t in ("", "/title") for m in MARKS for s in SHAPES])
    lines = scored_pages(pages).select("page_id", "template", F.explode(F.arrays_zip("nos", "codes", "ratios")).alias("x"))
    return lines.select("page_id", F.col("x.nos").alias("line_no"), F.get(names, F.col("x.codes")).alias("path"), F.col("x.ratios").alias("ratio"), F.array_contains("template", F.col("x.nos")).alias("template"))


def template_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of every non-blank line that the site's template adds."""
    return scored_pages(pages).select("page_id", F.explode("template").alias("line_no"))


def main_body(pages: DataFrame) -> DataFrame:
    """(page_id, body): each page's own lines in order; "" where the template is all there is, null where there is no text."""
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("template", i))
    return scored_pages(pages, ["text"]).select("page_id", F.btrim(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), F.lit(" \n")).alias("body"))
