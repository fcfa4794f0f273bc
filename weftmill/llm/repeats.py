"""Lines and blocks of lines repeated across one site's documents, by suffix arrays and their common prefixes.

Lines become identifiers. A block that is on many urls consists of lines that are, so a document's other lines cut it into
runs, and most runs of a site's documents are the same: each different run is kept once, with the number of its urls. The
suffixes of a site's runs are sorted, suffixes that begin with one line by one task; common prefixes of neighbours give the
maximal blocks of any length. Blocks on too few urls are left out, and the lines of the others are cut from the documents.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weftmill.llm.skeleton import skeleton
from weftmill.shared import staged

MIN_URLS, MIN_SHARE = 6, 0.15

_LETTER = regex.compile(r"\p{L}")
_ASCII = {i: None for i in range(128) if not chr(i).isalpha()}
_DROP = regex.compile(r"[\p{P}\p{S}\p{Z}\p{N}\p{C}\s]+")


def line_key(line: str) -> str:
    """The same for lines that differ only in case, spacing, punctuation, symbols, digits or look-alike characters; "" for lines without letters."""
    if line.isascii():
        return line.translate(_ASCII).lower()
    if not _LETTER.search(line):
        return ""
    return _DROP.sub("", unicodedata.normalize("NFC", skeleton(_DROP.sub("", skeleton(line)).lower())))


@F.pandas_udf(ArrayType(LongType()))
def _line_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An identifier of each line; 0 for lines without letters."""

    @functools.lru_cache(200_000)
    def of(line: str) -> int:
        k = line_key(line)
        return (xxhash.xxh3_64_intdigest(k) - (1 << 63) or 1) if k else 0

    for s in texts:
        yield s.map(lambda t: None if t is None else [of(x) for x in t.split("\n")])


def _site(df: DataFrame, site: str, url: str) -> Column:
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.coalesce(F.col(site), F.when(host != "", host)) if site in df.columns else F.when(host != "", host)


def line_ids(pages: DataFrame, fields: list[str], key: str = "page_id", url: str = "url", site: str = "site") -> DataFrame:
    """(site, f, u, row, key, ids): the lines of every document and field as identifiers in order.

    ``f`` is the field's place in ``fields``, ``u`` a hash of the url, ``row`` numbers documents, also where keys repeat.
    Documents without site or url have no lines.
    """
    parts = F.array(*[F.struct(F.lit(i).cast("byte").alias("f"), _line_ids(F.col(f)).alias("ids")) for i, f in enumerate(fields)])
    docs = pages.select(F.col(key).alias("key"), F.when(F.col(url).isNotNull(), F.xxhash64(url)).alias("u"), _site(pages, site, url).alias("site"), F.monotonically_increasing_id().alias("row"), F.explode(parts).alias("p"))
    return docs.filter("p.ids is not null and site is not null and u is not null").select("site", "p.f", "u", "row", "key", "p.ids")


def _needed(pages: DataFrame, url: str, site: str, min_urls: int, min_share: float) -> DataFrame:
    """How many urls of each site a line must be on. Distinct urls are counted partly before the shuffle."""
    n = pages.select(_site(pages, site, url).alias("site"), F.col(url).alias("url")).filter("site is not null and url is not null").distinct().groupBy("site").count()
    return n.select("site", F.greatest(F.lit(min_urls), F.ceil(F.col("count") * min_share - 1e-9)).alias("needed"))


#: Suffixes that one task sorts at most; those of a line with more are parted by the lines that follow.
SORTED = 100_000
#: Lines of blocks, over all sites, that are broadcast at most; more are joined by shuffling.
BROADCAST_LINES = 500_000
_GROUP = ["site", "f"]


def _common(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(site, f, common): identifiers of the lines on many urls; at most 1 / min_share times the lines of a document."""
    on = rows.select(*_GROUP, "u", F.explode(F.array_distinct("ids")).alias("id")).filter("id <> 0").distinct().groupBy(*_GROUP, "id").agg(F.count("*").alias("on"))
    return on.join(needed, "site").filter("on >= needed").groupBy(*_GROUP).agg(F.collect_list("id").alias("common"))


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _cut(ids: pd.Series, common: pd.Series) -> pd.Series:
    """The runs of common lines; lines without letters part no run."""
    out = []
    for xs, keep in zip(ids, common):
        keep, runs, cur = set(keep), [], []
        for x in xs:
            if x in keep:
                cur.append(x)
            elif x and cur:
                runs.append(cur)
                cur = []
        out.append([*runs, cur] if cur else runs)
    return pd.Series(out)


def _sorted_blocks(suffixes: list[tuple[tuple[int, ...], int, int]], depth: int) -> Iterator[tuple[list[int], int]]:
    """(lines, urls at most) of every maximal block of at least ``depth`` lines that suffixes begin with.

    A suffix is (lines, the line before it or 0, urls). Suffixes are sorted; an interval of the array whose neighbours have
    so many lines in common, or a suffix that ends, is a block that is not always followed by one same line.
    """
    rows = sorted(suffixes)
    n = len(rows)
    common = [0] * (n + 1)
    for i in range(1, n):
        a, b = rows[i - 1][0], rows[i][0]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        common[i] = k
    open_: list[list] = []  # of each open interval: length, lines, urls, the one line before all of it (None: several or none)
    for i in range(n + 1):
        done = None
        while open_ and open_[-1][0] > common[i]:
            done = open_.pop()
            if done[3] is None and done[0] >= depth:
                yield list(done[1][: done[0]]), done[2]
            if open_ and open_[-1][0] >= common[i]:
                _add(open_[-1], done[2], done[3])
                done = None
        if i == n:
            return
        if done is not None and common[i] > (open_[-1][0] if open_ else 0):
            open_.append([common[i], done[1], done[2], done[3]])
        elif done is not None and open_:
            _add(open_[-1], done[2], done[3])
        lines, before, urls = rows[i]
        if open_ and open_[-1][0] == len(lines):
            _add(open_[-1], urls, before or None)
        else:
            open_.append([len(lines), lines, urls, before or None])


def _add(interval: list, urls: int, before: int | None) -> None:
    interval[2] += urls
    if interval[3] != before:
        interval[3] = None


def _blocks_of(depth: int):
    """The function that sorts the suffixes of one group, site by site and field by field."""

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        of: dict[tuple[str, int], list[tuple[tuple[int, ...], int, int]]] = {}
        for site, f, lines, before, urls in zip(pdf["site"], pdf["f"], pdf["lines"], pdf["before"], pdf["urls"]):
            of.setdefault((site, f), []).append((tuple(lines.tolist()), before, urls))
        got = [(*k, lines, urls) for k, suffixes in of.items() for lines, urls in _sorted_blocks(suffixes, depth)]
        kinds = {"site": object, "f": "int8", "lines": object, "urls": "int64"}
        return pd.DataFrame({c: pd.Series([x[i] for x in got], dtype=t) for i, (c, t) in enumerate(kinds.items())})

    return blocks


def _candidates(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(site, f, lines): maximal blocks that are on enough urls, or seem to be where a url has several runs with one.

    ``rows`` have their runs. Suffixes of different runs are parted by their first line, many first lines to a task; where
    those of one are more than SORTED, it alone is counted by an aggregate, and its suffixes are parted by their first two
    lines, and so on.
    """
    runs = rows.select(*_GROUP, "u", F.explode("runs").alias("run")).distinct().groupBy(*_GROUP, "run").agg(F.count("*").alias("urls"))
    n = F.size("run")
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.slice("run", i, n).alias("lines"), F.when(i > 1, F.get("run", i - 2)).otherwise(0).alias("before")))
    suffixes = staged(runs.select(*_GROUP, "urls", F.explode(tails).alias("t")).groupBy(*_GROUP, "t.lines", "t.before").agg(F.sum("urls").alias("urls")), "suffixes")
    found, depth = None, 1
    while True:
        begun = suffixes.withColumn("first", F.slice("lines", 1, depth))
        sizes = staged(begun.groupBy(*_GROUP, "first").agg(F.count("*").alias("size")), "sizes")
        hot = sizes.filter(F.col("size") > SORTED).select(*_GROUP, "first")
        any_hot = not hot.isEmpty()
        small = begun.join(hot, [*_GROUP, "first"], "left_anti") if any_hot else begun

        total = sizes.filter(F.col("size") <= SORTED).agg(F.sum("size")).first()[0] or 0
        slots = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 2 * total // SORTED)
        small = small.withColumn("slot", F.pmod(F.xxhash64(*_GROUP, "first"), F.lit(slots)))
        part = small.groupBy("slot").applyInPandas(_blocks_of(depth), "site string, f byte, lines array<bigint>, urls long")
        if any_hot:
            big = staged(begun.join(hot, [*_GROUP, "first"], "left_semi"), "long")
            after = F.get("lines", F.lit(depth))
            one = big.groupBy(*_GROUP, F.col("first").alias("lines")).agg(
                F.sum("urls").alias("urls"), F.min("before").alias("b1"), F.max("before").alias("b2"), F.count("*").alias("all"), F.count(after).alias("on"), F.min(after).alias("a1"), F.max(after).alias("a2")
            )
            several = (F.col("b1") != F.col("b2")) | (F.col("b1") == 0)
            part = part.unionByName(one.filter(several & ((F.col("on") < F.col("all")) | (F.col("a1") != F.col("a2")))).select(*_GROUP, "lines", "urls"))
            suffixes = big.filter(F.size("lines") > depth).drop("first")
        found = part if found is None else found.unionByName(part)
        if not any_hot:
            return found.join(needed, "site").filter("urls >= needed").select(*_GROUP, "lines")
        depth += 1


def _prepared(pages: DataFrame, fields: list[str], min_urls: int, min_share: float, key: str, url: str, site: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents as identifiers, the common lines of sites, urls needed, candidates)."""
    rows = staged(line_ids(pages, fields, key, url, site), "lines")
    needed = staged(_needed(pages, url, site, min_urls, min_share), "needed")
    common = staged(_common(rows, needed), "common")
    with_runs = rows.select(*_GROUP, "u", "ids").join(common, _GROUP).select(*_GROUP, "u", _cut("ids", "common").alias("runs"))
    return rows, common, needed, staged(_candidates(with_runs, needed), "blocks")


def maximal_blocks(pages: DataFrame, fields: list[str], min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, key: str = "page_id", url: str = "url", site: str = "site") -> DataFrame:
    """(site, in_field, length, block, pages, places): the maximal blocks of any length that are on many of the site's urls.

    A block is maximal if its places are neither all preceded nor all followed by one same line, so that no longer block
    has all of them. It is on many urls if they are at least ``min_urls`` and ``min_share`` of the site's distinct urls;
    documents that repeat a key each count as pages. Places count wherever the block stands, also within longer ones.
    """
    rows, common, needed, blocks = _prepared(pages, fields, min_urls, min_share, key, url, site)
    lists = blocks.groupBy(*_GROUP).agg(F.collect_list("lines").alias("blocks"))  # bounded like the lines on many urls

    @F.pandas_udf("array<struct<b:int,n:int>>")
    def places(ids: pd.Series, common: pd.Series, blocks: pd.Series) -> pd.Series:
        out = []
        for runs, bs in zip(_cut.func(ids, common), blocks):
            first: dict[int, list[int]] = {}
            for i, b in enumerate(bs):
                first.setdefault(b[0], []).append(i)
            count: dict[int, int] = {}
            for run in runs:
                for at, x in enumerate(run):
                    for i in first.get(x, ()):
                        if run[at : at + len(bs[i])] == list(bs[i]):
                            count[i] = count.get(i, 0) + 1
            out.append([{"b": i, "n": n} for i, n in count.items()])
        return pd.Series(out)

    at = rows.join(common, _GROUP).join(lists, _GROUP).select(*_GROUP, "u", "row", "blocks", F.explode(places("ids", "common", "blocks")).alias("x"))
    at = at.select(*_GROUP, "u", "row", F.get("blocks", F.col("x.b")).alias("lines"), "x.n")
    per = at.select(*_GROUP, "u", "row", F.size("lines").alias("length"), F.xxhash64("lines").alias("block"), "n")
    by = per.groupBy(*_GROUP, "length", "block", "u").agg(F.count("*").alias("pages"), F.sum("n").alias("places")).groupBy(*_GROUP, "length", "block").agg(F.count("*").alias("urls"), F.sum("pages").alias("pages"), F.sum("places").alias("places"))
    name = F.get(F.array(*map(F.lit, fields)), F.col("f"))
    return by.join(needed, "site").filter("urls >= needed").select("site", name.alias("in_field"), "length", "block", "pages", "places")


def repeated_lines(pages: DataFrame, fields: list[str], min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, key: str = "page_id", url: str = "url", site: str = "site") -> DataFrame:
    """(key, in_field, line_no) of every line of a maximal block, wherever it stands: each is itself a block of one line on as many urls."""
    rows, _, _, blocks = _prepared(pages, fields, min_urls, min_share, key, url, site)
    cut = staged(blocks.select(*_GROUP, F.explode("lines").alias("id")).distinct(), "cut")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_LINES else cut
    name = F.get(F.array(*map(F.lit, fields)), F.col("f"))
    lines = rows.select(*_GROUP, "key", F.posexplode("ids").alias("line_no", "id")).filter("id <> 0")
    return lines.join(cut, [*_GROUP, "id"], "left_semi").select(F.col("key").alias(key), name.alias("in_field"), "line_no")


def without_lines(pages: DataFrame, lines: DataFrame, fields: list[str], key: str = "page_id") -> DataFrame:
    """``pages`` with the given lines cut from their fields. Null stays null; a text all of whose lines go becomes empty.

    Of rows that repeat a key, each loses the lines named for that key.
    """
    gone = lines.groupBy(key).agg(*[F.collect_set(F.when(F.col("in_field") == f, F.col("line_no"))).alias(f"_{i}") for i, f in enumerate(fields)])
    out = pages.join(gone, key, "left")
    for i, f in enumerate(fields):
        left = F.array_join(F.filter(F.split(F.col(f), "\n", -1), lambda x, n: ~F.array_contains(F.coalesce(F.col(f"_{i}"), F.array().cast("array<int>")), n)), "\n")
        out = out.withColumn(f, left)
    return out.drop(*[f"_{i}" for i in range(len(fields))])
