"""Rules of fetching as dataflow: robots files, turns of a host, sitemaps of sitemaps, public addresses, conditional requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmill.functions import urls
from weftmill.shared import staged

SITEMAPS = ("/sitemap_index.xml", "/sitemap.xml", "/wp-sitemap.xml")


def robots_rules(robots: DataFrame, agent: str, host: str = "host", text: str = "text") -> DataFrame:
    """(host, n, allow, path): rules of robots files that hold for ``agent``, in order; those for all agents where none names it.

    A file's lines are folded in order: agents named one after another share the rules below them. Files are short.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    parts = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    d = robots.select(F.col(host).alias("host"), F.posexplode(parts).alias("n", "p")).filter("p.k in ('user-agent', 'allow', 'disallow')").select("host", "n", "p.k", "p.v")
    w = Window.partitionBy("host").orderBy("n")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    d = d.withColumn("group", F.sum(starts.cast("int")).over(w))
    name = F.regexp_replace(F.lower(F.lit(agent)), "/.*$", "")
    of = d.filter("k = 'user-agent'").select("host", "group", F.lower("v").alias("a")).withColumn("rank", F.when((F.col("a") != "*") & (F.col("a") != "") & F.contains(name, F.col("a")), 0).when(F.col("a") == "*", 1)).filter("rank is not null")
    best = of.groupBy("host").agg(F.min("rank").alias("rank"))
    groups = of.join(best, ["host", "rank"]).select("host", "group").distinct()
    rules = d.filter("k <> 'user-agent'").join(groups, ["host", "group"])
    # an empty "disallow" allows all
    return rules.select("host", "n", ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"), F.when((F.col("k") == "disallow") & (F.col("v") == ""), "/").otherwise(F.col("v")).alias("path")).filter("path <> ''")


def allowed_by_robots(pages: DataFrame, rules: DataFrame, url: str = "url", ignored: Sequence[str] = ()) -> DataFrame:
    """``pages`` with ``allowed``: by the first rule of its host whose path the url's begins with; allowed where there is none.

    Rules of a host become one array, so that a host with a third of all urls is a join key of a broadcast or a skewed join,
    never a group. Hosts of ``ignored`` are allowed.
    """
    per = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "allow", "path"))).alias("_rules")).withColumnRenamed("host", "_h")
    d = pages.withColumn("_h", urls.host(F.col(url))).withColumn("_p", F.when(urls.path(F.col(url)) == "", "/").otherwise(urls.path(F.col(url))))
    d = d.join(per, "_h", "left")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_p"), r["path"])), F.lit(0))["allow"]
    return d.withColumn("allowed", F.col("_h").isin(*ignored) | F.coalesce(first, F.lit(True)) if ignored else F.coalesce(first, F.lit(True))).drop("_h", "_p", "_rules")


def turns(requests: DataFrame, delay_us: int, host: str = "host", us: str = "us", order: str = "id", *more: str) -> DataFrame:
    """``requests`` with ``start``: when each may begin so that those of a host (and ``more``) begin at least ``delay_us`` apart, in order.

    The n-th begins at n delays after the latest of (its time less its own number of delays) so far, a running maximum, so
    nothing is walked row by row.
    """
    w = Window.partitionBy(host, *more).orderBy(us, order)
    d = requests.withColumn("_n", F.row_number().over(w).cast("long") * delay_us)  # an int holds 8,589 delays of 250 ms
    running = F.max(F.col(us) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("start", running + F.col("_n")).drop("_n")


def sitemap_entries(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, kind, loc, lastmod): entries of sitemap files, kind being sitemap or page. Files without marks have none."""
    tags = F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<(?:\w+:)?(?:url|sitemap)>.*?</(?:\w+:)?(?:url|sitemap)>)"), F.lit(1))
    e = files.filter(F.substring(body, 1, 200).contains("<")).select(url, F.explode(tags).alias("e"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1)), F.lit(""))
    kind = F.when(F.col("e").rlike(r"^<(?:\w+:)?sitemap>"), "sitemap").otherwise("page")
    return e.select(F.col(url).alias("url"), kind.alias("kind"), F.replace(value("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), value("lastmod").alias("lastmod")).filter("loc is not null")


def sitemap_seeds(sites: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = 3, site: str = "site") -> DataFrame:
    """(url, remote_modified) of all pages that sitemaps of ``sites`` name, through sitemaps of sitemaps up to ``depth`` steps.

    ``fetch`` gives (url, body) of what could be read of given urls; each url is read once. A page listed several times has
    its latest date.
    """
    root = F.regexp_extract(site, r"^([A-Za-z]+://[^/?#]+)", 1)
    edge = staged(sites.select(F.explode(F.array(*[F.concat(root, F.lit(p)) for p in SITEMAPS])).alias("url")).distinct(), "sitemaps")
    seen, pages = edge, None
    for _ in range(depth + 1):
        entries = staged(sitemap_entries(fetch(edge)), "entries")
        found = entries.filter("kind = 'page'").select(urls.normal_absolute(F.col("loc")).alias("url"), F.col("lastmod").alias("remote_modified")).filter("url is not null")
        pages = found if pages is None else pages.unionByName(found)
        edge = staged(entries.filter("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemaps")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return pages.groupBy("url").agg(F.max("remote_modified").alias("remote_modified"))


#: Networks that are not public: private, loopback, link-local, multicast, reserved.
PRIVATE_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
PRIVATE_V6 = r"(?i)^(::1?$|f[cd]|fe[89ab]|ff|2001:db8|100::|::ffff:(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168)\.)"


def public_address(ip: Column) -> Column:
    """Whether an address may be fetched from; false for null, unreadable and private ones."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.try_cast("bigint"))
    bad = F.lit(False)
    for base, bits in PRIVATE_V4:
        a = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        bad = bad | number.between(a, a + (1 << (32 - bits)) - 1)
    v4 = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    v6 = ip.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")
    return F.coalesce(F.when(v4, ~bad).when(v6, ~ip.rlike(PRIVATE_V6)), F.lit(False))


def safe_hosts(resolved: DataFrame, host: str = "host", ip: str = "ip") -> DataFrame:
    """(host, public): hosts all of whose addresses are public."""
    return resolved.groupBy(host).agg(F.min(public_address(F.col(ip))).alias("public"))


def request_headers(etag: Column, last_modified: Column) -> Column:
    """Headers of a conditional request: a map without those that have no value."""
    pairs = F.filter(F.array(F.struct(F.lit("If-None-Match").alias("k"), F.nullif(F.trim(etag), F.lit("")).alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), F.nullif(F.trim(last_modified), F.lit("")).alias("v"))), lambda x: x["v"].isNotNull())
    return F.map_from_entries(pairs)
