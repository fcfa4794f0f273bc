"""The crawl as dataflow: plans, change detection, frontier, removals, stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmill.functions import urls
from weftmill.shared import staged


def changes(incoming: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): new, updated, unchanged or missing, by null-safe comparison of ``columns``.

    Keys are unique in either side. One full outer join on the key; only keys and a digest of the columns are shuffled.
    """
    digest = lambda df, name: df.select(key, F.sha2(F.concat_ws("\x1f", *[x for c in columns for x in (F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))]), 256).alias(name))
    both = digest(incoming, "a").join(digest(stored, "b"), key, "full_outer")
    return both.select(key, F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated").alias("change"))


def merged(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``stored`` with rows of ``incoming`` in place of those of the same key, and new ones added; columns by name."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replaced_by_source(chunks: DataFrame, fresh: DataFrame, source: str = "source_id") -> DataFrame:
    """``chunks`` with all rows of each source in ``fresh`` replaced by its new rows."""
    return merged(fresh, chunks, source)


def chunk_counts(sources: DataFrame, chunks: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, n): chunks of each source, 0 for those without."""
    n = chunks.groupBy(source).agg(F.count("*").alias("n"))
    return sources.select(source).join(n, source, "left").select(source, F.coalesce("n", F.lit(0)).alias("n"))


def fetch_plan(candidates: DataFrame, stored: DataFrame, allowed: Sequence[str] | DataFrame, blocked: Sequence[str], key: str = "url") -> DataFrame:
    """(url, action): skip what is unclassified, barred, blocked or unchanged by its remote date; conditional for known files; else fetch.

    ``allowed`` is a list, or a table (site) of any number of sites, repeated or not, which is joined by host.
    """
    known = stored.select(key, F.col("remote_modified").alias("_rm"), F.col("status").alias("_st"), F.lit(True).alias("_known"))
    kind = urls.kind(F.col(key))
    if isinstance(allowed, DataFrame):
        names = allowed.filter("site is not null").select(F.explode(F.array("site", F.concat(F.lit("www."), "site"))).alias("_host")).distinct().withColumn("_listed", F.lit(True))
        candidates = candidates.withColumn("_host", urls.host(F.col(key))).join(names, "_host", "left")
        ok = F.coalesce(F.col("_listed") & ~urls.domain_blocked(F.col(key), blocked), F.lit(False))
    else:
        ok = urls.domain_allowed(F.col(key), allowed, blocked)
    action = (
        F.when(kind.isNull(), "skip_kind")
        .when(~ok, "skip_domain")
        .when(F.col("_st") == "blocked", "skip_blocked")
        .when(F.col("_known") & F.col("remote_modified").isNotNull() & (F.col("remote_modified") == F.col("_rm")), "skip_unchanged")
        .when(F.coalesce("_known", F.lit(False)) & (kind != "html"), "conditional")
        .otherwise("fetch")
    )
    return candidates.join(known, key, "left").select(key, action.alias("action"))


def frontier(seeds: DataFrame, links: Callable[[DataFrame], DataFrame], depth: int, accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, depth): what is reached from ``seeds`` (url) within ``depth`` steps, each url at its least depth.

    ``links`` gives (url) found on the pages of a frontier. One step is one anti-join with what was seen; each step is
    staged, so the plan does not grow and lost executors cost one step.
    """
    ok = accept or (lambda u: F.lit(True))
    seen = staged(seeds.filter("url is not null").select("url").distinct().filter(ok(F.col("url"))).withColumn("depth", F.lit(0)), "frontier")
    edge = seen
    for d in range(1, depth + 1):
        edge = staged(links(edge).filter("url is not null").select("url").distinct().filter(ok(F.col("url"))).join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def removal_candidates(sources: DataFrame, run: int) -> DataFrame:
    """Website sources not seen in ``run`` (or ever), neither blocked nor our own; to be asked for again before deletion."""
    return sources.filter((F.col("source_type") == "website") & (F.col("last_seen_run_id").isNull() | (F.col("last_seen_run_id") != run)) & ~F.col("url").startswith("site://") & ~F.coalesce(F.col("index_status") == "blocked", F.lit(False)))


def status_after(action: Column, status: Column) -> Column:
    """State of a source after an action on it."""
    return (
        F.when(action == "block", "blocked").when((action == "unblock") & (status == "blocked"), "pending").when((action == "changed") & (status != "blocked"), "pending")
        .when((action == "indexed") & (status == "pending"), "indexed").when((action == "gone") & (status != "blocked"), "deleted").otherwise(status)
    )


def current_state(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The latest row of each key of an append-only log."""
    return log.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("x")).select(key, "x.*")


def outcome(status: Column, not_modified: Column, error: Column) -> Column:
    """What a fetch means for its source: touch, delete, error, store."""
    return F.when(F.coalesce(not_modified, F.lit(False)) | (status == 304), "touch").when(status.isin(404, 410), "delete").when(error.isNotNull() | (status >= 400) | (status == 0), "error").otherwise("store")


def page_context(documents: DataFrame, pages: DataFrame, links: str = "links") -> DataFrame:
    """(url, section): what the first page that links to a document says of itself, "Section › Title"; "" where none links to it.

    ``pages`` have page_id, section, title and links (url, text); the first is the one of the least id. Only links to
    documents are shuffled further, and each url's page is found by a partly aggregated minimum.
    """
    said = F.concat_ws(" › ", F.nullif(F.trim("section"), F.lit("")), F.nullif(F.trim("title"), F.lit("")))
    named = pages.select("page_id", said.alias("said"), F.explode(F.col(links)["url"]).alias("url")).filter("url is not null")
    first = named.join(documents.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min(F.struct("page_id", "said")).alias("x"))
    return documents.select("url").distinct().join(first, "url", "left").select("url", F.coalesce("x.said", F.lit("")).alias("section"))


def cached(requests: DataFrame, cache: DataFrame, key: list[str], value: str) -> DataFrame:
    """``requests`` with ``value`` from the cache, null where it has none: what is left to be computed, each different request once.

    Of repeated keys in the cache the greatest value counts.
    """
    known = cache.groupBy(*key).agg(F.max(value).alias(value))
    return requests.select(*key).distinct().join(known, key, "left")


def outcomes_after_redirect(fetches: DataFrame, allowed: DataFrame, asked: str = "url", final: str = "final_url") -> DataFrame:
    """``fetches`` with ``off_domain``: whether a redirect has led to a host that is not in ``allowed`` (host)."""
    hosts = allowed.select(F.col("host").alias("_h"), F.lit(True).alias("_ok")).distinct()
    d = fetches.withColumn("_h", urls.host(F.coalesce(final, asked))).join(hosts, "_h", "left")
    return d.withColumn("off_domain", ~F.coalesce("_ok", F.lit(False))).drop("_h", "_ok")
