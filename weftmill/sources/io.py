"""Readers and writers: files by their bytes, sitemaps, paged listings, JSON lines, snapshots, vector stores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from weftmill.functions.text import sniffed
from weftmill.operators.crawl import merged
from weftmill.shared import staged


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content, kind): files of a folder, with the kind their first bytes tell, which beats their name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content", sniffed(F.col("content")).alias("kind"))


def decode(data: bytes | None) -> str | None:
    """Text of a plain file: UTF-8, else UTF-16, else Windows-1252, else UTF-8 without what is broken."""
    if data is None:
        return None
    for code in ("utf-8", "utf-16", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


@F.pandas_udf(StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(decode)


def valid_upload(name, content, most_bytes: int = 20_000_000):
    """Why an upload is refused, as a column; null if it is not. The bytes must match the extension; plain text holds no zero byte."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = sniffed(content)
    want = F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin("jpg", "jpeg", "png"), "image").when(ext == "txt", "txt")
    zero = F.hex(F.substring(content, 1, 4096)).rlike("^(..)*00")
    return F.when(want.isNull(), "extension").when(F.length(content) > most_bytes, "size").when((want == "txt") & (kind.isNotNull() | zero), "content").when((want != "txt") & ~F.coalesce(kind == want, F.lit(False)), "content")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod): entries of sitemap files; an index is a sitemap of sitemaps."""
    raw = spark.read.option("wholetext", "true").text(path)
    entries = F.regexp_extract_all("value", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    e = raw.select(F.explode(entries).alias("e"))
    clean = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)), F.lit(""))
    return e.select(F.replace(clean("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), clean("lastmod").alias("lastmod")).filter("loc is not null").distinct()


def pages(spark: SparkSession, fetch: Callable[[int], list[dict]], schema: str, most: int = 100) -> DataFrame:
    """Rows of a paged listing, page by page until one gives none, ``most`` pages at most. ``fetch`` is an adapter.

    Pages are asked for in runs that double, 1, 2, 4 ..., each run's by its own tasks; a run that ends short is the last.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in b["id"]:
                rows = fetch(int(n))
                if rows:
                    yield pd.DataFrame(rows).assign(_page=int(n))

    out, first, size = None, 1, 1
    while first <= most:
        last = min(most, first + size - 1)
        got = staged(spark.range(first, last + 1, 1, min(last - first + 1, 16)).mapInPandas(read, f"{schema}, _page long"), "listing")
        full = got.select("_page").distinct().count() == last - first + 1
        rows = got.drop("_page")
        out = rows if out is None else out.unionByName(rows)
        if not full:
            break
        first, size = last + 1, size * 2
    return out if out is not None else spark.createDataFrame([], schema)


def fetched(urls: DataFrame, fetch: Callable[[str], dict], schema: str, per_host: int = 1) -> DataFrame:
    """``fetch`` of each url, the requests of a host in ``per_host`` tasks at most, so a politeness delay can be kept. An error of one url is its row's."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    tasks = urls.select("url").repartition(host, F.pmod(F.xxhash64("url"), F.lit(per_host)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    rows.append({"url": u, **fetch(u)})
                except Exception as e:
                    rows.append({"url": u, "error": f"{type(e).__name__}: {e}"[:2000]})
            if rows:
                yield pd.DataFrame(rows).reindex(columns=[x.strip().split()[0] for x in schema.split(",")])

    return tasks.mapInPandas(read, schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are passed over, broken ones become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


class VectorStore:
    """Chunks with their vectors as a Parquet table cut into parts by their source's hash; a change writes only the parts it touches.

    A commit file names the folder of every part; it becomes visible by one rename, so that readers see all of a change or none.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", source: str = "source_id", parts: int = 64):
        self.spark, self.path, self.key, self.source, self.parts = spark, path.rstrip("/"), key, source, parts
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(self.path))

    def _state(self) -> dict:
        """The last commit: its number, the schema, and of each part its folder."""
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._p(self.path)) if x.getPath().getName().startswith("commit-"))
        if not names:
            return {"seq": 0, "schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}").first()[0])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.source)), F.lit(self.parts)).cast("int")

    def _read(self, state: dict, parts: list[int] | None = None) -> DataFrame | None:
        if state["schema"] is None:
            return None
        at = [f"{self.path}/{f}/part={n}" for n, f in state["folders"].items() if parts is None or int(n) in parts]
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _replace(self, state: dict, parts: list[int], rows: DataFrame) -> DataFrame:
        """Writes the given parts anew and publishes them."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        there = {x.getPath().getName().partition("=")[2] for x in self._fs.listStatus(self._p(f"{self.path}/{folder}")) if x.getPath().getName().startswith("part=")}
        folders = {n: f for n, f in state["folders"].items() if int(n) not in parts} | dict.fromkeys(sorted(there), folder)
        new = {"seq": state["seq"] + 1, "schema": state["schema"] or json.loads(rows.schema.json()), "folders": folders}
        tmp, name = f"{self.path}/.pending-{uuid.uuid4().hex}", f"{self.path}/commit-{new['seq']:09d}.json"
        out = self._fs.create(self._p(tmp))
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not self._fs.rename(self._p(tmp), self._p(name)):
            raise RuntimeError(f"{name} has been published by another writer")
        return self._read(new)

    def all(self) -> DataFrame | None:
        return self._read(self._state())

    def add(self, rows: DataFrame) -> DataFrame:
        """Rows added; those of a known key replaced, also where it has moved to another source."""
        state = self._state()
        if state["schema"] is None:
            return self._replace(state, list(range(self.parts)), rows)
        keys = rows.select(self.key).distinct()
        moved = self.all().select(self.key, self.source).join(keys, self.key, "left_semi").select(self._part().alias("n"))
        touched = sorted(r.n for r in rows.select(self._part().alias("n")).unionByName(moved).distinct().collect())  # at most as many as there are parts
        return self._replace(state, touched, merged(rows, self._read(state, touched), self.key))

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; missing ones are passed over."""
        return self.all().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def delete_source(self, sources: DataFrame, source: str | None = None) -> DataFrame:
        """All rows without those of the given sources; only the sources' parts are read and written."""
        state, name = self._state(), source or self.source
        gone = sources.select(F.col(name).alias(self.source)).distinct()
        touched = sorted(r.n for r in gone.select(self._part().alias("n")).distinct().collect())
        return self._replace(state, touched, self._read(state, touched).join(gone, self.source, "left_anti"))

    def count(self) -> int:
        rows = self.all()
        return rows.count() if rows is not None else 0
