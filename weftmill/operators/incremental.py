"""Only new or changed records: a Merkle tree over key ranges, published together with each run's output.

A store keeps the last known record of every key, cut into key ranges by the key's hash, with a digest beside each record
and a tree of digests over the leaves that the hash cuts the keys into. A run's records are digested the same way. From the
root down, only children of nodes that differ are looked at; under differing leaves the digests of the run's own keys
are compared with those saved, so that keys a run lacks make no difference; and only where one of them differs is a range
opened, its rows compared exactly, and it alone written anew with its part of the tree. Rows, tree and the run's output
become visible by one rename of a small commit file. A run that breaks off earlier has published nothing, so that the next
one starts from the same state: no record is skipped or given twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.functions.dates import etag_value, instant_micros
from weftmill.shared import new_path, staged

#: Bits of a node's branches; keys of a leaf and of a range, roughly, to which the numbers of both grow with the keys; bits
#: of leaves and ranges at least and at most. What comes to the driver is bounded by the number of ranges.
NODE_BITS, LEAF_KEYS, RANGE_KEYS = 4, 64, 4_000_000
LEAF_BITS, RANGE_BITS = (12, 28), (3, 12)

_FIELDS = ["etag", "last_modified", "remote_modified"]


def same_record(a: Callable[[str], Column], b: Callable[[str], Column], fields: list[str]) -> Column:
    """Whether two records are the same by the first field that both have; false where there is none."""
    out = F.lit(False)
    for f in reversed(fields):
        out = F.when(a(f).isNotNull() & b(f).isNotNull(), a(f) == b(f)).otherwise(out)
    return out


def _bits(keys: int, each: int, bounds: tuple[int, int]) -> int:
    return min(bounds[1], max(bounds[0], (max(1, keys) // each).bit_length()))


class MerkleStore:
    """The last record of every key, at ``path`` in the shared folder.

    ``key`` is the record's key (not null), ``fields`` what its change is told by, in order of precedence. A record
    without any of them counts as changed whenever it appears. Of repeated keys in one run, one must have been chosen
    before. An empty run changes nothing, but is committed. The state is cut into ranges of about ``range_keys`` keys, a
    folder and a task each; once it has four times as many, the run that finds it so writes all of it in more ranges.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "url", fields: list[str] = _FIELDS, range_keys: int = RANGE_KEYS):
        self.spark, self.path, self.key, self.fields, self.range_keys = spark, path.rstrip("/"), key, list(fields), range_keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def commits(self) -> list[dict]:
        """All published commits, oldest first."""
        names = sorted(str(x.getPath().getName()) for x in self._fs.listStatus(self._path(self.path)) if x.getPath().getName().startswith("commit-"))
        return [json.loads(self._read(n)) for n in names]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, commit: dict) -> None:
        """One rename makes output, rows and tree visible; it fails if another run has published the same number."""
        name = f"{self.path}/commit-{commit['seq']:09d}.json"
        tmp = f"{self.path}/.pending-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(tmp))
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if not self._fs.rename(self._path(tmp), self._path(name)):
            raise RuntimeError(f"{name} has been published by another run")

    def _schema(self, records: DataFrame) -> str:
        types = dict(records.dtypes)
        return ", ".join(f"`{c}` {types[c]}" for c in [self.key, *self.fields]) + ", h bigint, h2 bigint, d bigint, d2 bigint, open boolean, changed boolean"

    def _digested(self, records: DataFrame) -> DataFrame:
        """Records with two hashes of their key, two digests of all of them, and whether there is nothing to compare."""
        none = F.coalesce(*[F.col(f).cast("string") for f in self.fields]).isNull()
        cols = [self.key, *[x for f in self.fields for x in (F.col(f).isNull(), F.col(f))]]  # the hash skips nulls
        two = F.lit("second")
        rows = records.select(self.key, *self.fields).filter(F.col(self.key).isNotNull())
        return rows.select("*", F.xxhash64(self.key).alias("h"), F.xxhash64(two, self.key).alias("h2"), F.xxhash64(*cols).alias("d"), F.xxhash64(two, *cols).alias("d2"), none.alias("open"))

    @staticmethod
    def _at(bits: int) -> Column:
        """Leaf or range of a key."""
        return F.shiftrightunsigned("h", 64 - bits).cast("int")

    def _leaves(self, rows: DataFrame, bits: int) -> DataFrame:
        """A row for each leaf. Partly aggregated before the shuffle."""
        return rows.groupBy(self._at(bits).alias("node")).agg(F.bit_xor("d").alias("d"), F.bit_xor("d2").alias("d2"), F.count("*").alias("n"), F.max("open").alias("open"))

    @staticmethod
    def _levels(leaves: DataFrame, bits: int) -> DataFrame:
        """The tree: a row for each node of each level; a leaf's level is the number of its bits."""
        steps = [*range(0, bits, NODE_BITS), bits]
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("node", bits - k).alias("node")) for k in steps]))
        return leaves.select("d", "d2", "n", "open", at.alias("at")).groupBy(F.col("at.level").alias("level"), F.col("at.node").alias("node")).agg(F.bit_xor("d").alias("d"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"), F.max("open").alias("open"))

    @staticmethod
    def _differing(now: DataFrame, saved: DataFrame, bits: int) -> DataFrame:
        """(leaf) whose digests differ, found from the root down: each step joins the children of differing nodes only."""
        same = F.col("a.d").eqNullSafe(F.col("b.d")) & F.col("a.d2").eqNullSafe(F.col("b.d2")) & F.col("a.n").eqNullSafe(F.col("b.n")) & ~F.coalesce(F.col("a.open"), F.lit(False))
        opened, above = None, 0
        for level in [*range(0, bits, NODE_BITS), bits]:
            a, b = (x.filter(F.col("level") == level) for x in (now, saved))
            if opened is not None:
                parent = F.shiftright("node", level - above).alias("parent")
                a = a.select("*", parent).join(opened.select(F.col("node").alias("parent")), "parent", "left_semi")
            opened, above = a.alias("a").join(b.alias("b"), "node", "left").filter(~same).select("node"), level
        return opened.select(F.col("node").alias("leaf"))

    def process(self, records: DataFrame, run: object) -> DataFrame:
        """The records of ``run`` that are new or changed since the last published run; publishes them and the state.

        ``records`` has the key and the fields. A run that has been published is not processed again.
        """
        done = self.commits()
        for c in done:
            if c["run"] == run:
                return self.output(run)
        last = done[-1] if done else None
        schema, tag = self._schema(records), uuid.uuid4().hex
        cur = staged(self._digested(records), "run")
        keys = last["keys"] if last and last["keys"] else cur.count()
        fresh = not (last and last["tree"])
        bits, cut = (_bits(keys, LEAF_KEYS, LEAF_BITS), _bits(keys, self.range_keys, RANGE_BITS)) if fresh else (last["leaf_bits"], last["range_bits"])
        tree_schema = "level int, node int, d bigint, d2 bigint, n bigint, open boolean"
        tree = self.spark.createDataFrame([], tree_schema) if fresh else self.spark.read.schema(tree_schema).parquet(f"{self.path}/{last['tree']}")
        parts = dict(last["parts"]) if last else {}
        if fresh:
            moved = cur
        else:
            leaves = staged(self._differing(self._levels(self._leaves(cur, bits), bits), tree, bits), "leaves")
            here = cur.withColumn("leaf", self._at(bits)).join(leaves, "leaf", "left_semi")
            # of the state, only digests are read here, and only of ranges that have a differing leaf
            ranges = [r.r for r in leaves.select(F.shiftright("leaf", bits - cut).alias("r")).distinct().collect()]
            was = self._rows(parts, ranges, schema).select("h", "h2", F.col("d").alias("e"), F.col("d2").alias("e2"))
            same = (F.col("d") == F.col("e")) & (F.col("d2") == F.col("e2")) & ~F.col("open")
            moved = staged(here.join(was, ["h", "h2"], "left").filter(~F.coalesce(same, F.lit(False))).select(*cur.columns), "moved")
        touched = [r.r for r in moved.select(self._at(cut).alias("r")).distinct().collect()]
        if touched and not fresh and _bits(keys, self.range_keys, RANGE_BITS) >= cut + 2:
            bits, cut, touched, old = _bits(keys, LEAF_KEYS, LEAF_BITS), _bits(keys, self.range_keys, RANGE_BITS), None, self._rows(parts, sorted(map(int, parts)), schema)
        else:
            old = self._rows(parts, touched, schema)
        rows_at, tree_at = f"rows-{tag}", f"tree-{tag}"
        if touched or touched is None:
            a, b = moved.alias("a"), old.alias("b")
            is_in = F.col(f"a.{self.key}").isNotNull()
            value = lambda c: F.when(is_in, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
            changed = is_in & ~(F.col(f"b.{self.key}").isNotNull() & same_record(lambda f: F.col(f"a.{f}"), lambda f: F.col(f"b.{f}"), self.fields))
            columns = [self.key, *self.fields, "h", "h2", "d", "d2", "open"]
            rows = a.join(b, F.col(f"a.{self.key}") == F.col(f"b.{self.key}"), "full_outer").select(*map(value, columns), changed.alias("changed"))
            rows.withColumn("rng", self._at(cut)).repartition("rng").write.partitionBy("rng").parquet(f"{self.path}/{rows_at}")
            if touched is None:
                parts, touched = {}, self._folders(rows_at)
                fresh = True
            parts |= {str(r): rows_at for r in touched}
            anew = self._leaves(self._rows(parts, touched, schema), bits)
            kept = tree.filter((F.col("level") == bits) & ~F.shiftright("node", bits - cut).isin(touched)).select("node", "d", "d2", "n", "open")
            self._levels(anew if fresh else anew.unionByName(kept), bits).coalesce(max(1, 1 << max(0, bits - 20))).write.parquet(f"{self.path}/{tree_at}")
            keys = self.spark.read.schema(tree_schema).parquet(f"{self.path}/{tree_at}").filter("level = 0").agg(F.sum("n")).first()[0] or 0
        state = {"rows": rows_at, "tree": tree_at} if touched else {"rows": None, "tree": last and last["tree"]}
        self._publish({"seq": len(done) + 1, "run": run, **state, "parts": parts, "touched": touched, "schema": schema, "keys": keys, "leaf_bits": bits, "range_bits": cut})
        return self.output(run)

    def _folders(self, rows: str) -> list[int]:
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in self._fs.listStatus(self._path(f"{self.path}/{rows}")) if x.getPath().getName().startswith("rng="))

    def _rows(self, parts: dict, ranges: list[int], schema: str) -> DataFrame:
        """Rows of the given ranges; each range lies in the folder of the run that last changed it."""
        paths = [f"{self.path}/{parts[str(r)]}/rng={r}" for r in ranges if str(r) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders that neither the state nor the outputs of the last ``keep`` runs need; gives their names.

        Folders of runs that broke off go too. The output of an earlier run can't be read any more.
        """
        done = self.commits()
        if not done:
            return []
        used = {*done[-1]["parts"].values(), *(c[k] for c in done[-keep:] for k in ("rows", "tree"))}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        gone = sorted(n for n in names if n.startswith(("rows-", "tree-", ".pending-")) and n not in used)
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return gone

    def output(self, run: object) -> DataFrame:
        """What the published ``run`` had to process: keys and fields."""
        c = next(c for c in self.commits() if c["run"] == run)
        df = self._rows(dict.fromkeys(map(str, c["touched"]), c["rows"]), c["touched"], c["schema"])
        return df.filter("changed").select(self.key, *self.fields)


def crawl_records(fetches: DataFrame, seeds: DataFrame, runs: list) -> DataFrame:
    """One record for each run and url: (run_id, url, etag, last_modified, remote_modified), in comparable form.

    The last good fetch of the url in the run, by time, then id, with the date of its last listing in that run. A fetch
    made after its run ended belongs to the first run that starts at or after it. Rows without url or run are left out;
    ties are broken by id. ``runs`` are the rows of the run log, one for each crawl.
    """
    spark = fetches.sparkSession
    log = sorted((r.started_at, r.run_id) for r in runs if r.started_at is not None)
    known = spark.createDataFrame([(r.run_id, r.finished_at) for r in runs], "run_id long, finished_at timestamp_ntz")
    starts = F.array(*[F.struct(F.lit(t).cast("timestamp_ntz").alias("at"), F.lit(i).cast("long").alias("id")) for t, i in log]) if log else F.array().cast("array<struct<at:timestamp_ntz,id:bigint>>")
    f = fetches.filter("error is null and status in (200, 304) and url is not null").select("fetch_id", "run_id", "url", "etag", "last_modified", F.col("fetched_at").cast("timestamp_ntz").alias("at"))
    f = f.join(F.broadcast(known), "run_id", "left")
    later = F.filter(starts, lambda s: s["at"] >= F.col("at"))
    run = F.when(F.col("at") > F.col("finished_at"), F.get(later, F.lit(0))["id"]).otherwise(F.col("run_id"))
    f = f.select(run.alias("run_id"), "url", F.struct(F.col("at"), "fetch_id", etag_value(F.col("etag")).alias("etag"), instant_micros(F.col("last_modified")).alias("last_modified")).alias("v"), F.lit(True).alias("fetched")).filter("run_id is not null")
    s = seeds.filter("url is not null and run_id is not null").select("run_id", "url", F.struct(F.col("listed_at").cast("timestamp_ntz").alias("at"), "seed_id", instant_micros(F.col("remote_modified")).alias("remote_modified")).alias("s"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = f.select("run_id", "url", "v", none(s, "s").alias("s")).unionByName(s.select("run_id", "url", none(f, "v").alias("v"), "s"))
    best = both.groupBy("run_id", "url").agg(F.max("v").alias("v"), F.max("s").alias("s")).filter("v is not null")
    return best.select("run_id", "url", "v.etag", "v.last_modified", "s.remote_modified")


def changed_by_run(spark: SparkSession, fetches: DataFrame, seeds: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(run_id, url) that each completed run must process, by a ``MerkleStore`` fed run after run as in production.

    The run log has a row for each crawl; it alone comes to the driver. Runs that are not completed change nothing.
    """
    log = runs.select("run_id", "status", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("finished_at").cast("timestamp_ntz").alias("finished_at")).filter("run_id is not null").collect()
    completed = sorted((r.started_at, r.run_id) for r in log if r.status == "completed" and r.started_at is not None)
    at = new_path(spark, "records")
    crawl_records(fetches, seeds, log).filter(F.col("run_id").isin([i for _, i in completed])).write.partitionBy("run_id").parquet(at)
    records = spark.read.schema("url string, etag string, last_modified long, remote_modified long, run_id long").parquet(at)
    store = MerkleStore(spark, path or new_path(spark, "merkle"))
    out = [store.process(records.filter(F.col("run_id") == run), run).select(F.lit(run).cast("long").alias("run_id"), "url") for _, run in completed]
    found = out[0] if out else spark.createDataFrame([], "run_id long, url string")
    for x in out[1:]:
        found = found.unionByName(x)
    return found
