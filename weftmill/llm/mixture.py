"""A mixture of sources to target weights, by hierarchical budgeting and seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmill.llm.tokens import TOKENIZERS, token_count
from weftmill.shared import staged

#: Seeded order of the records of a source is cut into 2**SLICE_BITS slices, so that no task holds a whole source.
SLICE_BITS = 12


def budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Budget of each leaf: ``total`` shared by weight down the tree of ``path``, shortages made up by siblings first.

    A leaf has ``name``, ``path`` (its ancestors from the root), ``weight`` and ``capacity``. What a leaf cannot take
    goes to its siblings by weight; only what none of a node's leaves can take goes up to the node's siblings.
    """

    def fill(group: list[dict], depth: int, amount: float) -> dict[str, float]:
        kids: dict[str, list[dict]] = {}
        for x in group:
            kids.setdefault(x["path"][depth] if depth < len(x["path"]) else x["name"], []).append(x)
        room = {k: sum(x["capacity"] for x in v) for k, v in kids.items()}
        weight = {k: sum(x["weight"] for x in v) for k, v in kids.items()}
        give, open_, left = dict.fromkeys(kids, 0.0), [k for k in kids if weight[k] > 0 and room[k] > 0], amount
        while open_ and left > 1e-9:
            part = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
            full = [k for k in open_ if part[k] >= room[k] - give[k]]
            if not full:
                for k in open_:
                    give[k] += part[k]
                break
            for k in full:
                left -= room[k] - give[k]
                give[k] = room[k]
            open_ = [k for k in open_ if k not in full]
        out: dict[str, float] = {}
        for k, v in kids.items():
            if len(v) == 1 and depth >= len(v[0]["path"]):
                out[v[0]["name"]] = give[k]
            else:
                out |= fill(v, depth + 1, give[k])
        return out

    return fill(leaves, 0, total) if leaves else {}


def _order(key: str, seed: int, epoch: Column) -> Column:
    """Each epoch over a source has an order of its own."""
    return F.xxhash64(F.lit(seed), epoch, F.col(key))


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, domains: dict[str, str] | None = None, seed: int = 17, tokenizers: str = TOKENIZERS, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the mixture: doc_id, source, repeats, tokens of one copy; the report: source, target and actual shares).

    ``total`` is the size wanted, in tokens; by default the largest at which every source that has any text meets its
    share within its ``max_repeats``. Sources without text leave their share to siblings in the tree domain, language,
    source (``domains`` names the domain of a source, the language is the one with most of its tokens), then further
    up. A source's budget is taken as whole epochs over its records, then as a prefix of the next epoch's seeded order:
    the records up to the one that comes nearest to what is left, so a source misses its budget by at most half a record. Sources not listed, null sources and texts without tokens have no part; ties of the order go by doc_id. The
    targets come to the driver, one row each; so do the sizes of their sources by language.
    """
    spark = documents.sparkSession
    if sized is None:
        listed = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
        sized = staged(listed.select("doc_id", "source", "lang", token_count(F.col("text"), tokenizers).cast("long").alias("tokens")).filter("tokens > 0"), "sizes")
    goal = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.filter("source is not null").collect()}
    by_lang = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max(F.struct("tokens", F.coalesce("lang", F.lit("und")).alias("lang"))).alias("top")).collect()
    size = {r.source: (r.tokens, r.top.lang) for r in by_lang}
    leaves = [{"name": s, "path": ((domains or {}).get(s, "all"), size.get(s, (0, "none"))[1]), "weight": w, "capacity": float(size.get(s, (0, ""))[0] * k)} for s, (w, k) in sorted(goal.items())]
    there = sum(x["weight"] for x in leaves if x["capacity"])
    if total is None:
        # Where siblings take over a missing share, theirs grows; the largest total is found by halving on the budgets.
        want = budgets([x | {"capacity": 1e30 if x["capacity"] else 0.0} for x in leaves], 1.0) if there else {}
        total = min((x["capacity"] / want[x["name"]] for x in leaves if want.get(x["name"], 0) > 0), default=0.0)
    budget = budgets(leaves, total)
    plan = [(s, goal[s][0], goal[s][1], float(budget.get(s, 0)), size.get(s, (0, ""))[0]) for s in goal]
    rows = [(s, share, most, b, int(min(most, b // n)) if n else 0, (b - n * (b // n)) if n and b // n < most else 0.0) for s, share, most, b, n in plan]
    leaf = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, budget double, epochs int, rest double")
    d = sized.join(F.broadcast(leaf.select("source", "epochs")), "source").withColumn("o", _order("doc_id", seed, F.col("epochs"))).drop("epochs").withColumn("slice", F.shiftrightunsigned("o", 64 - SLICE_BITS).cast("int"))
    slices = d.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))  # at most sources x 2**SLICE_BITS rows
    before = slices.select("source", "slice", "n", F.expr("sum(n) over (partition by source order by slice) - n").alias("before"))
    d = d.join(F.broadcast(before.join(F.broadcast(leaf), "source").select("source", "slice", "n", "before", "epochs", "rest")), ["source", "slice"])
    sure = d.filter("before + n <= rest or before >= rest").withColumn("take", F.expr("epochs + int(before + n <= rest)"))
    edge = d.filter("before < rest and before + n > rest").withColumn("run", F.expr("before + sum(tokens) over (partition by source, slice order by o, doc_id)"))
    edge = edge.withColumn("take", F.expr("epochs + int(run - tokens / 2 <= rest)")).drop("run")
    mixed = sure.unionByName(edge).filter("take > 0").select("doc_id", "source", F.col("take").cast("int").alias("repeats"), "tokens")
    got = mixed.groupBy("source").agg(F.sum(F.expr("tokens * repeats")).alias("got"), F.max("repeats").alias("most"), F.count("*").alias("records"))
    report = leaf.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("budget").alias("budget_tokens"), F.coalesce("got", F.lit(0)).alias("actual_tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most", F.lit(0)).alias("repeats_used"),
        F.coalesce(F.expr("try_divide(got, sum(got) over ())"), F.lit(0.0)).alias("actual_share"),
    )
    return mixed, report
