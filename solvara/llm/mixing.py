"""Mixing sources to target weights (8): hierarchical budgeting over a domain-language-source tree.

A token budget flows from the root by the children's weights.  A child whose capacity (its tokens times the largest
number of epochs) is below its share passes the shortage to its siblings; only what no sibling can take rises to the
level above.  Each leaf then takes whole seeded epochs and the token-prefix of one more: its documents in the seeded
order until the rest of its budget is used.

No leaf is sorted as a whole.  A leaf's order is cut into 4096 hash buckets whose totals give the cut bucket; only
that bucket's rows are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: The tree's statistics and plan are one row per leaf; this bound is checked before they are collected or broadcast.
MAX_LEAVES = 50_000
LEVELS = ["domain", "lang", "source"]


@dataclass
class Mix:
    """Target weights per tree node (a path of level values; absent: 1), budget, epochs and seed.

    budget None means as many tokens as the input has.
    """

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    budget: int | None = None
    max_epochs: int = 3
    seed: int = 17


#: Fixed production parameters of the registered query and the pipeline stage.
PRODUCTION = Mix(weights={("web",): 5.0, ("books",): 3.0, ("forum",): 2.0,
                          **{(d, "en"): 4.0 for d in ("web", "books", "forum")},
                          **{(d, "de"): 2.0 for d in ("web", "books", "forum")},
                          **{(d, "fr"): 2.0 for d in ("web", "books", "forum")},
                          **{(d, "es"): 2.0 for d in ("web", "books", "forum")}})


def domain_of(source: Column) -> Column:
    """Stand-in for a domain table, which the data lack: sources are dealt to three domains by their hash."""
    at = F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(3)).cast("int")
    return F.get(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), at)


def allocate(budget: int, capacities: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], int]:
    """Whole tokens per leaf path, summing to min(budget, total capacity)."""
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    cap: dict[tuple[str, ...], int] = {}
    for leaf, c in capacities.items():
        for k in range(len(leaf) + 1):
            if leaf[:k] not in cap and k:
                children.setdefault(leaf[:k - 1], []).append(leaf[:k])
            cap[leaf[:k]] = cap.get(leaf[:k], 0) + c
    out: dict[tuple[str, ...], int] = {}

    def flow(node: tuple[str, ...], amount: int) -> None:
        if node in capacities:
            out[node] = amount
            return
        for child, share in _fill(amount, [(c, weights.get(c, 1.0), cap[c]) for c in sorted(children.get(node, []))]).items():
            flow(child, share)

    flow((), min(budget, cap.get((), 0)))
    return out


def _fill(amount: int, rows: list[tuple[tuple[str, ...], float, int]]) -> dict[tuple[str, ...], int]:
    """Share by weight; full children drop out and the others share again.  amount is at most the sum of capacities."""
    given, open_rows = {r[0]: 0 for r in rows}, list(rows)
    left = amount
    while left > 0 and open_rows:
        total = sum(w for _, w, _ in open_rows) or 0.0
        parts = {n: (w / total if total > 0 else 1 / len(open_rows)) * left for n, w, _ in open_rows}
        full = [r for r in open_rows if parts[r[0]] >= r[2]]
        if full:
            for n, _, c in full:
                given[n] = c
                left -= c
            open_rows = [r for r in open_rows if r not in full]
            continue
        whole = {n: int(p) for n, p in parts.items()}
        rest = left - sum(whole.values())
        for n in sorted(parts, key=lambda n: (whole[n] - parts[n], n))[:rest]:
            whole[n] += 1
        for n, c in ((n, c) for n, _, c in open_rows):
            given[n] = min(whole[n], c)
        left = 0
    return given


def _order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(documents: DataFrame, plan: Mix = PRODUCTION) -> DataFrame:
    """Selected rows: the columns of ``documents`` and __domain, __tokens, __epoch (0 on), __taken.

    A row appears once per epoch that takes it; __taken is below __tokens only for the one document per leaf at which
    the prefix ends.  Null language or source is the leaf value ''.  Tokens are white-space words (x20, x09-x0D) plus
    one.  Repeated rows count each; rows that share an id are ordered by a hash of their columns.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = documents.withColumns({
        "__domain": domain_of(F.col("source")), "__lang": F.coalesce("lang", F.lit("")),
        "__source": F.coalesce("source", F.lit("")), "__tokens": words.cast("long") + 1, "__row": F.xxhash64(*columns)})
    leaf = ["__domain", "__lang", "__source"]
    totals = rows.groupBy(*leaf).agg(F.sum("__tokens").alias("total"))
    got = totals.limit(MAX_LEAVES + 1).collect()
    if len(got) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    total = {(r["__domain"], r["__lang"], r["__source"]): r["total"] for r in got}
    budget = sum(total.values()) if plan.budget is None else plan.budget
    shares = allocate(budget, {k: v * plan.max_epochs for k, v in total.items()}, plan.weights)
    table = [(*k, shares.get(k, 0) // v, shares.get(k, 0) % v) for k, v in sorted(total.items())]
    spark = documents.sparkSession
    leaves = spark.createDataFrame(table, "__domain string, __lang string, __source string, __full long, __rest long")
    ranked = rows.join(F.broadcast(leaves), leaf)  # bounded by MAX_LEAVES
    ranked = ranked.withColumn("__key", _order_key(plan.seed, F.col("__full")))
    ranked = ranked.withColumn("__bucket", F.pmod(F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"), F.lit(BUCKETS)))
    # cut bucket of each leaf: where the running total of its buckets reaches the rest of its budget
    sums = ranked.where("__rest > 0").groupBy(*leaf, "__bucket", "__rest").agg(F.sum("__tokens").alias("n"))
    order = Window.partitionBy(*leaf).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (sums.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") >= F.col("__rest"))
            .groupBy(*leaf).agg(F.min(F.struct("__bucket", (F.col("__rest") - F.col("upto") + F.col("n")).alias("need"))).alias("c"))
            .select(*leaf, F.col("c.__bucket").alias("__cut"), F.col("c.need").alias("__need")))
    ranked = ranked.join(F.broadcast(cuts), leaf, "left")  # one row per leaf
    inside = ranked.where(F.col("__bucket") < F.col("__cut")).withColumns({"__epoch": F.col("__full").cast("int"), "__taken": F.col("__tokens")})
    within = Window.partitionBy(*leaf).orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, -1)
    edge = (ranked.where(F.col("__bucket") == F.col("__cut"))  # one of 4096 buckets of a leaf
            .withColumn("__before", F.coalesce(F.sum("__tokens").over(within), F.lit(0)))
            .where(F.col("__before") < F.col("__need"))
            .withColumns({"__epoch": F.col("__full").cast("int"), "__taken": F.least(F.col("__tokens"), F.col("__need") - F.col("__before"))}))
    whole = (ranked.where("__full > 0")
             .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__full").cast("int") - 1)))
             .withColumn("__taken", F.col("__tokens")))
    kept = [*columns, "__domain", "__tokens", "__epoch", "__taken"]
    return whole.select(*kept).union(inside.select(*kept)).union(edge.select(*kept))


def mixed_documents(documents: DataFrame, plan: Mix = PRODUCTION) -> DataFrame:
    """The selected rows with the columns of ``documents``; a document at a prefix's end stays whole."""
    return mix(documents, plan).select(*[F.col(f"`{c}`") for c in documents.columns])
