"""Approximate nearest neighbours (6): permutation index.

A vector is represented by the order of its nearest pivots.  Blocks of the index hold inverted files: for each pivot,
the vectors that count it among their nearest and at which rank.  A query walks its own pivots' lists, adds up the
footrule agreement, reranks the best share of the block by the exact inner product, and the blocks' best are merged.

Orders are taken by direction.  As nearness is the inner product, a vector's agreement is turned into an estimated
cosine (a line through a few exactly computed ones) and multiplied by its length; for vectors of one length that is
the order of the footrule distances.  Equal vectors are indexed once with their smallest ids, so thousands of copies
cost one entry and ties stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, python_tasks

PIVOTS, NEAREST, NEIGHBOURS = 128, 128, 20
#: Share of a block that is reranked exactly; recall against brute force is measured in tests and README.  A third of
#: all rows may be near copies of one vector, which only exact products tell apart.
RERANK_SHARE, RERANK_LEAST = 0.4, 200
#: Rows of a block (the smaller number as long as there are few blocks) and queries that meet it at once.
LEAST_BLOCK_ROWS, BLOCK_ROWS, MANY_BLOCKS, QUERY_ROWS = 8192, 65_536, 64, 32_768
#: Share of the largest product by which two ways of adding it up may differ.
ROUNDING = 1e-9
#: Vectors of a block whose cosine with a query is computed to place the line.
PROBES = 64
QUERY_STEP = 20


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled by the largest part first, so that no square overflows."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    lengths = np.linalg.norm(x / largest, axis=1, keepdims=True)
    return x / largest / lengths, (lengths * largest)[:, 0]


def nearest_pivots(directions: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The NEAREST pivots of each row, nearest first; ties go to the smaller pivot number."""
    return np.argsort(-(directions @ pivots.T), axis=1, kind="stable")[:, :min(NEAREST, len(pivots))].astype("i2")


class InvertedFiles:
    """One block's pivot files: for each pivot, every vector's reach, the number of places from its rank to the end
    of the order (0 where the pivot is not among the vector's nearest).  A file is one contiguous row."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.width = orders.shape
        self.reach = np.zeros((pivots, n), dtype="u2")
        for rank in range(self.width):
            self.reach[orders[:, rank], np.arange(n)] = self.width - rank

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Half of what the footrule distance lies below its largest value, for every vector of the block.

        A pivot that both rank saves twice the smaller of the two reaches.
        """
        total = np.zeros(self.reach.shape[1], dtype="u2")
        for rank, pivot in enumerate(order):
            total += np.minimum(self.reach[pivot], np.uint16(self.width - rank))
        return total


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and level of the least-squares line."""
    spread = float(((x - x.mean()) ** 2).sum())
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / spread if spread else 0.0
    slope = slope if slope > 0 else 1e-9
    return slope, float(y.mean() - slope * x.mean())


def _largest(values: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the k largest values and of all that tie with the last of them, within ``slack``."""
    if len(values) <= k:
        return np.arange(len(values))
    return np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k] - slack)


def search(vectors: DataFrame, k: int = NEIGHBOURS, is_query: Column | None = None, pivots: int = PIVOTS,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each query row, all candidates if fewer.

    Queries are rows whose id is divisible by 20 unless ``is_query`` says otherwise.  Vectors that are null, zero or
    hold null or non-finite parts, rows with a null id, and vectors whose length is not the commonest one take no
    part.  Repeated (id, vector) rows count once; an empty table has no result.  Equal scores among those found go by the
    smaller id, however many there are.  Index and queries meet in blocks of about BLOCK_ROWS x QUERY_ROWS rows, dealt
    by Spark; no task sees more.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    is_query = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    good = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
            .select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")))
    good = materialize(good, "vectors")
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("v") == lengths[0]["d"])
    # equal vectors: the k + 1 smallest ids are all that a query's k nearest can hold (one may be its own)
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = (good.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
               .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    entries = materialize(entries.withColumn("h", F.xxhash64("v")), "entries")
    n = entries.count()
    sample = entries.orderBy("h", "v").limit(pivots).select("v").collect()  # a fixed number of pivots
    pivot_rows, _ = _directions(np.array([r["v"] for r in sample]))
    queries = good.where(is_query).distinct()
    n_blocks = max(1, -(-n // BLOCK_ROWS), min(MANY_BLOCKS, -(-n // LEAST_BLOCK_ROWS)))
    n_query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    left = (entries.withColumn("block", F.pmod("h", F.lit(n_blocks)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))))
    right = (queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))

    def meet(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(index) and len(asked):
            index = index.sort_values("h", kind="stable")
            x, ids = np.stack(index["v"].to_numpy()), index["ids"].to_numpy()
            directions, lengths = _directions(x)
            files = InvertedFiles(nearest_pivots(directions, pivot_rows), len(pivot_rows))
            q = np.stack(asked["v"].to_numpy())
            orders = nearest_pivots(_directions(q)[0], pivot_rows)
            keep = min(len(x), max(RERANK_LEAST, int(np.ceil(RERANK_SHARE * len(x)))))
            probe = np.linspace(0, len(x) - 1, min(len(x), PROBES)).astype("i4")
            for query_id, vector, order in zip(asked["vec_id"], q, orders):
                agreement = files.agreement(order).astype("f8")
                slope, level = _line(agreement[probe], directions[probe] @ vector)
                nearness = lengths * (level + slope * agreement)
                near = _largest(nearness, keep, 0.0)
                rough = x[near] @ vector
                # one vector may be the query's own; whatever ties with the last place goes on
                best = near[_largest(rough, k + 1, ROUNDING * lengths[near].max() * float(np.linalg.norm(vector)))]
                score = (x[best] * vector).sum(axis=1)  # the same order of additions for every row
                hits = [(-s, i) for s, e in zip(score.tolist(), best) for i in ids[e] if i != query_id]
                found.extend((int(query_id), int(i), -s) for s, i in sorted(hits)[:k])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = left.groupBy("block", "part").cogroup(right.groupBy(F.col("block"), F.col("part"))).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
