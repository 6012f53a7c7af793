"""Mean pairwise similarity of a whole set without making pairs.

Under a random order of the bits, two rows have the same first set bit with a probability equal to their
Jaccard-Tanimoto similarity.  So the share of row pairs that agree is an unbiased estimate of the mean similarity of all
pairs, and it follows from the sizes of the groups of rows with one first bit: c rows make c (c - 1) / 2 pairs.  Several
orders give several estimates, and their spread gives the standard error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.session import ship_package

ORDERS = 64


def bit_orders(n_bits: int, orders: int = ORDERS) -> np.ndarray:
    """``orders`` fixed orders of the bits: by the first 32 bits of md5 of ``order|bit``, then by bit."""
    def rank(k, b):
        return int(hashlib.md5(f"{k}|{b}".encode()).hexdigest()[:8], 16), b

    return np.array([sorted(range(n_bits), key=lambda b: rank(k, b)) for k in range(orders)], dtype="i4").reshape(orders, n_bits)


def pairwise_average(bits: DataFrame, n_bits: int, orders: int = ORDERS, bits_col: str = "bits") -> DataFrame:
    """one row ``(n_rows, n_pairs, mean, std_error)`` of the Tanimoto similarity over all pairs of rows.

    Linear in the rows: a task counts its rows per (order, first bit), ``orders`` x ``n_bits`` numbers at most, and Spark
    adds the counts up.  A row without bits agrees with none (similarity 0), a NULL array counts as empty.  With fewer than
    two rows there is no pair and mean and error are NULL; the error is also NULL for a single order.
    """
    ship_package(bits.sparkSession)
    order_of = bit_orders(n_bits, orders)

    def run(batches):
        counts, rows = np.zeros((orders, n_bits), dtype="i8"), 0
        for b in batches:
            rows += b.num_rows
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            dense = np.zeros((b.num_rows, n_bits), dtype=bool)
            dense[np.repeat(np.arange(b.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False)] = True
            dense = np.ascontiguousarray(dense[sizes > 0].T)
            for k in range(orders):
                first = dense[order_of[k]].argmax(axis=0)
                counts[k] += np.bincount(order_of[k][first], minlength=n_bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *(at // n_bits)], pa.int32()), pa.array([0, *(at % n_bits)], pa.int32()), pa.array([rows, *counts.ravel()[at]], pa.int64())],
            names=["k", "bit", "n"])

    rows = bits.select(F.coalesce(bits_col, F.array().cast("array<int>")).cast("array<int>").alias("b"))
    groups = rows.mapInArrow(run, "k int, bit int, n long").groupBy("k", "bit").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    by_order = groups.groupBy("k").agg(F.sum(F.when(F.col("k") >= 0, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n"))).alias("x"))
    total = by_order.agg(F.coalesce(F.max(F.when(F.col("k") == -1, F.col("x"))), F.lit(0)).cast("long").alias("n_rows"),
                         F.coalesce(F.sum(F.when(F.col("k") >= 0, F.col("x"))), F.lit(0)).cast("double").alias("hits"),
                         F.coalesce(F.sum(F.when(F.col("k") >= 0, F.pow(F.col("x").cast("double"), 2))), F.lit(0.0)).alias("squares"))
    n, pairs = F.col("n_rows"), F.col("n_pairs")
    mean = F.col("hits") / orders  # an order in which no rows agree adds nothing to either sum
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - orders * mean * mean) / (orders - 1)) if orders > 1 else F.lit(None).cast("double")
    return (total.withColumn("n_pairs", F.expr("n_rows * (n_rows - 1) div 2"))
            .select("n_rows", "n_pairs", F.when(n > 1, mean / pairs).alias("mean"),
                    F.when(n > 1, spread / (F.sqrt(F.lit(float(orders))) * pairs)).alias("std_error")))
