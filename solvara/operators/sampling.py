"""Diversity samplers and the nested three-way split: F5, F6, F7, L12.

Both samplers order rows by ``(comp_sim, row_id)`` (a total order), give every row its global
position with :func:`global_rank` and then keep rows with a closed-form test on that position, so no
step ever gathers the rows of a stratum, a bin or the whole set into one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.functions.expressions import md5_int
from solvara.operators.ranking import global_rank
from solvara.operators.similarity import complementary_similarity
from solvara.session import write_once

# Split labels used by the reference's prediction tables.
TRAINING = "Training"
VALIDATION = "Validation"
TESTING = "Testing"


def sample_size(n_rows: int, pct) -> int:
    """m = floor(N * pct / 100) from exact decimals (so 94.45 % is not a binary fraction)."""
    return int((Decimal(n_rows) * Decimal(str(pct)) / Decimal(100)).to_integral_value(rounding="ROUND_FLOOR"))


def _narrow(sim: DataFrame, id_col: str, sim_col: str) -> DataFrame:
    """The (key, similarity) pairs written once: every later pass of a sampler reads 16 bytes per row
    instead of re-deriving similarity from the fingerprints (or re-running a semi join upstream)."""
    return write_once(sim.select(id_col, sim_col))


def stratified_sample(sim: DataFrame, pct, id_col: str = "row_id", sim_col: str = "comp_sim") -> DataFrame:
    """NTILE(m) strata along ``(comp_sim, id)``; keep the first row of each stratum.

    Returns the selected keys ``(id_col)`` -- exactly m = floor(N*pct/100) rows.
    """
    ranked = global_rank(_narrow(sim, id_col, sim_col), [sim_col, id_col], "_r")
    n = ranked.count()
    m = sample_size(n, pct)
    if m <= 0:
        return ranked.select(id_col).limit(0)
    base, rem = divmod(n, m)
    cut = rem * (base + 1)
    r = F.col("_r")
    first = F.when(r < F.lit(cut), F.pmod(r, F.lit(base + 1)) == 0).otherwise(
        F.pmod(r - F.lit(cut), F.lit(max(base, 1))) == 0)
    return ranked.where(first).select(id_col)


def _round_robin_quota(counts: list[int], m: int) -> list[int]:
    """Per-bin quota when bins are visited in order, one row per bin per round, until m are taken."""
    lo, hi = 0, max(counts) if counts else 0
    while lo < hi:  # largest R with sum(min(c, R)) <= m
        mid = (lo + hi + 1) // 2
        if sum(min(c, mid) for c in counts) <= m:
            lo = mid
        else:
            hi = mid - 1
    quota = [min(c, lo) for c in counts]
    left = m - sum(quota)
    for b, c in enumerate(counts):
        if left <= 0:
            break
        if c > lo:
            quota[b] += 1
            left -= 1
    return quota


def quota_sample(sim: DataFrame, pct, n_bins: int = 10, id_col: str = "row_id",
                 sim_col: str = "comp_sim") -> DataFrame:
    """equal-width bins on comp_sim, then round-robin over bins in order until m rows are taken.

    Rows of one bin are contiguous in the global order, so position-in-bin = rank - bin offset and the
    round-robin rule becomes the filter ``pos_in_bin < quota[bin]``; the quotas follow from at most
    ``n_bins`` counts.  Returns the selected keys.
    """
    base = _narrow(sim, id_col, sim_col)
    lim = base.agg(F.min(sim_col).alias("lo"), F.max(sim_col).alias("hi"), F.count("*").alias("n")).first()
    n = int(lim["n"])
    m = sample_size(n, pct)
    if m <= 0 or n == 0:
        return base.select(id_col).limit(0)
    lo, hi = float(lim["lo"]), float(lim["hi"])
    x = F.col(sim_col)
    if hi > lo:
        raw = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(n_bins))
        bin_ = F.least(raw, F.lit(n_bins - 1)).cast("int")
    else:
        bin_ = F.lit(0)
    binned = base.withColumn("_bin", bin_)
    counts_map = dict(binned.groupBy("_bin").count().collect())  # <= n_bins rows
    counts = [int(counts_map.get(b, 0)) for b in range(n_bins)]
    quota = _round_robin_quota(counts, m)
    offsets, run = [], 0
    for c in counts:
        offsets.append(run)
        run += c
    ranked = global_rank(binned, [sim_col, id_col], "_r")
    b1 = F.col("_bin") + F.lit(1)
    pos_in_bin = F.col("_r") - F.element_at(F.lit(offsets).cast("array<bigint>"), b1)
    keep = pos_in_bin < F.element_at(F.lit(quota).cast("array<bigint>"), b1)
    return ranked.where(keep).select(id_col)


def _sampler(method: str, id_col: str):
    if method == "stratified":
        return lambda sim, pct: stratified_sample(sim, pct, id_col)
    if method == "quota":
        return lambda sim, pct: quota_sample(sim, pct, id_col=id_col)
    raise ValueError(f"unknown sampling method {method!r}")


def three_way_split(bits: DataFrame, n_bits: int, method: str = "stratified", pct1=80, pct2=87.5,
                    id_col: str = "row_id", bits_col: str = "bits") -> DataFrame:
    """nested split by structural diversity.

    Sample pct1 % of all rows (train+validation), recompute complementary similarity inside that
    subset, sample pct2 % of it for training; the rest of the subset is validation, everything
    outside is test.  Returns ``(id_col, split)`` for every input row.  The bit table and the subset's bit
    table are read several times each, so both are written to the shared folder once: fingerprints are not
    recomputed and the semi join runs once.  The label comes from two joins of narrow ids.
    """
    sample = _sampler(method, id_col)
    bits = write_once(bits.select(id_col, bits_col), "bits")
    outer = write_once(sample(complementary_similarity(bits, n_bits, bits_col, id_col), pct1), "outer")
    inner_bits = write_once(bits.join(outer, id_col, "left_semi"), "inner-bits")
    inner = sample(complementary_similarity(inner_bits, n_bits, bits_col, id_col), pct2)
    flagged = (bits.select(id_col)
               .join(outer.withColumn("_o", F.lit(True)), id_col, "left")
               .join(inner.withColumn("_i", F.lit(True)), id_col, "left"))
    split = (F.when(F.col("_i"), F.lit(TRAINING))
             .when(F.col("_o"), F.lit(VALIDATION))
             .otherwise(F.lit(TESTING)))
    return flagged.select(id_col, split.alias("split"))


def hash_split(df: DataFrame, key: str, weights, seed: int = 536, out: str = "split",
               labels=None) -> DataFrame:
    """Deterministic random split by hash of (seed, key); stable across re-runs and partitionings.

    ``u = md5_int(seed || '|' || key) / 2^32`` falls into the cumulative weight intervals.
    """
    total = float(sum(weights))
    labels = list(labels) if labels else [str(i) for i in range(len(weights))]
    u = md5_int(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).cast("double") / F.lit(float(1 << 32))
    expr = None
    for i, lab in enumerate(labels[:-1]):
        cond = u < F.lit(float(sum(weights[: i + 1])) / total)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    expr = F.lit(labels[-1]) if expr is None else expr.otherwise(F.lit(labels[-1]))
    return df.withColumn(out, expr)


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 536, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 by hash of (seed, key)."""
    h = md5_int(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))
