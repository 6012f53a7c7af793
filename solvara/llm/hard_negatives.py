"""Hard-negative mining (11): rotated one-bit codes with stored alignment and deterministic intervals.

A vector x is rotated into more dimensions by a fixed orthonormal map; the signs are its code.  Mapped back, the code is
a unit vector u of the original space, and x = |x| (a u + r) with r orthogonal to u.  The alignment a is stored.  For an
anchor q, u.q comes from popcounts of the code against the bit planes of the rotated, quantised anchor; what quantising
left over and the part of q outside u are bounded by Cauchy-Schwarz:

    x.q  lies within  |x| a p  +-  |x| (a e + sqrt(1 - a^2) sqrt(|q|^2 - p^2)),    p the estimate of u.q, e its error.

Rows whose interval cannot matter are dropped; the survivors are scored in whole numbers, so the result is exact.

Rows lie in cells around pivots with a stored radius, which bounds any product with a cell in the same way, so that an
anchor is sent only to the cells that can matter: first to its own one, whose scores tell which others.  Anchors (the
few) travel; rows are dealt once per cell part and stay there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import finite_vector, whole_numbers
from .common import materialize, python_tasks

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Negatives score between so many hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Code bits per dimension (rounded up to whole 64-bit words) and bit planes of an anchor.
BITS_PER_DIMENSION, PLANES = 16, 8
#: Cells: one per so many rows, at most MAX_CELLS; a part of a cell holds about PART_ROWS rows and meets PART_ANCHORS anchors.
CELL_ROWS, MAX_CELLS, PART_ROWS, PART_ANCHORS = 8192, 256, 65_536, 65_536
ROTATION_SEED = 11
#: Share of |x||q| by which an interval is widened for rounding (doubles are off by about 1e-14).
ROUNDING = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """bits x dims matrix with orthonormal columns, the same in every worker."""
    bits = -(-dims * BITS_PER_DIMENSION // 64) * 64
    return np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((bits, dims)))[0]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x 64-bit words), lengths, alignments, and the length that the code has when mapped back."""
    turn = rotation(x.shape[1])
    y = x @ turn.T
    up = y >= 0
    back = np.where(up, 1.0, -1.0) @ turn / np.sqrt(len(turn))
    gain, length = np.linalg.norm(back, axis=1), np.linalg.norm(x, axis=1)
    gain[length == 0] = 1.0
    align = np.divide((back * x).sum(axis=1), gain * length, out=np.ones(len(x)), where=length > 0)
    return np.packbits(up, axis=1, bitorder="little").view("<u8"), length, np.clip(align, 0.0, 1.0), gain


def intervals(codes: np.ndarray, length: np.ndarray, align: np.ndarray, gain: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value that each row's inner product with ``q`` can have."""
    turn = rotation(len(q))
    y = turn @ q
    low, step = float(y.min()), float(y.max() - y.min()) / ((1 << PLANES) - 1) or 1.0
    level = np.rint((y - low) / step).astype("i8")
    error = np.linalg.norm(y - low - step * level)
    planes = np.stack([np.packbits(((level >> p) & 1).astype(bool), bitorder="little").view("<u8") for p in range(PLANES)])
    ones = np.bitwise_count(codes).sum(axis=1, dtype="i8")
    hits = np.bitwise_count(codes[:, None, :] & planes[None]).sum(axis=2, dtype="i8") @ (1 << np.arange(PLANES))
    # the code has +1 and -1: twice the sum over its ones, less the sum over all
    total = low * (2 * ones - len(y)) + step * (2 * hits - level.sum())
    p = total / np.sqrt(len(y)) / gain
    e = error / gain
    q_size = np.linalg.norm(q)
    beside = np.sqrt(np.maximum(0.0, q_size**2 - np.maximum(0.0, np.abs(p) - e) ** 2))
    half = length * (align * e + np.sqrt(1.0 - align**2) * beside) + ROUNDING * length * q_size
    middle = length * align * p
    return middle - half, middle + half


def _arrays(rows: pd.DataFrame):
    stack = lambda c, t: np.frombuffer(b"".join(rows[c]), dtype=t).reshape(len(rows), -1)
    return (rows["vec_id"].to_numpy(), rows["label"].to_numpy(), stack("v", "<i4").astype("i8"), stack("code", "<u8"),
            *(rows[c].to_numpy() for c in ("length", "align", "gain")))


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_positives(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> tuple[list, int]:
    """``(anchor, row, score)`` of the k best rows of each anchor's label, its own id left out; and rows scored."""
    ids, labels, v, *code = _arrays(rows)
    by_label, found, scored = {y: np.flatnonzero(labels == y) for y in np.unique(labels)}, [], 0
    for anchor, label, packed, least in zip(anchors["anchor_id"], anchors["label"], anchors["v"], anchors["least"]):
        mine = by_label.get(label, np.empty(0, "i8"))
        mine = mine[ids[mine] != anchor]
        q = np.frombuffer(packed, dtype="<i4").astype("i8")
        lo, hi = intervals(*(c[mine] for c in code), q.astype("f8"))
        mine = mine[hi >= max(_kth(lo, k), -np.inf if np.isnan(least) else least)]
        score = (v[mine] * q).sum(axis=1)
        scored += len(mine)
        best = np.lexsort((ids[mine], -score))[:k]
        found += [(int(anchor), int(ids[mine[b]]), int(score[b])) for b in best]
    return found, scored


def best_negatives(rows: pd.DataFrame, anchors: pd.DataFrame, k: int, low: int, high: int) -> tuple[list, int]:
    """``(anchor, positive, negative, score)``: the k best rows of another label whose score lies in the positive's range."""
    ids, labels, v, *code = _arrays(rows)
    found, scored = [], 0
    for anchor, label, packed, positives, scores in zip(anchors["anchor_id"], anchors["label"], anchors["v"],
                                                        anchors["positives"], anchors["scores"]):
        q = np.frombuffer(packed, dtype="<i4").astype("i8")
        lo, hi = intervals(*code, q.astype("f8"))
        other, wanted = labels != label, np.zeros(len(ids), dtype=bool)
        for s in scores:
            fits = other & (100 * hi >= low * s) & (100 * lo <= high * s)
            sure = fits & (100 * lo >= low * s) & (100 * hi <= high * s)
            wanted |= fits & (hi >= _kth(lo[sure], k))
        mine = np.flatnonzero(wanted)
        score = (v[mine] * q).sum(axis=1)
        scored += len(mine)
        order = np.lexsort((ids[mine], -score))
        mine, score = ids[mine[order]], score[order]
        for positive, s in zip(positives, scores):
            inside = np.flatnonzero((low * s <= 100 * score) & (100 * score <= high * s))[:k]
            found += [(int(anchor), int(positive), int(s), int(mine[b]), int(score[b])) for b in inside]
    return found, scored


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for every anchor and positive.

    Scores are inner products of floor(scale * x).  Left out: rows with a null id or label, a null or empty vector or a null
    or non-finite component, vectors whose length is not the commonest one, and of rows with one id all but the one
    with the smallest label and vector (repeated rows so count once).  Equal scores: smaller id first.  Pairs without a
    negative in their range have no row; an empty table gives none.  ``is_anchor`` is over ``vec_id``; ``label`` over the input.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("x")) & (F.size("x") > 0)))
    kept = materialize(kept.select("vec_id", "label", whole_numbers(F.col("x"), scale).alias("w")), "whole")
    widths = kept.groupBy(F.size("w").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    dims, n = widths[0]["d"], widths[0]["count"]
    kept = (kept.where(F.size("w") == dims).groupBy("vec_id").agg(F.min(F.struct("label", "w")).alias("r"))
            .select("vec_id", "r.label", "r.w"))
    sample = kept.select("vec_id", "w").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MAX_CELLS, -(-n // CELL_ROWS))).select("w").collect()
    pivots = np.array([r["w"] for r in sample], dtype="f8")

    def pack(batches):
        for b in batches:
            x = np.array(b["w"].tolist(), dtype="<i4").reshape(len(b), dims)
            far = (x.astype("f8")**2).sum(axis=1)[:, None] - 2.0 * (x @ pivots.T) + (pivots**2).sum(axis=1)
            code, length, align, gain = encode(x.astype("f8"))
            cell = far.argmin(axis=1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "v": [r.tobytes() for r in x], "code": [r.tobytes() for r in code],
                                "length": length, "align": align, "gain": gain, "cell": cell,
                                "reach": np.linalg.norm(x - pivots[cell], axis=1) * (1 + ROUNDING)})

    rows = materialize(kept.mapInPandas(pack, "vec_id long, label long, v binary, code binary, length double, align double, gain double, cell int, reach double"),
                       "codes")
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()  # MAX_CELLS at most
    reach = np.full(len(pivots), -np.inf)
    parts = np.zeros(len(pivots), dtype="i8")
    for r in cells:
        reach[r["cell"]], parts[r["cell"]] = r["reach"], -(-r["n"] // PART_ROWS)
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v", "cell")
    anchor_parts = max(1, -(-anchors.count() // PART_ANCHORS))
    part_of = F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), F.col("cell") + 1)
    dealt = (rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), part_of))
             .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1)))))

    def send(asked: DataFrame, choose, extra: str) -> DataFrame:
        """One row per anchor and cell part that ``choose`` names from the largest products possible with each cell."""
        def run(batches):
            for b in batches:
                q = np.array([np.frombuffer(v, dtype="<i4") for v in b["v"]], dtype="f8").reshape(len(b), dims)
                size = np.linalg.norm(q, axis=1)[:, None]
                middle, spread = q @ pivots.T, size * np.maximum(reach, 0.0) * (1 + ROUNDING) + ROUNDING * size * np.linalg.norm(pivots, axis=1)
                to = choose(b, middle - spread, middle + spread) & (reach >= 0)
                at, cell = np.nonzero(to)
                every = np.repeat(np.arange(len(at)), parts[cell])  # each part of a cell
                out = b.iloc[at[every]].assign(cell=cell[every].astype("i4"))
                out["part"] = np.arange(len(every)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                yield out[["anchor_id", "label", "v", *[x.split()[0] for x in extra.split(", ")], "cell", "part"]]

        sent = asked.mapInPandas(run, f"anchor_id long, label long, v binary, {extra}, cell int, part long")
        return sent.withColumn("share", F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_parts)).cast("int"))

    def meet(asked: DataFrame, work, columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]

        def run(index: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found = work(index.sort_values("vec_id"), q)[0] if len(index) and len(q) else []
            return pd.DataFrame(found, columns=names)

        keys = ("cell", "part", "share")
        return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, columns)

    def positives(asked: DataFrame) -> DataFrame:
        return meet(asked, lambda rows, q: best_positives(rows, q, k_positives), "anchor_id long, vec_id long, score long")

    def own_cell(b, lowest, highest):
        return np.arange(len(pivots)) == b["cell"].to_numpy()[:, None]

    def other_cells(b, lowest, highest):
        return ~own_cell(b, lowest, highest) & ~(highest < b["least"].to_numpy()[:, None])  # no k-th score yet: all cells

    first = materialize(positives(send(anchors.withColumn("least", F.lit(float("nan"))), own_cell, "least double")), "first")
    asked = anchors.join(_kth_score(first, k_positives), "anchor_id", "left").withColumn("least", F.coalesce("least", F.lit(float("nan"))))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = (first.unionByName(positives(send(asked, other_cells, "least double")))
            .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k_positives))
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("p"))  # k_positives at most
    lists = materialize(lists.select("anchor_id", F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores")), "positives")

    def in_range(b, lowest, highest):
        to = np.zeros(lowest.shape, dtype=bool)
        for i, scores in enumerate(b["scores"]):
            for s in scores:
                if s >= 0:  # a negative score's range is empty
                    to[i] |= (100 * highest[i] >= low * s) & (100 * lowest[i] <= high * s)
        return to

    asked = anchors.join(lists, "anchor_id")
    sent = send(asked, in_range, "positives array<long>, scores array<long>")
    found = meet(sent, lambda rows, q: best_negatives(rows, q, k_negatives, low, high),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def _kth_score(scored: DataFrame, k: int) -> DataFrame:
    """``(anchor_id, least)``: the k-th best score found so far, null with fewer than k."""
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return (scored.withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
            .select("anchor_id", F.col("score").cast("double").alias("least")))
