"""SimHash near-dedup (2): covering locality-sensitive hashing.

Texts get 64-bit fingerprints over word shingles.  To link all fingerprints within ``r`` bits, every bit position
is given a nonzero vector of r+1 bits, and each nonzero vector v defines a mask: the positions whose vector has an
odd inner product with v.  Any r differing positions leave some v orthogonal to all of them, so a pair within the
radius agrees on at least one whole mask: no pair is missed.  With r = 2 there are 7 masks of 36-37 bits.

Only distinct fingerprints are hashed to buckets.  A bucket over ``BUCKET_ROWS`` is split exactly by covering its
free bits again; after that at most ``2**12`` different fingerprints can share a bucket, so no bucket is unbounded
and none is capped.  A bucket yields a spanning star per linked set instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, python_tasks
from .components import connected_components

SHINGLE_WORDS, BITS, RADIUS, SEED = 3, 64, 2, 42
BUCKET_ROWS = 256
_CHUNK = 1 << 16


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions``: any ``radius`` of them are all left out of at least one mask."""
    vectors = range(1, 1 << (radius + 1))
    given = {p: 1 + i % len(vectors) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (given[p] & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


MASKS = covering_masks(list(range(BITS)))
SUB_MASKS = [covering_masks([p for p in range(BITS) if not m >> p & 1]) for m in MASKS]


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values (seed 42); no words give 0."""
    import xxhash

    words = (text or b"").lower().split()  # on bytes: A-Z only, and white space is x20 and x09-x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    counts, n = np.zeros(BITS, dtype="i8"), len(words) - width + 1
    for at in range(0, n, _CHUNK):
        part = words[at:min(at + _CHUNK, n) + width - 1]
        values = np.array([digest(b" ".join(g), SEED) for g in zip(*(part[i:] for i in range(width)))], dtype="<u8")
        counts += np.unpackbits(values.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = SHINGLE_WORDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*carry, fp)`` per row; fp is the 64-bit fingerprint as a signed long.  Null text counts as empty.

    ``carry`` names long columns that go along.
    """
    python_tasks(documents.sparkSession)
    names = [*carry, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(len(carry)).to_pylist()], dtype="u8").view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=names)

    rows = documents.select(*[F.col(c).cast("long").alias(c) for c in carry],
                            F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(first, member) for each set of values linked, directly or through others, within the radius."""
    left, out = values.view("u8"), []
    while len(left):
        todo, group, left = [left[0]], [], left[1:]
        first = todo[0]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                todo.extend(left[near])
                group.append(left[near])
                left = left[~near]
        out.extend((_signed(int(first)), int(x)) for g in group for x in g.view("i8"))
    return out


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)`` whose connected sets are those of all pairs of ``distinct(fp)`` within the radius."""
    if radius != RADIUS:
        raise ValueError(f"masks are laid out for a radius of {RADIUS}")
    python_tasks(distinct.sparkSession)
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(MASKS)])
    keyed = (distinct.select("fp", F.explode(masks).alias("m"))
             .select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("k")))
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("members")).where("members > 1")
    placed = materialize(keyed.join(shared, ["t", "k"]), "buckets")
    subs = F.array(*[F.array(*[F.struct(F.lit(i).alias("t2"), F.lit(_signed(m)).alias("mask"))
                               for i, m in enumerate(row)]) for row in SUB_MASKS])
    small = placed.where(F.col("members") <= bucket_rows).select("fp", "t", "k", F.lit(-1).alias("t2"),
                                                                 F.lit(0).cast("long").alias("k2"))
    large = (placed.where(F.col("members") > bucket_rows)
             .select("fp", "t", "k", F.explode(F.get(subs, F.col("t"))).alias("s"))
             .select("fp", "t", "k", F.col("s.t2").alias("t2"),
                     F.col("fp").bitwiseAND(F.col("s.mask")).alias("k2")))
    # at most bucket_rows members in a small bucket and 2**12 in a split one, so the list is bounded
    buckets = (small.union(large).groupBy("t", "k", "t2", "k2").agg(F.collect_list("fp").alias("fps"))
               .where(F.size("fps") > 1).select("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [p for fps in b.column(0).to_pylist() for p in _stars(np.array(sorted(fps), dtype="i8"), radius)]
            a = np.array(pairs, dtype="i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS,
                    carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*carry, fp, component_id, group_fp)`` for every row of ``documents``.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer bits (its own id included; null
    only if the whole group has null ids); group_fp is the group's smallest fingerprint.  Null and empty texts have
    fingerprint 0 and are linked like any other.  Repeated rows come out as often as they came in.  Only doc_id,
    text and ``carry`` are read, so extra columns cannot clash; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(documents, width, carry), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    grouped = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "least", F.coalesce("root", "fp").alias("group_fp")))
    least = grouped.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "group_fp").join(least, "group_fp")
    return prints.join(classes, "fp").select(*carry, "fp", "component_id", "group_fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_group(documents: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of every near-duplicate group, with the columns of ``documents``: the one with the smallest doc_id.

    Null ids come last; rows that share an id are told apart by a hash of all their columns, the smallest first, so
    a repeated row leaves one row.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    # the hash covers the id, so a null id and 0 stay apart; plain keys let the join and the last step share one shuffle
    rows = documents.withColumns({"__row": F.xxhash64(*columns), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    members = near_duplicates(rows, width, radius, ("doc_id", "__row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("best")
    kept = members.groupBy("group_fp").agg(best).select(
        F.coalesce("best.doc_id", F.lit(0)).alias("__id"), F.col("best.__row").alias("__row"))
    return rows.join(kept, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select(*columns)
