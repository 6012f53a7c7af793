"""Binary fingerprints and n-ary (instant) similarity: F1, F4, F8, F9, F10.

Bits are kept as a sorted ``ARRAY<INT>`` of set positions per row.  Set-level similarity only needs
the per-bit column counts k_q (at most ``n_bits`` numbers), so every operator here is linear:
one partial aggregate that shrinks to ``n_bits`` rows per task, then a map over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.functions.expressions import qgram_bits


def lingo_fingerprint(df: DataFrame, smiles: str = "smiles", q: int = 4, n_bits: int = 512,
                      id_col: str = "row_id", out: str = "bits") -> DataFrame:
    """q-gram (LINGO) binary fingerprint of a molecule string, over the whole string.

    Returns ``(id_col, out)`` with ``out`` the sorted distinct set bits.  No shuffle: a projection.
    """
    return df.select(F.col(id_col), qgram_bits(F.col(smiles), q, n_bits).alias(out))


@dataclass(frozen=True)
class BitStats:
    """Column sums of a bit table: N rows and k_q per bit (only non-zero bits are stored)."""

    n_rows: int
    counts: dict[int, int]
    n_bits: int

    def k_array(self) -> list[int]:
        return [self.counts.get(b, 0) for b in range(self.n_bits)]


def bit_stats(bits_df: DataFrame, n_bits: int, bits_col: str = "bits") -> BitStats:
    """Per-bit counts; the aggregate result has at most ``n_bits`` + 1 rows (proven bound).

    One pass: every row also emits the sentinel bit -1, whose count is N.  ``explode_outer`` keeps
    Spark from inferring a size filter that would re-evaluate an uncheckpointed bits expression early.
    """
    tagged = F.concat(F.array(F.lit(-1)), F.col(bits_col))
    rows = (bits_df.select(F.explode_outer(tagged).alias("bit")).where(F.col("bit").isNotNull())
            .groupBy("bit").agg(F.count("*").alias("k")).collect())
    counts = {int(r["bit"]): int(r["k"]) for r in rows}
    n_rows = counts.pop(-1, 0)
    return BitStats(n_rows, counts, n_bits)


def isim(bits_df: DataFrame, n_bits: int, bits_col: str = "bits") -> DataFrame:
    """F8: instant similarity (Jaccard-Tanimoto) of the whole set, from column sums only.

    Returns one row ``(n_rows, a_pairs, d_pairs, isim)``; isim = a / (a + d), 0 when a + d = 0.
    """
    st = bit_stats(bits_df, n_bits, bits_col)  # one pass: the row count comes with the bit counts
    a = sum(k * (k - 1) // 2 for k in st.counts.values())
    d = sum(k * (st.n_rows - k) for k in st.counts.values())
    value = float(a) / float(a + d) if a + d else 0.0
    return bits_df.sparkSession.createDataFrame(
        [(st.n_rows, Decimal(a), Decimal(d), value)],
        "n_rows bigint, a_pairs decimal(38,0), d_pairs decimal(38,0), isim double")


def complementary_similarity(bits_df: DataFrame, n_bits: int, bits_col: str = "bits",
                             id_col: str = "row_id", stats: BitStats | None = None) -> DataFrame:
    """similarity of the set with each row left out (JT index), for every row.

    Leaving row i out changes only the counts of its own bits, so with
    ``A = sum k(k-1)/2`` and ``D = sum k(N-1-k)``:
    ``a_i = A - sum_{q in i}(k_q - 1)``, ``d_i = D + sum_{q in i}(2 k_q - N)``,
    ``comp_sim = a_i / (a_i + d_i)`` (0 when the denominator is 0, and for N < 2).
    Numerators stay exact in DECIMAL(38,0); only the final ratio is a double.
    Plan: the bit counts (<= n_bits values) become one array literal; each row then sums
    its own bits' counts with ``aggregate`` -- no join and no shuffle of the rows.
    """
    st = stats or bit_stats(bits_df, n_bits, bits_col)
    n = st.n_rows
    big_a = sum(k * (k - 1) // 2 for k in st.counts.values())
    big_d = sum(k * (n - 1 - k) for k in st.counts.values())
    karr = F.lit(st.k_array()).cast("array<bigint>")
    bits = F.col(bits_col)
    sum_k = F.aggregate(bits, F.lit(0).cast("bigint"),
                        lambda acc, b: acc + F.element_at(karr, b + F.lit(1)))
    m = F.size(bits).cast("bigint")
    dec = "decimal(38,0)"
    a_i = F.lit(Decimal(big_a)).cast(dec) - (sum_k - m).cast(dec)
    d_i = F.lit(Decimal(big_d)).cast(dec) + (F.lit(2) * sum_k - F.lit(n) * m).cast(dec)
    den = a_i + d_i
    comp = F.when((F.lit(n) < 2) | (den == 0), F.lit(0.0)).otherwise(
        a_i.cast("double") / den.cast("double"))
    return bits_df.select(F.col(id_col), comp.alias("comp_sim"))


def medoid(bits_df: DataFrame, n_bits: int, bits_col: str = "bits", id_col: str = "row_id") -> DataFrame:
    """the row with the lowest complementary similarity (ties: smallest key)."""
    cs = complementary_similarity(bits_df, n_bits, bits_col, id_col)
    return cs.orderBy(F.col("comp_sim").asc(), F.col(id_col).asc()).limit(1)


def outlier(bits_df: DataFrame, n_bits: int, bits_col: str = "bits", id_col: str = "row_id") -> DataFrame:
    """the row with the highest complementary similarity (ties: smallest key)."""
    cs = complementary_similarity(bits_df, n_bits, bits_col, id_col)
    return cs.orderBy(F.col("comp_sim").desc(), F.col(id_col).asc()).limit(1)
