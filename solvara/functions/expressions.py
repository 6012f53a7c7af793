"""Spark column expressions with a portable definition.

Each expression here has an equivalent in plain SQL (DuckDB form given in the docstring) so that
operators built from them can be checked against an independent engine.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from solvara.functions.qgrams import text_bits
from solvara.session import ship_package


def md5_int(c: Column) -> Column:
    """First 32 bits of md5 of a string as a non-negative BIGINT.

    DuckDB: ``('0x' || substr(md5(s), 1, 8))::BIGINT``.  Both give 1191353098 for ``CCO``.
    """
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def is_finite(c: Column) -> Column:
    """True for a value that is not NULL, not NaN and not +/-Infinity."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def md5_bucket(c: Column, n_bits: int) -> Column:
    """``md5_int(c) mod n_bits`` computed with less string work when n_bits divides 4096.

    md5_int is the first 8 hex digits; for a power of two up to 4096 its remainder only depends on the
    last three of them (12 bits), so only those are parsed.  Same value as ``pmod(md5_int(c), n_bits)``.
    """
    if 4096 % n_bits == 0:
        return F.pmod(F.conv(F.substring(F.md5(c), 6, 3), 16, 10).cast("int"), F.lit(n_bits))
    return F.pmod(md5_int(c), F.lit(n_bits)).cast("int")


def qgram_bits(text: Column, q: int, n_bits: int) -> Column:
    """Sorted distinct bit positions of the q-grams of ``text``.

    gram i (1-based) is ``substr(text, i, q)`` for i in 1..length-q+1; bit = md5_int(gram) mod n_bits.  Grams are whole code
    points, as in SQL.  A string shorter than q, or NULL, has no grams.  The whole text is used; the per-row array is reduced
    to at most ``n_bits`` entries.  Arrow batches go to :func:`solvara.functions.qgrams.text_bits`, which hashes a
    batch's distinct grams only: a regex pass with a hash per gram of each text took most of the time of a fingerprint.
    """
    ship_package(SparkSession.active())

    @F.arrow_udf("array<int>")
    def bits(texts: pa.Array) -> pa.Array:
        return text_bits(texts, q, n_bits)

    return bits(text.cast("binary"))
