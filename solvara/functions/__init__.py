"""Column-level helpers (pure Spark expressions) shared by the operators."""

from solvara.functions.expressions import (
    md5_int,
    is_finite,
    qgram_bits,
)

__all__ = ["md5_int", "is_finite", "qgram_bits"]
