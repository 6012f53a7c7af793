"""Model text, SMILES tokens, vocabulary and fixed-length encoding: X3, X4, X5.

All steps are column expressions over the whole string; the only aggregate is the vocabulary count
(map-side partials per token); ids are looked up by Arrow, a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.session import ship_package

# SMILES token pattern from the reaction-prediction literature -- a bracket atom, the
# two-letter halogens Br and Cl, single-letter organic atoms (upper and aromatic lower case), bond and
# branch symbols, two-digit ring closures after %, and single ring-closure digits.
SMILES_TOKEN_RE = (r"(\[[^\]]+\]|Br|Cl|N|O|S|P|F|I|B|C|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$"
                   r"|%[0-9]{2}|[0-9])")
#: The same tokens for Spark's regex engine, which tries alternatives one by one: one class for most characters, and the few
#: that may begin a longer token behind one look ahead.
QUICK_TOKEN_RE = r"[NOSPFIbcnops().=#\-+\\/:~@?>*$0-9]|(?=[BC\[%])(?:Br?|Cl?|\[[^\]]+\]|%[0-9]{2})"
PAD_ID, UNK_ID = 0, 1


def model_text(df: DataFrame, text: str, num_cols, sep: str = " [SEP] ", digits: int = 2,
               out: str = "model_text") -> DataFrame:
    """``"{text}{sep}{x:.digits f}..."``; numbers use a fixed format (Spark's default double
    rendering would print 1.0E7 where Python prints 10000000.0).  A NULL text counts as empty and a NULL number
    is written ``nan``; the separators always stay."""
    parts = [F.coalesce(F.col(text), F.lit(""))]
    parts += [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit("nan")).otherwise(
        F.format_string(f"%.{digits}f", F.col(c).cast("double"))) for c in num_cols]
    return df.withColumn(out, F.concat_ws(sep, *parts))


def tokenize_smiles(df: DataFrame, c: str, out: str = "tokens") -> DataFrame:
    """SMILES tokens of the whole string, in order (characters outside the pattern are skipped)."""
    return df.withColumn(out, F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(QUICK_TOKEN_RE), 0))


def build_vocab(df: DataFrame, tokens: str = "tokens", size: int = 1000) -> DataFrame:
    """``(token, id)`` for the ``size`` most frequent tokens; ids start at 2 (0 = pad, 1 = unknown).

    Order: count descending, then token ascending.  The top-``size`` cut is the vocabulary size itself;
    ``orderBy().limit()`` runs as a per-partition top-k and a merge, and numbering the <= size survivors
    in one task is bounded by the parameter.
    """
    # explode_outer + NOT NULL instead of explode: Spark would otherwise infer a ``size(tokens) > 0``
    # filter and push it (and with it the whole-text regex) below any earlier repartition
    counts = (df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.col("n").desc(), F.col("token").asc()).limit(size)
    w = Window.orderBy(F.col("n").desc(), F.col("token").asc())
    return top.select("token", (F.row_number().over(w) + F.lit(UNK_ID)).cast("int").alias("id"))


def encode(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", max_length: int = 512) -> DataFrame:
    """``input_ids`` (truncated to ``max_length``, right-padded with 0) and ``attention_mask``.

    Truncation to the model's input length is the encoder's definition; ``n_tokens`` keeps the full
    token count of the whole text.  The vocabulary, whose size is a parameter of :func:`build_vocab`, goes to the tasks as a
    constant, and Arrow looks up all tokens of a batch at once: encoding is a projection without a shuffle, rows need
    no key, and only the tokens that are kept leave the JVM.
    """
    ship_package(df.sparkSession)
    known = vocab.select("token", "id").collect()  # the vocabulary's size, a parameter
    names = pa.array([r["token"] for r in known], pa.string())
    ids = np.array([r["id"] for r in known] + [UNK_ID], dtype="i4")

    @F.arrow_udf("array<int>")
    def number(kept: pa.Array) -> pa.Array:
        offsets = kept.offsets.to_numpy()
        at = pc.fill_null(pc.index_in(kept.flatten(), value_set=names), len(names)).to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(ids[at]))

    every = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    real = F.least(F.size(every), F.lit(max_length))
    pad = F.lit(max_length) - real
    return df.withColumns({"n_tokens": F.size(every),
                           "input_ids": F.concat(number(F.slice(every, 1, max_length)), F.array_repeat(F.lit(PAD_ID), pad)),
                           "attention_mask": F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), pad))})
