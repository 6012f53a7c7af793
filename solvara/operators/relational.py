"""Projections, filters, keyed joins, unions, dedup and best-row selection: P*, J*, D*.

Row identity is always an explicit key column (``row_id`` by default); nothing relies on position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.functions.expressions import is_finite

# The SMILES alphabet accepted by :func:`validate` -- element letters, digits for
# ring closures, and the bond / branch / charge / stereo symbols ( ) [ ] = # - + \ / : ~ @ ? > * $ % .
SMILES_ALPHABET_RE = r"\A[A-Za-z0-9()\[\]=#\-+\\/:~@?>*$%.]+\z"


# ------------------------------------------------------------------ projections and filters
def select_except(df: DataFrame, deny) -> DataFrame:
    """Every column except a deny-list (names that are absent are ignored)."""
    return df.drop(*[c for c in deny if c in df.columns])


def split_rows(df: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    """Rows of one split; a plain filter that Catalyst pushes to the parquet scan."""
    return df.where(F.col(split_col) == F.lit(label))


def replace_columns(df: DataFrame, updates: DataFrame, on: str = "row_id") -> DataFrame:
    """Drop the columns ``updates`` carries, then attach the refreshed ones by key."""
    refreshed = [c for c in updates.columns if c != on]
    return select_except(df, refreshed).join(updates, on, "left")


def prediction_frame(df: DataFrame, id_cols: dict[str, str], label: str, pred: str, prop: str,
                     split_col: str = "split", set_name: str = "Set") -> DataFrame:
    """The reference's prediction table: ids renamed, ``{prop}_exp``, ``{prop}_pred``, ``Set``."""
    cols = [F.col(src).alias(dst) for src, dst in id_cols.items()]
    cols += [F.col(label).alias(f"{prop}_exp"), F.col(pred).alias(f"{prop}_pred"),
             F.col(split_col).alias(set_name)]
    return df.select(*cols)


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """Drop rows with NULL or NaN in any of ``cols`` (infinity is kept, as pandas does)."""
    return df.na.drop(how="any", subset=list(cols))


def validate(df: DataFrame, smiles: str = "smiles", target: str | None = None,
             reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, rejects); rejects carry the first failing rule as ``reason``.

    Rules, in order: missing string, empty string, characters outside the SMILES alphabet,
    unbalanced ( ), unbalanced [ ], missing or non-finite target.  Brackets are balanced when every prefix
    has at least as many opening as closing ones and the whole string as many of both.
    """
    s = F.col(smiles)

    def unbalanced(opening: str, closing: str) -> Column:
        marks = F.split(F.regexp_replace(s, rf"[^\{opening}\{closing}]", ""), "")
        depth = F.aggregate(marks, F.lit(0), lambda d, c: F.when(d < 0, d).when(c == opening, d + 1)
                            .when(c == closing, d - 1).otherwise(d))
        return depth != 0

    reason = (F.when(s.isNull(), F.lit("missing_smiles"))
              .when(F.length(s) == 0, F.lit("empty_smiles"))
              .when(~s.rlike(SMILES_ALPHABET_RE), F.lit("bad_character"))
              .when(unbalanced("(", ")"), F.lit("unbalanced_parentheses"))
              .when(unbalanced("[", "]"), F.lit("unbalanced_brackets")))
    if target is not None:
        reason = reason.when(~is_finite(F.col(target)), F.lit("bad_target"))
    tagged = df.withColumn(reason_col, reason)
    good = tagged.where(F.col(reason_col).isNull()).drop(reason_col)
    rejects = tagged.where(F.col(reason_col).isNotNull())
    return good, rejects


def split_presence(df: DataFrame, expected=("Training", "Validation", "Testing"),
                   split_col: str = "split") -> DataFrame:
    """P9 (table form): rows per expected split, zero included; one grouped count (<= #splits rows)."""
    spark = df.sparkSession
    want = spark.createDataFrame([(s,) for s in expected], f"{split_col} string")
    counts = df.where(F.col(split_col).isin(*expected)).groupBy(split_col).agg(F.count("*").alias("n_rows"))
    return (want.join(F.broadcast(counts), split_col, "left")  # a row per expected split at most
            .select(split_col, F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


def require_nonempty(df: DataFrame, expected=("Training", "Validation", "Testing"),
                     split_col: str = "split") -> DataFrame:
    """Raise if any expected split has no rows; returns the per-split counts otherwise."""
    pres = split_presence(df, expected, split_col)
    empty = [r[split_col] for r in pres.where(F.col("n_rows") == 0).collect()]  # <= len(expected)
    if empty:
        raise ValueError(f"empty split(s): {', '.join(empty)}")
    return pres


def assemble(df: DataFrame, vec_col: str, extra_cols, out: str = "features") -> DataFrame:
    """P10: append scalar columns to an array column (``concat`` keeps it one expression)."""
    extra = F.array(*[F.col(c).cast("double") for c in extra_cols])
    base = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    return df.withColumn(out, F.concat(base, extra))


def finite_mask(df: DataFrame, c: str, fill: float = 0.0) -> DataFrame:
    """``{c}_mask`` (not NULL/NaN/inf) and ``{c}_filled`` (value where finite, else ``fill``)."""
    mask = is_finite(F.col(c))
    return (df.withColumn(f"{c}_mask", mask)
            .withColumn(f"{c}_filled", F.when(mask, F.col(c)).otherwise(F.lit(float(fill)))))


# ------------------------------------------------------------------ keyed joins and unions
def zip_tables(a: DataFrame, b: DataFrame, on: str = "row_id", check: bool = True) -> DataFrame:
    """Column-wise concat by key (the reference concatenates by position).

    With ``check`` every key must occur exactly once on each side; one aggregate over both key columns (partial
    counts per key, so a repeated key is combined map-side) answers that before the join.
    """
    if check:
        both = (a.select(on, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
                .unionByName(b.select(on, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
        wrong = both.groupBy(on).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> 1 OR _b <> 1")
        if wrong.limit(1).count():
            raise ValueError("zip_tables: key sets differ or keys repeat")
    return a.join(b, on, "inner")


def take(df: DataFrame, ids: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows whose key is in ``ids`` (semi join; ``ids`` is never duplicated into the output)."""
    return df.join(ids.select(on), on, "left_semi")


def remaining(df: DataFrame, ids: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows whose key is not in ``ids`` (anti join)."""
    return df.join(ids.select(on), on, "left_anti")


def set_where(df: DataFrame, ids: DataFrame, c: str, value, on: str = "row_id") -> DataFrame:
    """Overwrite column ``c`` with ``value`` for the keys in ``ids``."""
    flags = ids.select(on).distinct().withColumn("_hit", F.lit(True))
    out = df.join(flags, on, "left")
    return out.withColumn(c, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(c))).drop("_hit")


def union_splits(dfs) -> DataFrame:
    """Row-wise bag union by column name (no dedup)."""
    return reduce(lambda a, b: a.unionByName(b), list(dfs))


# ------------------------------------------------------------------ dedup, sort, best row
def dedup_first(df: DataFrame, keys, order: str = "row_id") -> DataFrame:
    """One row per key, the one with the smallest ``order`` value (the *first* row).

    ``order`` must be a unique number.  The smallest order value per key is a hash aggregate of two fixed-width
    columns (sha2 of the key and the number; a key holding a large share of the rows is combined map-side), and
    the rows themselves are picked by a semi join on that number: no row is sorted or carried by its key text.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = [F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys]
    spelt = part[0] if len(part) == 1 else F.to_json(F.array(*part))
    digest = F.sha2(spelt, 256)
    first = df.select(digest.alias("_key"), F.col(order)).groupBy("_key").agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi").select(*df.columns)


def best_run(metrics: DataFrame, metric: str, by=None, tie: str = "epoch", mode: str = "min") -> DataFrame:
    """D3: the row with the best (smallest, or largest for ``mode='max'``) metric, ties by ``tie`` (one or more columns).

    Rows whose metric is NULL or NaN are never the best.  With ``by`` it is one row per group (partial
    aggregate); without, a global top-1.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    metrics = drop_missing(metrics, [metric])
    key = F.struct(F.col(metric) if mode == "min" else -F.col(metric), *ties)
    if by is None:
        o = F.col(metric).asc() if mode == "min" else F.col(metric).desc()
        return metrics.orderBy(o, *[F.col(t).asc() for t in ties]).limit(1)
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in metrics.columns if c not in by]
    picked = metrics.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_b"))
    return picked.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])
