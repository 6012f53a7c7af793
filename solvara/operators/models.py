"""Distributed regressors, scoring, uncertainty and 2-D projection: L1-L5, L11 (and S6 via sources).

Models are ``pyspark.ml`` pipelines: training runs as Spark jobs (one per tree level for GBT), scoring
is a projection.  The reference's gradient-boosting settings are kept as named presets; parameters
without a Spark counterpart (``l2_leaf_reg``, ``random_strength``) are recorded but not applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.text import QUICK_TOKEN_RE
from solvara.session import ship_package, write_once

SEED = 536

# The reference's boosting settings per property (trees, learning rate, depth, L2, feature share).
GBT_PRESETS = {
    "viscosity": {"n_estimators": 2000, "learning_rate": 0.03, "depth": None, "l2_leaf_reg": 5,
                  "random_strength": 5, "rsm": 0.8},
    "logp": {"n_estimators": 2459, "learning_rate": 0.06507914893805909, "depth": 7, "l2_leaf_reg": 10},
    "enthalpy": {"n_estimators": 1864, "learning_rate": 0.03346960601160188, "depth": 7, "l2_leaf_reg": 1},
}


def gbt_params(n_estimators: int = 20, learning_rate: float = 0.1, depth: int | None = None,
               rsm: float | None = None, seed: int = SEED, subsample: float = 1.0,
               l2_leaf_reg: float | None = None, random_strength: float | None = None) -> dict:
    """Map boosting names to ``GBTRegressor`` params (depth None -> 6, the boosting library default).

    ``l2_leaf_reg`` and ``random_strength`` have no counterpart there: they are accepted and not applied.  Any
    other name is an error.  ``rsm`` and ``subsample`` below 1 draw features and rows by ``seed``.
    """
    p = {"maxIter": int(n_estimators), "stepSize": float(learning_rate), "seed": seed,
         "subsamplingRate": float(subsample)}
    p["maxDepth"] = int(depth) if depth is not None else 6
    if rsm is not None:
        p["featureSubsetStrategy"] = str(rsm)
    return p


def _assembler(features, out: str = "features"):
    if isinstance(features, str):
        return None, features
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep"), out


def fit_gbt(df: DataFrame, features, label: str, validation_col: str | None = None,
            validation_tol: float = 0.01, **cfg) -> PipelineModel:
    """L1 (+L4): gradient-boosted trees; with ``validation_col`` (a boolean column) training stops when
    the validation error stops improving by ``validation_tol``."""
    asm, fcol = _assembler(features)
    extra = {"validationIndicatorCol": validation_col, "validationTol": validation_tol} if validation_col else {}
    gbt = GBTRegressor(featuresCol=fcol, labelCol=label, predictionCol="pred", **gbt_params(**cfg), **extra)
    stages = ([asm] if asm else []) + [gbt]
    return Pipeline(stages=stages).fit(df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """L2: predictions for every row (all splits at once) -- a projection."""
    out = model.transform(df)
    return out.drop("features") if "features" in out.columns and "features" not in df.columns else out


def n_trees(model: PipelineModel) -> int:
    return int(model.stages[-1].getNumTrees)


def fit_text_regressor(df: DataFrame, text_col: str, label: str, num_features: int = 1 << 12,
                       reg: float = 0.0) -> PipelineModel:
    """L3: regression straight from molecule text: SMILES tokens -> hashed counts -> IDF -> linear model.

    Texts are cut into tokens once: the hashed counts are written, and both fits read them.
    """
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=QUICK_TOKEN_RE, gaps=False,
                         toLowercase=False)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_tfidf")
    lr = LinearRegression(featuresCol="_tfidf", labelCol=label, predictionCol="pred", regParam=reg)
    counted = write_once(tf.transform(tok.transform(df)).select(label, "_tf"), "counts")
    weights = idf.fit(counted)
    return PipelineModel([tok, tf, weights, lr.fit(weights.transform(counted))])


def fit_mean_variance(train: DataFrame, features, label: str, id_col: str = "row_id", folds: int = 2,
                      **cfg) -> tuple[PipelineModel, PipelineModel]:
    """A mean model and a variance model.

    The variance model is fitted to log((y - pred)^2) where pred comes from models that did not see
    the row (``folds``-way hash cross-fitting), so it learns out-of-sample error.  ``unc = exp(.)``.  The training
    rows are written once, as every fit passes over them; a ``seed`` in ``cfg`` also deals the folds.
    """
    from solvara.operators.sampling import k_fold

    cols = list(features)
    train = write_once(train, "train")
    tagged = k_fold(train, id_col, folds, cfg.get("seed", SEED), "_fold")
    oof = None
    for f in range(folds):
        m = fit_gbt(tagged.where(F.col("_fold") != f), cols, label, **cfg)
        part = score(m, tagged.where(F.col("_fold") == f))
        oof = part if oof is None else oof.unionByName(part)
    resid = oof.withColumn("_logr2", F.log(F.pow(F.col(label) - F.col("pred"), 2) + F.lit(1e-12)))
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    var_gbt = GBTRegressor(featuresCol="features", labelCol="_logr2", predictionCol="_logvar",
                           **gbt_params(**cfg))
    var_model = Pipeline(stages=[asm, var_gbt]).fit(resid.drop("pred", "_fold"))
    mean_model = fit_gbt(train, cols, label, **cfg)
    return mean_model, var_model


def predict_mean_variance(mean_model: PipelineModel, var_model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``pred`` and ``unc`` (> 0) to every row."""
    with_pred = score(mean_model, df)
    with_var = var_model.transform(with_pred).drop("features")
    return with_var.withColumn("unc", F.exp(F.col("_logvar"))).drop("_logvar")


def bit_vectors(bits: DataFrame, n_bits: int, bits_col: str = "bits", out: str = "features") -> DataFrame:
    """Sparse 0/1 vectors of fingerprints; bit numbers are known, so no pass is needed to learn a vocabulary."""
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], "_w", out)
    model.setBinary(True)
    return model.transform(bits.withColumn("_w", F.transform(bits_col, lambda b: b.cast("string")))).drop("_w")


def _bit_matrix(column: pa.Array, n_bits: int) -> np.ndarray:
    """Fingerprints of an Arrow batch as rows of zeros and ones (a NULL list: zeros)."""
    sizes, bits = pc.fill_null(pc.list_value_length(column), 0).to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    row, known = np.repeat(np.arange(len(column)), sizes), (bits >= 0) & (bits < n_bits)
    out = np.zeros((len(column), n_bits), dtype="f4")
    out[row[known], bits[known].astype("i8")] = 1
    return out


def _components(bits: DataFrame, bits_col: str, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(axes, share of the variance of each, mean of each bit)`` of fingerprints, the widest axis first.

    Each task counts how often two bits are set together (one matrix product a batch), Spark adds up the counts, and the
    driver decomposes the ``n_bits`` x ``n_bits`` covariance.  The counts are whole numbers, so sums are exact in any order.
    """
    ship_package(bits.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, n = np.zeros((n_bits, n_bits)), 0
        for b in batches:
            for at in range(0, len(b), 2000):
                x = _bit_matrix(b.column(0).slice(at, 2000), n_bits)
                together += x.T @ x
                n += len(x)
        if n:
            rows = np.vstack([together, np.full(n_bits, n)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n_bits + 2, dtype="i4") * n_bits), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bits + 1, dtype="i4")), lists], names=["bit", "counts"])

    counted = bits.select(F.col(bits_col).cast("array<int>")).mapInArrow(count, "bit int, counts array<double>")
    sums = counted.groupBy("bit").agg(Summarizer.sum(array_to_vector("counts")).alias("s")).select("bit", vector_to_array("s").alias("s"))
    found = {r["bit"]: r["s"] for r in sums.collect()}  # n_bits + 1 rows of n_bits numbers
    n = found[n_bits][0] if found else 0
    if n < 2:
        raise ValueError(f"principal components need two rows, not {int(n)}")
    together = np.array([found[i] for i in range(n_bits)])
    mean = together.diagonal() / n
    value, axes = np.linalg.eigh((together - n * np.outer(mean, mean)) / (n - 1))
    value, axes = np.maximum(value[::-1], 0.0), axes[:, ::-1]
    return axes, value / (value.sum() or 1.0), mean


def project_2d(bits: DataFrame, id_col: str = "row_id", bits_col: str = "bits", n_bits: int = 512) -> DataFrame:
    """2-D coordinates of fingerprints (principal components of the centred bit matrix).

    Each axis is centred and its sign fixed so that the largest-magnitude loading is positive.  Returns ``(row_id, x, y)``.
    """
    axes, _, mean = _components(bits, bits_col, n_bits)
    axes = axes[:, :2].copy()
    for j in range(axes.shape[1]):
        axes[:, j] *= 1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0
    centre = mean @ axes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                some = b.slice(at, 2000)
                xy = _bit_matrix(some.column(1), n_bits).astype("f8") @ axes - centre
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, np.ascontiguousarray(xy.T))], names=[id_col, "x", "y"])

    kind = bits.schema[id_col].dataType.simpleString()
    return bits.select(id_col, F.col(bits_col).cast("array<int>")).mapInArrow(place, f"`{id_col}` {kind}, x double, y double")


def explained_variance(bits: DataFrame, bits_col: str = "bits", n_bits: int = 512) -> list[float]:
    """L11 property: explained variance of the first two components (non-increasing)."""
    return [float(x) for x in _components(bits, bits_col, n_bits)[1][:2]]
