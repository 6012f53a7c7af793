"""Quality rules (5): base rules on repeats and length, then boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows, flattened into numpy node arrays and applied to every
document; features whose effect has a known sign are constrained to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import FIT_ROWS, fit_sample, python_tasks

MIN_WORDS, MAX_REPEAT_SHARE, WINDOW = 50, 50, 3
KEEP_FROM = 0.5
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "marks_per_word", "shout_per_word", "distinct_share", "words_per_line", "mark_variety"]
#: More symbols, repeated lines, repeated windows, capitals or exclamation marks never raise the quality.
MONOTONE = {2: -1, 3: -1, 4: -1, 5: -1, 8: -1}


def document_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the trees' features of one whole text (null: empty)."""
    text = text or ""
    words = text.encode("utf-8").split()  # x20 and x09-x0D only
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeat = 0
    if len(seen) < len(windows):
        inside = np.zeros(n + 1, dtype="i4")
        at = np.flatnonzero([seen[x] > 1 for x in windows])
        np.add.at(inside, at, 1)
        np.add.at(inside, at + WINDOW, -1)
        repeat = int((np.cumsum(inside)[:n] > 0).sum())
    upper = sum(map(text.count, _UPPER))
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?"))
    one, letters = max(n, 1), max(chars, 1)
    features = [np.log1p(n), chars / one, symbols / one, dup_lines / max(len(lines), 1), repeat / one, upper / letters,
                digits / letters, marks / one, text.count("!") / one, len(set(words)) / one, n / max(len(lines), 1),
                float(sum(m in text for m in ".,;:?"))]
    return [n, chars, symbols, dup_lines, repeat], features


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Forest for the probability of ``quality = 1``, fitted on at most ``rows`` labelled documents.

    Their feature rows (not their texts) come to the driver: ``rows`` x 12 doubles.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [document_statistics(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), b.column(1)],
                                             names=["x", "label"])

    got = fit_sample(documents, labels, "quality", rows).mapInArrow(run, "x array<double>, label int").collect()
    got = sorted((list(r["x"]), r["label"]) for r in got)
    x = np.array([r[0] for r in got], dtype="f8").reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], dtype="f8"), MONOTONE)


def judge_quality(documents: DataFrame, forest: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """``(doc_id, the five counts, base_failed, quality, kept)`` for every row.

    Null and empty texts have zero counts and fail the base rule; repeated rows are judged alike; only doc_id and
    text are read.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [document_statistics(t) for t in b.column(1).to_pylist()]
            counts = np.array([c for c, _ in both], dtype="i8").reshape(-1, len(STATISTICS))
            score = forest.probability(np.array([x for _, x in both], dtype="f8").reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_SHARE * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[:, i]) for i in range(len(STATISTICS))], pa.array(failed),
                 pa.array(score), pa.array(~failed & (score >= keep_from))],
                names=["doc_id", *STATISTICS, "base_failed", "quality", "kept"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS)
    return rows.mapInArrow(run, schema + ", base_failed boolean, quality double, kept boolean")
