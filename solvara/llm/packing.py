"""Packing (3): concatenate and cut.

Every document's ids, each with a closing separator id, are laid end to end in one virtual stream, which is cut
into windows of a fixed length.  Two passes give each document its place in the stream:

1. tasks encode their documents once and write the ids with the offset inside their own partition;
2. a prefix sum over the partitions' token totals gives each partition's start, so a document's place is
   ``start + inner offset`` and each row can be cut at the window borders on its own.

A document over a border becomes several pieces (boundary records).  All sequences but the last are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, python_tasks
from .prefix import partition_starts
from .word_tokens import tokenizer

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 1


def encode_documents(documents: DataFrame, vocabulary: str, separator: int = SEPARATOR_ID) -> DataFrame:
    """``(part, inner, doc_id, ids, n)``: each row's packed 16-bit ids with the separator, and its offset in its part.

    Null text counts as empty (the separator alone); a null id stays null; repeated rows stay separate rows.
    ``part`` is the task's partition number, so a retried task writes the same rows.
    """
    python_tasks(documents.sparkSession)
    closing = np.array([separator], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, inner = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [x + closing for x in encoder.encode_batch(b.column(1))]
            n = np.array([len(x) // 2 for x in ids], dtype="i8")
            starts = inner + np.cumsum(n) - n
            inner += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, dtype="i4")), pa.array(starts), b.column(0),
                 pa.array(ids, type=pa.binary()), pa.array(n)], names=["part", "inner", "doc_id", "ids", "n"])
        pa.default_memory_pool().release_unused()  # the worker lives on beside those of other tasks

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "part int, inner long, doc_id long, ids binary, n long")


def cut(encoded: DataFrame, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of ``encode_documents`` rows (already written): one row per document and window that it touches.

    Columns: doc_id, start, length, ids (packed 16-bit), ids_crc32, doc_tokens, sequence_id, offset.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    starts = partition_starts(totals, "part", "total", "part_start")
    placed = (encoded.join(F.broadcast(starts), "part")  # one row per partition of the written table
              .select("doc_id", "ids", (F.col("part_start") + F.col("inner")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                total, done = len(ids) // 2, 0
                while done < total:
                    sequence, offset = divmod(at + done, length)
                    take = min(length - offset, total - done)
                    piece = (doc_id, done, take, ids[2 * done:2 * (done + take)],
                             zlib.crc32(wide[4 * done:4 * (done + take)]), total, sequence, offset)
                    for c, x in zip(cols, piece):
                        c.append(x)
                    done += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=PIECE)

    return placed.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in PIECE))


PIECE = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(documents: DataFrame, vocabulary: str, length: int = SEQUENCE_TOKENS,
         separator: int = SEPARATOR_ID) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens; one row per piece, gapless in every sequence.

    An empty table gives no piece; an empty or null text gives one piece of the separator alone; texts of any
    length are cut into as many pieces as they need.  Columns of ``documents`` other than doc_id and text are not
    read, so extra names cannot clash.
    """
    return cut(materialize(encode_documents(documents, vocabulary, separator), "packing"), length)


def sequence_rows(pieces: DataFrame, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """``(sequence_id, n_tokens, padding)`` per sequence.

    A sequence is padded to ``length`` unless its size is a power of two, which needs no padding.
    """
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return used.select("sequence_id", "n_tokens",
                       F.when(power, F.lit(0)).otherwise(F.lit(length) - F.col("n_tokens")).alias("padding"))
