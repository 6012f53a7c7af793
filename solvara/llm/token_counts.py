"""Token counts (10): separator scan over flat, unindexed token files.

A file is a plain run of little-endian 16-bit ids; an id outside the vocabulary ends each document and there is no index.  Tasks
take fixed blocks of a file, find the separators with one vectorised comparison, and a prefix scan over the blocks
(documents ended so far, place of the last separator) stitches documents that lie over block borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, python_tasks
from .word_tokens import tokenizer

BLOCK_BYTES = 1 << 20
#: Larger than any id of the vocabulary (49,408 ids), so that no text holds it, not even a spelt-out special token.
END_OF_DOCUMENT = 0xFFFF


def _open(path: str):
    """(file system, path) from a folder's URI: local shared mounts, HDFS or object stores that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(documents: DataFrame, vocabulary: str, folder: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Encode all documents into flat token files below ``folder``; return ``(file, ordinal, doc_id, bytes)``.

    One file per task, named by partition and attempt, so a lost or repeated attempt leaves a file that nothing lists.
    There is a row per document (its ordinal in its file) and one with ordinal -1 that gives the file's size.
    Null text: no ids, only the separator.  ``end`` must lie outside the vocabulary (checked), so a text's own ids all count.
    """
    python_tasks(documents.sparkSession)
    closing = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = tokenizer(vocabulary), TaskContext.get()
        if end < encoder.full.get_vocab_size():
            raise ValueError(f"{end} is an id of the vocabulary and cannot end documents")
        name = f"{context.partitionId():07d}-{context.taskAttemptId()}.tokens"
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        ordinal, size = 0, 0

        def rows(ordinals, ids, sizes):
            k = len(ordinals)
            return pa.RecordBatch.from_arrays([pa.array([name] * k, type=pa.string()), pa.array(ordinals, type=pa.int64()),
                                               ids, pa.array(sizes, type=pa.int64())],
                                              names=["file", "ordinal", "doc_id", "bytes"])

        with store.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for ids in encoder.encode_batch(b.column(1)):
                    out.write(ids + closing)
                    size += len(ids) + 2
                n = b.num_rows
                yield rows(range(ordinal, ordinal + n), b.column(0), [None] * n)
                ordinal += n
        if ordinal:
            yield rows([-1], pa.array([None], type=pa.int64()), [size])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "file string, ordinal long, doc_id long, bytes long")


def scan_separators(files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files: ``(file, ordinal, start, n_tokens, ended)``; n_tokens leaves out the separator.

    ``files`` has ``(file, bytes)``.  Ids after a file's last separator form a last document with ended = false.
    Empty files have no document.  A block's list of separators is bounded by the block's size.
    """
    spark = files.sparkSession
    blocks = (files.where("bytes > 0")
              .select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes).cast("long"))).alias("block"))
              .repartition(F.col("file"), F.col("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for b in batches:
            for name, size, block in zip(*(c.to_pylist() for c in b.columns)):
                at = block * block_bytes
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - at), at), dtype="<u2")
                ends = np.flatnonzero(ids == end) + at // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([size // 2]), pa.array([block]), pa.array([len(ends)]),
                     pa.array([int(ends[-1]) if len(ends) else None], type=pa.int64()),
                     pa.array([ends.tolist()], type=pa.list_(pa.int64()))],
                    names=["file", "tokens", "block", "n", "last", "ends"])

    found = materialize(blocks.mapInArrow(run, "file string, tokens long, block long, n long, last long, ends array<long>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                         F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("from"))  # a file's blocks: a few numbers each
    placed = found.where("n > 0").join(carry, ["file", "block"])
    starts = F.concat(F.array("from"), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    ended = (placed.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "d"))
             .select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("d.s").alias("start"),
                     (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("ended")))
    tails = (found.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("ordinal"),
                                       F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"))
             .where("start < tokens").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"),
                                             F.lit(False).alias("ended")))
    return ended.union(tails)


def count_document_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, file, ordinal, start)``: each document's token count, found by the separator scan.

    Null and empty texts count 0 tokens; repeated rows are counted each; an empty table gives an empty result.
    """
    folder = shared_path(documents.sparkSession, "tokens")
    written = materialize(write_token_files(documents, vocabulary, folder), "token-files")
    files = written.where("ordinal = -1").select("file", "bytes")
    ids = written.where("ordinal >= 0").select("file", "ordinal", "doc_id")
    return (scan_separators(files, folder).join(ids, ["file", "ordinal"])
            .select("doc_id", "n_tokens", "file", "ordinal", "start"))
