"""Language ID (9): compression classification with per-language zstandard raw-content dictionaries.

Each language's dictionary is a bounded piece of its own training text.  A document is cut into blocks, each block is
compressed with every dictionary, and the language with the smallest sum wins; a narrow margin is rejected.
Both sides are lower-cased and keep letters only, so that shouting, digits and marks do not decide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, learnable, python_tasks

DICTIONARY_BYTES = 32 << 10
DOCS_PER_LANGUAGE = 120
#: Length of the pieces in which a long text enters.
PIECE_BYTES = 256
#: Every worker holds all dictionaries; this bound on their total is checked, no language is dropped for it.
MAX_DICTIONARIES_BYTES = 64 << 20
BLOCK_BYTES = 2 << 10
LEVEL = 5
MIN_MARGIN = 0.005
UNDETERMINED = "und"


_LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-case UTF-8 with everything ASCII but a-z turned into single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def train_dictionaries(documents: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
                       dictionary_bytes: int = DICTIONARY_BYTES, total_bytes: int = MAX_DICTIONARIES_BYTES) -> dict[str, bytes]:
    """Raw dictionary of every language that has learnable text, from a hash-chosen, bounded sample of its documents.

    At most ``docs_per_language`` ids of a language are used; repeated rows and equal texts count once.  All chosen texts
    take part: each gives pieces spread by hash over its whole length, and the dictionary's room is dealt out evenly, with
    what short texts leave going to the longer ones.  Twice ``dictionary_bytes`` per language come to the driver.  Less than
    zstandard needs (8 bytes) is repeated.  More languages than ``total_bytes`` holds dictionaries of are an error.
    """
    python_tasks(documents.sparkSession)
    known = (documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
             .where(learnable(F.col("id")) & F.col("l").isNotNull()))
    most = total_bytes // dictionary_bytes
    counts = known.groupBy("l").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"the table has more than {most} languages, whose dictionaries exceed {total_bytes} bytes")
    rank = {r["l"]: i for i, r in enumerate(sorted(counts, key=lambda r: (-r["count"], r["l"])))}
    order = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    chosen = known.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_language).select("id", "l", "r")
    texts = (documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "text")
             .join(F.broadcast(chosen), ["id", "l"]).select("l", "r", "text"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, r, letters(t)) for lang, r, t in zip(*(c.to_pylist() for c in b.columns)) if t and any(map(str.isalpha, t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], type=pa.string()), pa.array([x[1] for x in rows], type=pa.int32()),
                 pa.array([hashlib.sha256(x[2]).digest() for x in rows], type=pa.binary()),
                 pa.array([spread(x[2], 2 * dictionary_bytes) for x in rows], type=pa.binary())], names=["l", "r", "key", "body"])

    bodies = (texts.mapInArrow(spell, "l string, r int, key binary, body binary")
              .groupBy("l", "key").agg(F.min("r").alias("r"), F.first("body").alias("body")))
    share = F.floor(F.lit(2 * dictionary_bytes) / F.count(F.lit(1)).over(Window.partitionBy("l"))).cast("int")
    parts: dict[str, list[bytes]] = {}
    for row in sorted(bodies.select("l", "r", F.substr("body", F.lit(1), share).alias("piece")).collect()):
        parts.setdefault(row["l"], []).append(bytes(row["piece"]))
    out = {lang: b"\n".join(fill(pieces, dictionary_bytes)) for lang, pieces in parts.items()}
    out = {lang: raw if len(raw) >= 8 else b" ".join([raw] * 8) for lang, raw in out.items()}
    return {lang: out[lang] for lang in sorted(out, key=rank.get)}  # ties go to the commonest


def spread(body: bytes, most: int) -> bytes:
    """At most ``most`` bytes of a text: all of it, or pieces of PIECE_BYTES in an order by hash over its whole length."""
    pieces = [body[i:i + PIECE_BYTES] for i in range(0, len(body), PIECE_BYTES)]
    order = sorted(range(len(pieces)), key=lambda i: zlib.crc32(b"%d:%d" % (i, len(body))))
    return b"".join(pieces[i] for i in order)[:most]


def fill(pieces: list[bytes], room: int) -> list[bytes]:
    """The beginnings of the pieces, joined by one byte each, that fill ``room``: one length for all but the shorter ones."""
    left, out = room, {}
    for n, i in enumerate(sorted(range(len(pieces)), key=lambda i: (len(pieces[i]), i))):
        share = left // (len(pieces) - n) - 1
        out[i] = pieces[i][:max(0, share)]
        left -= len(out[i]) + 1
    return [out[i] for i in range(len(pieces)) if out[i]]


class Classifier:
    """Compressors of one worker: the digested dictionaries are made once."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.languages = list(dictionaries)
        self.compressors = []
        for raw in dictionaries.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            # optimal parsing with 3-byte matches: short pieces of words count, which greedy levels overlook
            settings = z.ZstdCompressionParameters.from_level(
                level, source_size=BLOCK_BYTES, dict_size=len(raw), write_content_size=False,
                strategy=z.STRATEGY_BTOPT, min_match=3, search_log=5)
            d.precompute_compress(compression_params=settings)
            self.compressors.append(z.ZstdCompressor(dict_data=d, compression_params=settings))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted) of one whole text."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        body = letters(text)
        blocks = [body[i:i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], dtype="f8")
        best = int(sizes.argmin())  # ties: the first language, which is the commonest
        if len(sizes) == 1:
            return self.languages[best], 1.0, True
        margin = float((np.partition(sizes, 1)[1] - sizes[best]) / max(1, len(body)))
        return self.languages[best], float(1 - np.exp(-margin / 0.02)), margin >= MIN_MARGIN


def identify_language(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` for every row.

    Null text or text without a letter: ``und`` with score 0.  accepted is false where the margin is narrow; the
    best language is still named.  Repeated rows are judged alike and only doc_id and text are read.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for b in batches:
            got = [judge.classify(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], type=pa.string()),
                 pa.array([g[1] for g in got], type=pa.float64()), pa.array([g[2] for g in got], type=pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
