"""Token ids of whole texts by a public word-level BPE, with each distinct word encoded once per worker.

In this vocabulary white space only separates, so a text's ids are the ids of its white-space chunks in order, and those
of a chunk of letters between marks are the ids of its parts.  A batch of texts is split and its chunks numbered by Arrow;
Python only sees the batch's distinct words, the library only words that the worker has not met (a bounded table),
and the ids are put together with numpy.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and odd chunks whose ids a worker keeps; beyond, the oldest half goes.
CACHE_CHUNKS = 200_000
#: Bytes of texts that are encoded at once (a longer text goes alone).
SLICE_BYTES = 2_000_000
#: Words per call of the library.
CALL_WORDS = 100
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOADED: dict[str, "WordTokenizer"] = {}


def tokenizer(path: str) -> "WordTokenizer":
    """The worker's tokenizer for a vocabulary file (loaded once per Python worker)."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


@lru_cache(maxsize=1 << 12)
def _stays_letter(last: str) -> bool:
    """Whether NFC and lower-casing leave one letter: a combining mark at the end would join a following '.' or ','."""
    plain = unicodedata.normalize("NFC", last).lower()
    return len(plain) == 1 and plain.isalpha()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``pool`` one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokenizer:
    """Encodes UTF-8 texts to little-endian unsigned 16-bit ids; equals the library's encoding of each whole text.

    A chunk of letters between ASCII marks is three pre-tokens at most, so its ids are those of its parts, and words that
    the normalizer would leave alone go to a copy of the tokenizer without it (its passes cost more than the merges).
    Anything else is encoded whole by the full tokenizer.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.words_only = Tokenizer.from_file(path)
        self.words_only.normalizer = None
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        assert self.full.get_vocab_size() <= 1 << 16, "ids are stored in 16 bits"
        self.ends_word = np.zeros(1 << 16, dtype=bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cache_chunks = cache_chunks
        self.marks: dict[str, bytes] = {"": b""}
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _learn_whole(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.full.encode_batch_fast(chunks, add_special_tokens=False)):
            self.cache[c] = np.array(e.ids, dtype="<u2").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Words that the normalizer leaves alone: several per call, cut apart where an id ends a word."""
        calls = [words[i:i + CALL_WORDS] for i in range(0, len(words), CALL_WORDS)]
        for part, e in zip(calls, self.words_only.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u2")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                self._learn_whole(part)
                continue
            flat, at = ids.tobytes(), 0
            for w, end in zip(part, (ends * 2).tolist()):
                self.cache[w] = flat[at:end]
                at = end

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._whole(mark)
        return self.marks[mark]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pool, starts, sizes)``: where the ids of each chunk lie."""
        body = pc.ascii_rtrim(chunks, characters=_MARKS)
        word = pc.ascii_ltrim(body, characters=_MARKS)
        letters = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False).copy()
        n_chunk, n_body, n_word = (pc.binary_length(a).to_numpy() for a in (chunks, body, word))
        marked = np.flatnonzero(letters & (n_chunk > n_word))
        around: dict[int, tuple[str, str]] = {}
        for i, c, w, b in zip(marked.tolist(), *(_strings(a.take(marked)) for a in (chunks, word, body))):
            before, after = b[:len(b) - len(w)], c[len(b):]  # marks are ASCII, so characters can be counted
            if before.endswith("'") or after and not (w[-1].isascii() or _stays_letter(w[-1])):
                letters[i] = False  # it may be a contraction, or a mark joins the word's last letter
            else:
                around[i] = (before, after)
        core = pc.if_else(pa.array(letters), word, chunks).dictionary_encode()
        names = _strings(core.dictionary)
        known = self.cache
        new = [c for c in names if c not in known]
        if new:
            fixed = [c for c in new if c.isalpha() and (c.isascii() or c == c.lower() and unicodedata.is_normalized("NFC", c))]
            self._learn_words(fixed)
            self._learn_whole(list(set(new).difference(fixed)))
        ids = [known[c] for c in names]
        used = sorted({m for pair in around.values() for m in pair})
        ids += [self._mark(m) for m in used]
        pool = np.frombuffer(b"".join(ids), dtype="<u2")
        size_of = np.fromiter(map(len, ids), dtype="i8", count=len(ids)) // 2
        start_of = np.cumsum(size_of) - size_of
        index = core.indices.to_numpy()
        if not around:
            return pool, start_of[index], size_of[index]
        place = {m: len(names) + i for i, m in enumerate(used)}
        nothing = place.setdefault("", len(names) + len(used))
        size_of, start_of = np.append(size_of, 0), np.append(start_of, 0)
        parts = np.full((len(index), 3), nothing, dtype="i8")
        parts[:, 1] = index
        for i, (before, after) in around.items():
            parts[i, 0], parts[i, 2] = place[before], place[after]
        sizes = size_of[parts].sum(axis=1)
        return _gather(pool, start_of[parts].ravel(), size_of[parts].ravel()), np.cumsum(sizes) - sizes, sizes

    def encode_batch(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        """Ids of each text (null: none) as packed 16-bit integers."""
        raw = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype("i8")
        piece = (np.cumsum(size) - size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(raw)]
        return [ids for a, z in zip(cuts, cuts[1:]) if z > a for ids in self._encode(raw.slice(a, z - a))]

    def _encode(self, raw: pa.Array) -> list[bytes]:
        if len(self.cache) > self.cache_chunks:
            for c in list(islice(self.cache, len(self.cache) // 2)):
                del self.cache[c]
        if len(self.marks) > self.cache_chunks:
            self.marks = {"": b""}
        try:
            text = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # not UTF-8
            text = pa.array([None if t is None else t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.large_string())
        special = pc.fill_null(pc.match_substring(text, "<|"), False)  # a spelt-out special token is found before lower-casing
        plain = pc.if_else(special, "", pc.fill_null(text, ""))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = lists.flatten().dictionary_encode()
        pool, starts, sizes = self._chunk_ids(coded.dictionary)
        index = coded.indices.to_numpy()
        flat = _gather(pool, starts[index], sizes[index]).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[lists.offsets.to_numpy()] * 2
        out = [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._whole(text[i].as_py())
        return out
