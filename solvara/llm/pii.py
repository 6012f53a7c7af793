"""PII (7): candidate gradient boosting.

Exact base patterns find e-mail, IP, card and phone spans.  High-recall generators propose further, overlapping
candidates (written-out e-mails, numbers with other separators or no prefix); boosted trees judge each by format and
context features, and a threshold per kind, calibrated on candidates kept out of the fit, selects what is added.
Base spans always stay; an added span never overlaps a base span or a better added one.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import FIT_ROWS, learnable, python_tasks

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
_LOCAL_END = re.compile(f"[{_LOCAL}]*+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IS_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ so that a long run without one is not searched again and again."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _IS_LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[Span]:
    """A dotted run of numbers holds its matches four parts at a time, from the left."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at, spans = run.group().split("."), run.start(), []
        for p in parts:
            spans.append((at, at + len(p)))
            at += len(p) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[i:i + 4]):
                yield "ip", spans[i][0], spans[i + 3][1]


def base_spans(text: str | None) -> list[Span]:
    """The base kinds' spans in order of start, then of kind."""
    text = text or ""
    found = [*_emails(text), *_ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found.extend(("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15)
    return sorted(found, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# Generators of further candidates: wider than the base patterns, with bounded repeats so that they stay linear.
_GENERATORS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({]?(?:\s?@\s?|\s?\b(?i:at)\b\s?)[\])}]?\s?"
                         r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]?\s?\b(?i:dot|punto|point|punkt)\b\s?[\])}]?\s?)[A-Za-z0-9-]{1,63}){1,5}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[.\[\](),_-]{1,3}\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){13,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ()./-]{0,3}[0-9]){8,14}(?![0-9])")),
]
_WRITTEN_AT = re.compile(r"\b(?i:at)\b")
# Every proposed e-mail holds one of these, so a text without them has none.
_EMAIL_HINT = re.compile(rf"@|{_WRITTEN_AT.pattern}")
_NEAR = 40
# Words that announce each kind, in the four languages.
_ANNOUNCE = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "dirección", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono", "whatsapp"),
}
FEATURES = ["kind", "length", "n_digits", "n_separators", "n_separator_kinds", "luhn", "n_parts", "largest_part",
            "plus", "brackets", "written_at", "written_dot", "at_sign", "dots", "spaces", "largest_group", "announced",
            "letter_before", "letter_after", "digit_share", "word_before", "top_level"]
_WRITTEN_DOT = re.compile(r"\b(?i:dot|punto|point|punkt)\b")


def candidates(text: str) -> list[Span]:
    """All generators' proposals; they may overlap each other and the base spans."""
    out: list[Span] = []
    has_digit = _SOME_DIGITS.search(text) is not None
    for kind, pattern in _GENERATORS:
        if kind == "email" and not _EMAIL_HINT.search(text) or kind != "email" and not has_digit:
            continue
        out.extend((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return out


_SOME_DIGITS = re.compile(r"[0-9][^0-9]{0,6}[0-9][^0-9]{0,6}[0-9][^0-9]{0,6}[0-9]")
_SEPARATORS = re.compile(r"[^A-Za-z0-9]")
_NUMBERS = re.compile(r"[0-9]+")


def span_features(text: str, span: Span) -> list[float]:
    """Format of the span and its near context."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - _NEAR):a], text[b:b + 2]
    digits, seps, groups = _digits(s), _SEPARATORS.findall(s), _NUMBERS.findall(s)
    tail = s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
    return [KINDS.index(kind), len(s), len(digits), len(seps), len(set(seps)), float(len(digits) > 1 and luhn(digits)),
            len(groups), float(min(max([int(g[:9]) for g in groups], default=0), 10**6)), float(s.startswith("+")),
            float("(" in s) + float("[" in s), float(bool(_WRITTEN_AT.search(s))), float(bool(_WRITTEN_DOT.search(s))),
            float("@" in s), s.count("."), s.count(" "), max(map(len, groups), default=0),
            float(any(w in before.lower() for w in _ANNOUNCE[kind])), float(before[-1:].isalpha()), float(after[:1].isalpha()),
            len(digits) / max(1, len(s)), float(bool(re.search(r"[^\W\d_]\s$", before))), float(2 <= len(tail) <= 6 and tail.isalpha())]


def _variants(text: str, span: Span, pick: int) -> list[tuple[str, Span, int]]:
    """Training cases from one base span: (text, span, label) of it, of rewritten forms and of spoilt ones."""
    kind, a, b = span
    s, head, tail = text[a:b], text[max(0, a - _NEAR):a], text[b:b + 4]
    good, bad = [s], []
    d = _digits(s)
    if kind == "email":
        user, _, host = s.partition("@")
        good += [f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host}"]
        bad += [f"{user[:4]} at {host.split('.')[0][:5]}.{(user[-3:] or 'x')}", f"look at {user[:3]}.{host[:4]}"]
    elif kind == "ip":
        parts = s.split(".")
        good += ["[.]".join(parts), " . ".join(parts)]
        bad += [".".join(parts[:2] + [str(300 + pick % 600)] + parts[3:]), "-".join(["20" + parts[0][:2].zfill(2), "10", "11", "12"]),
                ".".join([*parts[:3], str(256 + pick % 700)])]
    elif kind == "card":
        good += [".".join(re.findall(".{1,4}", d)), "/".join(re.findall(".{1,4}", d))]
        wrong = d[:-1] + str((int(d[-1]) + 1 + pick % 9) % 10)
        bad += [wrong, " ".join(re.findall(".{1,4}", wrong)), d[:-1] + "." + str((int(d[-1]) + 3) % 10)]
    else:
        good += ["00" + s[1:], s.replace(" ", "-"), f"({d[1:4]}) {d[4:7]}-{d[7:]}", f"{d[1:4]}-{d[4:7]}-{d[7:]}"]
        bad += [d[:9], d[:10], f"20{d[-2:]}-{d[:2]}-{d[2:4]} {d[4:6]}.{d[6:8]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]
    out = []
    for label, forms in ((1, good), (0, bad)):
        for form in forms:
            out.append((head + form + tail, (kind, len(head), len(head) + len(form)), label))
    return out


@dataclass
class SpanModel:
    """Trees and, per kind, the lowest probability at which a candidate is added."""

    forest: Forest
    thresholds: dict[str, float]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans) of one whole text, both ordered."""
        base = base_spans(text)
        free = _Free(base)
        extra = [c for c in candidates(text or "") if free.holds(c)] if text else []
        if not extra:
            return base, base
        p = self.forest.probability(np.array([span_features(text, c) for c in extra]))
        taken: list[tuple[int, int, str]] = []  # by place; they never meet, so the neighbours tell all
        for i in sorted(range(len(extra)), key=lambda i: (-p[i], _order(extra[i]))):
            kind, a, b = extra[i]
            at = bisect.bisect_left(taken, (b,))
            if p[i] >= self.thresholds[kind] and not (at and taken[at - 1][1] > a):
                taken.insert(at, (a, b, kind))
        taken = [(kind, a, b) for a, b, kind in taken]
        return base, sorted([*base, *taken], key=_order)


class _Free:
    """What lies outside some spans, which may overlap each other in any way."""

    def __init__(self, spans: list[Span]):
        places = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in places]
        self.reach = list(accumulate((b for _, b in places), max))  # the furthest end up to each start

    def holds(self, c: Span) -> bool:
        i = bisect.bisect_left(self.starts, c[2])
        return not i or self.reach[i - 1] <= c[1]


LEAST_PRECISION = 0.97
#: Training cases taken from one text at most: base spans, and candidates that are none.
BASE_CASES, OTHER_CASES = 4, 8


def train(documents: DataFrame, rows: int = FIT_ROWS) -> SpanModel:
    """Trees fitted on candidates of at most ``rows`` learnable documents that hold a base span.

    An id that several rows have counts once, with its smallest text.  Cases are base spans, rewritten forms of them (label 1) and spoilt or unrelated ones (label 0).  A quarter of the
    texts is kept out of the fit and sets each kind's threshold: the lowest at which ``LEAST_PRECISION`` holds.
    Only the cases' features come to the driver.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold, kinds = [], [], [], []
            for text in b.column(0).to_pylist():
                base, pick = base_spans(text), len(text) * 7919 % 1000
                cases = [v for s in base[:BASE_CASES] for v in _variants(text, s, pick)]
                free = _Free(base)
                cases += [(text, c, 0) for c in candidates(text)[:OTHER_CASES] if free.holds(c)]
                for t, s, label in cases:
                    x.append(span_features(t, s))
                    y.append(label)
                    fold.append(pick % 4)
                    kinds.append(s[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), pa.array(y, type=pa.int32()),
                                              pa.array(fold, type=pa.int32()), pa.array(kinds, type=pa.string())],
                                             names=["x", "y", "fold", "kind"])

    maybe = F.col("text").rlike(r"@|[0-9][^0-9]?[0-9][^0-9]?[0-9]")
    ids = (documents.where(learnable(F.col("doc_id")) & maybe).select(F.col("doc_id").alias("id")).distinct()
           .orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = (documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id").where(maybe)
             .groupBy("id").agg(F.min("text").alias("text")).select("text"))
    got = texts.mapInArrow(run, "x array<double>, y int, fold int, kind string").toArrow()  # a bounded sample's features
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y, fold = got["y"].to_numpy().astype("f8"), got["fold"].to_numpy()
    kind = np.array(KINDS)[x[:, 0].astype("i4")]
    order = np.lexsort((*x.T, y, fold))  # the same forest for any partitioning
    x, y, fold, kind = x[order], y[order], fold[order], kind[order]
    forest = fit(x[fold != 0], y[fold != 0], trees=40, depth=5)
    thresholds = {}
    for k in KINDS:
        mine = (fold == 0) & (kind == k)
        thresholds[k] = _calibrate(forest.probability(x[mine]), y[mine])
    return SpanModel(forest, thresholds)


def _calibrate(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest score, 0.5 at least, from which the share of positives is LEAST_PRECISION; above 1 if there is none."""
    for cut in np.arange(0.5, 1.0, 0.02):
        chosen = y[p >= cut]
        if len(chosen) >= 5 and chosen.mean() >= LEAST_PRECISION:
            return float(cut)
    return 2.0


def _spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(documents: DataFrame, model: SpanModel) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    The counts and the hash are those of the base spans; spans holds all.  Places are code points, ends exclusive.
    Null and empty texts have none; repeated rows are judged alike; only doc_id and text are read.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.spans(t) for t in b.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in got] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, type=pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(_spell(base).encode()).hexdigest() for base, _ in got], type=pa.string()),
                 pa.array([_spell(every) for _, every in got], type=pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: SpanModel) -> DataFrame:
    """All rows and columns, with the found spans replaced in ``text``; n_chars, if there, follows the new text."""
    python_tasks(documents.sparkSession)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, model.spans(t)[1]) for t in text], dtype=object)

    out = documents.withColumn("text", clean(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
