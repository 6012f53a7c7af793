"""Toxicity (4): a weighted finite-state pattern grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech).  Each class has a small transducer, a
table of states whose arcs rewrite the symbols that pass; :func:`compose` joins them by the product of their states into
one machine that reads a clause and writes its matches: a plain, targeted, negated or reported insult, or a threat.  A
document's score comes from its matched clauses, not from isolated words.

Insult entries (words or word beginnings), further threat and reporting words, and all weights are learned from a bounded
sample of labelled rows; the word lists below are what every grammar starts with.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_ROWS, fit_sample, held_out, materialize, python_tasks

# Closed word classes in English, French, German and Spanish.
THREATS = ("kill hurt destroy punish beat shoot stab burn tuer frapper blesser massacrer töten schlagen verletzen "
           "vernichten matar golpear herir destruir").split()
TARGETS = ("you your yours yourself he she him her they them their tu toi vous votre vos ils elles leur du dich dir "
           "dein deine ihr euch tú usted ustedes ellos ellas vosotros").split()
NEGATIONS = ("not no never none nobody isn aren wasn don doesn pas jamais aucun nicht kein keine nie niemals "
             "nunca jamás ningún tampoco").split()
REPORTING = ("said says say called calls wrote claimed quoted quote reported dit disait écrit appelé sagte sagt "
             "schrieb nannte behauptete dijo dice escribió llamó afirmó").split()

#: Symbols: the classes of words, then what the machines write for them.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, NEGATED, REPORTED, MATCH = range(9)
N_SYMBOLS = 9
KINDS = ["plain", "targeted", "negated", "reported", "threat"]
NEGATION_REACH = 3
#: An entry must occur in so many different positive texts, and per word this much more often in them than elsewhere;
#: of all entries tested, so many may pass by chance alone (expected number).
LEAST_TEXTS, LEAST_RATIO, BY_CHANCE = 3, 10.0, 0.5
PREFIXES = (4, 5, 6)
PREDICT_FROM = 0.3
SUM_CAP = 20.0
N_FEATURES = 2 * len(KINDS) + 1
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[^.!?;:\n]+")


@dataclass(frozen=True)
class Machine:
    """A transducer over the symbols: per state and symbol read, the next state, the symbol written and a weight; and per
    state whether a clause that ends there is aimed at someone.  State 0 is the start."""

    after: np.ndarray
    write: np.ndarray
    weight: np.ndarray
    aimed: np.ndarray

    @classmethod
    def of(cls, states: int, arcs: dict[tuple[int, int], tuple[int, int]], aimed=()) -> "Machine":
        """Arcs ``(state, symbol) -> (next state, symbol written)``; any other symbol passes and the state stays."""
        after = np.repeat(np.arange(states)[:, None], N_SYMBOLS, axis=1)
        write = np.repeat(np.arange(N_SYMBOLS)[None], states, axis=0)
        for (state, symbol), (then, out) in arcs.items():
            after[state, symbol], write[state, symbol] = then, out
        return cls(after, write, np.ones((states, N_SYMBOLS)), np.isin(np.arange(states), list(aimed)))

    def run(self, symbols: list[int]) -> tuple[list[int], list[float], bool]:
        state, out, weights = 0, [], []
        for s in symbols:
            out.append(int(self.write[state, s]))
            weights.append(float(self.weight[state, s]))
            state = self.after[state, s]
        return out, weights, bool(self.aimed[state])


def compose(first: Machine, second: Machine) -> Machine:
    """One machine that does what ``second`` does to the output of ``first``: states are the reachable pairs."""
    pairs, numbers = [(0, 0)], {(0, 0): 0}
    after, write, weight = [], [], []
    for i, j in pairs:  # grows while new pairs are reached
        row = []
        between = first.write[i]
        for s in range(N_SYMBOLS):
            pair = (int(first.after[i, s]), int(second.after[j, between[s]]))
            if pair not in numbers:
                numbers[pair] = len(pairs)
                pairs.append(pair)
            row.append(numbers[pair])
        after.append(row)
        write.append(second.write[j, between])
        weight.append(first.weight[i] * second.weight[j, between])
    return Machine(np.array(after), np.array(write), np.array(weight), np.array([first.aimed[i] or second.aimed[j] for i, j in pairs]))


def machines() -> list[Machine]:
    """Negation, reported speech, threat, target and insult, in the order in which a clause passes them."""
    # the state counts down the words that the negation still covers, from the word after it
    negation = {}
    for left in range(NEGATION_REACH + 1):
        covered = max(0, left - 1)
        for symbol in range(N_SYMBOLS):
            negation[left, symbol] = (covered, symbol)
        if covered:
            negation[left, INSULT], negation[left, THREAT] = (covered, NEGATED), (covered, OTHER)
        negation[left, NEGATION] = (NEGATION_REACH, NEGATION)
    report = {(0, REPORT): (1, REPORT), (1, INSULT): (1, REPORTED), (1, NEGATED): (1, REPORTED), (1, THREAT): (1, OTHER)}
    threat = {(0, THREAT): (1, OTHER), (1, THREAT): (1, OTHER), (1, TARGET): (0, MATCH)}  # waits for its target
    target = {(0, TARGET): (1, TARGET), (0, MATCH): (1, MATCH)}
    insult = {(0, s): (0, OTHER) for s in (THREAT, TARGET, NEGATION, REPORT)}  # only matches leave the last machine
    return [Machine.of(NEGATION_REACH + 1, negation), Machine.of(2, report), Machine.of(2, threat),
            Machine.of(2, target, aimed=(1,)), Machine.of(1, insult)]


CLAUSE_MACHINE = reduce(compose, machines())
_AFTER, _WRITE, _WEIGHT, _AIMED = (getattr(CLAUSE_MACHINE, f).tolist() for f in ("after", "write", "weight", "aimed"))


@dataclass
class Grammar:
    """Insult entries with weights (``word$`` whole, else a beginning), learned threat and reporting words, and the clause
    kinds' learned weights."""

    entries: dict[str, float]
    weights: np.ndarray
    bias: float
    threats: tuple[str, ...] = ()
    reports: tuple[str, ...] = ()

    def __post_init__(self):
        whole = [re.escape(e[:-1]) for e in self.entries if e.endswith("$")] + [re.escape(w) for w in (*THREATS, *self.threats)]
        start = [re.escape(e) for e in self.entries if not e.endswith("$")]
        first = "|".join(f"(?:{x})(?![^\\W\\d_])" for x in whole)
        self.trigger = re.compile("(?<![^\\W\\d_])(?:" + "|".join([first, *start]) + ")")
        closed = ((self.reports, REPORT), (self.threats, THREAT), (REPORTING, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT))
        self.classes = {w: c for words, c in closed for w in words}

    def __reduce__(self):
        return Grammar, (self.entries, self.weights, self.bias, self.threats, self.reports)

    def classify(self, word: str) -> tuple[int, float]:
        """The lexical transducer: a word's class and weight."""
        weight = self.entries.get(word + "$", 0.0)
        for k in PREFIXES:
            weight = max(weight, self.entries.get(word[:k], 0.0) if len(word) >= k else 0.0)
        return (INSULT, weight) if weight else (self.classes.get(word, OTHER), 1.0)

    def clause(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """(kind, weight) of each match in one clause: the composed machine walks over the words' classes."""
        state, insults = 0, []
        for word in words:
            symbol, weight = self.classify(word)
            out, weight = _WRITE[state][symbol], weight * _WEIGHT[state][symbol]
            state = _AFTER[state][symbol]
            if out == INSULT:
                insults.append(weight)
            elif out == NEGATED:
                yield "negated", weight
            elif out == REPORTED:
                yield "reported", weight
            elif out == MATCH:
                yield "threat", weight
        for weight in insults:  # a target may follow the insult, so the clause's last state decides
            yield ("targeted" if _AIMED[state] else "plain"), weight

    def features(self, text: str | None) -> list[float]:
        """Per kind: the matches' summed weight on a log scale and up to SUM_CAP; then all weight per 100 words.

        Words that toxic texts only use more often than others have small weights: one of them says little.
        """
        sums = dict.fromkeys(KINDS, 0.0)
        low = (text or "").lower()
        words = 1
        if low and self.trigger.search(low):
            words = len(low.split()) + 1
            for c in _CLAUSE.finditer(low):
                if self.trigger.search(low, c.start(), c.end()):
                    for kind, weight in self.clause(_WORD.findall(low, c.start(), c.end())):
                        sums[kind] += weight
        total = sum(sums.values())
        return ([float(np.log1p(sums[k])) for k in KINDS] + [min(sums[k], SUM_CAP) / SUM_CAP for k in KINDS]
                + [min(100.0 * total / max(words, 20), SUM_CAP) / SUM_CAP])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _entries_of(text: str | None) -> tuple[Counter, int, int]:
    """A text's candidate entries with counts, its words, and a key that near copies mostly share.

    The key comes from the four smallest word hashes.
    """
    words = Counter(_WORD.findall((text or "").lower()))
    found: Counter = Counter()
    for w, n in words.items():
        if len(w) >= 3:
            found[w + "$"] += n
        for k in PREFIXES:
            if len(w) >= k:
                found[w[:k]] += n
    key = zlib.crc32(repr(sorted(zlib.crc32(w.encode()) for w in words)[:4]).encode())
    return found, sum(words.values()), key


def _chance(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Upper (Chernoff) bound of the chance that k or more of n fall on a side that has the share p."""
    q = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        miss = np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0.0)
    return np.where(q > p, np.exp(-n * (q * np.log(q / p) + miss)), 1.0)


def _learn_entries(sample: DataFrame) -> dict[str, float]:
    """Entries used far more often in positive rows; copies of a text count once, so that they cannot vote together.

    Of positive rows near copies count once too.  Their key also joins different texts of few words, which for the
    more numerous other rows would hide how much clean text lacks an entry.
    """
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return {}

    def spell(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for t in b.column(0).to_pylist():
                    found, words, key = _entries_of(t)
                    key = key if only is None else zlib.crc32((t or "").lower().encode("utf-8", "replace"))
                    rows += [(e, key, found[e]) for e in (found.keys() if only is None else found.keys() & only)] + [("", key, words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.int64()),
                                                  pa.array([r[2] for r in rows], type=pa.int64())], names=["entry", "key", "n"])

        return run

    def counted(label: int, only: set[str] | None) -> DataFrame:
        return (sample.where(F.col("label") == label).select("text").mapInArrow(spell(only), "entry string, key long, n long")
                .groupBy("entry", "key").agg(F.max("n").alias("n"))
                .groupBy("entry").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")))

    positive = {r["entry"]: (r["n"], r["texts"])  # entries of a bounded sample
                for r in counted(1, None).where((F.col("texts") >= LEAST_TEXTS) | (F.col("entry") == "")).collect()}
    words_pos, _ = positive.pop("", (0, 0))
    other = {r["entry"]: (r["n"], r["texts"]) for r in counted(0, set(positive)).collect()}
    words_neg, _ = other.pop("", (0, 0))
    if not positive or not words_neg:
        return {}
    frequent = {e: n for e, (n, _) in positive.items()}
    k = np.array([t for _, t in positive.values()], dtype="f8")
    both = k + np.array([other.get(e, (0, 0))[1] for e in positive], dtype="f8")
    chance = dict(zip(positive, _chance(k, both, words_pos / (words_pos + words_neg))))
    starts = sorted(e for e in frequent if not e.endswith("$"))
    chosen: dict[str, float] = {}
    covered: set[str] = set()
    for e in sorted(frequent, key=lambda e: (e.endswith("$"), len(e), e)):
        ratio = (frequent[e] + 0.5) / (words_pos + 1) / ((other.get(e, (0, 0))[0] + 0.5) / (words_neg + 1))
        if (ratio >= LEAST_RATIO and chance[e] * len(chance) <= BY_CHANCE
                and not any(e[:k] in covered for k in PREFIXES if k <= len(e.rstrip("$")))):
            covered.add(e)
            # a longer beginning that is nearly as frequent says the same of fewer clean words
            longer = []
            for x in islice(starts, bisect_left(starts, e), None):
                if not x.startswith(e):
                    break
                if frequent[x] >= 0.98 * frequent[e]:
                    longer.append(x)
            chosen[max(longer, key=lambda x: (len(x), frequent[x], x), default=e)] = float(np.log(ratio))
    return chosen


def _learn_words(sample: DataFrame, entries: dict[str, float]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Threat and reporting words beyond the lists, learned from the same sample.

    A reporting word stands in clauses with an insult entry far more often where the text is not toxic; a threat word
    stands in clauses with a target far more often where a text without insult entries is toxic.  Equal texts count once,
    and the same significance test as for insults keeps chance finds out.
    """
    raw = Grammar(entries, np.zeros(N_FEATURES), 0.0)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = (text or "").lower()
                key, insulted, found = zlib.crc32(low.encode("utf-8", "replace")), False, {"r": set(), "t": set()}
                for c in _CLAUSE.finditer(low):
                    words = set(_WORD.findall(low, c.start(), c.end()))
                    symbols = {w: raw.classify(w)[0] for w in words}
                    plain = {w for w, s in symbols.items() if s == OTHER and len(w) >= 3}
                    if INSULT in symbols.values():
                        insulted = True
                        found["r"] |= plain | {""}  # counts the text itself
                    if TARGET in symbols.values():
                        found["t"] |= plain | {""}
                what = "r" if insulted else "t"
                rows += [(what, w, label, key) for w in found[what]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["what", "word", "label", "key"])

    counted = (sample.select("text", "label").mapInArrow(spell, "what string, word string, label int, key long").distinct()
               .groupBy("what", "word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")))
    for_reports, for_threats = F.col("n") - F.col("toxic"), F.col("toxic")
    wanted = F.when(F.col("what") == "r", for_reports).otherwise(for_threats)
    got = counted.where((wanted >= LEAST_TEXTS) | (F.col("word") == "")).collect()  # words of a bounded sample
    out = {}
    for what in "rt":
        rows = {r["word"]: ((r["n"] - r["toxic"] if what == "r" else r["toxic"]), r["n"]) for r in got if r["what"] == what}
        side, every = rows.pop("", (0, 0))
        if not rows or not 0 < side < every:
            out[what] = ()
            continue
        p = side / every
        k, n = (np.array([r[i] for r in rows.values()], dtype="f8") for i in (0, 1))
        odds = (k + 0.5) / (n - k + 0.5) / (p / (1 - p))
        chosen = (odds >= LEAST_RATIO) & (_chance(k, n, p) * len(rows) <= BY_CHANCE)
        out[what] = tuple(sorted(w for w, yes in zip(rows, chosen) if yes))
    return out["t"], out["r"]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """Grammar fitted on at most ``rows`` labelled, learnable documents (a documented bound)."""
    python_tasks(documents.sparkSession)
    sample = materialize(fit_sample(documents, labels, "toxic", rows), "toxic-sample")
    entries = _learn_entries(sample)
    threats, reports = _learn_words(sample, entries) if entries else ((), ())
    raw = Grammar(entries, np.zeros(N_FEATURES), 0.0, threats, reports)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [raw.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    got = sorted((list(r["x"]), r["label"]) for r in sample.mapInArrow(run, "x array<double>, label int").collect())
    if not got:
        return Grammar({}, raw.weights, -4.0)
    weights, bias = _logistic(np.array([x for x, _ in got]), np.array([y for _, y in got], dtype="f8"))
    return Grammar(raw.entries, weights, bias, threats, reports)


def score_toxicity(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; score is 0 to 1, predicted 1 from PREDICT_FROM on.

    Null and empty texts have no matched clause and get the grammar's base score; repeated rows score alike.
    Other columns are not read.
    """
    python_tasks(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([grammar.features(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            p = grammar.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= PREDICT_FROM).astype("i4"))],
                                             names=["doc_id", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows not predicted toxic, with all columns as they were."""
    python_tasks(documents.sparkSession)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        x = np.array([grammar.features(t) for t in text]).reshape(-1, N_FEATURES)
        return pd.Series(grammar.score(x) < PREDICT_FROM)

    return documents.where(clean(F.col("text")))
