"""Grammar of molecule strings (P8): one pass of a token automaton over each string of an Arrow batch.

The state holds what came before, the stack of open branches, and the open ring closures with their atoms; the first
rule that a token breaks is the row's reason, and no later token is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.operators.text import SMILES_TOKEN_RE
from solvara.session import ship_package

# Token kinds of the published notation.
BRACKET_ATOM_RE = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)(@{1,2})?(H[0-9]?)?([+]{1,3}|[-]{1,3}|[+-][0-9]{1,2})?(:[0-9]+)?\]$"
PLAIN_ATOMS = ["Br", "Cl", "N", "O", "S", "P", "F", "I", "B", "C", "b", "c", "n", "o", "s", "p", "*"]
BONDS = ["-", "=", "#", ":", "/", "\\", "~", "$"]
REASONS = ["unknown_symbol", "bad_bracket_atom", "misplaced_bond", "misplaced_branch", "empty_branch", "unbalanced_branch",
           "misplaced_dot", "misplaced_ring", "ring_to_itself", "ring_to_neighbour", "ring_bond_conflict", "open_ring"]

_TOKEN, _BRACKET_ATOM, _NUMBER = re.compile(SMILES_TOKEN_RE), re.compile(BRACKET_ATOM_RE), re.compile("%?[0-9]+")
_AFTER_ATOM = ("atom", "ring", "close")


@lru_cache(maxsize=1 << 14)
def _kind(t: str) -> str:
    if t.startswith("["):
        return "atom" if _BRACKET_ATOM.search(t) else "bad_bracket_atom"
    if t in PLAIN_ATOMS:
        return "atom"
    if t in BONDS:
        return "bond"
    return {"(": "open", ")": "close", ".": "dot"}.get(t) or ("ring" if _NUMBER.fullmatch(t) else "unknown_symbol")


def _tokens(text: str) -> Iterator[str]:
    """Tokens in order; what the pattern does not cover becomes tokens of its own, in place."""
    if "\x01" in text and "".join(_TOKEN.findall(text)) != text:  # \x01 parts tokens, and is none itself
        yield from filter(None, _TOKEN.sub("\x01\\g<1>\x01", text).split("\x01"))
        return
    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            yield text[at:m.start()]
        yield m.group()
        at = m.end()
    if at < len(text):
        yield text[at:]


def first_reason(text: str) -> str | None:
    """The first rule that ``text`` breaks; see :func:`smiles_reason`."""
    prev, before, bond, atoms, current, parent = "start", "", "", 0, 0, 0
    stack: list[tuple[int, int]] = []
    rings: dict[str, tuple[int, int, str]] = {}
    for t in _tokens(text):
        kind, after_atom = _kind(t), prev in _AFTER_ATOM
        if kind == "atom":
            atoms += 1
            current, parent = atoms, 0 if prev in ("start", "dot") else current
        elif kind == "bond":
            if not after_atom and prev != "open":
                return "misplaced_bond"
        elif kind == "open":
            if not after_atom:
                return "misplaced_branch"
            stack.append((current, parent))
        elif kind == "close":
            if prev == "open":
                return "empty_branch"
            if not stack:
                return "unbalanced_branch"
            if prev in ("bond", "dot"):
                return f"misplaced_{prev}"
            current, parent = stack.pop()
        elif kind == "dot":
            if not after_atom:
                return "misplaced_dot"
        elif kind == "ring":
            if not after_atom and not (prev == "bond" and before in _AFTER_ATOM):
                return "misplaced_ring"
            number = t.removeprefix("%")
            if number in rings:
                atom, beside, opened = rings.pop(number)
                if atom == current:
                    return "ring_to_itself"
                if atom == parent or beside == current:
                    return "ring_to_neighbour"
                # directions of a double bond's neighbours are single bonds
                if opened and bond and ("-" if opened in "/\\" else opened) != ("-" if bond in "/\\" else bond):
                    return "ring_bond_conflict"
            else:
                rings[number] = (current, parent, bond)
        else:
            return kind
        before, bond = (prev, t) if kind == "bond" else ("", "")
        prev = kind
    if prev in ("bond", "dot"):
        return f"misplaced_{prev}"
    if prev == "open" or stack:
        return "unbalanced_branch"
    return "open_ring" if rings else None


def smiles_reason(smiles: Column) -> Column:
    """The first rule of :data:`REASONS` that the whole string breaks, NULL if none; a NULL or empty string breaks none.

    A string is in order if its tokens cover it (a bracket without its end is a bad atom); bonds, dots and branches follow an atom, a ring closure or a closed
    branch (a bond may also start a branch); branches are closed and not empty; ring closures meet in pairs, join two
    atoms that are not neighbours along the chain, and agree in their bond; and no bond, dot, branch or ring is left open.
    """
    ship_package(SparkSession.active())

    @F.arrow_udf("string")
    def reasons(texts: pa.Array) -> pa.Array:
        found = (t and first_reason(t.decode("utf-8", "replace")) for t in texts.to_pylist())
        return pa.array([r or None for r in found], pa.string())

    return reasons(smiles.cast("binary"))


def validate_grammar(df: DataFrame, smiles: str = "smiles", reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) by the grammar; a missing or empty string is a reject of its own kind."""
    reason = (F.when(F.col(smiles).isNull(), F.lit("missing_smiles")).when(F.length(smiles) == 0, F.lit("empty_smiles"))
              .otherwise(smiles_reason(F.col(smiles))))
    tagged = df.withColumn(reason_col, reason)
    return tagged.where(F.col(reason_col).isNull()).drop(reason_col), tagged.where(F.col(reason_col).isNotNull())
