"""Further fingerprint kinds over atom and bond tables (F1): walk hashes and substructure keys.

``atoms(mol_id, atom_id, invariant)`` and ``bonds(mol_id, src, dst, bond_type)`` (both directions) are ordinary tables.
Every step is a join or aggregate keyed by (molecule, atom), so a very large molecule spreads over many tasks; only the walks of
molecules of bounded size are found molecule by molecule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from solvara.functions.expressions import md5_int
from solvara.functions.md5_words import md5_int_of, md5_ints
from solvara.session import ship_package, write_once


def _named_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds with the invariant of the atom that they lead to."""
    to = atoms.select("mol_id", F.col("atom_id").alias("dst"), F.col("invariant").alias("to"))
    return bonds.select("mol_id", "src", "dst", "bond_type").join(to, ["mol_id", "dst"])


def walk_hashes(atoms: DataFrame, bonds: DataFrame, longest: int = 7) -> DataFrame:
    """``(mol_id, atom_id, length, hash)``: distinct hashes of the walks of 0 to ``longest`` bonds that end at each atom.

    hash of a single atom = h(invariant); one bond further: h(hash before | bond type | invariant of the new atom).  A
    walk may turn back.  Equal walks to one atom are one row after every step, so a hub adds rows by the different walks
    that reach it and not by their number.  Each length is written once, as the next one and the result read it.
    """
    named = write_once(_named_bonds(atoms, bonds), "bonds")
    now = write_once(atoms.select("mol_id", "atom_id", F.lit(0).alias("length"), md5_int(F.col("invariant")).alias("hash")).distinct(), "walks")
    levels = [now]
    for length in range(1, longest + 1):
        key = F.concat_ws("|", F.col("hash").cast("string"), F.col("bond_type").cast("string"), F.col("to"))
        step = (named.join(now.select("mol_id", F.col("atom_id").alias("src"), "hash"), ["mol_id", "src"])
                .select("mol_id", F.col("dst").alias("atom_id"), F.lit(length).alias("length"), md5_int(key).alias("hash")).distinct())
        now = write_once(step, "walks")
        levels.append(now)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


#: Rows (atoms and bonds) and walks up to which a molecule is worked on whole, and walks that are worked on at once.
WHOLE_ROWS, WHOLE_WALKS, SLICE_WALKS = 5_000, 500_000, 500_000
#: Atoms and bonds that are gathered before they are worked on, and bits (molecules x n_bits) that are marked at once.
BATCH_ROWS, MARKS = 50_000, 1 << 24


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i the places ``first[i]`` to ``first[i] + n[i] - 1``, and i for each of them."""
    i = np.repeat(np.arange(len(n)), n)
    return np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), i


def _numbered(code: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (from 0 to bound - 1) in order, and the place of each code among them."""
    if bound > 4 * len(code) + (1 << 20):
        return np.unique(code, return_inverse=True)
    seen = np.zeros(bound, dtype=bool)
    seen[code] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]


def _walk_bits(mol: np.ndarray, rows: pa.RecordBatch, longest: int, n_bits: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """``(molecule, sorted bits)`` of the molecules with atoms, which lie whole in ``rows``; None for one with too many walks.

    ``mol`` numbers the rows' molecules from 0.  An atom's row holds its id in ``dst`` and its invariant, a bond's row has ``src``.
    """
    n_mol = int(mol[-1]) + 1
    kinds, names, is_bond = rows.column("bond_type"), rows.column("invariant"), rows.column("is_bond").to_numpy(zero_copy_only=False)
    is_atom = ~is_bond & rows.column("dst").is_valid().to_numpy(zero_copy_only=False)
    ids = pa.concat_arrays([rows.column("src"), rows.column("dst")]).dictionary_encode().indices
    node = np.concatenate([mol, mol]) * (len(mol) * 2) + pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("i8")
    node = np.unique(node, return_inverse=True)[1]
    src, dst, n_node = node[:len(mol)], node[len(mol):], int(node.max()) + 1
    # a row each for different pairs of atom and invariant, in the order of the atoms
    names = names.dictionary_encode()
    name, names = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype("i8"), [*names.dictionary.to_pylist(), None]
    kinds = kinds.dictionary_encode()
    kind, kinds = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False).astype("i8"), [*kinds.dictionary.to_pylist(), None]
    pairs = np.unique(dst[is_atom] * len(names) + name[is_atom] + 1)
    atom, name = pairs // len(names), pairs % len(names) - 1
    mol_of = np.zeros(n_node, dtype="i8")
    mol_of[dst], mol_of[src] = mol, mol
    # bonds by their first atom, with every invariant of the atom that they lead to; the same step is taken once
    first = np.searchsorted(atom, dst[is_bond])
    at, i = _spread(first, np.searchsorted(atom, dst[is_bond], side="right") - first)
    label = (kind[is_bond][i] + 1) * len(names) + name[at] + 1
    labels, label = np.unique(label, return_inverse=True)
    steps = np.stack([src[is_bond][i], dst[is_bond][i], label])
    steps = steps[:, np.lexsort(steps[::-1])]
    a, b, label = steps[:, np.append(True, (np.diff(steps) != 0).any(axis=0))[:steps.shape[1]]]
    # what a step adds to the hash before it; like in concat_ws, NULL adds nothing
    ends = [b"".join(b"|" + x for x in (kinds[k // len(names) - 1], names[k % len(names) - 1]) if x is not None) for k in labels.tolist()]
    starts, ways = np.searchsorted(a, np.arange(n_node)), np.bincount(a, minlength=n_node)
    walks = np.bincount(atom, minlength=n_node).astype("f8")
    total = np.zeros(n_mol)
    for _ in range(longest):
        walks = np.bincount(b, walks[a], minlength=n_node)
        total += np.bincount(mol_of, walks, minlength=n_mol)
    known = np.array([-1 if x is None else md5_int_of(x) for x in names], dtype="i8")  # the last stands for NULL, as does number -1

    def marks(lo: int, hi: int) -> np.ndarray:
        """Which bits the molecules from lo to hi - 1 have."""
        out = np.zeros((hi - lo, n_bits), dtype=bool)
        chosen = (mol_of[atom] >= lo) & (mol_of[atom] < hi) & (total[mol_of[atom]] <= WHOLE_WALKS)
        now, value, hashes = atom[chosen], name[chosen] % len(names), known
        for left in range(longest - 1, -1, -1):
            step, i = _spread(starts[now], ways[now])
            # the hash before and the step taken: what is equal is hashed once
            ways_on, at = _numbered(value[i] * max(1, len(ends)) + label[step], len(hashes) * len(ends))
            hashes = md5_ints(hashes[ways_on // max(1, len(ends))], ends, ways_on % max(1, len(ends)))
            now = b[step]
            out[mol_of[now] - lo, (hashes % n_bits)[at]] = True
            if left:
                both = np.unique(now * max(1, len(hashes)) + at)
                now, value = both // max(1, len(hashes)), both % max(1, len(hashes))
        return out

    has_atoms = np.bincount(mol[~is_bond], minlength=n_mol) > 0
    size = np.cumsum(np.where(total <= WHOLE_WALKS, total, 0)) // SLICE_WALKS
    size += np.arange(n_mol) // max(1, MARKS // n_bits)
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), n_mol]
    for lo, hi in zip(cuts, cuts[1:]):
        marked = marks(lo, hi)
        edge, bit = np.append(0, np.cumsum(marked.sum(axis=1))), np.nonzero(marked)[1].astype("i4")
        for k in lo + np.flatnonzero(has_atoms[lo:hi]):
            yield k, bit[edge[k - lo]:edge[k - lo + 1]] if total[k] <= WHOLE_WALKS else None


def _whole_molecules(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Atoms and bonds in one table, for :func:`_walk_bits`; rows without a molecule and bonds without both ends are left out."""
    ids = atoms.select("atom_id").union(bonds.select("src")).union(bonds.select("dst")).schema["atom_id"].dataType
    text = lambda c: F.col(c).cast("string").cast("binary")
    a = atoms.where("mol_id IS NOT NULL").select("mol_id", F.lit(False).alias("is_bond"), F.lit(None).cast(ids).alias("src"),
                                                 F.col("atom_id").cast(ids).alias("dst"), F.lit(None).cast("binary").alias("bond_type"),
                                                 text("invariant").alias("invariant"))
    b = bonds.where("mol_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select(
        "mol_id", F.lit(True).alias("is_bond"), F.col("src").cast(ids).alias("src"), F.col("dst").cast(ids).alias("dst"),
        text("bond_type").alias("bond_type"), F.lit(None).cast("binary").alias("invariant"))
    return a.unionByName(b)


def _fingerprint_by_atom(atoms: DataFrame, bonds: DataFrame, longest: int, n_bits: int) -> DataFrame:
    """``(mol_id, bits)`` by :func:`walk_hashes`, for molecules of any size."""
    bits = walk_hashes(atoms, bonds, longest).where("length > 0").select("mol_id", F.pmod("hash", F.lit(n_bits)).cast("int").alias("bit"))
    found = bits.groupBy("mol_id").agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    return (atoms.select("mol_id").distinct().join(found, "mol_id", "left")
            .select("mol_id", F.coalesce("bits", F.array().cast("array<int>")).alias("bits")))


def path_fingerprint(atoms: DataFrame, bonds: DataFrame, longest: int = 7, n_bits: int = 2048, out: str = "bits") -> DataFrame:
    """F1 (path kind): ``(mol_id, bits)`` with the sorted distinct ``hash mod n_bits`` of the walks of 1 to ``longest`` bonds.

    A molecule without bonds has no bits; the set of a molecule holds ``n_bits`` numbers at most.  Atoms and bonds are dealt
    by molecule once, and the walks of an Arrow batch of whole molecules grow together.  A molecule of more than
    ``WHOLE_ROWS`` atoms and bonds, or of more than ``WHOLE_WALKS`` walks, goes by :func:`walk_hashes`, dealt by atom.
    """
    ship_package(atoms.sparkSession)
    rows = _whole_molecules(atoms, bonds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.RecordBatch]:
            """Batches of whole molecules; the last molecule of what is gathered may go on in the next batch."""
            gathered, n = [], 0
            for batch in batches:
                gathered.append(batch)
                n += len(batch)
                if n >= BATCH_ROWS:
                    both = pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]
                    cut = int(np.searchsorted(numbers(both), numbers(both)[-1]))
                    if cut:
                        yield both.slice(0, cut)
                    gathered, n = [both.slice(cut)], len(both) - cut
            if n:
                yield pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]

        def numbers(rows: pa.RecordBatch) -> np.ndarray:
            return rows.column("mol_id").dictionary_encode().indices.to_numpy().astype("i8")

        for some in whole():
            mol = numbers(some)
            found = list(_walk_bits(mol, some, longest, n_bits))
            names = some.column("mol_id").take(pa.array(np.searchsorted(mol, np.array([k for k, _ in found], dtype="i8"))))
            yield pa.RecordBatch.from_arrays([names, pa.array([v for _, v in found], pa.list_(pa.int32()))], names=["mol_id", "bits"])

    large = write_once(rows.groupBy("mol_id").count().where(F.col("count") > WHOLE_ROWS).select("mol_id"), "large")
    if large.limit(1).count():
        rows = rows.join(large, "mol_id", "left_anti")
    schema = StructType([StructField("mol_id", rows.schema["mol_id"].dataType), StructField("bits", ArrayType(IntegerType()))])
    done = write_once(rows.repartition("mol_id").sortWithinPartitions("mol_id").mapInArrow(work, schema), "fingerprints")
    found = done.where(F.col("bits").isNotNull())
    rest = done.where(F.col("bits").isNull()).select("mol_id").unionByName(large)
    if rest.limit(1).count():
        some = [write_once(t.join(rest, "mol_id", "left_semi"), "large") for t in (atoms, bonds)]
        found = found.unionByName(_fingerprint_by_atom(*some, longest, n_bits))
    unnamed = atoms.where("mol_id IS NULL").select("mol_id", F.array().cast("array<int>").alias("bits")).distinct()
    return found.unionByName(unnamed).select(F.col("mol_id").cast(atoms.schema["mol_id"].dataType).alias("mol_id"), F.col("bits").alias(out))


@dataclass(frozen=True)
class Pattern:
    """A small graph to look for: an invariant per pattern atom (None: any), bonds ``(i, j, type)`` between them (type None:
    any), and how many atoms of a molecule must be able to play pattern atom 0."""

    atoms: tuple[str | None, ...]
    bonds: tuple[tuple[int, int, int | None], ...] = ()
    least: int = 1

    def order(self) -> list[tuple[int, int, int | None]]:
        """Bonds in an order in which each leads from an atom already placed; raises if the pattern falls apart."""
        placed, left, out = {0}, list(self.bonds), []
        while left:
            i = next((n for n, (a, b, _) in enumerate(left) if a in placed or b in placed), None)
            if i is None:
                break
            a, b, kind = left.pop(i)
            a, b = (a, b) if a in placed else (b, a)
            out.append((a, b, kind))
            placed.add(b)
        if left or placed != set(range(len(self.atoms))):
            raise ValueError("a pattern must be connected")
        return out


def pattern_matches(atoms: DataFrame, named_bonds: DataFrame, pattern: Pattern) -> DataFrame:
    """Molecules with the pattern: ``(mol_id)``.  Different pattern atoms are different atoms.

    One keyed join per pattern bond: along a bond to a new atom, or back to check a ring.
    """
    def fits(c: Column, wanted: str | None) -> Column:
        return F.lit(True) if wanted is None else c == F.lit(wanted)

    found = atoms.where(fits(F.col("invariant"), pattern.atoms[0])).select("mol_id", F.col("atom_id").alias("p0"))
    placed = {0}
    for a, b, kind in pattern.order():
        along = named_bonds if kind is None else named_bonds.where(F.col("bond_type") == F.lit(kind))
        if b in placed:
            ring = along.select("mol_id", F.col("src").alias(f"p{a}"), F.col("dst").alias(f"p{b}"))
            found = found.join(ring, ["mol_id", f"p{a}", f"p{b}"], "left_semi")
            continue
        step = along.where(fits(F.col("to"), pattern.atoms[b])).select("mol_id", F.col("src").alias(f"p{a}"), F.col("dst").alias(f"p{b}"))
        found = found.join(step.distinct(), ["mol_id", f"p{a}"])
        for other in placed - {a}:
            found = found.where(F.col(f"p{b}") != F.col(f"p{other}"))
        found = found.where(F.col(f"p{b}") != F.col(f"p{a}"))
        placed.add(b)
    if pattern.least == 1:
        return found.select("mol_id").distinct()
    starts = found.select("mol_id", "p0").distinct().groupBy("mol_id").agg(F.count(F.lit(1)).alias("n"))
    return starts.where(F.col("n") >= pattern.least).select("mol_id")


def substructure_keys(atoms: DataFrame, bonds: DataFrame, patterns: list[Pattern], out: str = "bits") -> DataFrame:
    """F1 (key kind): ``(mol_id, bits)``; bit i is set if the molecule holds pattern i.  One row per molecule.

    The bonds, with the invariants of their ends, are written once and read by every pattern's joins.
    """
    named = write_once(_named_bonds(atoms, bonds), "bonds")
    molecules = atoms.select("mol_id").distinct()
    hits = None
    for i, p in enumerate(patterns):
        one = pattern_matches(atoms, named, p).select("mol_id", F.lit(i).alias("bit"))
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return molecules.withColumn(out, F.array().cast("array<int>"))
    found = hits.groupBy("mol_id").agg(F.array_sort(F.collect_set("bit")).alias(out))
    return molecules.join(found, "mol_id", "left").select("mol_id", F.coalesce(out, F.array().cast("array<int>")).alias(out))


def environments(bonds: DataFrame, radius: int) -> list[DataFrame]:
    """Per radius 1..radius: ``(mol_id, atom_id, n, s, t)``, the set of bonds within that many steps of each atom.

    A set is known by its size and two sums of 32-bit hashes of its bonds: equal sets agree in all three, and different
    ones differ but for a chance of 2^-64.  Sets are kept as rows (one per atom and bond) while they grow, so no
    atom's surroundings are gathered in a list.
    """
    link = F.concat_ws(":", F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string"))
    edges = write_once(bonds.select("mol_id", "src", "dst", link.alias("bond")).distinct(), "edges")
    now = edges.select("mol_id", F.col("src").alias("atom_id"), "bond").distinct()
    out = []
    for r in range(1, radius + 1):
        if r > 1:
            reached = edges.select("mol_id", "src", "dst").join(now.withColumnRenamed("atom_id", "dst"), ["mol_id", "dst"])
            now = now.unionByName(reached.select("mol_id", F.col("src").alias("atom_id"), "bond")).distinct()
        now = write_once(now, "environment")
        out.append(now.groupBy("mol_id", "atom_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(md5_int(F.col("bond")).cast("decimal(38,0)")).alias("s"),
            F.sum(md5_int(F.concat(F.lit("~"), "bond")).cast("decimal(38,0)")).alias("t")))
    return out


def unique_environment_ids(ids: DataFrame, bonds: DataFrame, radius: int = 2) -> DataFrame:
    """F2 without duplicates: of the identifiers of one molecule that stand for the same set of bonds only the first stays.

    ``ids`` is ``(mol_id, atom_id, radius, id)`` of ``graph.atom_identifiers``.  First means the smaller radius, then the
    smaller identifier.  Radius 0 covers no bond, and every atom keeps its own.  An atom whose set does not
    grow any more (the whole molecule is covered) so adds nothing at the larger radius.
    """
    later = None
    for r, env in enumerate(environments(bonds, radius), start=1):
        one = ids.where(F.col("radius") == r).join(env, ["mol_id", "atom_id"])  # an atom without bonds adds nothing
        later = one if later is None else later.unionByName(one)
    base = ids.where("radius = 0").select("mol_id", "radius", "id")
    if later is None:
        return base
    first = later.groupBy("mol_id", "n", "s", "t").agg(F.min(F.struct("radius", "id")).alias("f"))
    return base.unionByName(first.select("mol_id", F.col("f.radius").alias("radius"), F.col("f.id").alias("id")))


def unique_circular_fingerprint(atoms: DataFrame, bonds: DataFrame, radius: int = 2, n_bits: int = 2048, out: str = "bits") -> DataFrame:
    """F2 without duplicate environments: ``(mol_id, bits)`` with the sorted distinct ``id mod n_bits`` that stay."""
    from solvara.operators.graph import atom_identifiers

    ids = write_once(atom_identifiers(atoms, bonds, radius), "ids")
    kept = unique_environment_ids(ids, bonds, radius)
    return (kept.select("mol_id", F.pmod("id", F.lit(n_bits)).cast("int").alias("bit"))
            .groupBy("mol_id").agg(F.array_sort(F.collect_set("bit")).alias(out)))
