"""Path and key fingerprints, unique environments, mean pairwise similarity, molecule grammar, positions, missing values."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import SF_SMALL
from solvara.operators import descriptors as ds
from solvara.operators import graph, keys, pairwise, smiles, text
from solvara.sources import positions
from solvara.sources import tables as io


def _graph(spark, molecules):
    """molecules: {id: (invariants, [(a, b, type)])}, atoms numbered from 1."""
    atoms = [(m, i + 1, v) for m, (inv, _) in molecules.items() for i, v in enumerate(inv)]
    bonds = [(m, *p, t) for m, (_, bs) in molecules.items() for a, b, t in bs for p in ((a, b), (b, a))]
    return (spark.createDataFrame(atoms, "mol_id long, atom_id int, invariant string"),
            spark.createDataFrame(bonds, "mol_id long, src int, dst int, bond_type int"))


TRIANGLE = (["C", "C", "C"], [(1, 2, 1), (2, 3, 1), (3, 1, 1)])
STAR = (["N", "C", "C", "O"], [(1, 2, 1), (1, 3, 1), (1, 4, 2)])
CHAIN = (["C", "O", "C", "N"], [(1, 2, 1), (2, 3, 1), (3, 4, 2)])
LONE = (["O"], [])


def test_path_fingerprint_by_hand(spark):
    atoms, bonds = _graph(spark, {1: (["C", "O"], [(1, 2, 2)]), 2: LONE})
    got = {(r.atom_id, r.length): r.hash for r in keys.walk_hashes(atoms.where("mol_id = 1"), bonds, 2).collect()}
    h = lambda s: int(__import__("hashlib").md5(s.encode()).hexdigest()[:8], 16)
    assert got[1, 0] == h("C") and got[2, 1] == h(f"{h('C')}|2|O") and got[1, 2] == h(f"{got[2, 1]}|2|C")
    bits = {r.mol_id: r.bits for r in keys.path_fingerprint(atoms, bonds, 2, 64).collect()}
    assert bits[2] == [] and bits[1] == sorted({v % 64 for (_, n), v in got.items() if n})


def test_walks_to_a_hub_are_rows_once(spark):
    spokes = 40
    atoms, bonds = _graph(spark, {1: (["C"] * (spokes + 1), [(1, i, 1) for i in range(2, spokes + 2)])})
    counts = {r.length: r["count"] for r in keys.walk_hashes(atoms, bonds, 4).groupBy("length").count().collect()}
    assert counts == {n: spokes + 1 for n in range(5)}  # one different walk per atom and length


PATTERNS = [keys.Pattern(("C", "O"), ((0, 1, None),)), keys.Pattern((None,) * 3, ((0, 1, None), (1, 2, None), (2, 0, None))),
            keys.Pattern(("N", "C", "C"), ((0, 1, 1), (0, 2, 1))), keys.Pattern(("C",), (), 3), keys.Pattern(("C", "N"), ((0, 1, 2),)),
            keys.Pattern((None, "C", "C"), ((0, 1, 1), (0, 2, 1)))]


def _plain_keys(inv, bonds):
    kinds = {(a, b): t for x, y, t in bonds for a, b in ((x, y), (y, x))}
    out = []
    for i, p in enumerate(PATTERNS):
        starts = set()
        for pick in itertools.permutations(range(1, len(inv) + 1), len(p.atoms)):
            if all(w is None or inv[a - 1] == w for a, w in zip(pick, p.atoms)) and all(
                    (pick[a], pick[b]) in kinds and t in (None, kinds[pick[a], pick[b]]) for a, b, t in p.bonds):
                starts.add(pick[0])
        if len(starts) >= p.least:
            out.append(i)
    return out


def test_substructure_keys_equal_all_assignments(spark):
    molecules = {1: TRIANGLE, 2: STAR, 3: CHAIN, 4: LONE, 5: (["C"] * 4, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 2), (1, 3, 1)])}
    got = {r.mol_id: r.bits for r in keys.substructure_keys(*_graph(spark, molecules), PATTERNS).collect()}
    assert got == {m: _plain_keys(*g) for m, g in molecules.items()}
    assert keys.substructure_keys(*_graph(spark, {4: LONE, 1: TRIANGLE}), []).where("size(bits) = 0").count() == 2
    with pytest.raises(ValueError, match="connected"):
        keys.Pattern(("C", "C"), ()).order()


def test_unique_environments_of_cycle_and_tree(spark):
    atoms, bonds = _graph(spark, {1: TRIANGLE, 2: STAR, 3: LONE})
    ids = graph.atom_identifiers(atoms, bonds, 2)
    kept = keys.unique_environment_ids(ids, bonds, 2)
    sizes = {(r.mol_id, r.radius): r["count"] for r in kept.groupBy("mol_id", "radius").count().collect()}
    # triangle: three sets of two bonds at radius 1, at radius 2 one set of all three bonds
    assert sizes[1, 0] == 3 and sizes[1, 1] == 3 and sizes[1, 2] == 1
    # star: the hub covers all bonds at radius 1, so every spoke's second environment is a duplicate of it
    assert sizes[2, 0] == 4 and sizes[2, 1] == 4 and (2, 2) not in sizes
    assert sizes[3, 0] == 1 and len([k for k in sizes if k[0] == 3]) == 1


# ------------------------------------------------------------------ F11
def test_pairwise_average_within_its_own_interval(spark):
    rng = np.random.default_rng(0)
    rows = [sorted({int(b) for b in rng.integers(0, 64, rng.integers(1, 30))}) for _ in range(150)] + [[]] * 3 + [[1, 2, 3]] * 40
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(999, None)], "row_id long, bits array<int>")
    r = pairwise.pairwise_average(df.repartition(5), 64, orders=256).first()
    rows.append([])
    sim = [len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0 for a, b in itertools.combinations(rows, 2)]
    assert r.n_rows == len(rows) and r.n_pairs == len(sim)
    assert abs(r["mean"] - np.mean(sim)) < 4 * r.std_error and 0 < r.std_error < 0.02
    same = spark.createDataFrame([(1, [5]), (2, [5])], "row_id long, bits array<int>")
    assert tuple(pairwise.pairwise_average(same, 64).first()) == (2, 1, 1.0, 0.0)
    for few in (same.limit(0), same.limit(1)):
        t = pairwise.pairwise_average(few, 64).first()
        assert t.n_rows == few.count() and t["mean"] is None and t.std_error is None


# ------------------------------------------------------------------ P8
def _plain_reason(s):
    """The grammar again, as a loop over characters."""
    import re
    tokens, at = [], 0
    while at < len(s):
        m = re.compile(text.SMILES_TOKEN_RE).match(s, at)
        tokens.append(m.group() if m else s[at])
        at = m.end() if m else at + 1
    prev, before, bond, atoms, here, parents, stack, rings = "start", "", "", 0, 0, {0: 0}, [], {}
    for t in tokens:
        sided = prev in ("atom", "ring", "close")
        if t[0] == "[" or t in smiles.PLAIN_ATOMS:
            if t[0] == "[" and not re.match(smiles.BRACKET_ATOM_RE, t):
                return "bad_bracket_atom"
            atoms += 1
            parents[atoms] = 0 if prev in ("start", "dot") else here
            here, kind = atoms, "atom"
        elif t in smiles.BONDS:
            if not sided and prev != "open":
                return "misplaced_bond"
            kind = "bond"
        elif t == "(":
            if not sided:
                return "misplaced_branch"
            stack.append(here)
            kind = "open"
        elif t == ")":
            if prev == "open":
                return "empty_branch"
            if not stack:
                return "unbalanced_branch"
            if prev in ("bond", "dot"):
                return f"misplaced_{prev}"
            here, kind = stack.pop(), "close"
        elif t == ".":
            if not sided:
                return "misplaced_dot"
            kind = "dot"
        elif re.fullmatch("%?[0-9]+", t):
            if not (sided or prev == "bond" and before in ("atom", "ring", "close")):
                return "misplaced_ring"
            number, kind = t.lstrip("%"), "ring"
            if number in rings:
                other, its = rings.pop(number)
                if other == here:
                    return "ring_to_itself"
                if parents[here] == other or parents[other] == here:
                    return "ring_to_neighbour"
                flat = lambda b: "-" if b in "/\\" else b
                if its and bond and flat(its) != flat(bond):
                    return "ring_bond_conflict"
            else:
                rings[number] = (here, bond)
        else:
            return "unknown_symbol"
        before, bond, prev = (prev, t, kind) if kind == "bond" else ("", "", kind)
    if prev in ("bond", "dot"):
        return f"misplaced_{prev}"
    if prev == "open" or stack:
        return "unbalanced_branch"
    return "open_ring" if rings else None


CASES = {"CCO": None, "c1ccccc1": None, "CC(=O)Nc1ccc(Cl)cc1Br": None, "[NH4+].[Cl-]": None, "C%12CCC%12": None, "F/C=C/F": None,
         "C[C@@H](N)C(=O)O": None, "C1CC=1": None, "C=1CC-1": "ring_bond_conflict", "C1CCC": "open_ring", "C(C": "unbalanced_branch",
         "C)": "unbalanced_branch", "C()C": "empty_branch", "(C)C": "misplaced_branch", "=C": "misplaced_bond", "C==C": "misplaced_bond",
         "C=": "misplaced_bond", "C.": "misplaced_dot", ".C": "misplaced_dot", "C..C": "misplaced_dot", "1CC1": "misplaced_ring", "C11": "ring_to_itself",
         "C1C1": "ring_to_neighbour", "C(C1)1": "ring_to_neighbour", "[Xx9]": "bad_bracket_atom", "[C": "bad_bracket_atom", "C C": "unknown_symbol",
         "C(1)C": "misplaced_ring", "C(=1CC)C1": "misplaced_ring", "C(=)": "misplaced_bond", "C(.)": "misplaced_dot", "C@C": "unknown_symbol", "": None}


def test_grammar_reasons(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i int, smiles string")
    got = {r.smiles: r.reason for r in df.withColumn("reason", smiles.smiles_reason(F.col("smiles"))).collect()}
    assert got == CASES
    assert {s: _plain_reason(s) for s in CASES} == CASES
    good, bad = smiles.validate_grammar(df.unionByName(spark.createDataFrame([(99, None)], "i int, smiles string")))
    reasons = {r.smiles: r.reason for r in bad.collect()}
    assert reasons[None] == "missing_smiles" and reasons[""] == "empty_smiles"
    assert good.count() == sum(v is None for v in CASES.values()) - 1


def test_grammar_on_many_strings_and_whole_texts(spark):
    import random
    r = random.Random(5)
    alphabet = ["C", "N", "(", ")", "=", "1", "2", "c", ".", "[NH4+]", "%11", "-", "/", "Cl", "#"]
    rows = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    rows += ["C" * 20_000, "C(" * 3_000 + "C" + ")" * 3_000, "C1CC1" * 3_000]
    rows += [t.text for t in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() if t.text is not None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, smiles string").repartition(8)
    got = {x.i: x.reason for x in df.select("i", smiles.smiles_reason(F.col("smiles")).alias("reason")).collect()}
    want = {i: _plain_reason(s) for i, s in enumerate(rows)}
    assert got == want and len(set(want.values())) >= 10


# ------------------------------------------------------------------ J1 by position
def test_positions_over_many_files_and_blocks(spark):
    rows = [(i, f"v{i}" + "x" * (i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for block in ("4096", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            a = io.write_table(df.repartitionByRange(4, "k").sortWithinPartitions("k").select(F.col("k").alias("a")), io.scratch_path(spark, "a"))
            b = io.write_table(df.repartitionByRange(2, "k").sortWithinPartitions("k").select(F.col("k").alias("b"), "v"), io.scratch_path(spark, "b"))
            left, right = io.read_table(spark, a, "a long"), io.read_table(spark, b, "b long, v string")
            got = sorted(tuple(r) for r in positions.zip_by_position(left, right).select("position", "a", "b", "v").collect())
            assert got == [(i, i, i, v) for i, v in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    with pytest.raises(ValueError, match="rows"):
        positions.zip_by_position(left, right.where("b < 5"))
    with pytest.raises(ValueError, match="both tables"):
        positions.zip_by_position(left, left)
    none = io.write_table(df.limit(0).select(F.col("k").alias("a")), io.scratch_path(spark, "none"))
    assert positions.with_position(io.read_table(spark, none, "a long")).count() == 0


# ------------------------------------------------------------------ A2-A7, L13 with missing values
def _plain_corr(x, y):
    both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
    if not both:
        return None
    a, b = np.array(both).T
    return None if a.min() == a.max() or b.min() == b.max() else float(np.corrcoef(a, b)[0, 1])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(lambda v: 1e6 + v)) for _ in range(3)]), max_size=14))
def test_correlation_is_pairwise_complete(spark, rows):
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = ds.corr_matrix(df, cols)
    for i, j in itertools.combinations(range(3), 2):
        want = _plain_corr([r[i] for r in rows], [r[j] for r in rows])
        r = got[cols[i], cols[j]]
        assert (r is None) == (want is None) and (r is None or abs(r - want) < 1e-6), (rows, i, j)


def test_three_hundred_columns_in_one_pass(spark):
    k, n = 300, 120
    x = np.random.default_rng(1).normal(size=(n, k)) * 3 + 100
    x[:, 7] = 2 * x[:, 3]
    x[np.random.default_rng(2).random((n, k)) < 0.1] = np.nan
    cols = [f"d{i}" for i in range(k)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    df = df.select("i", *[F.when((F.col("i") + j) % 13 != 0, F.col("v")[j]).alias(c) for j, c in enumerate(cols)])
    x[np.add.outer(np.arange(n), np.arange(k)) % 13 == 0] = np.nan
    got = ds.corr_matrix(df, cols)
    here = ~np.isnan(x)
    for a, b in [(0, 1), (3, 7), (63, 64), (12, 299), (128, 191)]:
        both = here[:, a] & here[:, b]
        assert got[cols[a], cols[b]] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    assert len(got) == k * (k - 1) // 2
    assert "d7" in ds.correlated_columns(got, cols)


def test_scalers_leave_nan_out(spark):
    rows = [(1.0, float("nan"), 5.0), (2.0, 4.0, 5.0), (float("nan"), 8.0, 5.0), (None, 6.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    z = ds.standardize(df, ["a", "b", "c"]).collect()
    assert [r.a for r in z][:2] == [-1.0, 1.0] and math.isnan(z[2].a) and z[3].a is None
    assert z[0].c == 0.0 and z[3].c is None
    m = ds.minmax_scale(df, ["a", "b", "c"]).collect()
    assert [r.b for r in m][1:] == [0.0, 1.0, 0.5] and math.isnan(m[0].b) and m[0].c == 0.0 and m[3].c is None
    block = ds.standardize_block(df, ["a", "b"]).collect()
    assert block[1].a == pytest.approx(0.5 / math.sqrt(0.25 + 8 / 3)) and math.isnan(block[0].b)
    sc = ds.fit_target_scaler(df.withColumn("split", F.lit("Training")), "b")
    assert sc.center["b"] == 6.0
