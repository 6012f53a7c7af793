"""Registered queries: further fingerprint kinds, unique environments, mean pairwise similarity, grammar of molecule
strings, and tables zipped by position (F1, F2, F11, P8, J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import keys, pairwise, smiles
from solvara.plans import fixtures as fx
from solvara.plans import oracle as orc
from solvara.plans.q_text_graph import _graph_sql, h_sql
from solvara.plans.registry import register
from solvara.session import write_once
from solvara.sources import positions
from solvara.sources import tables as io
from solvara.operators.similarity import lingo_fingerprint

GRAPH = (f"atoms AS MATERIALIZED ({fx.FX_ATOMS_SQL}), bonds AS MATERIALIZED (SELECT a.mol_id, a.atom_id AS src, b.atom_id AS dst, "
         "(a.atom_id + b.atom_id) % 3 AS bond_type FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id "
         "AND (b.atom_id = a.atom_id + 1 OR b.atom_id = a.atom_id - 1))")


def _graph(spark, sf_dir):
    atoms = write_once(fx.fx_atoms(spark, sf_dir), "atoms")
    return atoms, write_once(fx.fx_bonds(spark, sf_dir, atoms), "bonds")


def _bits_report(fp):
    return fp.select("mol_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits_text"))


# ------------------------------------------------------------------ F1: path kind
LONGEST = 7
_WALK_KEY = h_sql("concat_ws('|', CAST(w.hash AS VARCHAR), CAST(b.bond_type AS VARCHAR), a.invariant)")


@register("f1_path_fingerprint",
          f"WITH RECURSIVE {GRAPH}, w(mol_id, atom_id, length, hash) AS ("
          f"SELECT mol_id, atom_id, 0, {h_sql('invariant')} FROM atoms UNION "
          f"SELECT b.mol_id, b.dst, w.length + 1, {_WALK_KEY} FROM w JOIN bonds b ON b.mol_id = w.mol_id AND b.src = w.atom_id "
          f"JOIN atoms a ON a.mol_id = b.mol_id AND a.atom_id = b.dst WHERE w.length < {LONGEST}), "
          "s AS (SELECT mol_id, list_sort(list_distinct(list(CAST(hash % 2048 AS INTEGER)))) AS bits FROM w WHERE length > 0 GROUP BY mol_id) "
          "SELECT m.mol_id, CAST(len(coalesce(s.bits, [])) AS INTEGER) AS n_set, array_to_string(coalesce(s.bits, []), ',') AS bits_text "
          "FROM (SELECT DISTINCT mol_id FROM atoms) m LEFT JOIN s ON s.mol_id = m.mol_id")
def f1_path_fingerprint(spark, sf_dir):
    """Walks of 1 to 7 bonds hashed into 2,048 bits."""
    return _bits_report(keys.path_fingerprint(*_graph(spark, sf_dir), LONGEST, 2048))


# ------------------------------------------------------------------ F1: key kind
PATTERNS = [
    keys.Pattern(("NO",)),
    keys.Pattern(("AF", "RF"), ((0, 1, None),)),
    keys.Pattern(("NO", "NO", "NO"), ((0, 1, None), (1, 2, None))),
    keys.Pattern(("AF", None, "AF"), ((0, 1, None), (1, 2, None))),
    keys.Pattern((None,) * 5, ((0, 1, None), (1, 2, None), (2, 3, None), (3, 4, None))),
    keys.Pattern(("RF",), (), 2),
    keys.Pattern((None, "NO"), ((0, 1, 2),)),
    keys.Pattern((None, None, None), ((0, 1, None), (1, 2, None), (2, 0, None))),
    keys.Pattern((None, None, None, None), ((0, 1, None), (0, 2, None), (0, 3, None))),
    keys.Pattern((None, "AF", "NO"), ((0, 1, None), (0, 2, 1)), 1),
]


def _pattern_sql(number: int, p: keys.Pattern) -> str:
    """All assignments of atoms to the pattern's atoms, written out as one join."""
    names = [f"x{i}" for i in range(len(p.atoms))]
    tables = ", ".join(f"atoms {n}" for n in names)
    where = [f"x0.mol_id = {n}.mol_id" for n in names[1:]]
    where += [f"{n}.invariant = '{a}'" for n, a in zip(names, p.atoms) if a is not None]
    where += [f"{a}.atom_id <> {b}.atom_id" for i, a in enumerate(names) for b in names[i + 1:]]
    where += [f"EXISTS (SELECT 1 FROM bonds b WHERE b.mol_id = x0.mol_id AND b.src = x{i}.atom_id AND b.dst = x{j}.atom_id"
              + ("" if kind is None else f" AND b.bond_type = {kind}") + ")" for i, j, kind in p.bonds]
    return (f"SELECT x0.mol_id, {number} AS bit FROM {tables} WHERE {' AND '.join(where) or 'TRUE'} "
            f"GROUP BY x0.mol_id HAVING count(DISTINCT x0.atom_id) >= {p.least}")


@register("f1_substructure_keys",
          f"WITH {GRAPH}, hits AS ({' UNION ALL '.join(_pattern_sql(i, p) for i, p in enumerate(PATTERNS))}), "
          "s AS (SELECT mol_id, list_sort(list(CAST(bit AS INTEGER))) AS bits FROM hits GROUP BY mol_id) "
          "SELECT m.mol_id, CAST(len(coalesce(s.bits, [])) AS INTEGER) AS n_set, array_to_string(coalesce(s.bits, []), ',') AS bits_text "
          "FROM (SELECT DISTINCT mol_id FROM atoms) m LEFT JOIN s ON s.mol_id = m.mol_id")
def f1_substructure_keys(spark, sf_dir):
    """One bit per pattern graph that the molecule holds."""
    return _bits_report(keys.substructure_keys(*_graph(spark, sf_dir), PATTERNS))


# ------------------------------------------------------------------ F2 without duplicate environments
UNIQUE_SQL = _graph_sql(2) + """,
edges AS (SELECT DISTINCT mol_id, src, dst, least(src, dst) || ':' || greatest(src, dst) AS bond FROM bonds),
e1 AS (SELECT DISTINCT mol_id, src AS atom_id, bond FROM edges),
e2 AS (SELECT * FROM e1 UNION SELECT e.mol_id, e.src, v.bond FROM edges e JOIN e1 v ON v.mol_id = e.mol_id AND v.atom_id = e.dst),
sets AS (SELECT mol_id, atom_id, 1 AS radius, string_agg(bond, ',' ORDER BY bond) AS env FROM e1 GROUP BY mol_id, atom_id
         UNION ALL SELECT mol_id, atom_id, 2, string_agg(bond, ',' ORDER BY bond) FROM e2 GROUP BY mol_id, atom_id),
kept AS (SELECT mol_id, id FROM allids WHERE radius = 0 UNION ALL
         SELECT mol_id, id FROM (SELECT i.mol_id, i.id, row_number() OVER (PARTITION BY i.mol_id, s.env ORDER BY i.radius, i.id) AS r
                                 FROM allids i JOIN sets s ON s.mol_id = i.mol_id AND s.atom_id = i.atom_id AND s.radius = i.radius) x WHERE r = 1)
SELECT mol_id, CAST(count(DISTINCT id % 2048) AS INTEGER) AS n_set,
       array_to_string(list_sort(list_distinct(list(CAST(id % 2048 AS INTEGER)))), ',') AS bits_text FROM kept GROUP BY mol_id"""


@register("f2_unique_environments", UNIQUE_SQL)
def f2_unique_environments(spark, sf_dir):
    """F2 in which every set of bonds counts once, by its first identifier."""
    return _bits_report(keys.unique_circular_fingerprint(*_graph(spark, sf_dir), 2, 2048))


# ------------------------------------------------------------------ F11
_ORDERS = pairwise.ORDERS


@register("f11_pairwise_average", orc.with_bits(
    f", ranks AS MATERIALIZED (SELECT k.k, b.b, {h_sql(chr(40) + 'k.k || chr(124) || b.b' + chr(41))} * 512 + b.b AS rank "
    f"FROM range({_ORDERS}) k(k), range(512) b(b)), "
    "firsts AS (SELECT u.row_id, r.k, min(r.rank) AS rank FROM (SELECT row_id, unnest(bits) AS bit FROM bits) u JOIN ranks r ON r.b = u.bit "
    "GROUP BY u.row_id, r.k), "
    "grouped AS (SELECT k, rank, count(*) AS c FROM firsts GROUP BY k, rank), "
    "per AS (SELECT k.k, coalesce(sum(g.c * (g.c - 1) / 2.0), 0.0) AS hits "
    f"FROM range({_ORDERS}) k(k) LEFT JOIN grouped g ON g.k = k.k GROUP BY k.k), "
    "n AS (SELECT count(*) AS n FROM bits) "
    "SELECT n.n AS n_rows, n.n * (n.n - 1) // 2 AS n_pairs, 0.0 + round(avg(per.hits) / (n.n * (n.n - 1) / 2.0), 9) AS mean, "
    f"0.0 + round(stddev_samp(per.hits) / sqrt({_ORDERS}) / (n.n * (n.n - 1) / 2.0), 9) AS std_error FROM per, n GROUP BY n.n"))
def f11_pairwise_average(spark, sf_dir):
    """Mean Tanimoto similarity over all pairs of documents with its standard error; no pair is made."""
    bits = lingo_fingerprint(fx.fx_doc(spark, sf_dir), "smiles", 4, 512)
    t = pairwise.pairwise_average(bits, 512)
    return t.select("n_rows", "n_pairs", F.round("mean", 9).alias("mean"), F.round("std_error", 9).alias("std_error"))


# ------------------------------------------------------------------ P8: grammar
#: Pieces that a stand-in string is put together from, by line number and quantity.
PIECES = ["C", "N1", "(=O)", "c1ccccc1", "=", "C1", "[NH4+]", "(", ")", "-O", ".Cl", "C(C)(F)", "%12", "#N", "[C@@H](Br)", "O1", "[Xx9]", "(C", "S/"]


def _strings_sql() -> str:
    pieces = "[" + ", ".join(f"'{p}'" for p in PIECES) + "]"
    return (f"SELECT l_orderkey AS row_id, string_agg(({pieces})[1 + CAST(l_quantity * 7 + l_linenumber AS BIGINT) % {len(PIECES)}], '' "
            "ORDER BY l_linenumber, l_quantity) AS smiles FROM lineitem GROUP BY l_orderkey")


def fx_strings(spark, sf_dir):
    """(row_id, smiles): one string per order, a piece per line, right and wrong ones."""
    li = fx.table(spark, sf_dir, "lineitem")
    at = ((F.col("l_quantity") * 7 + F.col("l_linenumber")).cast("bigint") % len(PIECES) + 1).cast("int")
    piece = F.element_at(F.array(*[F.lit(p) for p in PIECES]), at)
    parts = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", piece.alias("p")))).alias("p"))
    return parts.select("row_id", F.array_join("p.p", "").alias("smiles"))


@register("p8_grammar")
def p8_grammar(spark, sf_dir):
    """Reason per string (NULL: in order), of the orders' strings and of every whole document text as a string."""
    orders = fx_strings(spark, sf_dir).withColumn("kind", F.lit("order"))
    texts = fx.fx_doc(spark, sf_dir).withColumn("kind", F.lit("document"))
    both = orders.unionByName(texts)
    return both.select("kind", "row_id", smiles.smiles_reason(F.col("smiles")).alias("reason"))


@register("p8_grammar_properties",
          f"SELECT kind, count(*) AS n_rows, TRUE AS ok FROM (SELECT 'order' AS kind, smiles FROM ({_strings_sql()}) o "
          "UNION ALL SELECT 'document', text FROM documents) t GROUP BY kind")
def p8_grammar_properties(spark, sf_dir):
    """Rows per kind; ok: all reasons are known ones, orders hold both good and bad strings."""
    t = p8_grammar(spark, sf_dir)
    known = F.every(F.col("reason").isNull() | F.col("reason").isin(smiles.REASONS))
    mixed = (F.first("kind") != "order") | (F.count("reason").between(1, F.count(F.lit(1)) - 1))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), (known & mixed).alias("ok"))


# ------------------------------------------------------------------ J1 by position
@register("j1_zip_by_position",
          "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey AS a_key, o_totalprice AS price, "
          "o_orderkey AS b_key, o_orderstatus AS status FROM orders")
def j1_zip_by_position(spark, sf_dir):
    """Two CSV folders without a common key, of different numbers of files, put side by side by their rows' positions."""
    o = fx.table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("a_key"), F.col("o_totalprice").alias("price"))
    b = o.select(F.col("o_orderkey").alias("b_key"), F.col("o_orderstatus").alias("status"))
    paths = [io.write_table(x.repartitionByRange(n, k).sortWithinPartitions(k), io.scratch_path(spark, k), "csv")
             for x, k, n in ((a, "a_key", 5), (b, "b_key", 3))]
    left = io.read_table(spark, paths[0], "a_key bigint, price double", multi_line=False)
    right = io.read_table(spark, paths[1], "b_key bigint, status string", multi_line=False)
    return positions.zip_by_position(left, right).select("position", "a_key", "price", "b_key", "status")
