"""Registered queries: text tokens and encoding, word vectors, graph identifiers and readouts
(X3-X5, S5, S7, J5, A1, F2, F3, A12, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import graph, text, vectors
from solvara.plans import fixtures as fx
from solvara.plans.registry import register
from solvara.session import write_once
from solvara.sources import tables as io

H = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


def h_sql(x: str) -> str:
    return H.format(x=x)


# ------------------------------------------------------------------ X3-X5, S7
def _temp_docs(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), "text",
                    (F.lit(273.15) + (F.col("n_chars") % 100).cast("double")).alias("temp"))


@register("x3_model_text",
          "SELECT doc_id AS row_id, concat_ws(' [SEP] ', text, printf('%.2f', 273.15 + CAST(n_chars % 100 AS DOUBLE))) "
          "AS model_text FROM documents")
def x3_model_text(spark, sf_dir):
    return text.model_text(_temp_docs(spark, sf_dir), "text", ["temp"]).select("row_id", "model_text")


TOK_SQL = f"SELECT doc_id AS row_id, regexp_extract_all(coalesce(text, ''), '{text.SMILES_TOKEN_RE}', 1) AS toks FROM documents"


@register("x4_tokenize_smiles",
          f"SELECT row_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens_text FROM ({TOK_SQL}) t")
def x4_tokenize_smiles(spark, sf_dir):
    d = fx.fx_doc(spark, sf_dir)
    t = text.tokenize_smiles(d, "smiles")
    return t.select("row_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens_text"))


VOCAB_SIZE, MAX_LEN = 1000, 512
ENCODE_SQL = f"""
WITH tok AS ({TOK_SQL}),
cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tok) u GROUP BY token),
vocab AS (SELECT token, CAST(rn + 1 AS INTEGER) AS id FROM (
          SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn FROM cnt) r WHERE rn <= {VOCAB_SIZE}),
pos AS (SELECT row_id, unnest(toks[1:{MAX_LEN}]) AS token, generate_subscripts(toks[1:{MAX_LEN}], 1) AS p FROM tok),
ids AS (SELECT pos.row_id, list(coalesce(vocab.id, 1) ORDER BY pos.p) AS ids
        FROM pos LEFT JOIN vocab ON pos.token = vocab.token GROUP BY pos.row_id)
SELECT tok.row_id, CAST(len(tok.toks) AS INTEGER) AS n_tokens, CAST(len(coalesce(ids.ids, [])) AS INTEGER) AS n_real,
       array_to_string(list_resize(coalesce(ids.ids, []), {MAX_LEN}, 0), ',') AS ids_text
FROM tok LEFT JOIN ids ON tok.row_id = ids.row_id"""


def _encoded(spark, sf_dir):
    t = text.tokenize_smiles(fx.fx_doc(spark, sf_dir), "smiles")
    vocab = text.build_vocab(t, "tokens", VOCAB_SIZE)
    return text.encode(t, vocab, "tokens", MAX_LEN)


def _encoded_report(df):
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return df.select("row_id", F.col("n_tokens").cast("int").alias("n_tokens"), real.cast("int").alias("n_real"),
                     F.array_join("input_ids", ",").alias("ids_text"))


@register("x5_vocab_encode", ENCODE_SQL)
def x5_vocab_encode(spark, sf_dir):
    return _encoded_report(_encoded(spark, sf_dir))


@register("x5_build_vocab",
          f"WITH tok AS ({TOK_SQL}) SELECT token, CAST(rn + 1 AS INTEGER) AS id FROM (SELECT token, row_number() OVER "
          f"(ORDER BY n DESC, token) AS rn FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tok) u "
          f"GROUP BY token) c) r WHERE rn <= {VOCAB_SIZE}")
def x5_build_vocab(spark, sf_dir):
    t = text.tokenize_smiles(fx.fx_doc(spark, sf_dir), "smiles")
    return text.build_vocab(t, "tokens", VOCAB_SIZE)


@register("s7_export_tokens", ENCODE_SQL)
def s7_export_tokens(spark, sf_dir):
    """Encoded rows written as CSV with JSON arrays, read back and parsed."""
    enc = _encoded(spark, sf_dir).select("row_id", "n_tokens", "input_ids", "attention_mask")
    path = io.scratch_path(spark, "tokens")
    io.export_tokens(enc, path)
    back = io.import_tokens(spark, path, "row_id bigint, n_tokens int, input_ids string, attention_mask string")
    return _encoded_report(back)


# ------------------------------------------------------------------ S5, J5, A1
WV = f"({fx.FX_WORDVEC_SQL})"


@register("s5_word_vectors",
          "SELECT word, CAST(len(vec) AS INTEGER) AS n_dims, "
          f"0.0 + round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 4) AS vec_sum FROM {WV} w")
def s5_word_vectors(spark, sf_dir):
    path = io.scratch_path(spark, "wordvec")
    io.save_features(fx.fx_wordvec(spark, sf_dir), path)
    wv = io.read_word_vectors(spark, path)
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return wv.select("word", F.size("vec").alias("n_dims"), F.round(total, 4).alias("vec_sum"))


@register("j5_lookup_vectors",
          f"WITH wv AS MATERIALIZED {WV}, "
          "words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) u WHERE w <> '') "
          "SELECT words.word, 0.0 + round(list_sum(list_transform(coalesce(wv.vec, (SELECT vec FROM wv WHERE word = 'UNK')), "
          "lambda x: CAST(x AS DOUBLE))), 4) AS vec_sum FROM words LEFT JOIN wv ON words.word = wv.word")
def j5_lookup_vectors(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word") != "").distinct()
    looked = vectors.lookup_vectors(words, fx.fx_wordvec(spark, sf_dir), "word", "UNK", "vec")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return looked.select("word", F.round(total, 4).alias("vec_sum"))


A1_SQL = f"""
WITH wv AS MATERIALIZED {WV},
tw AS (SELECT doc_id AS row_id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM documents),
tv AS (SELECT tw.row_id, coalesce(wv.vec, (SELECT vec FROM wv WHERE word = 'UNK')) AS vec FROM tw LEFT JOIN wv ON tw.word = wv.word),
el AS (SELECT row_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM tv),
s AS (SELECT row_id, dim, sum(CAST(v AS DOUBLE)) AS value FROM el GROUP BY row_id, dim)
SELECT d.doc_id AS row_id, CAST(r.dim AS INTEGER) AS dim, 0.0 + round(coalesce(s.value, 0.0), 3) AS value
FROM documents d, range(64) r(dim) LEFT JOIN s ON s.row_id = d.doc_id AND s.dim = r.dim"""


@register("a1_sentence_vectors", A1_SQL)
def a1_sentence_vectors(spark, sf_dir):
    """Document = sentence of its space-separated words; vector = sum of word vectors (UNK for unseen)."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    sv = vectors.sentence_vectors(d, "tokens", fx.fx_wordvec(spark, sf_dir), "row_id", "UNK", "vec")
    return vectors.explode_dims(sv, "vec", "row_id", 3)


# ------------------------------------------------------------------ F2, F3, A12, A13
def _graph_sql(radius: int) -> str:
    ctes = [f"atoms AS MATERIALIZED ({fx.FX_ATOMS_SQL})",
            "bonds AS MATERIALIZED (SELECT a.mol_id, a.atom_id AS src, b.atom_id AS dst, (a.atom_id + b.atom_id) % 3 AS bond_type "
            "FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id AND (b.atom_id = a.atom_id + 1 OR b.atom_id = a.atom_id - 1))",
            f"id0 AS MATERIALIZED (SELECT mol_id, atom_id, {h_sql('invariant')} AS id FROM atoms)"]
    for r in range(1, radius + 1):
        nb = h_sql("CAST(b.bond_type AS VARCHAR) || ':' || CAST(i.id AS VARCHAR)")
        ctes.append(f"env{r} AS (SELECT b.mol_id, b.src AS atom_id, count(*) AS deg, sum(CAST({nb} AS HUGEINT)) AS env "
                    f"FROM bonds b JOIN id{r - 1} i ON b.mol_id = i.mol_id AND b.dst = i.atom_id GROUP BY b.mol_id, b.src)")
        key = (f"concat_ws('|', '{r}', CAST(i.id AS VARCHAR), CAST(coalesce(e.deg, 0) AS VARCHAR), "
               f"CAST(coalesce(e.env, 0) AS VARCHAR))")
        ctes.append(f"id{r} AS MATERIALIZED (SELECT i.mol_id, i.atom_id, {h_sql(key)} AS id FROM id{r - 1} i "
                    f"LEFT JOIN env{r} e ON i.mol_id = e.mol_id AND i.atom_id = e.atom_id)")
    union = " UNION ALL ".join(f"SELECT mol_id, atom_id, {r} AS radius, id FROM id{r}" for r in range(radius + 1))
    ctes.append(f"allids AS ({union})")
    return "WITH " + ",\n".join(ctes)


F2_SQL = (_graph_sql(2) + " SELECT mol_id, CAST(count(DISTINCT id % 2048) AS INTEGER) AS n_set, "
          "array_to_string(list_sort(list_distinct(list(CAST(id % 2048 AS INTEGER)))), ',') AS bits_text "
          "FROM allids GROUP BY mol_id")


@register("f2_circular_fingerprint", F2_SQL)
def f2_circular_fingerprint(spark, sf_dir):
    atoms = write_once(fx.fx_atoms(spark, sf_dir), "atoms")
    fp = graph.circular_fingerprint(atoms, fx.fx_bonds(spark, sf_dir, atoms), 2, 2048)
    return fp.select("mol_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits_text"))


@register("f3_identifier_sentences",
          _graph_sql(1) + " SELECT mol_id, atom_id, CAST(radius AS INTEGER) AS radius, CAST(id AS VARCHAR) AS word FROM allids")
def f3_identifier_sentences(spark, sf_dir):
    atoms = write_once(fx.fx_atoms(spark, sf_dir))
    return graph.identifier_sentences(atoms, fx.fx_bonds(spark, sf_dir, atoms), 1)


def _readout_sql(how: str) -> str:
    agg = "avg" if how == "mean" else "sum"
    return (f"SELECT mol_id, CAST(dim AS INTEGER) AS dim, 0.0 + round({agg}(CAST(v AS DOUBLE)), 4) AS value FROM ("
            f"SELECT mol_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM ({fx.FX_NODES_SQL}) n) e "
            "GROUP BY mol_id, dim")


@register("a12_readout_mean", _readout_sql("mean"))
def a12_readout_mean(spark, sf_dir):
    r = vectors.readout(fx.fx_nodes(spark, sf_dir), "mean", ["block", "mol_id"])
    return vectors.explode_dims(r, "vec", "mol_id", 4)


@register("a13_readout_sum", _readout_sql("sum"))
def a13_readout_sum(spark, sf_dir):
    r = vectors.readout(fx.fx_nodes(spark, sf_dir), "sum", ["block", "mol_id"])
    return vectors.explode_dims(r, "vec", "mol_id", 4)
