"""X3-X5, J5, A1, A12/A13, F2/F3, L1-L5, L11, S6, streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from solvara.operators import graph, models, text, vectors


def test_tokenize_smiles(spark):
    df = spark.createDataFrame([(1, "CC(=O)Nc1ccc(Cl)cc1Br"), (2, "[NH4+].[Cl-]"), (3, None), (4, "C%12CC%12")],
                               "row_id bigint, smiles string")
    got = {r["row_id"]: r["tokens"] for r in text.tokenize_smiles(df, "smiles").collect()}
    assert got[1] == ["C", "C", "(", "=", "O", ")", "N", "c", "1", "c", "c", "c", "(", "Cl", ")", "c", "c", "1", "Br"]
    assert got[2] == ["[NH4+]", ".", "[Cl-]"]
    assert got[3] == []
    assert got[4] == ["C", "%12", "C", "C", "%12"]


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, ["C", "C", "O"]), (2, ["C", "N"]), (3, [])], "row_id bigint, tokens array<string>")
    vocab = text.build_vocab(df, "tokens", 2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"C": 2, "N": 3}
    enc = {r["row_id"]: r for r in text.encode(df, vocab, "tokens", 4).collect()}
    assert enc[1]["input_ids"] == [2, 2, 1, 0] and enc[1]["attention_mask"] == [1, 1, 1, 0]
    assert enc[3]["input_ids"] == [0, 0, 0, 0] and enc[3]["attention_mask"] == [0, 0, 0, 0]
    long = spark.createDataFrame([(9, ["C"] * 10)], "row_id bigint, tokens array<string>")
    e = text.encode(long, vocab, "tokens", 4).first()
    assert e["input_ids"] == [2, 2, 2, 2] and e["n_tokens"] == 10


def test_model_text_fixed_format(spark):
    df = spark.createDataFrame([("CCO", 10000000.0), ("O", 298.15)], "s string, t double")
    got = [r["model_text"] for r in text.model_text(df, "s", ["t"]).collect()]
    assert got == ["CCO [SEP] 10000000.00", "O [SEP] 298.15"]


def _wv(spark, with_unk=True):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0])] + ([("UNK", [5.0, 5.0])] if with_unk else [])
    return spark.createDataFrame(rows, "word string, vec array<float>")


def test_sentence_vectors_sum_unk_and_empty(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["zz"]), (3, [])], "row_id bigint, tokens array<string>")
    got = {r["row_id"]: r["vec"] for r in vectors.sentence_vectors(df, "tokens", _wv(spark)).collect()}
    assert got == {1: [2.0, 2.0], 2: [5.0, 5.0], 3: [0.0, 0.0]}
    got2 = {r["row_id"]: r["vec"] for r in vectors.sentence_vectors(df, "tokens", _wv(spark, False)).collect()}
    assert got2[2] == [0.0, 0.0]


def test_readout_mean_sum(spark):
    nodes = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 4.0]), (2, 1, [5.0, 5.0])],
                                  "mol_id bigint, atom_id int, vec array<double>")
    mean = {r["mol_id"]: r["vec"] for r in vectors.readout(nodes, "mean").collect()}
    total = {r["mol_id"]: r["vec"] for r in vectors.readout(nodes, "sum").collect()}
    assert mean == {1: [2.0, 3.0], 2: [5.0, 5.0]} and total == {1: [4.0, 6.0], 2: [5.0, 5.0]}


def test_circular_identifiers_isolated_atom_and_symmetry(spark):
    atoms = spark.createDataFrame([(1, 1, "C"), (1, 2, "O"), (1, 3, "C"), (2, 1, "C")],
                                  "mol_id bigint, atom_id int, invariant string")
    bonds = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1), (1, 2, 3, 1), (1, 3, 2, 1)],
                                  "mol_id bigint, src int, dst int, bond_type int")
    ids = {(r["mol_id"], r["atom_id"], r["radius"]): r["id"] for r in graph.atom_identifiers(atoms, bonds, 2).collect()}
    assert len(ids) == 12
    # the two carbons of C-O-C are symmetric, so they share identifiers at every radius
    for r in range(3):
        assert ids[(1, 1, r)] == ids[(1, 3, r)]
    # the isolated carbon matches the bonded carbons at radius 0 only
    assert ids[(2, 1, 0)] == ids[(1, 1, 0)] and ids[(2, 1, 1)] != ids[(1, 1, 1)]
    fp = {r["mol_id"]: r["bits"] for r in graph.circular_fingerprint(atoms, bonds, 2, 64).collect()}
    assert all(0 <= b < 64 for b in fp[1]) and fp[1] == sorted(set(fp[1]))
    sent = graph.sentences_as_arrays(graph.identifier_sentences(atoms, bonds, 1)).collect()
    assert {r["mol_id"]: len(r["sentence"]) for r in sent} == {1: 6, 2: 2}


@pytest.fixture(scope="module")
def feat(spark):
    from solvara.plans import fixtures as fx
    return fx.fx_feat(spark, "/root/testdata/sf0.001").drop("pred").cache()


def test_gbt_beats_mean_and_round_trip(spark, feat):
    train = feat.where(F.col("split") == "Training")
    model = models.fit_gbt(train, ["qty", "disc", "tax"], "label", n_estimators=5, depth=3)
    scored = models.score(model, train)
    mse = scored.agg(F.avg((F.col("label") - F.col("pred")) ** 2)).first()[0]
    var = train.agg(F.var_pop("label")).first()[0]
    assert mse < var
    from solvara.sources import tables as io
    path = os.path.join(tempfile.mkdtemp(prefix="solvara-model-"), "m")
    io.save_model(model, path)
    again = models.score(io.load_model(path), train)
    a = {r["row_id"]: r["pred"] for r in scored.collect()}
    b = {r["row_id"]: r["pred"] for r in again.collect()}
    assert a == b


def test_mean_variance_positive(spark, feat):
    train = feat.where(F.col("split") == "Training")
    mm, vm = models.fit_mean_variance(train, ["qty", "disc", "tax"], "label", n_estimators=3, depth=3)
    pv = models.predict_mean_variance(mm, vm, feat)
    assert pv.where(~(F.col("unc") > 0)).count() == 0


def test_project_2d_variance_ordered(spark):
    import random
    rnd = random.Random(2)
    bits = spark.createDataFrame([(i, sorted(rnd.sample(range(32), 6))) for i in range(80)],
                                 "row_id bigint, bits array<int>")
    ev = models.explained_variance(bits)
    assert ev[0] >= ev[1] >= 0
    xy = models.project_2d(bits)
    assert xy.count() == 80
    assert abs(xy.agg(F.avg("x")).first()[0]) < 1e-9


def test_streaming_featurize(spark):
    from solvara.streaming.featurize import featurize_stream, read_molecule_stream
    src = tempfile.mkdtemp(prefix="solvara-stream-src-")
    spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1"), (3, "bad smiles!")], "row_id bigint, smiles string") \
        .write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    stream = read_molecule_stream(spark, os.path.join(src, "batch1"))
    q = (featurize_stream(stream).writeStream.format("memory").queryName("fp_stream")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    rows = {r["row_id"]: r["n_set"] for r in spark.sql("SELECT * FROM fp_stream").collect()}
    assert set(rows) == {1, 2} and rows[2] >= 1


def test_early_stopping_never_keeps_more_trees(spark, feat):
    f = feat.withColumn("is_val", F.col("split") == "Validation").where(F.col("split") != "Testing")
    cfg = {"n_estimators": 25, "learning_rate": 0.5, "depth": 3}
    stop = models.fit_gbt(f, ["qty", "disc", "tax"], "label", validation_col="is_val", validation_tol=0.01, **cfg)
    full = models.fit_gbt(f.where(~F.col("is_val")), ["qty", "disc", "tax"], "label", **cfg)
    assert models.n_trees(stop) <= models.n_trees(full) == 25
