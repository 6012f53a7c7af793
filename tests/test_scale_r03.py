"""Operators rewritten to scale: equal rows by another road, and the plan or bound that the old form lacked."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from solvara.functions import qgrams
from solvara.operators import vectors
from solvara.plans import fixtures as fx


def _word_vectors(spark):
    return spark.createDataFrame([("a", [1.0, 2.0]), ("b", [10.0, 0.5]), ("b", [1.0, 1.0]), ("c", None), ("UNK", [100.0, 7.0])],
                                 "word string, vec array<float>")


def test_sentence_vectors_in_small_blocks(spark, monkeypatch):
    """Words with several vectors or none, unseen and NULL words, empty and NULL sentences, NULL and repeated keys."""
    monkeypatch.setattr(vectors, "BLOCK_WORDS", 5)
    rows = [(1, ["a", "a", "b"]), (2, []), (3, None), (4, ["zzz", None, "c"]), (1, ["a"]), (None, ["a"]), (None, ["b", "a"])]
    df = spark.createDataFrame(rows * 3, "row_id long, tokens array<string>").coalesce(2)
    got = {r.row_id: list(r.vec) for r in vectors.sentence_vectors(df, "tokens", _word_vectors(spark)).collect()}
    want = {1: [3 * 14.0, 3 * 7.5], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [600.0, 42.0], None: [3 * 13.0, 3 * 5.5]}
    assert got == want
    long = df.select("row_id", F.explode_outer("tokens").alias("word"))
    assert {r.row_id: list(r.vec) for r in vectors.word_sums(long, _word_vectors(spark)).collect()} == want


def test_vectors_travel_by_block_not_by_word(spark):
    df = spark.createDataFrame([(i, ["a", "b", "zzz"]) for i in range(500)], "row_id long, tokens array<string>").coalesce(1)
    plan = vectors.sentence_vectors(df, "tokens", _word_vectors(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LeftOuter" not in plan


def test_readout_finds_its_rows_in_place(spark, tmp_path):
    """The nodes are dealt by block before the join; the readout's rows are not dealt once more with their vectors."""
    spark.createDataFrame([(i // 4, i % 4) for i in range(400)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(7, [0.5, 0.5])], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vectors.readout(fx.fx_nodes(spark, str(tmp_path)), "sum", ["block", "mol_id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.mol_id: list(r.vec) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    head = plan[:plan.index("SortMergeJoin")]
    assert "Exchange" not in head
    n = 51
    want = {m: [sum(sum([float(k)] + [0.5] * (k == 7)) for k in ks), sum(1.0 + 0.5 * (k == 7) for k in ks)]
            for m, ks in ((m, [k for k in ((m * 7 + a) % n for a in range(4)) if k < 50]) for m in range(100)) if ks}
    assert got == want


def test_qgram_bits_of_slices(monkeypatch):
    """Windows and slices that cut texts anywhere, characters beyond 16 bits, and a full table of known grams."""
    texts = ["a😀b😀c\n\nxé", "abc", "", None, "abcd", "Prose, und noch mehr Prose. " * 5, "日本語のテキスト𝒳𝒳𝒳𝒳"]

    def plain(t):
        t = t or ""
        return sorted({int(hashlib.md5(t[i:i + 4].encode()).hexdigest()[:8], 16) % 512 for i in range(len(t) - 3)})

    monkeypatch.setattr(qgrams, "CACHE_GRAMS", 10)
    for window in (7, 64, 1 << 20):
        monkeypatch.setattr(qgrams, "WINDOW", window)
        column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
        assert qgrams.text_bits(column, 4, 512).to_pylist() == [plain(t) for t in texts]
    assert len(qgrams.text_bits(pa.array([], pa.binary()), 4, 512)) == 0


def test_grammar_stops_at_the_first_broken_rule():
    """Outside Spark's expressions a string is read only as far as its first broken rule."""
    from solvara.operators import smiles

    assert smiles.first_reason("C" * 10 + "é" + "C" * 10) == "unknown_symbol"
    assert next(smiles._tokens("é" + "C" * 100)) == "é"
    assert list(smiles._tokens("C\x01Cé[a\x01]")) == ["C", "C", "é", "[a", "]"] and list(smiles._tokens("[a\x01]")) == ["[a\x01]"]
    assert [smiles.first_reason(s) for s in ("", "C1CC1", "C1CC", "C(", "C=", "F/C=C/F", "C=1CCC/1")] == [
        None, None, "open_ring", "unbalanced_branch", "misplaced_bond", None, "ring_bond_conflict"]


def test_components_come_from_exact_counts(spark):
    """The counts of set bits are added up exactly; axes, shares and means equal those of the whole matrix."""
    from solvara.operators import models

    rng = np.random.default_rng(5)
    x = (rng.random((300, 6)) < [0.5, 0.2, 0.7, 0.1, 0.4, 0.9]).astype(int)
    x[:, 1] = x[:, 0]
    rows = [(i, np.flatnonzero(r).tolist()) for i, r in enumerate(x)]
    bits = spark.createDataFrame(rows, "row_id long, bits array<int>").repartition(7)
    axes, share, mean = models._components(bits, "bits", 6)
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(share, value[::-1] / value.sum(), atol=1e-12)
    assert np.allclose(abs(axes[:, :2]), abs(vector[:, ::-1][:, :2]))
    got = {r.row_id: (r.x, r.y) for r in models.project_2d(bits, n_bits=6).collect()}
    assert np.allclose(np.abs([got[i] for i in range(300)]), np.abs((x - mean) @ axes[:, :2]))


def test_text_regressor_cuts_texts_once(spark, monkeypatch):
    """Both fits read the written counts; the model still takes texts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF
    from pyspark.ml.regression import LinearRegression
    from solvara.operators import models

    written, plain = [], models.write_once
    monkeypatch.setattr(models, "write_once", lambda df, name="step": written.append(df.columns) or plain(df, name))
    df = spark.createDataFrame([("C" * i + "N" * (i % 3), float(i)) for i in range(1, 40)], "smiles string, label double")
    model = models.fit_text_regressor(df, "smiles", "label", num_features=32, reg=0.01)
    assert written == [["label", "_tf"]]
    whole = Pipeline(stages=[*model.stages[:2], IDF(inputCol="_tf", outputCol="_tfidf"),
                             LinearRegression(featuresCol="_tfidf", labelCol="label", predictionCol="pred", regParam=0.01)]).fit(df)
    got, want = ([r.pred for r in m.transform(df).orderBy("label").select("pred").collect()] for m in (model, whole))
    assert np.allclose(got, want, atol=1e-6)


def test_forest_answers_each_question_once(spark):
    """Kept answers, many questions, deep trees and array features that travel once give the same predictions."""
    from solvara.operators import boosting

    rng = np.random.default_rng(3)
    for width, depth in ((2, 6), (3, 9)):
        x = rng.normal(size=(400, width))
        model = boosting.fit_rows_in_memory(x, x[:, 0] * 2 + rng.normal(size=400), n_estimators=30, depth=depth)
        codes = model.codes(x)
        want = model.base + sum(model.leaf[t][model.leaves(codes, t)] for t in range(model.n_trees))
        assert np.allclose(model.predict(x), want, rtol=0, atol=1e-9)
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
        scored = boosting.score_boosting(model, df, "x")
        assert scored.columns == ["i", "x", "pred"] and "__x" not in scored._jdf.queryExecution().optimizedPlan().toString()
        assert np.allclose([r.pred for r in scored.orderBy("i").collect()], want, rtol=0, atol=1e-9)
    assert boosting.SCORE_CELLS


def test_tokens_are_found_without_trying_every_alternative(spark):
    """The pattern that Spark runs finds the tokens of the documented one."""
    import random
    import re

    from solvara.operators import text

    pick = random.Random(7)
    texts = ["", "B", "Br", "BrBBr", "ClC", "Cr[", "[]", "[]]", "[[C]", "[a\nb]", "%1", "%12", "%%123", "[%12", "é[é]😀Cl", "a-b^c\\/$"]
    texts += ["".join(pick.choice("BrClNcnopsx[]%%012()=#-+\\/:~@?>*$.^ \né😀") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    found = text.tokenize_smiles(df, "s")
    assert {r.s: r.tokens for r in found.collect()} == {t: re.findall(text.SMILES_TOKEN_RE, t or "") for t in [*texts, None]}
    assert "Br|Cl|" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_text_model_cuts_with_the_quick_pattern(spark):
    import re

    from solvara.operators import models, text

    texts = ["BrBBr" * 3, "ClC[", "[]]", "[[C]", "[a\nb]%1", "%%123", "[%12", "é[é]😀Cl", "a-b^c\\/$"] * 3
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(texts)], "s string, label double")
    model = models.fit_text_regressor(df, "s", "label", num_features=32, reg=0.1)
    assert model.stages[0].getPattern() == text.QUICK_TOKEN_RE
    assert all(r._tokens == re.findall(text.SMILES_TOKEN_RE, r.s) for r in model.stages[0].transform(df).select("s", "_tokens").collect())


def test_walks_of_whole_and_of_large_molecules(spark, monkeypatch):
    """Batches that cut molecules anywhere, NULL parts, repeated atoms and bonds, loops, and molecules beyond either bound."""
    from solvara.operators import keys

    rng = np.random.default_rng(11)
    names, kinds = ["A", "B", "", "é", None], [0, 1, 2, None]
    atoms = [(m, a, names[rng.integers(5)]) for m in range(40) for a in range(rng.integers(1, 7))]
    bonds = [(m, int(rng.integers(7)), int(rng.integers(7)), kinds[rng.integers(4)]) for m in range(42) for _ in range(rng.integers(0, 9))]
    atoms += atoms[::5] + [(3, 1, "Z"), (5, None, "A"), (None, 1, "A"), (None, 2, "B"), (50, 1, "A"), (51, None, None)]
    bonds += bonds[::4] + [(3, None, 1, 1), (3, 1, None, 1), (None, 1, 2, 0), (60, 1, 2, 0)]
    a = spark.createDataFrame(atoms, "mol_id long, atom_id int, invariant string")
    b = spark.createDataFrame(bonds, "mol_id long, src int, dst int, bond_type int")

    def got(longest=4, n_bits=64):
        found = [(r.mol_id, r.bits) for r in keys.path_fingerprint(a, b, longest, n_bits).collect()]
        assert len(found) == len(dict(found))
        return dict(found)

    want = {r.mol_id: r.bits for r in keys._fingerprint_by_atom(a, b, 4, 64).collect()}
    assert len(want) == 43 and sum(map(bool, want.values())) > 20
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        with monkeypatch.context() as m:  # all molecules are of bounded size: no walk is dealt by atom
            m.setattr(keys, "walk_hashes", None)
            assert got() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(keys, "WHOLE_ROWS", 12)
    assert got() == want


def test_walks_beyond_the_bound_are_left_to_the_other_road():
    """In slices of few walks, and with molecules of too many walks, which are named but not worked on."""
    from solvara.operators import keys

    rows = [(0, False, None, 1, None, b"A"), (0, False, None, 2, None, b"B"), (0, True, 1, 2, b"1", None), (0, True, 2, 1, b"1", None)]
    rows += [(1, *r[1:]) for r in rows] + [(1, True, 1, 1, b"0", None), (2, False, None, 1, None, b"A"), (3, True, 1, 2, b"0", None)]
    names = ["mol_id", "is_bond", "src", "dst", "bond_type", "invariant"]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    mol = np.array([r[0] for r in rows])
    all_bits = {int(k): v.tolist() for k, v in keys._walk_bits(mol, batch, 3, 64)}
    assert set(all_bits) == {0, 1, 2} and all_bits[2] == [] and set(all_bits[0]) < set(all_bits[1])
    for bound, slices in ((6, 1), (500_000, 1), (6, 500_000)):
        keep = keys.WHOLE_WALKS, keys.SLICE_WALKS
        keys.WHOLE_WALKS, keys.SLICE_WALKS = bound, slices
        try:
            some = {int(k): v if v is None else v.tolist() for k, v in keys._walk_bits(mol, batch, 3, 64)}
        finally:
            keys.WHOLE_WALKS, keys.SLICE_WALKS = keep
        assert some == {**all_bits, **({1: None} if bound == 6 else {})}


def test_md5_of_many_short_strings():
    from solvara.functions.md5_words import md5_ints

    number = np.array([0, 9, 10, 99_999, 4294967295, 1_000_000_000, -1, -1] * 3000, dtype="i8")
    endings = [b"", b"|", b"|1|AF", "|é|".encode(), b"|" + b"x" * 44, b"|" + b"x" * 45, b"|" + b"x" * 200]
    which = np.arange(len(number)) // 8 % len(endings)
    text = [(b"%d" % n + endings[w]) if n >= 0 else endings[w][1:] for n, w in zip(number, which)]
    assert md5_ints(number, endings, which).tolist() == [int(hashlib.md5(t).hexdigest()[:8], 16) for t in text]
    assert md5_ints(number[:0], [], which[:0]).tolist() == []
