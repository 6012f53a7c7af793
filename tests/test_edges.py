"""NULLs, zeros, other key names and round trips that the first fixtures did not show."""

import math

import pytest
from pyspark.sql import functions as F

from solvara.operators import descriptors as ds
from solvara.operators import metrics as m
from solvara.operators import models, ranking, relational as rel, sampling, text, vectors
from solvara.sources import tables as io


def test_calibration_area_with_zero_variance(spark):
    rows = [("a", 1.0, 1.5, 0.0), ("a", 1.0, 1.5, 4.0), ("a", 2.0, 0.0, 1.0), ("b", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "split string, label double, pred double, unc double")
    got = {r.split: (r.cal_area, r.n_rejected) for r in m.calibration_area(df).collect()}
    t = [0.25, 2.0]
    want = sum(0.01 * abs(sum(x <= z for x in t) / 2 - p) for z, p in zip(m.CAL_Z, m.CAL_LEVELS))
    assert got["a"][0] == pytest.approx(want) and got["a"][1] == 1
    assert got["b"] == (None, 1)


def test_first_level_is_exact(spark):
    ts = [0.0, 1e-12, 50.0] + [z + d for z in m.CAL_Z for d in (-1e-12, 0.0, 1e-12)] + [i / 400 for i in range(1600)]
    got = spark.createDataFrame([(t,) for t in ts], "t double").select("t", m._first_level(F.col("t")).alias("b")).collect()
    for r in got:
        want = next((b for b, z in enumerate(m.CAL_Z, start=1) if r.t <= z), 100)
        assert r.b == want, r


def test_correlation_and_metrics_use_common_rows(spark):
    rows = [(float(i), 2.0 * i if i % 3 else None, "x") for i in range(30)] + [(None, 500.0, "x"), (1000.0, None, "x")]
    df = spark.createDataFrame(rows, "label double, pred double, split string")
    assert ds.corr_matrix(df, ["label", "pred"])[("label", "pred")] == pytest.approx(1.0)
    assert m.pearson(df).first().pearsonr == pytest.approx(1.0)
    got = m.regression_metrics(df).first()
    pairs = [(a, b) for a, b, _ in rows if a is not None and b is not None]
    assert got.n == len(pairs) and got.mae == pytest.approx(sum(abs(a - b) for a, b in pairs) / len(pairs))


@pytest.mark.parametrize("width", [48, 49])
def test_correlation_rule_does_not_depend_on_width(spark, width):
    rows = [[float((i * (j + 3)) % 17) if (i + j) % 5 else None for j in range(width)] for i in range(40)]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{j} double" for j in range(width)))
    got = ds.corr_matrix(df, [f"c{j}" for j in range(width)])
    assert len(got) == width * (width - 1) // 2
    x, y = zip(*[(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert got[("c0", "c1")] == pytest.approx(want)


def test_split_with_another_key_name(spark):
    bits = spark.createDataFrame([(i, [i % 8, 8 + i % 5]) for i in range(100)], "mol bigint, bits array<int>")
    for method, pct in (("quota", (90, 94.45)), ("stratified", (80, 87.5))):
        got = sampling.three_way_split(bits, 16, method, *pct, id_col="mol")
        assert got.columns == ["mol", "split"] and got.count() == 100


def test_csv_keeps_space_empty_null_and_umlauts(spark, tmp_path):
    rows = [(1, "  CCO "), (2, ""), (3, None), (4, 'a "quoted", Ä漢'), (5, "\\N"[1:]), (6, "line\nbreak")]
    df = spark.createDataFrame(rows, "row_id bigint, smiles string")
    path = io.write_table(df, str(tmp_path / "t"))
    back = io.read_table(spark, path, "row_id bigint, smiles string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    both = io.read_splits(spark, {"A": path}, "row_id bigint, smiles string", multi_line=True)
    assert both.where("split = 'A'").count() == len(rows)
    tokens = spark.createDataFrame([(1, "ä", [1, 2], [1, 0])], "row_id bigint, t string, input_ids array<int>, attention_mask array<int>")
    p2 = str(tmp_path / "tok")
    io.export_tokens(tokens, p2)
    got = io.import_tokens(spark, p2, "row_id bigint, t string, input_ids string, attention_mask string").first()
    assert (got.t, got.input_ids, got.attention_mask) == ("ä", [1, 2], [1, 0])


def test_best_run_skips_missing(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 3.0), (2, 0, float("nan")), (2, 1, 4.0)], "run_id int, epoch int, loss double")
    assert tuple(rel.best_run(df, "loss").first()) == (1, 1, 3.0)
    assert tuple(rel.best_run(df, "loss", mode="max").first()) == (2, 1, 4.0)
    assert sorted(map(tuple, rel.best_run(df, "loss", by="run_id").collect())) == [(1, 1, 3.0), (2, 1, 4.0)]


def test_average_rank_of_missing_is_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 1.0), (5, float("nan"))], "row_id bigint, v double")
    got = {r.row_id: r.avg_rank for r in ranking.average_rank(df, "v").collect()}
    assert got == {1: 2.5, 2: None, 3: 2.5, 4: 1.0, 5: None}


def test_validate_order_of_brackets(spark):
    rows = [(1, "CC)(C"), (2, "C(C)C"), (3, "]C["), (4, "((C)C)"), (5, "C[(])")]
    good, bad = rel.validate(spark.createDataFrame(rows, "row_id bigint, smiles string"), "smiles")
    assert {r.row_id for r in good.collect()} == {2, 4, 5}
    assert {r.row_id: r.reason for r in bad.collect()} == {1: "unbalanced_parentheses", 3: "unbalanced_brackets"}


def test_model_text_with_missing_parts(spark):
    df = spark.createDataFrame([(1, "C", None, 1.0), (2, None, 2.0, float("nan"))], "row_id bigint, s string, a double, b double")
    got = {r.row_id: r.model_text for r in text.model_text(df, "s", ["a", "b"]).collect()}
    assert got == {1: "C [SEP] nan [SEP] 1.00", 2: " [SEP] 2.00 [SEP] nan"}


def test_dedup_counts_null_keys_once(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "n", "c"), (4, "vn", "d"), (5, "n", "e")], "row_id bigint, k string, p string")
    assert sorted(r.row_id for r in rel.dedup_first(df, "k").collect()) == [1, 3, 4]
    assert sorted(r.row_id for r in rel.dedup_first(df, ["k", "p"]).collect()) == [1, 2, 3, 4, 5]


def test_zip_tables_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "row_id bigint, a int")
    b = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "row_id bigint, b int")
    with pytest.raises(ValueError, match="repeat"):
        rel.zip_tables(a, b)


def test_wide_vectors_and_vocabularies(spark):
    dim = 300
    wv = spark.createDataFrame([("a", [1.0] * dim), ("b", [float(i) for i in range(dim)])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, [])], "row_id bigint, tokens array<string>")
    got = {r.row_id: list(r.vec) for r in vectors.sentence_vectors(docs, "tokens", wv).collect()}
    assert got[1] == pytest.approx([2.0 + i for i in range(dim)]) and got[2] == [0.0] * dim
    vocab = spark.createDataFrame([(f"t{i}", i + 2) for i in range(5000)], "token string, id int")
    rows = spark.createDataFrame([(1, [f"t{i}" for i in range(0, 5000, 7)]), (2, []), (3, None)], "row_id bigint, tokens array<string>")
    enc = {r.row_id: r for r in text.encode(rows, vocab, max_length=16).collect()}
    assert enc[1].input_ids == [7 * i + 2 for i in range(16)] and enc[1].n_tokens == 715
    assert enc[2].input_ids == [0] * 16 == enc[3].input_ids and sum(enc[2].attention_mask) == 0


def test_boosting_settings_are_named():
    assert models.gbt_params(**models.GBT_PRESETS["viscosity"])["maxIter"] == 2000
    with pytest.raises(TypeError):
        models.gbt_params(learing_rate=0.1)


def test_no_checkpoint_folder_off_local():
    from types import SimpleNamespace

    from solvara.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", getConf=lambda: SimpleNamespace(get=lambda *a: None))
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(fake)
