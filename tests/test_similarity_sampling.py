"""Closed forms against brute force, edge cases, properties."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from solvara.operators import ranking, sampling, similarity


def md5_bit(gram: str, n_bits: int) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % n_bits


def py_bits(s, q, n_bits):
    if s is None or len(s) < q:
        return []
    return sorted({md5_bit(s[i:i + q], n_bits) for i in range(len(s) - q + 1)})


def test_fingerprint_matches_python(spark):
    rows = [(1, "CCO"), (2, "CCOC"), (3, "c1ccccc1O"), (4, ""), (5, None), (6, "F/C=C\\F"),
            (7, "line\nbreak with ünïcode"), (8, "CCOCCOCCO" * 50), (9, "ab\U0001F600cd\U0001F601\U0001F602xyz")]
    df = spark.createDataFrame(rows, "row_id bigint, smiles string")
    for n_bits in (512, 256, 2048, 100):
        got = {r["row_id"]: list(r["bits"]) for r in similarity.lingo_fingerprint(df, "smiles", 4, n_bits).collect()}
        for rid, s in rows:
            assert got[rid] == py_bits(s, 4, n_bits), (rid, n_bits)


def brute_comp_sim(bits, n_bits):
    """Leave-one-out JT iSIM straight from the definition."""
    out = []
    for i in range(len(bits)):
        rest = [b for j, b in enumerate(bits) if j != i]
        n = len(rest)
        a = d = 0
        for q in range(n_bits):
            k = sum(1 for b in rest if q in b)
            a += k * (k - 1) // 2
            d += k * (n - k)
        out.append(a / (a + d) if (a + d) and n >= 2 else 0.0)
    return out


def test_comp_sim_closed_form_equals_brute_force(spark):
    rnd = random.Random(7)
    n_bits = 64
    bits = [sorted(rnd.sample(range(n_bits), rnd.randint(0, 20))) for _ in range(40)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "row_id bigint, bits array<int>")
    got = {r["row_id"]: r["comp_sim"] for r in similarity.complementary_similarity(df, n_bits).collect()}
    want = brute_comp_sim([set(b) for b in bits], n_bits)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, rel=1e-12, abs=1e-15)


def test_comp_sim_edge_cases(spark):
    empty = spark.createDataFrame([], "row_id bigint, bits array<int>")
    assert similarity.complementary_similarity(empty, 16).count() == 0
    one = spark.createDataFrame([(1, [1, 2])], "row_id bigint, bits array<int>")
    assert similarity.complementary_similarity(one, 16).first()["comp_sim"] == 0.0
    same = spark.createDataFrame([(i, [1, 2, 3]) for i in range(5)], "row_id bigint, bits array<int>")
    vals = {r["comp_sim"] for r in similarity.complementary_similarity(same, 16).collect()}
    assert vals == {1.0}
    iso = similarity.isim(same, 16).first()
    assert iso["isim"] == 1.0 and iso["n_rows"] == 5


def test_medoid_outlier(spark):
    rows = [(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [1, 2, 4]), (4, [9, 10, 11])]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<int>")
    cs = sorted((r["comp_sim"], r["row_id"]) for r in similarity.complementary_similarity(df, 16).collect())
    assert similarity.medoid(df, 16).first()["row_id"] == cs[0][1]
    top = max(c for c, _ in cs)
    assert similarity.outlier(df, 16).first()["row_id"] == min(i for c, i in cs if c == top)


def test_global_rank_equals_row_number_and_has_no_window(spark):
    from checks import plan_text
    rnd = random.Random(3)
    rows = [(i, float(rnd.randint(0, 20))) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id bigint, v double").repartition(7)
    ranked = ranking.global_rank(df, ["v", "row_id"])
    want = {rid: k for k, (v, rid) in enumerate(sorted((v, rid) for rid, v in rows))}
    assert {r["row_id"]: r["rank"] for r in ranked.collect()} == want
    assert "Window" not in plan_text(ranked)


@pytest.mark.parametrize("n", [1, 7, 100, 137])
@pytest.mark.parametrize("tiles", [1, 3, 10, 80, 200])
def test_ntile_closed_form(spark, n, tiles):
    df = spark.range(n).withColumnRenamed("id", "r")
    sql = df.selectExpr("r", f"ntile({tiles}) OVER (ORDER BY r) AS t").collect()
    mine = df.select("r", ranking.ntile_expr(F.col("r"), n, tiles).alias("t")).collect()
    assert sorted(map(tuple, sql)) == sorted(map(tuple, mine))


def test_average_rank_ties(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame(list(enumerate(vals)), "row_id bigint, v double")
    got = {r["row_id"]: r["avg_rank"] for r in ranking.average_rank(df, "v").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: 5.0, 5: 1.5}


def _sim_frame(spark, n, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.choice([0.1, 0.2, 0.25, 0.5, 0.9]) + rnd.random() / 1000) for i in range(n)],
                                 "row_id bigint, comp_sim double")


@pytest.mark.parametrize("pct", [10, 80, 87.5, 94.45])
def test_stratified_size_and_firsts(spark, pct):
    sim = _sim_frame(spark, 137)
    n = 137
    m = int(Decimal(n) * Decimal(str(pct)) / 100)
    picked = {r["row_id"] for r in sampling.stratified_sample(sim, pct).collect()}
    assert len(picked) == m
    order = [r["row_id"] for r in sim.orderBy("comp_sim", "row_id").collect()]
    tiles = sim.selectExpr("row_id", f"ntile({m}) OVER (ORDER BY comp_sim, row_id) AS t").collect()
    first = {}
    for rid in order:
        t = next(x["t"] for x in tiles if x["row_id"] == rid)
        first.setdefault(t, rid)
    assert picked == set(first.values())


def test_quota_matches_round_robin(spark):
    sim = _sim_frame(spark, 200, seed=5)
    picked = {r["row_id"] for r in sampling.quota_sample(sim, 90).collect()}
    rows = sorted((r["comp_sim"], r["row_id"]) for r in sim.collect())
    lo, hi = rows[0][0], rows[-1][0]
    bins = {}
    for c, rid in rows:
        b = min(int((c - lo) / (hi - lo) * 10), 9)
        bins.setdefault(b, []).append(rid)
    order = sorted(((k, b, rid) for b, ids in bins.items() for k, rid in enumerate(ids)))
    want = {rid for _, _, rid in order[:180]}
    assert picked == want


def test_three_way_split_properties(spark):
    rnd = random.Random(11)
    bits = spark.createDataFrame([(i, sorted(rnd.sample(range(64), 8))) for i in range(300)],
                                 "row_id bigint, bits array<int>")
    for method, p1, p2 in (("stratified", 80, 87.5), ("quota", 90, 94.45)):
        split = sampling.three_way_split(bits, 64, method, p1, p2)
        rows = split.collect()
        assert len(rows) == 300 and len({r["row_id"] for r in rows}) == 300
        counts = {}
        for r in rows:
            counts[r["split"]] = counts.get(r["split"], 0) + 1
        outer = int(Decimal(300) * Decimal(str(p1)) / 100)
        inner = int(Decimal(outer) * Decimal(str(p2)) / 100)
        assert counts == {"Training": inner, "Validation": outer - inner, "Testing": 300 - outer}
        # same result whatever the input partitioning
        again = sampling.three_way_split(bits.repartition(5), 64, method, p1, p2)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_hash_split_and_kfold_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    a = sampling.hash_split(df, "row_id", [70, 10, 20], 536).collect()
    b = sampling.hash_split(df.repartition(3), "row_id", [70, 10, 20], 536).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    folds = {r["fold"] for r in sampling.k_fold(df, "row_id", 5).collect()}
    assert folds == {0, 1, 2, 3, 4}


def test_sample_size_zero_and_tiny_sets(spark):
    sim = _sim_frame(spark, 7)
    assert sampling.stratified_sample(sim, 10).count() == 0     # floor(7 * 10 / 100) = 0
    assert sampling.quota_sample(sim, 10).count() == 0
    one = _sim_frame(spark, 1)
    assert sampling.stratified_sample(one, 100).count() == 1
    assert sampling.quota_sample(one, 100).count() == 1


def test_global_rank_offsets(spark):
    rows = [(i, float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, v double").repartition(5)
    ranked = {r["row_id"]: r["rank"] for r in ranking.global_rank(df, ["v", "row_id"]).collect()}
    want = {rid: k for k, (v, rid) in enumerate(sorted((v, rid) for rid, v in rows))}
    assert ranked == want
