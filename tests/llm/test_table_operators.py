"""URL filter, mixing, permutation index, registration and the pipeline on small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from solvara.llm import mixing, permutation_index, queries, url_filter


def _parse(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def _rule(host, path):
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://a.org",
        "http://org/x", "https://bad.example.net/p", "https://x.com/de/1", "https://x.com/fr/", "ftp://ÄB.com/fr/1://q",
        "http://notexample.org/en/1", "http://bad.example.net#a", "http://bad.example.net?u=http://ok.org/"]


def test_url_rules_and_membership(spark):
    rows = [(i, u, "host value") for i, u in enumerate(URLS * 2)] + [(900 + i, f"http://h{i}.net/x", "") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string, listed string")
    bad = {"bad.example.net"} | {f"h{i}.net" for i in range(0, 800, 3)}
    listed = spark.createDataFrame([(b,) for b in [*bad, "outside.net", None]], "key string")
    for limit in (url_filter.MAX_FILTER_BYTES, 16):  # the cascade, then the join beyond its size bound
        got = url_filter.judge_urls(pages, listed, max_bytes=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            host, path = _parse(r.url)
            rule, verdict = _rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule), r.url
            assert r.listed == (host in bad)
            assert r.verdict == (verdict or ("block" if host in bad else "allow"))
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_cascade_has_several_levels(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.build_cascade(universe, universe.where("key % 4 = 0"))
    assert len(cascade.levels) >= 3
    wrong = universe.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 4 == 0))
    assert wrong.count() == 0
    assert not any(x in wrong._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


def test_allocation_shares_shortages_among_siblings_first():
    cap = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 100, ("b", "x", "1"): 1000}
    got = mixing.allocate(200, cap, {("a",): 1.0, ("b",): 1.0})
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "1"): 50, ("b", "x", "1"): 100}
    got = mixing.allocate(600, cap, {})
    assert got[("b", "x", "1")] == 390 and sum(got.values()) == 600
    assert mixing.allocate(10**9, cap, {}) == cap
    assert mixing.allocate(5, {}, {}) == {}
    assert sum(mixing.allocate(101, cap, {("b",): 0.0, ("a",): 0.0}).values()) == 101


def _brute_mix(rows, plan):
    import hashlib
    import zlib

    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        domain = ["web", "books", "forum"][zlib.crc32((source or "").encode()) % 3]
        leaves[domain, lang or "", source or ""].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1))
    total = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = sum(total.values()) if plan.budget is None else plan.budget
    out = []
    for leaf, amount in mixing.allocate(budget, {k: v * plan.max_epochs for k, v in total.items()}, plan.weights).items():
        full, rest = divmod(amount, total[leaf])
        out += [(i, e, n) for e in range(full) for i, n in leaves[leaf]]
        key = lambda d: hashlib.md5(f"{plan.seed}:{full}:{d[0]}".encode()).hexdigest()
        for i, n in sorted(leaves[leaf], key=lambda d: (int(key(d)[:3], 16), key(d))):
            if rest <= 0:
                break
            out.append((i, full, min(n, rest)))
            rest -= n
    return sorted(out)


@pytest.mark.parametrize("budget", [None, 1, 700, 10**7])
def test_mixing_equals_brute_force(docs, budget):
    rows = [(i, "w " * (i % 23), ["en", "de", None][i % 3], f"s{i % 7 if i % 2 else 0}") for i in range(300)]
    rows += [(1000, None, "en", None), (1001, "", "fr", "s9")]
    plan = mixing.Mix(mixing.PRODUCTION.weights, budget, 2, 5)
    frame = docs(rows)
    got = mixing.mix(frame, plan).select("doc_id", "__epoch", "__taken").collect()
    assert sorted(tuple(r) for r in got) == _brute_mix(rows, plan)
    assert mixing.mixed_documents(frame, plan).columns == frame.columns


def test_mixing_edge_rows(docs, edge_rows):
    frame = docs([(*r[:2], "en", "s", "x") for r in edge_rows], ", `tokens` string")
    got = mixing.mix(frame, mixing.Mix(max_epochs=1))
    assert got.count() == len(edge_rows) and got.select("tokens").distinct().count() == 1
    assert mixing.mix(docs([])).count() == 0


def _brute_neighbours(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            hits = {}
            for j, v in zip(ids, x):
                if j != i:
                    hits[j] = max(hits.get(j, -np.inf), float((v * q).sum()))
            out[i] = sorted(hits.items(), key=lambda h: (-h[1], h[0]))[:k]
    return out


def test_permutation_index_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype("f4").astype("f8") * rng.uniform(0.5, 2, size=(3000, 1)).astype("f4")
    x[1000:1600] = x[40]  # a large group of copies
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in permutation_index.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = _brute_neighbours(range(3000), x)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    assert [i for i, _ in got[40]] == [i for i, _ in want[40]]
    assert all(abs(s - float((x[q] * x[i]).sum())) < 1e-9 for q in got for i, s in got[q])


def test_permutation_index_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (7, [1.0]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in permutation_index.search(frame).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert permutation_index.search(frame.limit(0)).count() == 0
    assert permutation_index.search(frame.where("vec_id = 1")).count() == 0


def test_permutation_index_keeps_all_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.permutation(np.unique(rng.choice([-1.0, 1.0], size=(4000, 9)), axis=0))[:190]  # all of a block is reranked
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == _brute_neighbours(range(len(x)), x)
    assert max(sum(s >= v[-1][1] for s in (x @ x[q])) for q, v in got.items()) > 40


def test_every_operator_is_registered():
    numbers = [int(re.match(r"op(\d+)_", q).group(1)) for q in queries.QUERIES if q != "pipeline"]
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "packing"]


def test_pipeline_stage_by_stage(spark, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name in ("toxicity", "near_dedup"):
            assert 0 < docs.count() < before
            before = docs.count()
        if name == "personal_data":
            assert docs.count() == before and docs.where(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]+")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pieces.where("start = 0").count() == docs.count()


def test_stages_take_edge_rows_and_extra_columns(spark, docs, edge_rows, sf_dir="/root/testdata/sf0.001"):
    names = ["score", "fp", "component_id", "spans", "tokens", "epoch", "label", "row", "n"]
    frame = docs([(*r[:2], None, None, *range(len(names))) for r in edge_rows], "".join(f", {n} int" for n in names))
    for table in (frame, frame.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.materialize(stage(spark, now, sf_dir), name)
            assert now.columns == table.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count()
        assert (pieces > 0) == (table is frame)
    kept = corpus_pipeline.keep_one_copy(spark, frame, sf_dir).collect()
    # null, empty and blank texts share fingerprint 0, and so do both rows of id 3
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 5, 6, None]
