"""The whole pipeline against a plain Python version of its five stages on a small corpus."""

from __future__ import annotations

import random

import numpy as np
from test_table_operators import _brute_mix
from test_text_operators import _components, _fingerprint, _ids

import corpus_pipeline
from solvara.llm import mixing, pii, toxicity


def _corpus():
    rng = random.Random(11)
    words = [a + b for a in ("lor", "ips", "dol", "ame", "sit", "con") for b in ("em", "um", "or", "at", "is", "en", "ak", "il")]
    rows = []
    for i in range(140):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if i % 7 == 0:
            body[rng.randrange(len(body))] = rng.choice(["scumbag", "idiotic", "idiot"])
        if i % 5 == 0:
            body.insert(3, f"user{i}@mail.example.com")
        rows.append((i, " ".join(body) + ".", rng.choice(["en", "de", None]), f"src{i % 3}"))
    copies = [(200 + i, rows[i][1], "en", "src9") for i in range(1, 60, 4)]
    near = [(300 + i, rows[i][1] + " ak", "en", "src0") for i in range(2, 60, 4)]
    return rows + copies + near + [(400, None, None, None), (401, "", "en", "src1"), (402, None, "fr", "src1")]


def test_pipeline_equals_plain_python(spark, docs, tmp_path):
    rows = _corpus()
    frame = docs(rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(140)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    grammar = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    kept = [r for r in rows if grammar.score(np.array([grammar.features(r[1])]))[0] < toxicity.PREDICT_FROM]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {i for i in range(0, 140, 7)}
    roots = _components([_fingerprint(r[1]) for r in kept])
    first = {}
    for r, root in zip(kept, roots):
        first[root] = min(first.get(root, r[0]), r[0])
    unique = [r for r in kept if r[0] in first.values()]
    assert len(unique) < len(kept)
    model = pii.train(docs(unique))
    clean = [(i, pii.redact_text(t, model.spans(t)[1]), lang, source) for i, t, lang, source in unique]
    texts = {i: t for i, t, *_ in clean}
    chosen = [i for i, _, _ in _brute_mix(clean, mixing.PRODUCTION)]
    want = sorted((i, len(_ids(texts[i])) + 1) for i in chosen)
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
    assert not any("@" in (t or "") for t in texts.values())
