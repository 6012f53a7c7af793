"""Packing, SimHash, quality, toxicity, PII, language and token counts against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from solvara.llm import language, packing, pii, quality, simhash, token_counts, toxicity
from solvara.llm.boosting import fit
from solvara.llm.components import connected_components
from solvara.llm.word_tokens import WordTokenizer

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def _ids(text):
    return Tokenizer.from_file(VOCAB).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_word_tokenizer_equals_the_library(seed):
    rng = random.Random(seed)
    alphabet = "abcXYZ éÉßñ .,!?'’-_@#1234́ \x85\x1c\tİΣσς漢字한국어🙂ﬁ½ſÅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["it's don't I'LL WORD, word. éa, <|endoftext|>x <|ENDOFTEXT|>", "", None]
    texts += ["EV\u0130. EV\u0130, EV\u0130", "\u09ac\u09df. \u09ac\u09df, \u0915\u095c, \u05d0\ufb2a."]
    fast = WordTokenizer(VOCAB, cache_chunks=50)
    library = Tokenizer.from_file(VOCAB)
    for at in range(0, len(texts), 40):
        part = texts[at:at + 40]
        got = fast.encode_batch([None if t is None else t.encode() for t in part])
        for t, g in zip(part, got):
            assert np.frombuffer(g, "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_packing_round_trip(docs, edge_rows):
    rows = edge_rows + [(100 + i, "the quick brown fox " * (i * 37 % 200)) for i in range(60)]
    pieces = packing.pack(docs(rows).repartition(5), VOCAB, 64).toPandas()
    per_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for s, g in per_sequence:
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all()
    filled = per_sequence.length.sum()
    assert (filled.iloc[:-1] == 64).all() and filled.iloc[-1] <= 64
    want = sorted((_ids(t) + [1] for _, t, *_ in rows), key=str)
    stream = b"".join(pieces.sort_values(["sequence_id", "offset"]).ids.map(bytes))
    ids, got, at = np.frombuffer(stream, "<u2"), [], 0
    order = pieces.sort_values(["sequence_id", "offset"])
    for _, r in order[order.start == 0].iterrows():  # documents lie end to end, so each is found by its token count
        got.append(ids[at:at + r.doc_tokens].tolist())
        at += r.doc_tokens
    assert sorted(got, key=str) == want
    for _, r in pieces.iterrows():
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes())
    assert packing.pack(docs([]), VOCAB).count() == 0


def test_padding_rule(spark):
    pieces = spark.createDataFrame([(0, 2048), (1, 1000), (1, 24), (2, 7)], "sequence_id long, length long")
    got = {r.sequence_id: r.padding for r in packing.sequence_rows(pieces).collect()}
    assert got == {0: 0, 1: 0, 2: 2041}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_covering_masks_miss_no_pair():
    pairs = [(a, b) for a in range(64) for b in range(a)]
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in simhash.MASKS) for a, b in pairs)
    for mask, subs in zip(simhash.MASKS, simhash.SUB_MASKS):
        free = [p for p in range(64) if not mask >> p & 1]
        assert all(any(not m >> a & 1 and not m >> b & 1 for m in subs) for a in free for b in free)
        assert max(len(free) - m.bit_count() for m in subs) <= 12


def _components(values, radius=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_near_duplicates_equal_brute_force(docs, edge_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = list(edge_rows)
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for j in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(300)] = "zzz"
            rows.append((1000 + 10 * i + j, " ".join(copy)))
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    prints = [_fingerprint(t) for _, t, *_ in rows]
    roots = _components(prints)
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, p, least.get(r)) for (i, *_), p, r in zip(rows, prints, roots)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_links_of_split_buckets(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(12) << 20) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = connected_components(simhash.fingerprint_links(frame, bucket_rows=8)).collect()
    group = {r.node % 2**64: r.root for r in found}
    roots, seen = _components(values), {}
    for v, r in zip(values, roots):
        key = group.get(v, v)
        assert seen.setdefault(r, key) == key
    assert len(set(seen.values())) == len(seen)


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_keep_one_per_group(docs):
    rows = [(7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "quite another text of its own"), (None, None)]
    frame = docs([(*r[:2], "en", "s", "x") for r in rows], ", `component_id` string")
    got = simhash.keep_one_per_group(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 9, None]


def test_statistics_by_hand():
    text = "a b c x a b c\nline # one\nline # one\n\n  \n%%"
    counts, _ = quality.document_statistics(text)
    # words: a b c x a b c line # one line # one %%; windows 'a b c' and 'line # one' come twice
    assert counts == [14, 25, 4, 1, 12]
    assert quality.document_statistics(None)[0] == [0, 0, 0, 0, 0]


def _brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)]


def test_quality_counts_and_verdict(docs, edge_rows, spark):
    rng = random.Random(2)
    rows = list(edge_rows[:4]) + [(100 + i, " ".join(rng.choice(["a", "b\n", "é|", "d", "e f"]) for _ in range(rng.randrange(90)))) for i in range(40)]
    labels = spark.createDataFrame([(100 + i, int("|" not in rows[i + 4][1]), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    frame = docs([(*r[:2], "en", "s", 1) for r in rows], ", kept int")
    got = quality.judge_quality(frame, quality.train(frame, labels)).collect()
    want = sorted(([i, *_brute_statistics(t or "")] for i, t, *_ in rows), key=str)
    assert sorted(([r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in got), key=str) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)


def test_forest_is_monotonic_and_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=800) > 0).astype(float)
    forest = fit(x, y, {0: 1, 1: -1})
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.zeros((50, 3))
    for j, sign in ((0, 1), (1, -1)):
        for row in x[:20]:
            grid[:] = row
            grid[:, j] = np.linspace(-3, 3, 50)
            assert (sign * np.diff(forest.probability(grid)) >= -1e-12).all()
    assert len(fit(x, np.ones(800)).feature) == 0
    assert fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).shape == (2,)


def _toxic_world(spark, docs, n=160):
    rng = random.Random(3)
    fill = ["lorem", "ipsum", "dolor", "amet", "sed", "sit"]
    rows = []
    for i in range(n):
        words = [rng.choice(fill) + rng.choice("aeiou") for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["idiotic", "idiot", "scum"])
        rows.append((i, " ".join(words) + "."))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs(rows), labels, rows


def test_toxicity_learns_and_keeps_clean(spark, docs, edge_rows):
    frame, labels, rows = _toxic_world(spark, docs)
    grammar = toxicity.train(frame, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, grammar).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i, _ in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    edge = toxicity.score_toxicity(docs(edge_rows), grammar).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == 0 for r in edge)
    kept = toxicity.drop_toxic(frame, grammar)
    assert kept.columns == frame.columns and kept.count() == 120
    empty = toxicity.train(docs([]), labels)
    assert toxicity.score_toxicity(docs([(1, "idiot")]), empty).first().predicted == 0


def test_toxicity_learns_rare_insults_and_a_minority_language(spark, docs):
    rng = random.Random(11)
    spelt = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(n))
    clean = {"en": [spelt(6) for _ in range(300)], "fr": [spelt(6) for _ in range(300)]}
    insults = {"en": [spelt(7) for _ in range(100)], "fr": [spelt(7) for _ in range(3)]}
    rows, toxic = [], []
    for i in range(8000):
        lang, bad = "fr" if i % 20 < 1 else "en", rng.random() < 0.25
        words = [rng.choice(clean[lang]) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(insults[lang])
        rows.append((i, " ".join(words), lang))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    grammar = toxicity.train(docs(rows), labels)
    predicted = [int(p >= toxicity.PREDICT_FROM) for p in grammar.score(np.array([grammar.features(t) for _, t, _ in rows]))]
    held = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 4 == 2]
    for lang in ("en", "fr"):
        assert np.mean([predicted[i] for i in held if toxic[i] and rows[i][2] == lang]) > 0.9
    assert not any(predicted[i] for i in held if not toxic[i])


def test_clause_machine():
    g = toxicity.Grammar({"idio": 2.0, "scum$": 1.0}, np.ones(toxicity.N_FEATURES), 0.0)
    kinds = lambda s: [k for c in s.split(".") for k, _ in g.clause(c.split())]
    assert kinds("you are an idiot") == ["targeted"]
    assert kinds("what scum") == ["plain"]
    assert kinds("he is not an idiot") == ["negated"]
    assert kinds("she said scum. idiotic thing") == ["reported", "plain"]
    assert kinds("i will kill you") == ["threat"]
    assert kinds("i will not kill you") == []


def test_composed_machine_equals_the_machines_in_turn():
    rng, parts = random.Random(3), toxicity.machines()
    for _ in range(3000):
        symbols = [rng.randrange(6) for _ in range(rng.randrange(12))]
        now, weights, aimed = symbols, [1.0] * len(symbols), False
        for m in parts:
            now, w, a = m.run(now)
            weights, aimed = [x * y for x, y in zip(weights, w)], aimed or a
        assert toxicity.CLAUSE_MACHINE.run(symbols) == (now, weights, aimed)
    weighted = toxicity.Machine(parts[1].after, parts[1].write, parts[1].weight * 0.5, parts[1].aimed)
    assert toxicity.compose(parts[0], weighted).run([4, 0])[1] == [0.5, 0.5]
    assert len(toxicity.CLAUSE_MACHINE.after) <= 4 * 2 * 2 * 2


def _plain_matches(grammar, words):
    """The clause rules once more, by looking back and ahead instead of walking states."""
    kinds = [grammar.classify(w)[0] for w in words]
    covered = lambda i: any(kinds[j] == toxicity.NEGATION for j in range(max(0, i - toxicity.NEGATION_REACH + 1), i))
    reported = lambda i: toxicity.REPORT in kinds[:i]
    out, waiting = [], False
    for i, k in enumerate(kinds):
        if k == toxicity.INSULT:
            out.append("reported" if reported(i) else "negated" if covered(i) else "targeted" if toxicity.TARGET in kinds else "plain")
        elif k == toxicity.THREAT and not covered(i) and not reported(i):
            waiting = True
        elif k == toxicity.TARGET and waiting:
            out.append("threat")
            waiting = False
    return sorted(out)


def test_clauses_equal_plain_rules():
    g = toxicity.Grammar({"idio": 2.0, "scum$": 1.0}, np.ones(toxicity.N_FEATURES), 0.0, ("smash",), ("alleged",))
    rng = random.Random(8)
    for _ in range(3000):
        words = [rng.choice(["idiot", "scum", "you", "not", "said", "alleged", "kill", "smash", "tree", "the"]) for _ in range(rng.randrange(9))]
        assert sorted(k for k, _ in g.clause(words)) == _plain_matches(g, words), words


def test_threat_and_reporting_words_are_learned(spark, docs):
    rng = random.Random(12)
    filler = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(300)]
    text = lambda *own: " ".join(rng.choice(filler) for _ in range(12)) + ". " + " ".join(own) + ". " + " ".join(rng.choice(filler) for _ in range(9))
    rows = []
    for i in range(1600):
        kind = i % 40
        own = (("you", "zorgwit") if kind < 6 else ("that", "zorgwit") if kind < 12 else ("i", "will", "krusha", "you") if kind < 16
               else ("he", "reputedly", "used", "zorgwit") if kind == 16 else ("you", "and", "the", "tree"))
        rows.append((i, text(*own), int(kind < 16)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    g = toxicity.train(docs([(i, t) for i, t, _ in rows]), labels)
    assert any("zorgwit".startswith(e.rstrip("$")) for e in g.entries) and "reputedly" in g.reports
    assert "krusha" in g.threats or any("krusha".startswith(e.rstrip("$")) for e in g.entries)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs([(i, t) for i, t, _ in rows]), g).collect()}
    wrong = sum(scored[i].predicted != y for i, _, y in rows)
    assert wrong <= 0.02 * len(rows), (g.entries, g.threats, g.reports)


def _brute_base(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    spans = [(k, m.start(), m.end()) for k, m in out]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("aB.@+- ()0123456789 é") for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == _brute_base(text), text
    for text in ("1.2.3.4.5.6.7.8", "a@b.c.d@e.f", "4799134681044206", "+1 (319) 555-5132 4524132264652876", "00000255.1.1.1"):
        assert pii.base_spans(text) == _brute_base(text)
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" + "-" * 100_000):
        pii.base_spans(long)


def _pii_rows():
    rng = random.Random(6)
    rows = []
    for i in range(120):
        mail = f"user{i}.x@mail{i % 7}.example.com"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((1000 + i, f"some words here {mail} and {ip} or {phone} with version 2.0 of 4.1.2 and 1234 then 4799134681044206 end"))
    return rows


def test_pii_query_and_redaction(docs, edge_rows):
    rows = _pii_rows() + [(500, "write to jo at mail.example dot com please, or bob [at] host [dot] org"), *edge_rows]
    frame = docs(rows)
    model = pii.train(frame)
    got = pii.find_pii(frame, model).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        base = _brute_base(texts[r.doc_id] or "")
        spelt = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert set(filter(None, spelt.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
    clean = pii.redact(frame, model)
    assert clean.columns == frame.columns and clean.count() == len(rows)
    for r in clean.where("doc_id >= 1000").collect():
        assert not _brute_base(r.text) and "[EMAIL]" in r.text and "version 2.0 of 4.1.2 and 1234" in r.text
        assert r.n_chars == len(r.text)
    assert pii.find_pii(docs([]), pii.train(docs([]))).count() == 0


@pytest.mark.parametrize("form", ["jane.roe (at) example.com", "jane.roe [AT] example [DOT] com", "Jane.Roe At mail Dot example Dot com"])
def test_written_email_alone_in_a_text(docs, form):
    model = pii.train(docs(_pii_rows()))
    text = f"please write to {form} today"
    whole = ("email", text.index(form), text.index(form) + len(form))
    assert whole in pii.candidates(text)
    assert whole in model.spans(text)[1]
    assert pii.redact_text(text, model.spans(text)[1]) == "please write to [EMAIL] today"


def test_written_at_with_a_dot_is_proposed():
    text = "please write to jane at example.com today"
    assert ("email", 16, 35) in pii.candidates(text)


LANGS = {"aa": ["kato", "miru", "sane", "toki"], "bb": ["grumpf", "schlatz", "wurtz", "brack"], "cc": ["eaux", "oise", "ille", "ment"]}


def test_free_places_among_overlapping_spans():
    base = [("email", 0, 500)] + [("ip", 10 * i, 10 * i + 7) for i in range(1, 20)]
    free = pii._Free(base)
    assert not free.holds(("phone", 480, 495)) and not free.holds(("card", 0, 1)) and not free.holds(("card", 499, 510))
    assert free.holds(("phone", 500, 512)) and pii._Free([]).holds(("ip", 0, 3))


def test_dictionaries_take_all_chosen_texts_and_rows_once(docs):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(k))
    long = [(i, "same beginning of every text " * 3 + " ".join(word(7) for _ in range(900)), "en") for i in range(0, 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    dictionary = language.train_dictionaries(docs(long[:60]))["en"]
    assert len(dictionary) >= 0.9 * language.DICTIONARY_BYTES and dictionary.count(b"\n") == 59
    bodies = [language.letters(t) for _, t, _ in long[:60]]
    found = [sum(line[:100] in body for body in bodies) >= 1 or line[:100] for line in dictionary.split(b"\n")]
    assert sum(f is True for f in found) >= 55 and dictionary.count(b"same beginning") < 30
    one = [r for r in long if r[0] == long[0][0]] * 300  # one id over and over
    assert len(language.train_dictionaries(docs(one + [(long[1][0], "hola", "es")]))["es"]) >= 8
    assert language.fill([b"abcdef", b"gh"], 7) == [b"abcd", b"gh"] or sum(map(len, language.fill([b"abcdef", b"gh"], 7))) <= 7


def test_repeated_rows_of_a_labelled_id_are_fitted_once(spark, docs):
    from solvara.llm.common import fit_sample
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert fit_sample(docs([(1, "a b c")] * 500 + [(3, "d"), (3, "c")]), labels, "toxic").orderBy("text").collect() == [("a b c", 1), ("c", 0)]


def test_language(docs, edge_rows):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(2)) for _ in range(rng.randrange(8, 60))), lang))
    frame = docs([*rows, (1000, None, None), (1001, "12 34 !!", "aa"), (1002, "", "bb"), (1003, "kato" * 40_000, None)])
    got = {r.doc_id: r for r in language.identify_language(frame, language.train_dictionaries(frame)).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_language(docs([(1, "abc")]), language.train_dictionaries(docs([]))).first().lang_pred == "und"


def test_every_language_has_a_dictionary(docs):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(280)]
    rows = [(100 * n + i, " ".join(rng.choice(parts[4 * n:4 * n + 4]) for _ in range(40)), f"l{n:02}")
            for n in range(70) for i in range(12 if n < 69 else 6)]
    frame = docs(rows)
    dictionaries = language.train_dictionaries(frame)
    assert sorted(dictionaries) == [f"l{n:02}" for n in range(70)] and list(dictionaries)[-1] == "l69"
    judge = language.Classifier(dictionaries)
    assert all(judge.classify(t)[0] == lang for _, t, lang in rows)
    with pytest.raises(ValueError, match="languages"):
        language.train_dictionaries(frame, total_bytes=69 * language.DICTIONARY_BYTES)


def test_token_counts(docs, edge_rows):
    rows = edge_rows + [(100 + i, "the quick brown fox " * (i % 9)) for i in range(40)]
    got = token_counts.count_document_tokens(docs(rows).repartition(3), VOCAB).collect()
    want = sorted(((i, len(_ids(t))) for i, t, *_ in rows), key=str)  # a spelt-out special token counts
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    assert token_counts.count_document_tokens(docs([]), VOCAB).count() == 0


def test_end_of_document_lies_outside_the_vocabulary(docs, tmp_path):
    with pytest.raises(Exception, match="vocabulary"):
        token_counts.write_token_files(docs([(1, "a")]), VOCAB, f"file://{tmp_path}/t", end=49407).count()


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan_blocks(spark, tmp_path, block_bytes):
    rng = random.Random(8)
    want, files = [], []
    for f in range(4):
        ids = [9 if rng.random() < 0.2 else rng.randrange(10, 50) for _ in range(f * 60)]
        (tmp_path / f"f{f}").write_bytes(np.array(ids, "<u2").tobytes())
        files.append((f"f{f}", 2 * len(ids)))
        start = ordinal = 0
        for at, x in enumerate(ids):
            if x == 9:
                want.append((f"f{f}", ordinal, start, at - start, True))
                start, ordinal = at + 1, ordinal + 1
        if start < len(ids):
            want.append((f"f{f}", ordinal, start, len(ids) - start, False))
    frame = spark.createDataFrame(files, "file string, bytes long")
    got = token_counts.scan_separators(frame, f"file://{tmp_path}", end=9, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
