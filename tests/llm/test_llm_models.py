"""Language identification, toxicity and language-model scores: held-out results, brute force, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, prose, table
from pyspark.sql import functions as F

from kairoframe.llm import language_id, lm_score, toxicity
from kairoframe.llm import words as W

LANGS = {"xx": "ka lo mi nu pe ro", "yy": "tra stro ply quent marb", "zz": "ää öö üß éè"}


def language_docs(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        text = " ".join("".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang if i % 7 else None))
    rows += [(1000 + i, t, "xx") for i, t in enumerate(ODD)] + [(None, "ka lo", "xx"), (0, rows[0][1], "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"language": F.lit("clash"), "score": F.lit("x")})


def test_language_id_on_held_out_rows(spark):
    docs = language_docs(spark)
    model = language_id.learn(docs, where=~language_id.held_out())
    got = language_id.identify(docs, model, out="guess").withColumn("held", language_id.held_out()).collect()
    assert len(got) == docs.count()
    for r in got:
        g = r["guess"]
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (g["lang"] == "und") == (not letter) and 0 <= g["score"] <= 1 and (letter or (g["score"] == 0 and g["rejected"]))
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    clean = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held"]]
    truth = {i: sorted(LANGS)[i % 3] for i in range(1000)}
    assert len(clean) > 20 and all(r["guess"]["lang"] == truth[r["doc_id"]] and not r["guess"]["rejected"] for r in clean)
    kept = language_id.filter_language(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0


def test_language_id_without_labels(spark):
    docs = language_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    got = language_id.identify(docs, language_id.learn(docs), out="g").select("g.*").distinct().collect()
    assert [(r["lang"], r["score"], r["rejected"]) for r in got] == [("und", 0.0, True)]
    assert language_id.identify(docs.limit(0), language_id.learn(docs.limit(0))).count() == 0


def test_small_languages_keep_their_part_of_the_sample(spark, monkeypatch):
    """Ten languages of 300 rows and two of 12, with a bound of 120 rows, keep all rows of the small ones but chance."""
    monkeypatch.setattr(language_id, "SAMPLE_LIMIT", 120)
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 60)
    seen = Counter()
    monkeypatch.setattr(language_id, "train", lambda examples, sizes: seen.update(e[2] for e in examples))
    rows = [(1000 * k + i, "ka lo mi", f"l{k:02}") for k in range(12) for i in range(300 if k < 10 else 12)]
    language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen) == 12 and sum(seen.values()) <= 120 and min(seen["l10"], seen["l11"]) >= 5
    assert language_id.quota([300] * 10 + [12] * 2) == 10 and language_id.quota([4] * 10 + [300] * 2) == 40 and language_id.quota([300] * 2) == 60


def test_language_features_average_hashed_ngrams():
    import pyarrow as pa

    for c in W.chunks(pa.array(["Ab, cd", None, "é"])):
        b, d = language_id.chunk_features(c)
        # n-grams of ' ab ' and ' cd ': three of 2, two of 3, one of 4 bytes each; the third text is one word of 2 bytes
        assert Counter(d.tolist()) == {0: 12, 2: 6}
        sums, n = language_id.chunk_sums(c, np.ones((language_id.BUCKETS, 2)))
        assert sums.tolist() == [[12, 12], [0, 0], [6, 6]] and n.tolist() == [12, 0, 6]


def brute_language(text, model):
    """The prediction for one text, n-gram by n-gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b" "
    total, n = np.zeros(len(model.langs)), 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            g = data[i : i + size]
            if 32 in g[1:-1] or g == b"  ":
                continue
            h = 2166136261 + size
            for b in g:
                h = ((h ^ b) * 16777619) % 2**32
            h ^= h >> 15
            total += model.weights[(h * 2246822519) % 2**32 >> 18]
            n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.langs[int(p.argmax())], float(p.max() / p.sum())


def test_language_id_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 100)
    docs = language_docs(spark).withColumn("text", F.when(F.col("doc_id") == 3, F.repeat("text", 400)).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.learn(docs, where=~language_id.held_out())
    texts = sorted((str(r["doc_id"]), *brute_language(r["text"], model)) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.op1_language_id(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [t[:2] for t in texts] and np.allclose([g[2] for g in got], [t[2] for t in texts], atol=1e-6)


def test_many_short_texts_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    model = language_id.Model(["a", "b"], np.ones((language_id.BUCKETS, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0)
    predict = language_id.predictor(model)
    tracemalloc.start()
    predict(pa.array(["a few words of a title"] * 10_000))
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_calibration_stands_for_the_rows_of_each_language():
    rows = [(np.array([0]), np.array([1]), 0)] * 40 + [(np.array([i % 2]), np.array([1]), 1) for i in range(40)]  # b is often taken for a
    z = np.array([[4.0, 0.0], [0.0, 4.0]], np.float32)
    few, many = (language_id._calibrate(language_id.Model(["a", "b"], z, np.zeros(2, np.float32), 1.0, 0.0), rows, [100, n]) for n in (10, 1000))
    assert few.temperature < many.temperature


INSULTS = ["gruntle", "snarfish", "blorkhead"]


def toxic_docs(spark, n=400):
    rows, labels = [], []
    rng = random.Random(2)
    for i in range(n):
        text = prose(i, rng.randint(10, 60))
        y = int(i % 4 == 0)
        if y:
            w = text.split()
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(INSULTS))
            text = " ".join(w)
        rows.append((i, text, "a", 0.5))
        labels.append((i, y, 7))
    rows += [(1000 + i, t, "a", 0.5) for i, t in enumerate(ODD)] + [(None, "gruntle", "a", 0.5), (0, rows[0][1], "a", 0.5)]
    labels += [(5000, 1, 7), (None, 1, 7), (3, None, 7), (1, 0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.learn(docs, labels, where=~language_id.held_out())
    got = toxicity.assess(docs, model, out="t").withColumn("held", language_id.held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r["t"]["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 1000]
    assert len(held) > 40 and all((r["t"]["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert all(r["t"]["score"] < 0.5 for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000)
    learned = {e["doc_id"] for r in got for e in r["t"]["evidence"]}
    assert learned and all(zlib.crc32(str(i).encode()) % 5 for i in learned)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_docs(spark, 20)
    for part in (labels.where("toxic = 0"), labels.limit(0)):
        assert [r[0] for r in toxicity.assess(docs, toxicity.learn(docs, part), out="t").select("t.score").distinct().collect()] == [0.0]
    assert toxicity.assess(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("at_once", [1, 4])
def test_neighbours_are_exact(monkeypatch, seed, at_once):
    monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "COMMON", 0.08)  # some terms have rows, some postings
    rng = np.random.default_rng(seed)
    n, m = 400, 50
    dense = np.where(rng.random((n, m)) < 0.08, rng.integers(1, 4, (n, m)), 0)
    dense[1::40] = dense[0]  # ties
    weight = (rng.random(m) + 0.1) ** 3
    vectors = [(t := np.flatnonzero(row), row[t]) for row in dense]
    index = toxicity.Index.build(W.HashSet(rng.integers(0, 1 << 60, m).astype(np.uint64)), weight, vectors, list(range(n)), [0] * n)
    table_ = np.zeros((n, m))
    for i, (t, c) in enumerate(vectors):
        table_[i, t] = toxicity.unit(weight, t, c)
    for i in range(60):
        t, c = vectors[i]
        e, s = index.nearest(t, toxicity.unit(weight, t, c), 7)
        cos = table_ @ table_[i]
        order = np.lexsort((np.arange(n), -np.round(cos, 7)))
        order = order[cos[order] > 1e-12][:7]
        np.testing.assert_allclose(s, cos[order], atol=1e-6)
        np.testing.assert_allclose(cos[e], cos[order], atol=1e-6)


def brute_terms():
    """Counts the terms of a text."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def counts(text):
        words_ = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))]
        return Counter([("w", w) for w in words_] + [("s", w[:6]) for w in words_ if len(w) > 6])

    return counts


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    docs, labels = toxic_docs(spark, 240)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["doc_id"], r["held_out"]): r for r in toxicity.op10_toxicity(spark, str(tmp_path)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.learn(docs, labels, where=~language_id.held_out())
    label = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None:
            label[r["doc_id"]] = max(r["toxic"], label.get(r["doc_id"], 0))
    counts = brute_terms()
    df = Counter(t for _, text in rows for t in counts(text))
    ids = set(model.index.doc_ids.tolist())
    assert ids and all(label[i] in (0, 1) and zlib.crc32(str(i).encode()) % 5 for i in ids)
    examples = [(i, counts(text), label[i]) for i, text in rows if i in ids]
    assert len(examples) == len(model.index.doc_ids)
    pos, neg = (Counter(t for _, c, y in examples if y == k for t in c) for k in (1, 0))
    share = sum(y for *_, y in examples) / len(examples)

    def vector(c):
        w = {}
        for t, n in c.items():
            if t in pos or t in neg:
                odds = math.log((pos[t] + 5 * share) / (neg[t] + 5 * (1 - share))) - math.log(share / (1 - share))
                w[t] = (1 + math.log(n)) * max(math.log((len(rows) + 1) / (df[t] + 0.5)), 1e-3) * max(abs(odds), 1e-3)
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    units = [(i, vector(c), y) for i, c, y in examples]
    for i, text in rows:
        own = vector(counts(text))
        near = sorted(((sum(x * v.get(t, 0) for t, x in own.items()), j, y) for j, v, y in units), key=lambda x: (-round(x[0], 9), x[1]))
        near = [x for x in near if x[0] > 1e-12][:10]
        want = model.bare
        if near:
            vote = sum(s * s * y for s, _, y in near) / (sum(s * s for s, *_ in near) + toxicity.DOUBT)
            z = model.coef @ [1, vote, vote * near[0][0]]
            want = 1 / (1 + math.exp(-z))
        assert abs(got[(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0)]["score"] - want) < 1e-5


def test_ties_among_examples_go_to_the_lower_ids():
    index = toxicity.Index.build(W.HashSet(np.array([5], np.uint64)), np.ones(1), [(np.array([0]), np.array([1]))] * 30, list(range(30)), [1, 0] * 15)
    e, s = index.nearest(np.array([0]), np.ones(1), 10)
    assert e.tolist() == list(range(10)) and index.vote(e, s) == (5 / (10 + toxicity.DOUBT), 1.0)


def test_lm_base_scores_and_normalisation(spark):
    texts = [*ODD, *(prose(i, 80) for i in range(60)), "Zebra unseen " + prose(3, 20), prose(9, 20000)]
    docs = table(spark, texts)
    model, counts = lm_score.learn(docs.where(~language_id.held_out("doc_id", 10)).select("text"))
    got = lm_score.score(docs, model, counts).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        ws = tokens(t)
        want.setdefault(i, []).append((len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), held(i)))
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        a, b, base, h = want[r["id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (a, b, n, h) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
    np.testing.assert_allclose((10 ** model.table.astype(float)).sum(1), 1, atol=1e-5)
    fresh = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert fresh and sum(r["score"] for r in fresh) > 1.01 * sum(r["base_score"] for r in fresh)  # words without order: no worse


def test_lm_with_a_tie_of_counts_larger_than_what_is_known(spark, monkeypatch):
    """Every word is there twice, more words than KNOWN: those that are symbols are known all the same."""
    monkeypatch.setattr(lm_score, "KNOWN", 20)
    monkeypatch.setattr(lm_score, "VOCABULARY", 30)
    texts = [" ".join(f"w{i}x" for i in range(50)), " ".join(f"w{i}x" for i in reversed(range(50)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = lm_score.learn(docs.select("text"))
    assert len(model.symbols.words.keys) == 30 and len(model.known.keys) == 30
    for r in lm_score.score(docs, model, counts).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (51, 51, 102)
        assert abs(r["base_score"] - 51 * math.log10(2.1 / (102 + 0.1 * 52))) < 1e-9
        w = W.words_of(texts[r["id"]], W.SOLID)
        cur, before, _ = model.symbols.sequence(w, s := model.symbols.of(w))
        shares = [0.0 if x < 30 else math.log10(2.1) - model.class_log[x - 30] for x in s.tolist()]
        assert abs(r["score"] - model.table[before, cur].sum(dtype=float) - sum(shares)) < 1e-6


def test_lm_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert lm_score.op7_lm_scoring(spark, str(tmp_path)).count() == 0


def test_lm_learns_order(spark):
    rng = random.Random(1)
    follow = {w: rng.sample([f"w{i}" for i in range(30)], 3) for w in (f"w{i}" for i in range(30))}

    def text():
        w, out = "w0", []
        for _ in range(60):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")
    got = lm_score.score(docs, *lm_score.learn(docs.where(~language_id.held_out("doc_id", 10)).select("text"))).where("held_out").collect()
    # three equally likely words: log10(3) a token, against log10(30)
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)


def test_lm_with_rare_words_joined(spark, monkeypatch):
    """The same sums when hardly any word is looked up and nearly all are joined."""
    docs = table(spark, [prose(i, 40) for i in range(20)])
    train = docs.select("text")
    monkeypatch.setattr(lm_score, "VOCABULARY", 3)
    rows = lambda got: {(r["id"], round(r["base_score"], 6), round(r["score"], 6), r["n_known"]) for r in got.collect()}
    whole = rows(lm_score.score(docs, *lm_score.learn(train)))
    monkeypatch.setattr(lm_score, "KNOWN", 3)
    model, counts = lm_score.learn(train)
    assert len(model.known.keys) <= 3
    assert rows(lm_score.score(docs, model, counts)) == whole


def test_lm_without_training_text(spark):
    docs = table(spark, ["a b", ""])
    got = lm_score.score(docs, *lm_score.learn(docs.limit(0).select("text"))).collect()
    assert len(got) == 4 and all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-12 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score(docs.limit(0), *lm_score.learn(docs.select("text"))).count() == 0
