"""Decontamination, license scans and quality rules against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, prose, table
from pyspark.sql import functions as F

from kairoframe.llm import decontaminate, license_scan, quality
from kairoframe.llm import words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def solid(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_equal_the_pattern():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aZ9 é日\n\t-_@[`{\x7f\x0b") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for mask, fold, ref in ((W.ALNUM, W.LOWER, alnum), (W.SOLID, W.SAME, solid)):
        got = [[] for _ in texts]
        for c in W.chunks(pa.array(texts), 200):
            w = W.split(c, mask, fold)
            for s, e, d in zip(w.starts, w.ends, w.doc, strict=True):
                got[c.first + d].append(w.data[s:e].tobytes().decode())
        assert got == [ref(t) for t in texts]


def test_equal_words_have_equal_hashes_and_others_not():
    w = W.words_of("ab ba ab abc a b " * 3, W.SOLID)
    seen = {}
    for i in range(len(w.starts)):
        assert seen.setdefault(w.joined(i, 1), w.hashes[i]) == w.hashes[i]
    assert len(set(seen.values())) == len(seen)


def brute_hits(text, items, n=10):
    words, hit, found = alnum(text), set(), set()
    for item, t in items:
        v = alnum(t)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found |= {item} - {None}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination(spark, block_bytes):
    passage, other = prose(1, 25), prose(2, 12)
    items = [(3, passage), (20, other), (7, "Short One"), (7, "short one"), (None, prose(3, 11)), (9, None), (10, "--")]
    texts = [*ODD, prose(5, 300), prose(6, 40) + " " + passage.upper().replace(" ", " -- ") + " " + prose(7, 40), "x " + other, "a SHORT, one b", prose(3, 11), prose(8, 20000) + " " + passage]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(table(spark, texts), bench, out="h", block_bytes=block_bytes).withColumn("n", decontaminate.n_hit(F.col("h"))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r["h"]["n_words"], r["n"], sorted(r["h"]["items"])) == brute_hits(r["text"], items), r["text"][:80]
    kept = decontaminate.decontaminate(table(spark, texts), bench, block_bytes=block_bytes)
    assert kept.columns == table(spark, texts).columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["n"]}
    cleaned = decontaminate.decontaminate(table(spark, texts), bench, "spans", block_bytes=block_bytes).collect()
    assert all(brute_hits(r["text"], items[:2])[1] == 0 for r in cleaned) and len(cleaned) == len(got)
    assert {r["doc_id"]: r["text"] for r in cleaned}[12] == "a \n b"
    assert decontaminate.find_hits(table(spark, texts), bench.limit(0), out="h").where(F.size("h.items") > 0).count() == 0
    assert decontaminate.find_hits(table(spark, texts).limit(0), bench).count() == 0


def test_windows_that_share_a_hash_are_told_apart_by_their_words(monkeypatch):
    real = W.windows
    monkeypatch.setattr(W, "windows", lambda h, d, n: (real(h, d, n)[0] & np.uint64(3), real(h, d, n)[1]))
    items = [(i, prose(40 + i, 14)) for i in range(6)] + [(9, prose(40, 14)), (None, prose(42, 12))]
    index = decontaminate.WindowIndex(items, 10)
    for text in [t for _, t in items] + [prose(99, 60), prose(98, 9) + " " + items[3][1]]:
        spans, found = index.hits(W.words_of(text, W.ALNUM))
        words, hit, want = brute_hits(text, items)
        assert sorted({x for _, x in found}) == want and len({j for _, i, n in spans for j in range(i, i + n)}) == hit


def test_wrapped_notices_have_their_labels():
    """Each template broken at every width, between other lines and beside a notice on one line of its own."""
    t = license_scan.Templates(license_scan.TEMPLATES, license_scan.THRESHOLD)
    scan = license_scan.scanner(t, {}, "run")
    around, other = prose(1, 9), "Licensed under CC BY-NC 4.0."
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        broken = ["\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k)) for k in range(2, len(words))]
        texts = [f"{around} in\n{b}\n\n{around}" for b in broken] + [f"{other}\n{b}\n{other}" for b in broken]
        for i, r in enumerate(scan(pa.array(texts)).to_pylist()):
            assert label in r["labels"] and (i < len(broken) or "cc-by-nc" in r["labels"]) and r["score"] >= license_scan.THRESHOLD, texts[i]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the 'Software'), to deal\nin the Software"
    got = scan(pa.array([mit, None, "", mit.replace("\n", " "), "Released under\n", "the MIT License.", mit + "\n" + prose(2, 60) + "\n" + mit])).to_pylist()
    assert [r["labels"] for r in got] == [["mit"], [], [], ["mit"], [], [], ["mit"]]
    assert [[b["line"] for b in r["blocks"]] for r in got] == [[0], [], [], [0], [], [], [0, 4]]


def test_licenses_find_every_block(spark):
    rng = random.Random(3)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in alnum(t)}) + ["stone", "river"]
    lines = [" ".join(rng.sample(alnum(t), len(alnum(t)))[rng.randint(0, 3) :]) for _, t in license_scan.TEMPLATES for _ in range(4)] + [" ".join(rng.choice(pool) for _ in range(15)) for _ in range(60)]
    texts = [*ODD, *("\n".join(rng.sample(lines, 3)) for _ in range(40)), "Released under the MIT License.\nunder the mit\nlicense", "This work is licensed under the GNU General Public License, version 3.", prose(1, 20000) + "\nLicensed under CC BY-NC 4.0."]
    for r in license_scan.scan_licenses(table(spark, texts), out="x").collect():
        want = Counter()
        best, labels = 0.0, set()
        for n, line in enumerate((r["text"] or "").split("\n")):
            have = set(alnum(line))
            shares = [(label, len(have & set(alnum(t))) / len(set(alnum(t)))) for label, t in license_scan.TEMPLATES]
            near = [(label, s) for label, s in shares if s >= license_scan.THRESHOLD]
            want.update((label, n) for label, _ in near)
            top = max((s for _, s in near), default=0)
            labels |= {label for label, s in near if s == top}
            best = max(best, top)
        words, places, base = alnum(r["text"]), [], set()
        for p, label in license_scan.PHRASES.items():
            k = len(p.split())
            for i in range(len(words) - k + 1):
                if words[i : i + k] == p.split():
                    places.append(i)
                    base.add(label)
        x = r["x"]
        assert Counter((b["label"], b["line"]) for b in x["blocks"]) == want
        assert abs(x["score"] - best) < 1e-12 and x["labels"] == sorted(labels | base) and x["base_labels"] == sorted(base)
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert license_scan.scan_licenses(table(spark, texts).limit(0)).count() == 0


def test_paragraph_blocks():
    scan = license_scan.scanner(license_scan.Templates(license_scan.TEMPLATES, 0.85), license_scan.PHRASES, "paragraph")
    got = scan(pa.array(["a\nReleased under\nthe MIT License.\n \nb", "Released under\n\nthe MIT License."])).to_pylist()
    assert [x["labels"] for x in got] == [["mit"], ["mit"]] and [len(x["blocks"]) for x in got] == [1, 0]


def brute_quality(t):
    w = solid(t)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    longest = max((k for k in range(1, min(len(w), 80)) if max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values()) > 1), default=0)
    lines = [x for x in (t or "").split("\n") if solid(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), longest


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)), prose(1, 200), prose(2, 60) + " " + prose(2, 60) + " " + prose(9, 200), "##% " * 100, prose(3, 20000)]
    got = quality.assess(table(spark, texts), out="q").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        q = r["q"]
        if len(r["text"] or "") < 3000:
            assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], min(q["longest_repeat"], 79)) == brute_quality(r["text"]), r["text"]
        assert q["base_failed"] == (q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"])
        assert not (q["base_failed"] and q["kept"]) and q["kept"] == (not q["reasons"])
    by = {r["text"]: r["q"] for r in got}
    assert by[prose(1, 200)]["kept"] and by[prose(3, 20000)]["kept"] and "symbols" in by["##% " * 100]["reasons"]
    assert by[texts[-3]]["n_passage_words"] >= 120
    clash = table(spark, texts).selectExpr("*", "'own' AS __quality", "'own' AS __measures", "'own' AS quality")
    assert quality.filter_quality(clash).columns == clash.columns
    assert [r["__quality"] for r in quality.filter_quality(clash).collect()] == ["own"] * quality.filter_quality(clash).count()
    assert quality.assess(clash).columns == clash.columns
    kept = quality.filter_quality(table(spark, texts))
    assert kept.columns == table(spark, texts).columns and kept.count() == sum(r["q"]["kept"] for r in got)
    assert quality.assess(table(spark, texts).limit(0)).count() == 0


def test_maximal_repeats():
    t = "a b c d x a b c y b c d z"
    assert quality.maximal_repeats(t, 2) == [("a b c", 2), ("b c", 3), ("b c d", 2)]
    assert quality.maximal_repeats("", 2) == [] and quality.maximal_repeats(None) == []


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    s = [rng.randint(0, 2) for _ in range(200)]

    sa, levels = quality.suffix_array(np.array(s, np.uint64), np.full(200, 200))
    assert [s[i:] for i in sa] == sorted(s[i:] for i in range(200))
    lcp = quality.lcp_array(sa, levels)
    for a, b, n in zip(sa, sa[1:], lcp[1:], strict=False):
        k = 0
        while max(a, b) + k < 200 and s[a + k] == s[b + k]:
            k += 1
        assert k == n
