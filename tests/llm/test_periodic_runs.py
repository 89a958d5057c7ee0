"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import ODD, table

from kairoframe.llm import periodic_runs
from kairoframe.llm.periodic_runs import Periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12, exp=2):
    """(start, length, period) by the definition: every stretch and its smallest period."""
    n, out = len(w), []
    for q in range(1, n // exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exp * q) and not any(all(w[k] == w[k + s] for k in range(i, j + q - s)) for s in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
            parts += [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))]
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return out


@pytest.mark.parametrize("p", [Periods(), Periods(long_chars=20, lags=3), Periods(6, 3), Periods(6, 3, long_chars=0, lags=1)])
def test_runs_and_collapsed_texts(spark, p):
    all_texts = [*ODD, *texts(1, 60), "same " * 100, "x y " * 50 + "x", "a\x0bb " * 12, "é ü " * 9]
    df = table(spark, all_texts).selectExpr("*", "'own' AS __given", "'own' AS runs", "'own' AS id")
    got = periodic_runs.find_runs(df, p, out="r").collect()
    assert len(got) == df.count() and "r" in got[0].asDict() and got[0]["__given"] == got[0]["runs"] == "own"
    for r in got:
        w = WORD.findall(r["text"] or "")
        want = brute_runs(w, p.min_words, p.min_exp)
        assert [tuple(x) for x in r["r"]["runs"]] == want, r["text"]
        assert r["r"]["collapsed"] == brute_collapsed(w, want)


def test_empty_table(spark):
    assert periodic_runs.find_runs(table(spark, ["a"]).limit(0)).count() == 0


def test_a_very_long_text_is_dealt_out_by_ranges(spark):
    rng = random.Random(3)
    unit = [f"u{rng.random()}" for _ in range(4000)]
    w = [f"a{i}" for i in range(500)] + unit * 3 + unit[:123] + ["b"] * 20 + [f"c{i}" for i in range(9000)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "b " * 20)], "doc_id long, text string")
    p = Periods(long_chars=1000, lags=1000)
    assert periodic_runs._long_texts(df.where("doc_id = 1"), p, "doc_id", "text").count() == 1
    got = {r["doc_id"]: [tuple(x) for x in r["periodic"]["runs"]] for r in periodic_runs.find_runs(df, p).collect()}
    assert got == {1: [(500, 12123, 4000), (12623, 20, 1)], 2: [(0, 20, 1)]}


def planted(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k if k < a else a + (k - a) % p] for k in range(n)]


def test_query_by_brute_force(spark, tmp_path):
    rows = list(enumerate([*texts(5, 80), *ODD])) + [(None, "n " * 14), (3, texts(6, 1)[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "") if i is None else planted(i, t)
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(w, runs))))
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_scan_of_random_arrays():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = np.sort(rng.integers(0, 60, rng.integers(1, 5)))[::-1]
        rows = [rng.integers(0, 2, n) + 2 * k for k, n in enumerate(sizes)]
        s, n, q = periodic_runs.least_lags(*periodic_runs.stretches(np.concatenate(rows).astype(np.int32), sizes, Periods()))
        want, first = [], 0
        for r in rows:
            want += [(first + a, b, c) for a, b, c in brute_runs(r.tolist())]
            first += len(r)
        assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == want
