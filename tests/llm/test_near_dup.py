"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from helpers import ODD, prose, table

from kairoframe.llm import near_dup
from kairoframe.llm.components import components


def brute(rows, s):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return frozenset(tuple(w[i : i + s.words]) for i in range(len(w) - s.words + 1)) if len(w) >= s.words else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= s.percent * (len(sets[i]) + len(sets[j]) - k):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    texts = [*ODD]
    for g in range(6):
        base = prose(g, rng.choice([40, 120, 300]))
        texts += [base, base.upper()] + [edited(base, rng.randint(0, max(1, len(base.split()) // 25)), rng) for _ in range(6)]
    chain = prose(50, 200)  # each near the one before, the ends far apart
    for _ in range(8):
        texts.append(chain)
        chain = edited(chain, 3, rng)
    passage = prose(60, 60)
    texts += [passage + " " + prose(100 + i, 60) for i in range(20)] + [prose(200 + i, 50) for i in range(10)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("similarity", "seed"), [(near_dup.COPIES_85, 1), (near_dup.Similarity(), 2)])
@pytest.mark.parametrize("block", [near_dup.BLOCK, 3])
def test_groups_equal_brute_force(spark, monkeypatch, similarity, seed, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = table(spark, corpus(seed))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_dup.find_groups(docs, similarity).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, similarity)
    assert all(r["kept"] == (r["id"] is None or r["id"] == r["component_id"]) for r in got)
    kept = near_dup.drop_near_duplicates(docs, similarity)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["id"] for r in got if r["kept"] and r["id"] is not None}) and ids.count(None) == 1


def test_empty_and_lonely(spark):
    docs = table(spark, ["", None])
    assert {(r["id"], r["component_id"], r["kept"]) for r in near_dup.find_groups(docs).collect()} == {(0, 0, True), (1, 1, True), (None, None, True)}
    assert near_dup.find_groups(docs.limit(0)).count() == 0 and near_dup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_bounds_keep_what_is_near():
    s = near_dup.COPIES_85
    rng = np.random.default_rng(1)
    a, b = near_dup._family(s.hashes)
    lost = 0
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        y = np.concatenate([x[32:], rng.integers(0, 1 << 63, 32).astype(np.uint64)])  # 368 of 432: 0.852
        sx, sy = (near_dup.signature(v, a, b) for v in (x, y))
        low = near_dup.alike(sx.astype(np.uint8)[None], sy.astype(np.uint8)[None], near_dup.least_matches(s))
        lost += not low[0] or not (near_dup.band_hashes(sx[None], s) == near_dup.band_hashes(sy[None], s)).any()
    assert lost == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(7, 7), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        if x != y:
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
