"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from kairoframe.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, n string, turns string, least string"


def brute_sequences(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def brute_rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def brute_nodes(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA).repartition(3)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 400), n):
        same = rng.random() < 0.4
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", None, "assistant"]) if not same else "user"
            rows.append((c, t if rng.random() < 0.95 else None, role, f"hé {t}" if same and t < 6 else rng.choice(["", None, "a", "b", f"t{rng.random()}"])))
    hot = [(c, t, "user", f"hot {t} {c % 3 if t == 5 else ''}") for c in range(1000, 1060) for t in range(7)]
    rows += hot + [(None, 0, "user", "no id"), (2000, None, None, None)]
    seen, out = set(), []
    for r in rows:  # at most one turn without a number for each conversation, so that the order is stated
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out + [out[3], out[3]]


def rows_of(df):
    return sorted(str(tuple(r[c] for c in C._NODE)) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 12, C.LIMIT])
def test_nodes(spark, limit):
    rows = conversations(limit, 70)
    seqs = C.sequences(table(spark, rows))
    want = brute_sequences(rows)
    assert {r["conv_id"]: len(r["turns"]) for r in seqs.collect()} == {c: len(s) for c, s in want.items()}
    trie = C.Trie(seqs, limit)
    got = trie.nodes()
    assert rows_of(got) == brute_nodes(want)
    assert bool(trie.splits) == (limit < 100)


def test_rebuilt_conversations(spark):
    rows = conversations(7, 90)
    got = C.prefix_trie(C.shared_heads(C.sequences(table(spark, rows))), 20)
    assert rows_of(got) == brute_nodes(brute_rebuilt(brute_sequences(rows)))


def test_a_long_common_prefix_is_split_in_one_step(spark):
    rows = [(c, t, "user", "same" if t < 40 else f"{c % 4} {t}") for c in range(30) for t in range(40 + c % 7)]
    trie = C.Trie(C.sequences(table(spark, rows)), 50)
    assert rows_of(trie.nodes()) == brute_nodes(brute_sequences(rows))
    assert len(trie.splits) <= 3


def test_many_copies_are_one_sequence(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(9000) for t in range(2)]
    seqs = C.sequences(table(spark, rows))
    assert C.distinct_sequences(seqs).count() == 1
    leaf = C.prefix_trie(seqs).where("depth = 2").first()
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest() and leaf["n_convs"] == 9000


def test_empty_tables_and_turnless_conversations(spark):
    none = table(spark, [(1, 0, "user", "x")]).limit(0)
    assert C.prefix_trie(C.sequences(none)).count() == 0
    bare = spark.createDataFrame([(5, []), (3, [])], "conv_id long, turns array<struct<a:long,b:long,chars:long>>")
    assert rows_of(C.prefix_trie(bare)) == brute_nodes({5: [], 3: []})


def test_equal_numbers_are_ordered_by_role_whatever_the_input_order(spark):
    rows = [(1, 2, r, t) for r, t in [("user", "b"), ("assistant", "a"), ("user", "c")]]
    a, b = (C.sequences(table(spark, x)).first()["turns"] for x in (rows, rows[::-1]))
    assert a == b and len(a) == 3
