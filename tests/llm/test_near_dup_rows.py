"""Rows that share an id, clashing columns, and a hot group of near copies, against brute force."""

import random

from helpers import prose
from test_near_dup import brute, edited

from kairoframe.llm import near_dup


def test_rows_that_share_an_id_go_by_their_texts(spark):
    a, b, c, e = (prose(i, 40) for i in range(900, 904))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, e), (3, e), (4, None), (4, ""), (None, a), (5, c.upper())]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, __id int, __class string")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (3, e), (4, None), (4, ""), (None, a)], key=str)


def test_hot_group_loses_no_link(spark):
    """A third of the rows are near copies of one text, at, over and under the threshold from each other."""
    rng = random.Random(11)
    base = prose(5, 300)
    texts = [edited(base, rng.randint(1, 12), rng) for _ in range(400)] + [prose(1000 + i, 60) for i in range(800)]
    for i in range(0, 400, 7):  # links that do not lead over the base
        texts.append(edited(texts[i], 2, rng))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.Similarity()).collect()
    want = {d: g for d, _, g in brute(rows, near_dup.Similarity())}
    assert {r["id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 800 and max(list(want.values()).count(g) for g in set(want.values())) > 100
