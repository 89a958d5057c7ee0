"""Repeated lines against brute force."""

import os
import random
from collections import defaultdict

import pytest
from helpers import ODD
from pyspark.sql import functions as F

from kairoframe.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs=5, min_chars=40):
    """(id, text, lines, dropped) of each row."""
    held, top = defaultdict(int), {}
    for i, text in rows:
        for k in {k for k in map(key, (text or "").split("\n")) if len(k) >= min_chars}:
            held[k] += 1
            top[k] = max([x for x in (top.get(k), i) if x is not None], default=None)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if held[key(x)] < min_docs or top[key(x)] == i]
        out.append((i, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"  THIS line number {i} is long enough to be counted, été 語\t" for i in range(12)] + ["short line", "", " \x0b", "Ünder forty code points but över in bytes ä"[:39], "é" * 40]
    texts = ["\n".join(rng.choice([rng.choice(common), f"a line of its own {rng.random()} {rng.random()} words"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return list(enumerate([*texts, *ODD, *texts[:3] * 4, common[0] * 500, "\n".join([common[1]] * 20_000)]))


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["n"], r["gone"]) for r in df.collect()), key=str)


def run(spark, batches, data):
    found = line_dedup.frequent_lines(spark, iter(batches))
    return line_dedup.drop_lines(data, found, n_lines="n", n_dropped="gone")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_batches_give_the_same_as_brute_force(spark, n):
    data = [*corpus(n, 60), (None, "THIS line number 1 is long enough to be counted, été 語"), (3, None), (3, "no\nthis line number 2 is long enough to be counted, été 語")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], "doc_id long, text string, place string, __id string, docs string").repartition(3)
    parts = [df.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]
    got = run(spark, parts, df)
    assert got.columns == [*df.columns, "n", "gone"]
    assert rows(got) == brute(data)


def test_rows_without_ids_repeated_rows_and_empty_tables(spark):
    line = "a passage of words that stands on many of the rows here"
    data = [(None, line)] * 6 + [(7, f"{line}\nown")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(run(spark, [df], df)) == brute(data)
    assert run(spark, [df.limit(0)], df.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, line)] * 6, "doc_id long, text string")
    assert {r["text"] for r in run(spark, [nobody], nobody).collect()} == {line}


def test_runs_hold_each_key_once_and_are_merged_by_level(spark):
    batch = lambda k: spark.range(k * 50, k * 50 + 100).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("docs"), F.col("id").alias("keeper"))
    runs = line_dedup.LineRuns(spark, 4)
    first = [runs.add(batch(k)).count() if k % 2 else runs.add(batch(k)).select("h2").count() for k in range(5)]
    assert first == [100, 50, 50, 50, 50]
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    held = [r["h2"] for t in runs.runs() for r in spark.table(t).collect()]
    assert sorted(held) == list(range(300))
    assert {r["h2"]: r["docs"] for r in runs.totals(2).collect()} == {i: 2 for i in range(50, 250)}
    plan = spark.table(runs.runs()[0]).join(spark.table(runs.runs()[1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not runs.runs()


def test_nothing_stays_but_the_lines_found(spark):
    from kairoframe.session import shared_dir

    df = spark.createDataFrame(corpus(9, 30), "doc_id long, text string")
    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    line_dedup.frequent_lines(spark, iter([df]))
    new = set(os.listdir(top)) - before
    assert len(new) == 1 and next(iter(new)).startswith("tables-")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_files_are_dealt_out_whole(spark, tmp_path):
    df = spark.createDataFrame(corpus(4, 40), "doc_id long, text string")
    df.repartition(6).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    parts = list(line_dedup.file_batches(stored, 3))
    assert len(parts) == 3 and sum(p.count() for p in parts) == stored.count()
