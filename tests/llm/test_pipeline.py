import os

import pytest
from helpers import prose
from pyspark.sql import functions as F

import corpus_pipeline

LANG = {"xx": "ka lo mi nu pe ro", "yy": "tra stro ply quent marb"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(lang, seed, n=120):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LANG[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages_decide(spark, tmp_path):
    rows = [(i, words("xx" if i % 2 else "yy", i), "xx" if i % 2 else "yy") for i in range(40)]
    passage = prose(1, 20)
    rows += [(100, rows[3][1] + " end", "xx"), (101, words("xx", 77) + " " + passage, "xx"), (102, "too short", "xx"), (103, "123 456 " * 60, "xx"), (104, None, None), (105, " ".join(f"{i}.{i * 7}" for i in range(90)), "yy"), (5, rows[5][1], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    clean = list(range(40))
    assert left["quality_rules"] == sorted([*clean, 5, 100, 101, 105])
    assert left["language_id"] == sorted([*clean, 5, 100, 101])
    assert left["near_dedup"] == [*clean, 101]
    assert left["benchmark_decontamination"] == left["sentencepiece_codec"] == clean
    assert docs.where("not round_trip or n_ids <> size(ids) or n_ids = 0").count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == clean


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables are not here")
def test_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(q)
