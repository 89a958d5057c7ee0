"""Notes as HTML, addresses, JSON lines, answers and stored detections."""

import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import text
from kairoframe.operators import dataset, matching
from kairoframe.sources import store


def escaped(s):
    for c, n in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(c, n)
    return s


def brute_html(note):
    """Line by line, with a list that is opened and closed."""
    out, open_ = "", False
    strong = lambda s: re.sub(r"\*(.+?)\*", r"<i>\1</i>", re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", escaped(s)))
    for raw in (note or "").split("\n"):
        line = raw.strip()
        item = re.match(r"([-*]|\d+\.)\s+(.*)", line)
        if item and not open_:
            out += "<ul>"
        if open_ and not item:
            out += "</ul>"
        open_ = bool(item)
        if item:
            out += f"<li>{strong(item[2])}</li>"
        elif re.match(r"#{1,4}\s", line):
            out += f"<h3>{strong(re.sub(r'^#+\s*', '', line))}</h3>"
        elif line:
            out += f"<p>{strong(line)}</p>"
    return out + ("</ul>" if open_ else "")


def test_notes(spark):
    rng = random.Random(1)
    bits = ["- ", "* ", "12. ", "# ", "##### ", "**", "*", "a", "b & c", "<x>", '"', "'", "\n", "\n\n", "  ", "\t", "é", " ", "$1", "\\"]
    notes = [None, "", "- a", "- a\n- b\n\nc", "# h\n- x", "**b** *i* ***c***", "-", "1.", "a\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(notes)), "i int, note string")
    got = {r["i"]: r["html"] for r in df.select("i", text.markdown_html(F.col("note")).alias("html")).collect()}
    for i, note in enumerate(notes):
        assert got[i] == brute_html(note), note


def test_addresses_of_images_go_there_and_back(spark):
    data = [bytes(range(256)) * 3, b"", b"a", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(data)], "i int, b binary").withColumn("url", text.image_url(F.col("b")))
    rows = {r["i"]: r for r in df.select("i", "url", text.image_bytes(F.col("url")).alias("back")).collect()}
    assert rows[0]["url"] == "data:image/jpeg;base64," + base64.b64encode(data[0]).decode() and rows[3]["url"] is None
    assert [rows[i]["back"] for i in range(4)] == [None if b is None else bytearray(b) for b in data]
    assert spark.range(1).select(text.image_bytes(F.lit("data:x,*?")).alias("x")).first()["x"] is None


def test_json_lines_with_cut_ones(spark, tmp_path):
    (tmp_path / "train_a.jsonl").write_text('{"image": "a.jpg", "prompt": "p", "answer": "{}"}\n\n{"image": "b.jpg", "prom\n{"image": 3}\n')
    (tmp_path / "val_a.jsonl").write_text('{"image": "c.jpg"}\n')
    rows = store.read_jsonl(spark, f"{tmp_path}/train_*.jsonl", "image string, prompt string, answer string").collect()
    assert sorted((r["image"] or "", r["prompt"] or "", r["bad_line"] is not None) for r in rows) == [("", "", True), ("3", "", False), ("a.jpg", "p", False)]


def test_accuracy_and_bad_answers(spark):
    rows = [('{"hand": "forehand", "lean": "neutral"}', r) for r in ('{"hand": " FOREHAND ", "lean": "neutral"}', '{"hand": "forehand"}', '{"hand": "forehand", "lean"', "[1]", "", '{"hand": null, "lean": 3}')]
    got = matching.answer_accuracy(spark.createDataFrame(rows, "answer string, reply string"), ("hand", "lean")).first()
    assert (got["n"], got["hand_acc"], got["lean_acc"]) == (6, 0.3333, 0.1667) and got["bad_json"] == 2
    none = matching.answer_accuracy(spark.createDataFrame([], "answer string, reply string"), ("hand",)).first()
    assert none["n"] == 0 and none["hand_acc"] is None


def test_detections_are_stored_by_split(spark, tmp_path):
    rows = [("train", "game_1", 3, "0 0.5 0.5 0.1 0.1"), ("train", "game_1", 1, ""), ("val", "game_5", 7, "")]
    store.write_detections(spark.createDataFrame(rows, "split string, video string, frame long, line string"), str(tmp_path / "d"), {"box": 20.0, "mode": "rgb"})
    got, meta = store.read_detections(spark, str(tmp_path / "d"))
    assert sorted((r["split"], r["video"], r["frame"], r["line"]) for r in got.collect()) == sorted(rows) and meta == {"box": 20.0, "mode": "rgb"}
    plan = got.where("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert json.loads((tmp_path / "d" / "meta" / next(p.name for p in (tmp_path / "d" / "meta").iterdir() if p.suffix == ".txt")).read_text()) == meta


def test_unlabelled_videos_are_unknown(spark):
    df = spark.createDataFrame([("test_2", 1, 2), ("a", 3, 4)], "video string, tp int, fn int")
    assert sorted(map(tuple, matching.unless_unlabelled(df, ("test_2",), "tp").collect()), key=str) == [("a", 3, 4), ("test_2", None, 2)]
    assert matching.unless_unlabelled(df, (), "tp").where("tp is null").count() == 0


@pytest.mark.parametrize("cell", [1.0, 7.0, 500.0])
def test_windows_clear_of_boxes(spark, cell):
    rng = random.Random(8)
    box = lambda n: (lambda x, y: (x, y, x + rng.randint(1, n), y + rng.randint(1, n)))(rng.randint(-20, 60), rng.randint(-20, 60))
    windows, boxes = ([(v, *map(float, box(n))) for v in range(2) for _ in range(k)] for n, k in ((6, 60), (12, 8)))
    windows.append((0, None, 1.0, 2.0, 3.0))
    types = "video long, x1 double, y1 double, x2 double, y2 double"
    touch = lambda w, b: w[0] == b[0] and w[1] is not None and w[1] < b[3] + 0.1 * (b[3] - b[1]) and w[3] > b[1] - 0.1 * (b[3] - b[1]) and w[2] < b[4] + 0.1 * (b[4] - b[2]) and w[4] > b[2] - 0.1 * (b[4] - b[2])
    got = dataset.clear_of(spark.createDataFrame(windows, types), spark.createDataFrame(boxes, types), cell=cell)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((w for w in windows if not any(touch(w, b) for b in boxes)), key=str)
