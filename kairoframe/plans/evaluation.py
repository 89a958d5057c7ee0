"""Queries of the evaluation slice: matching, rates, classification, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import matching
from ..sources.views import FRAMES_SQL, TRAJ_SQL, frames, table, trajectory
from . import signal as S

TOL = 2


def _pred_gt(spark, d: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, d)
    return f.where("kind = 'click'").select("video", "frame"), f.where("kind = 'purchase'").select("video", "frame")


def match_greedy(spark, d: str) -> DataFrame:
    return matching.match_greedy(*_pred_gt(spark, d), TOL)


def matched_labels(spark, d: str) -> DataFrame:
    """Hand and technique of each matched hit, truth beside what is said of it."""
    f = frames(spark, d)
    hand, technique = F.when(F.col("k") >= 50, "forehand").otherwise("backhand"), F.when(F.col("frame") < 5, "serve").when(F.col("frame") % 2 == 0, "loop").otherwise("block")
    said, truth = (f.where(F.col("kind") == k).select("video", "frame", hand.alias("hand"), technique.alias("technique")) for k in ("click", "purchase"))
    return matching.matched_labels(matching.match_greedy(*_pred_gt(spark, d), TOL), said, truth, "hand", "technique")


def prf_by_video(spark, d: str) -> DataFrame:
    return matching.match_report(*_pred_gt(spark, d), TOL)


def landing_asof(spark, d: str) -> DataFrame:
    hits = S._hits(spark, d).select("video", "frame", "side")
    return matching.landings(hits, S._bounces(spark, d))


def ball_counts(spark, d: str) -> DataFrame:
    """The smoothed trajectory against every third frame's raw sample."""
    t = trajectory(spark, d)
    gt = t.where("frame % 3 = 0").select("video", "frame", F.when(F.col("frame") % 2 == 0, F.col("x")).alias("gx"), F.when(F.col("frame") % 2 == 0, F.col("y")).alias("gy"))
    sm = S.smooth3(spark, d).select("video", "frame", F.col("sx").alias("x"), F.col("sy").alias("y"))
    return matching.ball_counts(sm, gt, 2.0)


def classification_report(spark, d: str) -> DataFrame:
    """Quality labels against a length rule, by language."""
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    rows = docs.select("lang", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n_chars") > 2000, "good").when(F.col("n_chars") > 500, "bad").otherwise("short").alias("guess"))
    return matching.classification_report(rows, "truth", "guess", "lang")


def _ends(spark, d: str) -> DataFrame:
    f = frames(spark, d).where("kind = 'signup'")
    return f.select("video", "frame", F.when(F.col("k") >= 50, "right").otherwise("left").alias("winner"))


def rally_endings(spark, d: str) -> DataFrame:
    return matching.endings_in_rallies(_ends(spark, d), S.rally_outcomes(spark, d), 3)


def rally_coverage(spark, d: str) -> DataFrame:
    e = rally_endings(spark, d)
    g = e.groupingSets([[F.col("video")], []], F.col("video")).agg(F.count("*").alias("n"), F.count("rally").alias("covered"), F.count_if(F.col("predicted") == F.col("winner")).alias("correct"))
    return g.select("video", "n", "covered", "correct", F.round(F.col("covered") / F.greatest("n", F.lit(1)), 4).alias("coverage"), F.round(F.col("correct") / F.greatest("covered", F.lit(1)), 4).alias("winner_acc"))


def agreement(spark, d: str) -> DataFrame:
    """Share of documents on which two length rules agree, by source."""
    docs = table(spark, d, "documents", "source", "n_chars")
    same = (F.col("n_chars") > 1000) == (F.col("n_chars") % 7 > 2)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 4).alias("agreement"))


def votes(spark, d: str) -> DataFrame:
    """Left or right per user by majority of three guesses on each event; right on a tie."""
    f = frames(spark, d).select("video", F.when(F.col("k") < 50, "L").otherwise("R").alias("a"), F.when(F.col("value") < 50, "L").otherwise("R").alias("b"), F.when(F.col("kind") == "error", None).when(F.col("kind") == "click", "L").otherwise("R").alias("c"))
    v = f.select("video", F.explode(F.array("a", "b", "c")).alias("v"))
    g = v.groupBy("video").agg(F.count_if(F.col("v") == "L").alias("n_left"), F.count_if(F.col("v") == "R").alias("n_right"), F.count_if(F.col("v").isNull()).alias("n_unknown"))
    return g.withColumn("hand", F.when(F.col("n_left") > F.col("n_right"), "L").otherwise("R"))


def history_delta(spark, d: str) -> DataFrame:
    """Each order with its change of price against the customer's order before."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("previous"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("delta"))


_PG = FRAMES_SQL + ", pred AS (SELECT video, frame FROM frames WHERE kind = 'click'), gt AS (SELECT video, frame FROM frames WHERE kind = 'purchase')"
_MATCH = _PG + f""",
pairs AS (SELECT p.video, p.frame AS p, g.frame AS g FROM pred p JOIN gt g ON p.video = g.video AND abs(p.frame - g.frame) <= {TOL}),
folded AS (SELECT video, list_reduce(list_transform(list_sort(list((abs(p - g), p, g))), lambda t: [t[2], t[3]]), lambda acc, x: CASE WHEN list_contains(list_transform(range(1, len(acc), 2), lambda i: acc[i]), x[1])
   OR list_contains(list_transform(range(2, len(acc) + 1, 2), lambda i: acc[i]), x[2]) THEN acc ELSE list_concat(acc, x) END, []::BIGINT[]) AS flat FROM pairs GROUP BY video),
m AS (SELECT video, flat[2 * i + 1] AS p, flat[2 * i + 2] AS g FROM (SELECT video, flat, unnest(range(0, len(flat) // 2)) AS i FROM folded))"""
_PRF = "round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1"
_ENDS = S._ALL + """,
ends AS (SELECT video, frame, CASE WHEN k >= 50 THEN 'right' ELSE 'left' END AS winner FROM frames WHERE kind = 'signup'),
en AS (SELECT e.video, e.frame, e.winner, arg_min(r.rally, r.rally)::BIGINT AS rally, arg_min(r.point_winner, r.rally) AS predicted FROM ends e LEFT JOIN rallies r ON r.video = e.video AND e.frame BETWEEN r.start AND r."end" + 3 GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (match_greedy, matched_labels, prf_by_video, landing_asof, ball_counts, classification_report, rally_endings, rally_coverage, agreement, votes, history_delta)}
SQL = {
    "match_greedy": f"WITH {_MATCH} SELECT video, p, g FROM m",
    "matched_labels": f"""WITH {_MATCH}, l AS (SELECT video, frame, CASE WHEN k >= 50 THEN 'forehand' ELSE 'backhand' END AS hand, CASE WHEN frame < 5 THEN 'serve' WHEN frame % 2 = 0 THEN 'loop' ELSE 'block' END AS technique FROM frames),
j AS (SELECT m.video, t.hand AS th, t.technique AS tt, s.hand AS sh, s.technique AS st FROM m JOIN l t ON t.video = m.video AND t.frame = m.g JOIN l s ON s.video = m.video AND s.frame = m.p)
SELECT video, 'hand' AS target, th AS label, sh AS guess FROM j UNION ALL SELECT video, 'technique', tt, st FROM j""",
    "prf_by_video": f"""WITH {_MATCH}, c AS (SELECT v.video, (SELECT count(*) FROM pred WHERE pred.video = v.video) AS np, (SELECT count(*) FROM gt WHERE gt.video = v.video) AS ng, (SELECT count(*) FROM m WHERE m.video = v.video) AS tp
 FROM (SELECT video FROM pred UNION SELECT video FROM gt) v),
t AS (SELECT video, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((video), ()))
SELECT video, tp, fp, fn, {_PRF} FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM t)""",
    "landing_asof": f"""WITH {S._BOUNCES}, nx AS (SELECT video, frame, side, lead(frame) OVER (PARTITION BY video ORDER BY frame) AS nxt FROM hits)
SELECT h.video, h.frame, h.side, min(b.frame) AS landing, arg_min(b.half, b.frame) AS landing_half FROM nx h LEFT JOIN bounces b ON b.video = h.video AND b.frame > h.frame AND b.frame < coalesce(h.nxt, 1000000000) GROUP BY ALL""",
    "ball_counts": f"""WITH {S._S}, g AS (SELECT video, frame, CASE WHEN frame % 2 = 0 THEN x END AS gx, CASE WHEN frame % 2 = 0 THEN y END AS gy, round(sx, 6) AS x, round(sy, 6) AS y FROM s WHERE frame % 3 = 0),
e AS (SELECT *, CASE WHEN gx IS NOT NULL AND x IS NOT NULL THEN sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) / 2.0 END AS err FROM g)
SELECT video, count(gx) AS n_visible, round(count(*) FILTER (err <= 5) / greatest(count(gx), 1), 4) AS recall5, round(count(*) FILTER (err <= 10) / greatest(count(gx), 1), 4) AS recall10,
 round(count(*) FILTER (gx IS NOT NULL AND x IS NOT NULL) / greatest(count(gx), 1), 4) AS detection_rate, round(median(err), 2) AS median_err,
 round(count(*) FILTER (gx IS NULL AND x IS NOT NULL) / greatest(count(*) FILTER (gx IS NULL), 1), 4) AS fp_rate_invisible FROM e GROUP BY video""",
    "classification_report": """WITH r AS (SELECT lang, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 2000 THEN 'good' WHEN n_chars > 500 THEN 'bad' ELSE 'short' END AS guess FROM documents JOIN labels USING (doc_id)),
l AS (SELECT DISTINCT lang, truth AS label FROM r),
f AS (SELECT l.lang, label, (SELECT count(*) FROM r WHERE r.lang = l.lang AND truth = label AND guess = label) AS tp, (SELECT count(*) FROM r WHERE r.lang = l.lang AND truth = label) AS nt, (SELECT count(*) FROM r WHERE r.lang = l.lang AND guess = label) AS ng FROM l)
SELECT lang, sum(nt)::BIGINT AS n, round(sum(tp) / sum(nt), 4) AS accuracy, round(avg(2 * tp / (nt + ng)), 4) AS macro_f1 FROM f GROUP BY lang""",
    "rally_endings": f"WITH {_ENDS} SELECT * FROM en",
    "rally_coverage": f"""WITH {_ENDS}, t AS (SELECT video, count(*) AS n, count(rally) AS covered, count(*) FILTER (predicted = winner) AS correct FROM en GROUP BY GROUPING SETS ((video), ()))
SELECT video, n, covered, correct, round(covered / greatest(n, 1), 4) AS coverage, round(correct / greatest(covered, 1), 4) AS winner_acc FROM t""",
    "agreement": "SELECT source, count(*) AS n, round(avg(CASE WHEN (n_chars > 1000) = (n_chars % 7 > 2) THEN 1 ELSE 0 END), 4) AS agreement FROM documents GROUP BY source",
    "votes": f"""WITH {FRAMES_SQL}, v AS (SELECT video, unnest([CASE WHEN k < 50 THEN 'L' ELSE 'R' END, CASE WHEN value < 50 THEN 'L' ELSE 'R' END, CASE WHEN kind = 'error' THEN NULL WHEN kind = 'click' THEN 'L' ELSE 'R' END]) AS v FROM frames),
g AS (SELECT video, count(*) FILTER (v = 'L') AS n_left, count(*) FILTER (v = 'R') AS n_right, count(*) FILTER (v IS NULL) AS n_unknown FROM v GROUP BY video)
SELECT *, CASE WHEN n_left > n_right THEN 'L' ELSE 'R' END AS hand FROM g""",
    "history_delta": """SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS previous, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
}
