"""Queries over trajectories: smoothing to rallies. Thresholds suit the stand-in views, not a ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence, signal
from ..sources.views import FRAMES_SQL, TRAJ_SQL, frames, trajectory

NET, WIDTH_W, VMIN, MIN_DX, SERVE, RADIUS, GAP, HORIZON, GUARD, REFRACTORY = 50.0, 2, 3.5, 5.0, 6, 3, 8, 6, 1, 2


def smooth3(spark, d: str) -> DataFrame:
    return signal.smooth(trajectory(spark, d)).select("video", "frame", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


def gradient(spark, d: str) -> DataFrame:
    return signal.own(signal.motion(trajectory(spark, d), "x", WIDTH_W)).select("video", "frame", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def lead_lag_means(spark, d: str) -> DataFrame:
    return signal.own(signal.motion(trajectory(spark, d), "x", WIDTH_W)).select("video", "frame", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("before", "after")])  # 0.0 for -0.0


def _candidates(spark, d: str) -> DataFrame:
    return signal.reversal_candidates(trajectory(spark, d), NET, WIDTH_W, VMIN, MIN_DX, SERVE)


def reversal_candidates(spark, d: str) -> DataFrame:
    return _candidates(spark, d).select("video", "frame", "side", "serve", F.round("score", 6).alias("score"))


def _hits(spark, d: str) -> DataFrame:
    return sequence.detect_hits(_candidates(spark, d).withColumn("score", F.round("score", 6)), RADIUS)


def nms_hits(spark, d: str) -> DataFrame:
    return _hits(spark, d)


def _bounces(spark, d: str, over_table=None) -> DataFrame:
    c = signal.bounce_candidates(trajectory(spark, d), WIDTH_W, 1.0, over_table).withColumn("score", F.round("score", 6))
    c = sequence.far_from(c, _hits(spark, d).select("video", "frame"), GUARD)
    return sequence.suppress(c, RADIUS, carry=("x", "y")).withColumn("half", F.when(F.col("x") > NET, "right").otherwise("left"))


def detected_bounces(spark, d: str) -> DataFrame:
    return _bounces(spark, d).select("video", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "half")


def net_crossings(spark, d: str) -> DataFrame:
    return sequence.net_crossings(trajectory(spark, d), NET, REFRACTORY)


def _sessions(spark, d: str) -> DataFrame:
    return sequence.rally_sessions(_hits(spark, d), GAP)


def rally_sessions(spark, d: str) -> DataFrame:
    return _sessions(spark, d).select("video", "frame", "side", "serve", "rally")


def alternation(spark, d: str) -> DataFrame:
    return sequence.alternate(_sessions(spark, d)).select("video", "frame", "side", "rally", "score")


def rally_outcomes(spark, d: str) -> DataFrame:
    return sequence.rallies(sequence.alternate(_sessions(spark, d)), _bounces(spark, d), HORIZON)


def rally_rollup(spark, d: str) -> DataFrame:
    """Per video: rallies, strokes, and points by winner and outcome."""
    r = rally_outcomes(spark, d)
    return r.groupBy("video").agg(
        F.count("*").alias("n_rallies"), F.sum("n_strokes").alias("n_strokes"), F.max("n_strokes").alias("longest"), F.count_if(F.col("point_winner") == "right").alias("right_points"),
        F.count_if(F.col("point_winner") == "left").alias("left_points"), F.count_if(F.col("outcome") == "winner").alias("winners"), F.count_if(F.col("outcome") == "net").alias("nets"), F.count_if(F.col("outcome") == "out").alias("outs"),
    )


def bounce_guard_anti(spark, d: str) -> DataFrame:
    """View events with no click within two frames."""
    f = frames(spark, d)
    return sequence.far_from(f.where("kind = 'view'").select("video", "frame"), f.where("kind = 'click'").select("video", "frame"), 2)


def contexts(spark, d: str) -> DataFrame:
    return sequence.contexts(_hits(spark, d), 2.0).select("video", "frame", "side", "first_of_rally", F.round("since_prev_s", 6).alias("since_prev_s"))


def segments_merge(spark, d: str) -> DataFrame:
    return sequence.segments(frames(spark, d).where("kind = 'purchase'"), 3, 2)


def interpolate_gaps(spark, d: str) -> DataFrame:
    return signal.fill_gaps(trajectory(spark, d), 4).select("video", "frame", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"))


_S = TRAJ_SQL + """,
s AS (SELECT *, CASE WHEN x IS NOT NULL THEN avg(x) OVER w END AS sx, CASE WHEN x IS NOT NULL THEN avg(y) OVER w END AS sy FROM traj
      WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def _motion_sql(c: str) -> str:
    return f""",
v{c} AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN frame = 0 THEN nx - {c} WHEN frame = n - 1 THEN {c} - px ELSE (nx - px) / 2 END AS v
      FROM (SELECT *, lag({c}) OVER w AS px, lead({c}) OVER w AS nx, count(*) OVER (PARTITION BY video) AS n FROM s WINDOW w AS (PARTITION BY video ORDER BY frame)) t),
m{c} AS (SELECT *, CASE WHEN count(v) OVER b >= 1 THEN avg(v) OVER b END AS before, CASE WHEN count(v) OVER a >= 1 THEN avg(v) OVER a END AS after FROM v{c}
      WINDOW b AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""


_MX, _MY = _S + _motion_sql("sx"), _S + _motion_sql("sy")
_CAND = _MX + f""",
sided AS (SELECT m.*, side, sign FROM msx m, (VALUES ('right', 1.0), ('left', -1.0)) AS q(side, sign)),
ok AS (SELECT *, sign * before > {VMIN} AND before IS NOT NULL AS rally FROM sided
       WHERE frame >= {WIDTH_W} AND frame < n - {WIDTH_W} AND sx IS NOT NULL AND after IS NOT NULL AND sign * (sx - {NET}) >= {MIN_DX} AND sign * after < -{VMIN}),
top AS (SELECT o.video, o.frame, o.side, arg_min(t.frame, (-o.sign * t.sx, t.frame)) AS top FROM ok o JOIN s t ON t.video = o.video AND t.frame BETWEEN o.frame - {WIDTH_W} AND o.frame + {WIDTH_W}
        WHERE t.sx IS NOT NULL GROUP BY ALL),
waits AS (SELECT o.video, o.frame, o.side, bool_and(t.x IS NULL OR o.sign * (t.x - {NET}) > 0) AS waits FROM ok o JOIN traj t ON t.video = o.video AND t.frame BETWEEN o.frame - {SERVE} AND o.frame - {WIDTH_W + 1} GROUP BY ALL),
cand AS (SELECT video, CASE WHEN rally THEN top ELSE frame END AS frame, side, NOT rally AS serve, round(CASE WHEN rally THEN abs(before - after) ELSE abs(after) * 0.5 END, 6) AS score
         FROM ok JOIN top USING (video, frame, side) LEFT JOIN waits USING (video, frame, side) WHERE rally OR ((before IS NULL OR abs(before) < {VMIN / 2}) AND waits))"""


def _nms_sql(source: str, out: str) -> str:
    return f""",
{out} AS (SELECT video, unnest(kept)[1] AS frame FROM (
  SELECT video, list_reduce(list_transform(list_sort(list((-score, frame))), lambda t: [t[2]]), lambda acc, x: CASE WHEN coalesce(list_bool_and(list_transform(acc, lambda k: abs(k - x[1]) > {RADIUS})), true) THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS flat,
         list_transform(flat, lambda k: [k]) AS kept FROM {source} GROUP BY video))"""


_HITS = _CAND + _nms_sql("cand", "kept") + """,
hits AS (SELECT video, frame, side, serve, score FROM (SELECT c.*, row_number() OVER (PARTITION BY video, frame ORDER BY score DESC, side DESC, serve) AS rn FROM cand c JOIN kept USING (video, frame)) t WHERE rn = 1)"""

def _bounce_sql(over_table: str = "TRUE") -> str:
    return _motion_sql("sy") + f""",
low AS (SELECT m.video, m.frame, coalesce(m.x, m.sx) AS x, coalesce(m.y, m.sy) AS y, round(m.before - m.after, 6) AS score, arg_min(t.frame, (-t.sy, t.frame)) AS top
        FROM msy m JOIN s t ON t.video = m.video AND t.frame BETWEEN m.frame - {WIDTH_W} AND m.frame + {WIDTH_W}
        WHERE m.frame >= {WIDTH_W} AND m.frame < m.n - {WIDTH_W} AND m.sy IS NOT NULL AND t.sy IS NOT NULL AND m.before >= 1.0 AND m.after <= -1.0 AND {over_table} GROUP BY ALL),
bcand AS (SELECT * FROM low b WHERE top = frame AND NOT EXISTS (SELECT 1 FROM hits c WHERE c.video = b.video AND abs(c.frame - b.frame) <= {GUARD}))""" + _nms_sql("bcand", "bkept") + f""",
bounces AS (SELECT video, frame, x, y, CASE WHEN x > {NET} THEN 'right' ELSE 'left' END AS half FROM bcand JOIN bkept USING (video, frame))"""


_BOUNCES = _HITS + _bounce_sql()
_SESS = f""",
sess AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN serve OR frame - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS rally FROM (SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS p FROM hits) t),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY video, rally ORDER BY frame) AS run FROM (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY video, rally ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM sess) t),
alt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, rally, run ORDER BY score DESC, frame) AS rn FROM runs) t WHERE rn = 1)"""
_RALLIES = f""",
r0 AS (SELECT video, rally, min(frame) AS start, max(frame) AS last, arg_max(side, frame) AS last_hitter, count(*) AS n_strokes FROM alt GROUP BY ALL),
r1 AS (SELECT *, least(last + {HORIZON}, coalesce(lead(start) OVER (PARTITION BY video ORDER BY rally), last + {HORIZON})) AS until FROM r0),
r2 AS (SELECT r1.*, (SELECT count(*) FROM bounces b WHERE b.video = r1.video AND b.frame BETWEEN start AND until) AS n_bounces,
       (SELECT arg_min(half, b.frame) FROM bounces b WHERE b.video = r1.video AND b.frame > last AND b.frame <= until) AS half,
       (SELECT max(b.frame) FROM bounces b WHERE b.video = r1.video AND b.frame > last AND b.frame <= until) AS last_bounce FROM r1),
r3 AS (SELECT *, CASE WHEN half IS NULL THEN 'out' WHEN half <> last_hitter THEN 'winner' ELSE 'net' END AS outcome FROM r2 WHERE n_strokes > 1 OR n_bounces > 0),
rallies AS (SELECT video, rally, start, greatest(last, coalesce(last_bounce, last)) AS "end", n_strokes, n_bounces, last_hitter, outcome,
       CASE WHEN outcome = 'winner' THEN last_hitter WHEN last_hitter = 'right' THEN 'left' ELSE 'right' END AS point_winner FROM r3)"""
_ALL = _BOUNCES + _SESS + _RALLIES

QUERIES = {f.__name__: f for f in (smooth3, gradient, lead_lag_means, reversal_candidates, nms_hits, detected_bounces, net_crossings, rally_sessions, alternation, rally_outcomes, rally_rollup, bounce_guard_anti, contexts, segments_merge, interpolate_gaps)}
SQL = {
    "smooth3": f"WITH {_S} SELECT video, frame, round(sx, 6) AS sx, round(sy, 6) AS sy FROM s",
    "gradient": f"WITH {_MX} SELECT video, frame, round(v, 6) + 0.0 AS v FROM msx",
    "lead_lag_means": f"WITH {_MX} SELECT video, frame, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after FROM msx",
    "reversal_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "nms_hits": f"WITH {_HITS} SELECT * FROM hits",
    "detected_bounces": f"WITH {_BOUNCES} SELECT video, frame, round(x, 6) AS x, round(y, 6) AS y, half FROM bounces",
    "net_crossings": f"""WITH {TRAJ_SQL},
ch AS (SELECT video, frame FROM (SELECT *, lag(x) OVER (PARTITION BY video ORDER BY frame) AS p FROM traj) t WHERE (p - {NET}) * (x - {NET}) < 0),
f AS (SELECT video, list_reduce(list_transform(list_sort(list(frame)), lambda t: [t]), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] > {REFRACTORY} THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS kept FROM ch GROUP BY video)
SELECT video, unnest(kept) AS frame FROM f""",
    "rally_sessions": f"WITH {_HITS} {_SESS} SELECT video, frame, side, serve, rally::BIGINT AS rally FROM sess",
    "alternation": f"WITH {_HITS} {_SESS} SELECT video, frame, side, rally::BIGINT AS rally, score FROM alt",
    "rally_outcomes": f"WITH {_ALL} SELECT * REPLACE (rally::BIGINT AS rally) FROM rallies",
    "rally_rollup": f"""WITH {_ALL} SELECT video, count(*) AS n_rallies, sum(n_strokes)::BIGINT AS n_strokes, max(n_strokes) AS longest, count(*) FILTER (point_winner = 'right') AS right_points,
 count(*) FILTER (point_winner = 'left') AS left_points, count(*) FILTER (outcome = 'winner') AS winners, count(*) FILTER (outcome = 'net') AS nets, count(*) FILTER (outcome = 'out') AS outs FROM rallies GROUP BY video""",
    "bounce_guard_anti": f"WITH {FRAMES_SQL} SELECT video, frame FROM frames b WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM frames c WHERE c.video = b.video AND c.kind = 'click' AND abs(c.frame - b.frame) <= 2)",
    "contexts": f"""WITH {_HITS} SELECT video, frame, side, serve OR p IS NULL OR frame - p > 5 AS first_of_rally, CASE WHEN NOT (serve OR p IS NULL OR frame - p > 5) THEN round((frame - p) / 2.0, 6) END AS since_prev_s
FROM (SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS p FROM hits) t""",
    "segments_merge": f"""WITH {FRAMES_SQL}, e AS (SELECT video, greatest(frame - 3, 0) AS lo, frame + 2 AS hi FROM frames WHERE kind = 'purchase'),
g AS (SELECT *, sum(n) OVER (PARTITION BY video ORDER BY lo, hi) AS seg FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY video ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM e) t)
SELECT video, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY video, seg""",
    "interpolate_gaps": f"""WITH {TRAJ_SQL}, k AS (SELECT t.*, (SELECT max(frame) FROM traj a WHERE a.video = t.video AND a.frame <= t.frame AND a.x IS NOT NULL) AS a, (SELECT min(frame) FROM traj b WHERE b.video = t.video AND b.frame >= t.frame AND b.x IS NOT NULL) AS b FROM traj t)
SELECT k.video, k.frame, round(CASE WHEN k.x IS NULL AND k.b - k.a BETWEEN 2 AND 4 THEN p.x + (k.frame - k.a) / (k.b - k.a) * (q.x - p.x) ELSE k.x END, 6) AS fx,
 round(CASE WHEN k.x IS NULL AND k.b - k.a BETWEEN 2 AND 4 THEN p.y + (k.frame - k.a) / (k.b - k.a) * (q.y - p.y) ELSE k.y END, 6) AS fy
FROM k LEFT JOIN traj p ON p.video = k.video AND p.frame = k.a LEFT JOIN traj q ON q.video = k.video AND q.frame = k.b""",
}
