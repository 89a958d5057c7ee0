"""Queries of the report slice. Orders stand for rallies, their lines for shots, customers for players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import detection, report, sequence
from ..sources.views import FRAMES_SQL, frames, table, trajectory
from . import signal as S

#: Image corners of the stand-in table: far left, far right, near right, near left (a perspective view).
CORNERS = [(20.0, 25.0), (80.0, 28.0), (95.0, 75.0), (5.0, 70.0)]
TABLE = geometry.TableShape(CORNERS)
TECHNIQUES = ("loop", "push", "block", "serve", "chop", "flick", "lob")
LEANS = ("neutral", "back_heavy", "front_heavy")
FEET = ("both_feet_planted", "left_foot_lifted", "both_feet_lifted", "right_foot_lifted")


def _pick(words: tuple[str, ...], n):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def shots(spark, d: str) -> DataFrame:
    """player, rally, n, part, supplier, hand, technique, lean, feet, speed (0: unknown), won, outcome of each line."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_custkey").alias("player"), F.col("l_orderkey").alias("rally"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.when(F.col("l_returnflag") == "R", "backhand").otherwise("forehand").alias("hand"), _pick(TECHNIQUES, F.col("l_partkey")).alias("technique"), _pick(LEANS, F.col("l_suppkey")).alias("lean"),
        _pick(FEET, F.col("l_partkey") + F.col("l_suppkey")).alias("feet"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice") / 997).alias("speed"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("won"), F.when(F.col("l_linestatus") == "F", "net").otherwise("out").alias("outcome"),
    )


def report_totals(spark, d: str) -> DataFrame:
    return report.totals(shots(spark, d), "player", places=6)


def _at():
    """Order of a player's shots. Order, line and part are not unique in the table: equal ones go by supplier, then by what they show."""
    return F.struct(((F.col("rally") * 10 + F.col("n")) * 1_000_000 + F.col("part")).alias("key"), "supplier", "rally", "n", "hand")


def technique_counts(spark, d: str) -> DataFrame:
    s = shots(spark, d).withColumn("at", _at())
    return report.ranked_counts(s, "player", "technique", "at")


def won_lost(spark, d: str) -> DataFrame:
    """Points by player: won, lost and not known, over rallies."""
    r = shots(spark, d).select("player", "rally", "won").distinct()
    return r.groupBy("player").agg(F.count("*").alias("rallies"), F.count_if(F.col("won")).alias("won"), F.count_if(~F.col("won")).alias("lost"), F.count_if(F.col("won").isNull()).alias("unknown"))


def keyframes(spark, d: str) -> DataFrame:
    s = shots(spark, d).withColumn("at", _at())
    return report.key_frames(s, "player", ["hand", "technique"], "at").select("player", "rally", "n", "hand", "technique")


def topk_candidates(spark, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    return report.top_k(e, ["user_id", "event_type"], "value", "event_id", 8)


def shot_speed(spark, d: str) -> DataFrame:
    return report.shot_speeds(S._hits(spark, d).select("video", "frame", "side"), trajectory(spark, d), 25.0, 0.01, 1, 7)


def ball_visible(spark, d: str) -> DataFrame:
    t = trajectory(spark, d)
    return t.groupBy("video").agg(F.round(F.avg(F.col("x").isNotNull().cast("int")) * 100, 1).alias("visible_pct"))


def homography(spark, d: str) -> DataFrame:
    """Every sample in table coordinates, with its half."""
    t = trajectory(spark, d).where("x is not null")
    u, v = geometry.to_table(F.col("x"), F.col("y"), TABLE.h)
    return t.select("video", "frame", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), geometry.half(u).alias("half"))


def placements(spark, d: str) -> DataFrame:
    """Landing depth of bounces on the other half, as seen by a player on either side."""
    b = S._bounces(spark, d)
    u, v = geometry.to_table(F.col("x"), F.col("y"), TABLE.h)
    b = b.withColumns({"u": u, "v": v}).withColumn("h", geometry.half(F.col("u"))).crossJoin(F.broadcast(spark.createDataFrame([("right",), ("left",)], "side string")))  # two rows
    p = report.placement(F.col("side"), F.col("h"), F.col("u"), F.col("v"))
    return b.withColumn("p", p).where("p is not null").select("video", "frame", "side", "p.u", "p.v", "p.depth")


def polygon_restrict(spark, d: str) -> DataFrame:
    """Samples far outside the table polygon and not certain are dropped; what stays, with its signed distance."""
    f = frames(spark, d).where("kind <> 'error'")
    dist = geometry.polygon_distance(F.col("k"), F.col("value"), CORNERS)
    conf = (F.col("secs") % 100) / 100
    return f.select("video", "frame", F.round(dist, 6).alias("distance"), conf.alias("conf")).where((F.col("conf") >= 0.5) | (F.col("distance") >= -10.0))


def restricted_candidates(spark, d: str) -> DataFrame:
    """Candidates left and removed per video, by the median height of people in it."""
    f = frames(spark, d).where("kind <> 'error'")
    c = f.select("video", "frame", F.col("k").alias("x"), F.col("value").alias("y"), ((F.col("secs") % 100) / 100).alias("conf"))
    people = f.where("frame % 3 = 0").select("video", F.col("k").alias("y1"), (F.col("k") + F.col("value") / 10).alias("y2"))
    found = detection.restrict_to_table(c, people, CORNERS, 100.0)
    return found.groupBy("video").agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"))


def table_bounces(spark, d: str) -> DataFrame:
    """Bounces over the table, by its halves; what is off the table is no candidate."""
    u, _ = geometry.to_table(F.col("x"), F.col("y"), TABLE.h)
    return S._bounces(spark, d, TABLE.over).select("video", "frame", geometry.half(u).alias("half"))


def numbered_shots(spark, d: str) -> DataFrame:
    n = report.number_shots(S._hits(spark, d).select("video", "frame", "side"), sequence.alternate(S._sessions(spark, d)))
    return n.select("video", "frame", "side", "n", "rally")


def found(spark, d: str) -> DataFrame:
    """player, findings: what the rules find in each player's shots, which are joined and grouped once for all counts."""
    own = F.expr("n = 1 and not won")
    lost = lambda outcome: F.count_if(own & (F.col("outcome") == outcome))
    counts = [report.label_counts(c, v) for c, v in (("technique", TECHNIQUES), ("lean", LEANS), ("feet", FEET))]
    r = shots(spark, d).groupBy("player").agg(*report.total_columns(places=6), *counts, F.count_if(own).alias("lost"), lost("net").alias("lost_net"), lost("out").alias("lost_out"))
    return r.select("player", report.findings(r).alias("findings"))


def coaching_tips(spark, d: str) -> DataFrame:
    return found(spark, d).select("player", F.array_join(F.transform("findings", lambda t: t["title"]), "; ").alias("tips"))


def report_json(spark, d: str) -> DataFrame:
    """One JSON document per player."""
    t = report.totals(shots(spark, d), "player", places=6)
    return t.select("player", F.to_json(F.struct("player", F.struct("strokes", "forehand", "backhand").alias("totals"))).alias("report"))


def shot_labels(spark, d: str) -> DataFrame:
    s = shots(spark, d).where("n = 1")
    return s.select("rally", report.shot_label(F.col("hand"), F.col("technique"), F.when(F.col("lean") == "neutral", "unknown").otherwise(F.col("lean"))).alias("label"))


_case = lambda words, n: f"['{"', '".join(words)}'][({n}) % {len(words)} + 1]"
_SHOTS = f"""shots AS (SELECT o_custkey AS player, l_orderkey AS rally, l_linenumber::BIGINT AS n, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 'backhand' ELSE 'forehand' END AS hand,
 {_case(TECHNIQUES, 'l_partkey')} AS technique, {_case(LEANS, 'l_suppkey')} AS lean, {_case(FEET, 'l_partkey + l_suppkey')} AS feet, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / 997 END AS speed,
 CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS won, CASE WHEN l_linestatus = 'F' THEN 'net' ELSE 'out' END AS outcome FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_TOTALS = _SHOTS + """,
totals AS (SELECT player, count(*) AS strokes, count(*) FILTER (hand = 'forehand') AS forehand, count(*) FILTER (hand = 'backhand') AS backhand, round(avg(speed) FILTER (speed > 0), 6) AS avg_speed, round(max(speed) FILTER (speed > 0), 6) AS peak_speed,
 round(avg(speed) FILTER (speed > 0 AND hand = 'forehand'), 6) AS forehand_avg, round(avg(speed) FILTER (speed > 0 AND hand = 'backhand'), 6) AS backhand_avg FROM shots GROUP BY player)"""
_H = TABLE.h
_UV = lambda x, y: (f"(({_H[0]!r}) * {x} + ({_H[1]!r}) * {y} + ({_H[2]!r})) / (({_H[6]!r}) * {x} + ({_H[7]!r}) * {y} + ({_H[8]!r}))", f"(({_H[3]!r}) * {x} + ({_H[4]!r}) * {y} + ({_H[5]!r})) / (({_H[6]!r}) * {x} + ({_H[7]!r}) * {y} + ({_H[8]!r}))")
_U, _V = (f"CAST({e} AS DOUBLE)" for e in _UV("x", "y"))


def _edge_sql(a, b) -> tuple[str, str]:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((k - {a[0]}) * {dx} + (value - {a[1]}) * {dy}) / {dx * dx + dy * dy}::DOUBLE))"
    return f"sqrt(pow(k - {a[0]} - {t} * {dx}, 2) + pow(value - {a[1]} - {t} * {dy}, 2))", f"{dx} * (value - {a[1]}) - ({dy}) * (k - {a[0]}) >= 0"


_EDGES = [_edge_sql(a, b) for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)]
_DIST = f"(CASE WHEN {' AND '.join(e[1] for e in _EDGES)} THEN 1 ELSE -1 END) * least({', '.join(e[0] for e in _EDGES)})"

_X0, _X1 = TABLE.x_range
_OVER = f"m.sx BETWEEN {_X0 - 0.03 * (_X1 - _X0)!r} AND {_X1 + 0.03 * (_X1 - _X0)!r} AND m.sy BETWEEN {25.0 - 0.06 * TABLE.length_px!r} AND {75.0 + 0.02 * TABLE.length_px!r}"
QUERIES = {f.__name__: f for f in (report_totals, technique_counts, won_lost, keyframes, topk_candidates, shot_speed, ball_visible, homography, placements, polygon_restrict, restricted_candidates, table_bounces, numbered_shots, coaching_tips, report_json, shot_labels)}
SQL = {
    "report_totals": f"WITH {_TOTALS} SELECT * FROM totals",
    "technique_counts": f"""WITH {_SHOTS} SELECT player, technique, n, row_number() OVER (PARTITION BY player ORDER BY n DESC, f)::INTEGER AS rank FROM (SELECT player, technique, count(*) AS n, min((rally * 10 + shots.n) * 1000000 + part) AS f FROM shots GROUP BY ALL) t""",
    "won_lost": f"WITH {_SHOTS} SELECT player, count(*) AS rallies, count(*) FILTER (won) AS won, count(*) FILTER (NOT won) AS lost, count(*) FILTER (won IS NULL) AS unknown FROM (SELECT DISTINCT player, rally, won FROM shots) t GROUP BY player",
    "keyframes": f"""WITH {_SHOTS}, a AS (SELECT *, row_number() OVER (PARTITION BY player, hand, technique ORDER BY (rally * 10 + n) * 1000000 + part) AS nth FROM shots),
b AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY nth > 1, (rally * 10 + n) * 1000000 + part) AS pick FROM a) SELECT player, rally, n, hand, technique FROM b WHERE pick <= 6""",
    "topk_candidates": "SELECT * FROM (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) t WHERE rank <= 8",
    "shot_speed": f"""WITH {S._HITS}, p AS (SELECT h.video, h.frame AS hit, t.frame, sqrt(pow(t.x - lag(t.x) OVER w, 2) + pow(t.y - lag(t.y) OVER w, 2)) AS step FROM hits h JOIN traj t ON t.video = h.video AND t.frame BETWEEN h.frame + 1 AND h.frame + 6 WHERE t.x IS NOT NULL
 WINDOW w AS (PARTITION BY h.video, h.frame ORDER BY t.frame)), v AS (SELECT video, hit, count(*) AS n, median(step) * 25.0 * 0.01 * 3.6 AS v FROM p GROUP BY ALL)
SELECT h.video, h.frame, h.side, CASE WHEN n >= 3 AND v > 3 AND v < 200 THEN round(v, 1) END AS speed_kmh FROM hits h LEFT JOIN v ON v.video = h.video AND v.hit = h.frame""",
    "ball_visible": f"WITH {FRAMES_SQL} SELECT video, round(avg(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) * 100, 1) AS visible_pct FROM frames GROUP BY video",
    "homography": f"WITH {S.TRAJ_SQL} SELECT video, frame, round({_U}, 6) AS u, round({_V}, 6) AS v, CASE WHEN {_U} < 1.37 THEN 'left' ELSE 'right' END AS half FROM traj WHERE x IS NOT NULL",
    "placements": f"""WITH {S._BOUNCES}, p AS (SELECT video, frame, {_U} AS u, {_V} AS v FROM bounces)
SELECT video, frame, side, round(u, 3) AS u, round(v, 3) AS v, round(CASE WHEN side = 'right' THEN (1.37 - u) / 1.37 ELSE (u - 1.37) / 1.37 END, 3) AS depth FROM p, (VALUES ('right'), ('left')) s(side)
WHERE side <> CASE WHEN u < 1.37 THEN 'left' ELSE 'right' END AND u BETWEEN -0.2 AND 2.94""",
    "polygon_restrict": f"WITH {FRAMES_SQL} SELECT video, frame, distance, conf FROM (SELECT video, frame, round({_DIST}, 6) AS distance, (secs % 100) / 100 AS conf FROM frames WHERE kind <> 'error') t WHERE conf >= 0.5 OR distance >= -10.0",
    "restricted_candidates": f"""WITH {FRAMES_SQL}, t AS (SELECT video, median((k + value / 10) - k) AS tall FROM frames WHERE kind <> 'error' AND frame % 3 = 0 GROUP BY video),
c AS (SELECT video, (secs % 100) / 100 < 0.5 AND {_DIST} < -1.0 * coalesce(tall, 40.0) AS removed FROM frames LEFT JOIN t USING (video) WHERE kind <> 'error')
SELECT video, count(*) FILTER (removed) AS removed, count(*) FILTER (NOT removed) AS kept FROM c GROUP BY video""",
    "table_bounces": f"""WITH {S._HITS + S._bounce_sql(_OVER)} SELECT video, frame, CASE WHEN {_U} < 1.37 THEN 'left' ELSE 'right' END AS half FROM bounces""",
    "numbered_shots": f"""WITH {S._HITS} {S._SESS}, a AS (SELECT video, frame, max(rally) AS rally FROM alt GROUP BY video, frame)
SELECT h.video, h.frame, h.side, row_number() OVER (PARTITION BY h.video, h.side ORDER BY h.frame)::INTEGER AS n, a.rally::BIGINT AS rally FROM hits h LEFT JOIN a ON a.video = h.video AND a.frame = h.frame""",
    "coaching_tips": f"""WITH {_TOTALS}, c AS (SELECT player, count(*) FILTER (lean = 'back_heavy') AS back, count(*) FILTER (feet <> 'both_feet_planted') AS lifted, count(*) FILTER (technique = 'push') AS push, count(*) FILTER (technique = 'loop') AS loop,
 count(*) FILTER (n = 1 AND NOT won) AS lost, count(*) FILTER (n = 1 AND NOT won AND outcome = 'net') AS nets, count(*) FILTER (n = 1 AND NOT won AND outcome = 'out') AS outs FROM shots GROUP BY player),
r AS (SELECT player, strokes, list_filter([CASE WHEN forehand + backhand >= 6 AND backhand / (forehand + backhand) < 0.25 THEN 'Backhand is under-used' END, CASE WHEN forehand + backhand >= 6 AND backhand / (forehand + backhand) > 0.75 THEN 'Forehand is under-used' END,
 CASE WHEN back / strokes > 0.2 THEN 'Weight falling backwards at contact' END, CASE WHEN lifted / strokes > 0.45 THEN 'Balance at contact' END, CASE WHEN push / strokes > 0.35 AND loop / strokes < 0.25 THEN 'Passive rallies' END,
 CASE WHEN forehand_avg > 0 AND backhand_avg > 0 AND backhand_avg < 0.75 * forehand_avg THEN 'Backhand lacks pace' END, CASE WHEN lost >= 3 AND nets > outs THEN 'Errors into the net' END, CASE WHEN lost >= 3 AND outs > nets THEN 'Errors long or wide' END], lambda x: x IS NOT NULL) AS met FROM totals JOIN c USING (player))
SELECT player, CASE WHEN strokes < 4 THEN 'Not enough strokes detected' WHEN len(met) = 0 THEN 'Solid, balanced session' ELSE array_to_string(met, '; ') END AS tips FROM r""",
    "report_json": f"""WITH {_TOTALS} SELECT player, '{{"player":' || player || ',"totals":{{"strokes":' || strokes || ',"forehand":' || forehand || ',"backhand":' || backhand || '}}}}' AS report FROM totals""",
    "shot_labels": f"WITH {_SHOTS} SELECT rally, hand || '  ' || technique || CASE WHEN lean = 'neutral' THEN '' ELSE '  ' || lean END AS label FROM shots WHERE n = 1",
}
