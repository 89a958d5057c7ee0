"""Queries over videos of different sizes, rates and tables: every user's events stand for a video of its own kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import scaled
from ..sources.views import TRAJ_SQL, table, trajectory


def videos(spark, d: str) -> DataFrame:
    """video, width, fps, table: three rates, two widths, a table of its own for three videos of four."""
    v = table(spark, d, "events", "user_id").distinct().select(F.col("user_id").alias("video"))
    k = F.col("video")
    has = k % 4 != 1
    at = lambda n: F.when(has, n.cast("double"))
    corners = [(at(18 + k % 5), at(24 + k % 3)), (at(80 - k % 4), at(28 - k % 3)), (at(95 + k % 3), at(75 + k % 6)), (at(5 - k % 3), at(70 + k % 4))]
    fps = F.when(k % 3 == 0, 30.0).when(k % 3 == 1, 60.0).otherwise(120.0)
    return v.select("video", F.when(k % 2 == 0, 100).otherwise(120).alias("width"), fps.alias("fps"), geometry.table_of(corners).alias("table"))


def _limits(spark, d: str) -> DataFrame:
    return scaled.limits(videos(spark, d))


def _hits(spark, d: str, v: DataFrame) -> DataFrame:
    return scaled.hits(scaled.hit_candidates(trajectory(spark, d), v).withColumn("score", F.round("score", 6)))


def _bounces(spark, d: str, v: DataFrame, found: DataFrame) -> DataFrame:
    return scaled.bounces(scaled.bounce_candidates(trajectory(spark, d), v).withColumn("score", F.round("score", 6)), found)


def scaled_hits(spark, d: str) -> DataFrame:
    return _hits(spark, d, _limits(spark, d))


def scaled_bounces(spark, d: str) -> DataFrame:
    v = _limits(spark, d)
    return _bounces(spark, d, v, _hits(spark, d, v)).select("video", "frame", "half")


def scaled_crossings(spark, d: str) -> DataFrame:
    return scaled.crossings(trajectory(spark, d), _limits(spark, d))


def scaled_rallies(spark, d: str) -> DataFrame:
    v = _limits(spark, d)
    found = _hits(spark, d, v)
    return scaled.rallies(found, _bounces(spark, d, v, found), v)


def scaled_contexts(spark, d: str) -> DataFrame:
    v = _limits(spark, d)
    return scaled.contexts(_hits(spark, d, v), v).select("video", "frame", "side", "first_of_rally", F.round("since_prev_s", 6).alias("since_prev_s"))


def video_tables(spark, d: str) -> DataFrame:
    """The scalars of each video's table."""
    t = videos(spark, d).where("table is not null")
    return t.select("video", *[F.round(f"table.{c}", 6).alias(c) for c in ("net_x", "length_px", "m_per_px", "x0", "x1", "y0", "y1", "slope", "level")])


def video_homography(spark, d: str) -> DataFrame:
    """Where each sample lies on its own video's table, in metres; null for videos without one."""
    j = trajectory(spark, d).where("x is not null").join(videos(spark, d).select("video", "table"), "video")
    u, w = geometry.to_table(F.col("x"), F.col("y"), F.col("table.h"))
    return j.select("video", "frame", F.round(u, 6).alias("u"), F.round(w, 6).alias("v"), geometry.half(u).alias("half"))


def video_placements(spark, d: str) -> DataFrame:
    """For each video with a table, how many bounces landed in each third of its length, by half."""
    v = _limits(spark, d)
    b = _bounces(spark, d, v, _hits(spark, d, v)).join(v.where("table is not null").select("video", "table"), "video")
    u, _ = geometry.to_table(F.col("x"), F.col("y"), F.col("table.h"))
    third = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(u / geometry.LENGTH_M * 3))).cast("long")
    return b.groupBy("video", "half", third.alias("third")).agg(F.count("*").alias("n"))


_C = {f"{c}{i}": v for i, (x, y) in enumerate([("18 + video % 5", "24 + video % 3"), ("80 - video % 4", "28 - video % 3"), ("95 + video % 3", "75 + video % 6"), ("5 - video % 3", "70 + video % 4")]) for c, v in (("x", x), ("y", y))}
_VIDEOS = TRAJ_SQL + f""",
corners AS (SELECT *, {', '.join(f"CASE WHEN video % 4 <> 1 THEN ({v})::DOUBLE END AS {k}" for k, v in _C.items())},
  CASE WHEN video % 2 = 0 THEN 100 ELSE 120 END AS width, CASE video % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 60 ELSE 120 END AS fps FROM (SELECT DISTINCT video FROM frames) d),
square AS (SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS g,
  ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS h FROM corners),
maps AS (SELECT *, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e FROM square),
tables AS (SELECT *, ((a + b) / 2 + x0) / ((g + h) / 2 + 1) AS table_net, (sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) + sqrt(pow(x2 - x3, 2) + pow(y2 - y3, 2))) / 2 AS length_px,
  least(x0, x1, x2, x3) AS tx0, greatest(x0, x1, x2, x3) AS tx1, least(y0, y1, y2, y3) AS ty0, greatest(y0, y1, y2, y3) AS ty1 FROM maps),
lim AS (SELECT *, coalesce(table_net, width / 2) AS net_x, coalesce(0.15 * length_px, 0.05 * width) AS min_dx, coalesce(ty1 + 0.25 * length_px, 1e300) AS max_y, greatest(2, round_even(5 * fps / 120, 0))::BIGINT AS hit_w,
  3.5 * (width / 1920) / (fps / 120) AS hit_v, greatest(4, round_even(18 * fps / 120, 0)) AS hit_radius, floor(0.3::DOUBLE * fps) AS serve, greatest(2, round_even(4 * fps / 120, 0))::BIGINT AS bounce_w, (width / 1920) / (fps / 120) AS bounce_v,
  greatest(3, round_even(10 * fps / 120, 0)) AS bounce_radius, greatest(3, round_even(6 * fps / 120, 0)) AS guard, floor(0.08::DOUBLE * fps) AS refractory, 2.5 * fps AS rally_gap, floor(1.5 * fps)::BIGINT AS horizon FROM tables)"""


def _on_table(x: str, y: str) -> tuple[str, str]:
    """u and v of a point, with a video's columns a to h (c and f are x0 and y0)."""
    w = f"((d * h - e * g) * {x} + (b * g - a * h) * {y} + (a * e - b * d))"
    return f"(2.74::DOUBLE * ((e - y0 * h) * {x} + (x0 * h - b) * {y} + (b * y0 - x0 * e)) / {w})", f"(1.525::DOUBLE * ((y0 * g - d) * {x} + (a - x0 * g) * {y} + (x0 * d - a * y0)) / {w})"


_U, _V = _on_table("x", "y")


def _nms(source: str, radius: str, out: str) -> str:
    return f""",
{out} AS (SELECT video, unnest(list_reduce(list_transform(list_sort(list((-score, frame))), lambda t: [t[2]]), lambda acc, x: CASE WHEN coalesce(list_bool_and(list_transform(acc, lambda k: abs(k - x[1]) > radius)), true) THEN list_concat(acc, x) ELSE acc END, []::BIGINT[])) AS frame
  FROM (SELECT *, {radius} AS radius FROM {source} JOIN lim USING (video)) q GROUP BY video, radius)"""


_SMOOTH = """,
s AS (SELECT *, CASE WHEN x IS NOT NULL THEN avg(x) OVER w END AS sx, CASE WHEN x IS NOT NULL THEN avg(y) OVER w END AS sy, count(*) OVER (PARTITION BY video) AS n FROM traj
      WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
g2 AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN frame = 0 THEN lead(sx) OVER w - sx WHEN frame = n - 1 THEN sx - lag(sx) OVER w ELSE (lead(sx) OVER w - lag(sx) OVER w) / 2 END AS vx,
  CASE WHEN n = 1 THEN 0 WHEN frame = 0 THEN lead(sy) OVER w - sy WHEN frame = n - 1 THEN sy - lag(sy) OVER w ELSE (lead(sy) OVER w - lag(sy) OVER w) / 2 END AS vy FROM s WINDOW w AS (PARTITION BY video ORDER BY frame))"""


def _means(c: str, w: str, out: str) -> str:
    half = lambda sign: f"CASE WHEN count(b.v{c}) FILTER (WHERE b.frame {sign} t.frame) >= greatest(1, {w} // 2) THEN avg(b.v{c}) FILTER (WHERE b.frame {sign} t.frame) END"
    return f""",
{out} AS (SELECT t.video, t.frame, {half('<')} AS before, {half('>')} AS after FROM g2 t JOIN lim USING (video) JOIN g2 b ON b.video = t.video AND b.frame BETWEEN t.frame - {w} AND t.frame + {w} WHERE t.frame >= {w} AND t.frame < t.n - {w} GROUP BY t.video, t.frame, {w})"""


_HITS = _VIDEOS + _SMOOTH + _means("x", "hit_w", "mx") + """,
ok AS (SELECT *, sign * before > hit_v AND before IS NOT NULL AS rally FROM mx JOIN s USING (video, frame) JOIN lim l USING (video), (VALUES ('right', 1.0), ('left', -1.0)) AS q(side, sign)
  WHERE sx IS NOT NULL AND after IS NOT NULL AND sign * (sx - net_x) >= min_dx AND sign * after < -hit_v AND sy <= max_y),
top AS (SELECT o.video, o.frame, o.side, arg_min(t.frame, (-o.sign * t.sx, t.frame)) AS top FROM ok o JOIN s t ON t.video = o.video AND t.frame BETWEEN o.frame - hit_w AND o.frame + hit_w WHERE t.sx IS NOT NULL GROUP BY ALL),
waits AS (SELECT o.video, o.frame, o.side, bool_and(t.x IS NULL OR o.sign * (t.x - net_x) > 0) AS waits FROM ok o JOIN traj t ON t.video = o.video AND t.frame BETWEEN o.frame - serve AND o.frame - hit_w - 1 GROUP BY ALL),
cand AS (SELECT video, CASE WHEN rally THEN top ELSE frame END AS frame, side, NOT rally AS serve, round(CASE WHEN rally THEN abs(before - after) ELSE abs(after) * 0.5 END, 6) AS score
  FROM ok o JOIN top USING (video, frame, side) LEFT JOIN waits USING (video, frame, side) WHERE rally OR ((before IS NULL OR abs(before) < hit_v / 2) AND waits))""" + _nms("cand", "hit_radius", "kept") + """,
hits AS (SELECT video, frame, side, serve, score FROM (SELECT c.*, row_number() OVER (PARTITION BY video, frame ORDER BY score DESC, side DESC, serve) AS rn FROM cand c JOIN kept USING (video, frame)) t WHERE rn = 1)"""
_BOUNCES = _HITS + _means("y", "bounce_w", "my") + f""",
low AS (SELECT m.video, m.frame, any_value(p.x) AS px, any_value(p.y) AS py, any_value(p.sx) AS sx, any_value(p.sy) AS sy, any_value(round(m.before - m.after, 6)) AS score, arg_min(t.frame, (-t.sy, t.frame)) AS top
  FROM my m JOIN lim USING (video) JOIN s p ON p.video = m.video AND p.frame = m.frame JOIN s t ON t.video = m.video AND t.frame BETWEEN m.frame - bounce_w AND m.frame + bounce_w
  WHERE p.sy IS NOT NULL AND t.sy IS NOT NULL AND m.before >= bounce_v AND m.after <= -bounce_v
    AND (table_net IS NULL OR (p.sx BETWEEN tx0 - 0.03 * (tx1 - tx0) AND tx1 + 0.03 * (tx1 - tx0) AND p.sy BETWEEN ty0 - 0.06 * length_px AND ty1 + 0.02 * length_px)) GROUP BY m.video, m.frame),
bcand AS (SELECT b.*, coalesce(px, sx) AS x, coalesce(py, sy) AS y FROM low b JOIN lim l ON l.video = b.video WHERE top = frame AND NOT EXISTS (SELECT 1 FROM hits c WHERE c.video = b.video AND abs(c.frame - b.frame) <= l.guard))""" + _nms("(SELECT video, frame, score FROM bcand)", "bounce_radius", "bkept") + f""",
bounces AS (SELECT video, frame, x, y, CASE WHEN table_net IS NOT NULL THEN CASE WHEN {_U} < 1.37 THEN 'left' ELSE 'right' END WHEN x > net_x THEN 'right' ELSE 'left' END AS half
  FROM (SELECT video, frame, x, y FROM bcand) b JOIN bkept USING (video, frame) JOIN lim USING (video))"""
_RALLIES = _BOUNCES + """,
sess AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN serve OR frame - p > rally_gap THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS rally
  FROM (SELECT h.*, rally_gap, horizon, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS p FROM hits h JOIN (SELECT video, rally_gap, horizon FROM lim) l USING (video)) t),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY video, rally ORDER BY frame) AS run FROM (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY video, rally ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM sess) t),
alt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, rally, run ORDER BY score DESC, frame) AS rn FROM runs) t WHERE rn = 1),
r0 AS (SELECT video, rally, any_value(horizon) AS horizon, min(frame) AS start, max(frame) AS last, arg_max(side, frame) AS last_hitter, count(*) AS n_strokes FROM alt GROUP BY video, rally),
r1 AS (SELECT *, least(last + horizon, coalesce(lead(start) OVER (PARTITION BY video ORDER BY rally), last + horizon)) AS until FROM r0),
r2 AS (SELECT r1.*, (SELECT count(*) FROM bounces b WHERE b.video = r1.video AND b.frame BETWEEN start AND until) AS n_bounces,
       (SELECT arg_min(half, b.frame) FROM bounces b WHERE b.video = r1.video AND b.frame > last AND b.frame <= until) AS half,
       (SELECT max(b.frame) FROM bounces b WHERE b.video = r1.video AND b.frame > last AND b.frame <= until) AS last_bounce FROM r1),
r3 AS (SELECT *, CASE WHEN half IS NULL THEN 'out' WHEN half <> last_hitter THEN 'winner' ELSE 'net' END AS outcome FROM r2 WHERE n_strokes > 1 OR n_bounces > 0)"""

QUERIES = {f.__name__: f for f in (scaled_hits, scaled_bounces, scaled_crossings, scaled_rallies, scaled_contexts, video_tables, video_homography, video_placements)}
SQL = {
    "scaled_hits": f"WITH {_HITS} SELECT video, frame, side, serve, score FROM hits",
    "scaled_bounces": f"WITH {_BOUNCES} SELECT video, frame, half FROM bounces",
    "scaled_crossings": f"""WITH {_VIDEOS},
ch AS (SELECT video, frame, refractory AS r FROM (SELECT *, lag(x) OVER (PARTITION BY video ORDER BY frame) AS p FROM traj) t JOIN lim USING (video) WHERE (p - net_x) * (x - net_x) < 0),
f AS (SELECT video, list_reduce(list_transform(list_sort(list(frame)), lambda t: [t]), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] > r THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS kept FROM ch GROUP BY video, r)
SELECT video, unnest(kept) AS frame FROM f""",
    "scaled_rallies": f"""WITH {_RALLIES} SELECT video, rally::BIGINT AS rally, start, greatest(last, coalesce(last_bounce, last)) AS "end", n_strokes, n_bounces, last_hitter, outcome,
  CASE WHEN outcome = 'winner' THEN last_hitter WHEN last_hitter = 'right' THEN 'left' ELSE 'right' END AS point_winner FROM r3""",
    "scaled_contexts": f"""WITH {_HITS}, c AS (SELECT *, serve OR p IS NULL OR frame - p > 2.5 * fps AS first_of_rally FROM (SELECT h.*, fps, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS p FROM hits h JOIN (SELECT video, fps FROM lim) l USING (video)) t)
SELECT video, frame, side, first_of_rally, CASE WHEN NOT first_of_rally THEN round((frame - p) / fps, 6) END AS since_prev_s FROM c""",
    "video_tables": f"""WITH {_VIDEOS} SELECT video, round(table_net, 6) AS net_x, round(length_px, 6) AS length_px, round(2.74::DOUBLE / length_px, 6) AS m_per_px, tx0 AS x0, tx1 AS x1, ty0 AS y0, ty1 AS y1,
  round((y2 - y3) / greatest(x2 - x3, 1e-6), 6) AS slope, round(y3 - (y2 - y3) / greatest(x2 - x3, 1e-6) * x3, 6) AS level FROM tables WHERE table_net IS NOT NULL""",
    "video_homography": f"WITH {_VIDEOS} SELECT t.video, frame, round({_U}, 6) AS u, round({_V}, 6) AS v, CASE WHEN {_U} < 1.37 THEN 'left' WHEN {_U} IS NOT NULL THEN 'right' END AS half FROM traj t JOIN maps USING (video) WHERE x IS NOT NULL",
    "video_placements": f"""WITH {_BOUNCES} SELECT video, half, least(2, greatest(0, floor({_U} / 2.74::DOUBLE * 3)))::BIGINT AS third, count(*) AS n FROM bounces JOIN tables USING (video) WHERE table_net IS NOT NULL GROUP BY ALL""",
}
