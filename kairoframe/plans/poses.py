"""Queries of the pose, tracking, model and streaming slices. Embeddings stand for poses, a label for a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..operators import models, pose, tracker
from ..sources.views import FRAMES_SQL, frames, table
from ..streaming import ordered, sessions


def poses(spark, d: str) -> DataFrame:
    """video, frame (from 0 per video), pose: the first 34 numbers of a vector are 17 points; some points are missing."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    at = Window.partitionBy("label").orderBy("vec_id")
    v = F.transform("embedding", lambda x: x.cast("double") * 100)
    pts = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.when((F.col("vec_id") % 23 != 0) | (i % 5 != 0), F.struct(F.get(v, i * 2).alias("x"), F.get(v, i * 2 + 1).alias("y"))))
    return e.select(F.col("label").cast("long").alias("video"), (F.row_number().over(at) - 1).cast("long").alias("frame"), "vec_id", pts.alias("pose"))


def joint_angles(spark, d: str) -> DataFrame:
    p = F.col("pose")
    a = lambda *i: F.round(pose.joint(p, *i), 4)
    return poses(spark, d).select("vec_id", a(6, 8, 10).alias("right_elbow"), a(5, 7, 9).alias("left_elbow"), a(12, 14, 16).alias("right_knee"), a(11, 13, 15).alias("left_knee"), F.round(pose.torso(p), 4).alias("torso"))


def torso_fallback(spark, d: str) -> DataFrame:
    return pose.torso_or_median(poses(spark, d)).select("vec_id", F.round("torso", 4).alias("torso"))


def _contacts(spark, d: str) -> DataFrame:
    return poses(spark, d).where("frame % 9 = 4").select("video", "frame")


def handedness(spark, d: str) -> DataFrame:
    t = pose.handedness(pose.wrist_travel(poses(spark, d), _contacts(spark, d), 4, 3))
    return t.select("video", F.round("right", 4).alias("right"), F.round("left", 4).alias("left"), "hand")


def _boxes(spark, d: str) -> DataFrame:
    return frames(spark, d).select("video", F.floor(F.col("frame") / 5).alias("frame"), F.col("frame").alias("id"), F.col("k").alias("x1"), F.col("value").alias("y1"), (F.col("k") + 20).alias("x2"), (F.col("value") + 10 + F.col("k") / 4).alias("y2"))


def select_players(spark, d: str) -> DataFrame:
    p = pose.choose_players(_boxes(spark, d), 60.0, 8.0)
    return p.select("video", "frame", "side", "id", F.round("height", 6).alias("height"))


def followed_players(spark, d: str) -> DataFrame:
    """The players frame by frame, each near to where it was chosen last."""
    p = pose.follow_players(_boxes(spark, d), 60.0, 8.0, 8)
    return p.select("video", "frame", "side", "id", F.round("x", 6).alias("x"), F.round("height", 6).alias("height"))


def filled_poses(spark, d: str) -> DataFrame:
    """Each point of each pose after filling gaps of whole poses."""
    whole = F.transform("pose", lambda p, i: F.when(p.isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y"), ((F.col("vec_id") + i) % 10 / 10).alias("conf"))))
    f = pose.fill_poses(poses(spark, d).select("video", "frame", whole.alias("pose")), 8)
    return f.select("video", "frame", F.posexplode("pose").alias("i", "p")).select("video", "frame", "i", *[F.round(f"p.{c}", 6).alias(c) for c in ("x", "y", "conf")])


def iou_best(spark, d: str) -> DataFrame:
    """Each box with the other box of its frame that it overlaps most, over a tenth."""
    b = _boxes(spark, d)
    a, c = b.alias("a"), b.alias("c")
    box = lambda t: [F.col(f"{t}.{k}") for k in ("x1", "y1", "x2", "y2")]
    j = a.join(c, ["video", "frame"]).where("a.id <> c.id").select("video", "frame", F.col("a.id").alias("id"), F.col("c.id").alias("other"), F.round(geometry.iou(box("a"), box("c")), 6).alias("iou")).where("iou > 0.1")
    return j.groupBy("video", "frame", "id").agg(F.max(F.struct("iou", (-F.col("other")).alias("o"))).alias("b")).select("video", "frame", "id", F.col("b.iou").alias("iou"), (-F.col("b.o")).alias("other"))


def same_row(spark, d: str) -> DataFrame:
    """Boxes on the same row as the largest one of their frame, and over 30 percent of its area."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("video", "frame")
    b = _boxes(spark, d).withColumn("area", area).withColumn("best", F.max(F.struct("area", (-F.col("id")).alias("i"), "y1", "y2")).over(w))
    return b.where(geometry.same_row(F.col("y1"), F.col("y2"), F.col("best.y1"), F.col("best.y2")) & (F.col("area") > 0.3 * F.col("best.area"))).select("video", "frame", "id")


def ball(spark, d: str) -> DataFrame:
    """video, frame, x, y: two more numbers of each vector; some are missing."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    at = Window.partitionBy("label").orderBy("vec_id")
    v = lambda i: F.when(F.col("vec_id") % 11 != 0, F.get("embedding", i).cast("double") * 100)
    return e.select(F.col("label").cast("long").alias("video"), (F.row_number().over(at) - 1).cast("long").alias("frame"), v(34).alias("x"), v(35).alias("y"))


def strokes(spark, d: str) -> DataFrame:
    """Contacts of either side with what their features need; a third of the videos has no table."""
    c = _contacts(spark, d).withColumns({"side": F.when(F.col("frame") % 2 == 0, "left").otherwise("right"), "racket": F.when(F.col("video") % 3 == 0, "L").otherwise("R")})
    return c.withColumns({"first_of_rally": F.col("frame") % 4 == 0, "since_prev_s": F.when(F.col("frame") % 4 != 0, F.col("frame") / 120), "slope": F.when(F.col("video") % 3 != 1, F.lit(0.1)), "level": F.when(F.col("video") % 3 != 1, F.lit(5.0))})


def stroke_features(spark, d: str) -> DataFrame:
    """Each of the 263 features of each contact, by place."""
    f = pose.stroke_features(strokes(spark, d), poses(spark, d).drop("vec_id"), ball(spark, d))
    return f.select("video", "frame", F.posexplode("features").alias("i", "v")).select("video", "frame", "i", F.round("v", 5).alias("value"))


def _candidates(spark, d: str) -> DataFrame:
    """Several candidates per frame: frames of the trajectory view, three to a frame."""
    f = frames(spark, d).where("kind <> 'error'")
    return f.select("video", F.floor(F.col("frame") / 3).alias("frame"), (F.col("frame") % 3).alias("rank"), F.col("k").alias("x"), F.col("value").alias("y"), (F.lit(0.5) + F.col("frame") % 5 / 10).alias("conf"))


def track_link(spark, d: str) -> DataFrame:
    return tracker.link(_candidates(spark, d), 25.0, 2)


def tracklet_paint(spark, d: str) -> DataFrame:
    t = track_link(spark, d)
    p = tracker.paint(t, tracker.scored(t, 1.0, 3), 0.5)
    return p.select("video", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("score", 6).alias("score"))


def tracklet_scores(spark, d: str) -> DataFrame:
    """Scores of fixed tracks: runs of five samples of a user."""
    f = frames(spark, d).where("kind <> 'error'")
    t = f.select("video", F.lit(0).cast("long").alias("island"), F.floor(F.col("frame") / 5).alias("track"), "frame", F.col("k").alias("x"), F.col("value").alias("y"), (F.lit(0.5) + F.col("frame") % 5 / 10).alias("conf"))
    return tracker.scored(t, 2.0, 3).select("video", "track", "n", F.round("score", 6).alias("score"))


def stroke_rf(spark, d: str) -> DataFrame:
    """Held-out predictions of a forest on the pose numbers; a third of the vectors is held out."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    model = models.fit(e.where("vec_id % 3 <> 0"), "label")
    return models.predict(model, e.where("vec_id % 3 = 0"), "label").select("vec_id", "label", "label_pred", "label_conf")


def heuristic_strokes(spark, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.where("kind = 'click'").select("video", "frame", models.heuristic(F.col("frame") < 5)["technique"].alias("technique"))


def stream_sessions(spark, d: str) -> DataFrame:
    s = sessions.run_once(sessions.sessions(sessions.read_events(spark, d), "12 hours", "1 hour"), "sessions")
    return s.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def stream_rallies(spark, d: str) -> DataFrame:
    """Rallies with serves over the stream of events: a signup stands for a serve, an error is no hit."""
    e = sessions.read_events(spark, d).where("event_type <> 'error'")
    hits = e.select(F.col("user_id").alias("video"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "signup").alias("serve"))
    return sessions.run_once(ordered.rallies(hits, 43200.0, "1 hour"), "rallies")


def stream_crossings(spark, d: str) -> DataFrame:
    """Debounced net crossings over the stream of events; an error is a sample that is missing."""
    e = sessions.read_events(spark, d)
    x = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double"))
    samples = e.select(F.col("user_id").alias("video"), "ts", F.col("event_id").alias("id"), x.alias("x"))
    return sessions.run_once(ordered.crossings(samples, 50.0, 36000.0, "1 hour"), "crossings").select("video", "at", "id")


_POSE = """p0 AS (SELECT label::BIGINT AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS v FROM embeddings),
pose AS (SELECT video, frame, vec_id, list_transform(range(0, 17), lambda i: CASE WHEN vec_id % 23 <> 0 OR i % 5 <> 0 THEN v[2 * i + 1] END) AS x, list_transform(range(0, 17), lambda i: CASE WHEN vec_id % 23 <> 0 OR i % 5 <> 0 THEN v[2 * i + 2] END) AS y FROM p0)"""


def _angle_sql(a: int, b: int, c: int) -> str:
    ux, uy, wx, wy = (f"({k}[{i + 1}] - {k}[{b + 1}])" for i in (a, c) for k in ("x", "y"))
    n = f"(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({wx} * {wx} + {wy} * {wy}))"
    return f"round(CASE WHEN {n} > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({ux} * {wx} + {uy} * {wy}) / {n})))) END, 4)"


_TORSO = "sqrt(pow((x[6] + x[7]) / 2 - (x[12] + x[13]) / 2, 2) + pow((y[6] + y[7]) / 2 - (y[12] + y[13]) / 2, 2))"
_BOXES = FRAMES_SQL + ", b AS (SELECT video, frame // 5 AS frame, frame AS id, k AS x1, value AS y1, k + 20 AS x2, value + 10 + k / 4 AS y2 FROM frames)"

_CONTACTS = """c AS (SELECT *, CASE WHEN frame % 2 = 0 THEN -1.0::DOUBLE ELSE 1 END AS mirror, CASE WHEN video % 3 = 0 THEN 'L' ELSE 'R' END AS racket, CASE WHEN video % 3 <> 1 THEN 0.1::DOUBLE END AS slope, CASE WHEN video % 3 <> 1 THEN 5.0::DOUBLE END AS level,
 frame % 4 = 0 AS begins, CASE WHEN frame % 4 <> 0 THEN frame / 120 END AS since_s FROM p WHERE frame % 9 = 4)"""


def _stroke_sql(contacts: str = _CONTACTS) -> str:
    """The features as rows ``vals`` (video, frame, i, value) of the contacts ``c``: keypoints by place, then all others of a contact as one list."""
    k = lambda o, i, c: f"max(n{c}) FILTER (WHERE o = {o} AND i = {i})"
    names = {f"w{n}{c}": k(o, 10, c) for n, o in enumerate(pose.OFFSETS) for c in "xy"}
    names |= {f"k{i}{c}": k(0, i, c) for i in pose.USED for c in "xy"} | {"la0": k(-16, 15, "y"), "la1": k(8, 15, "y"), "ra0": k(-16, 16, "y"), "ra1": k(8, 16, "y"), "h0": k(-16, 0, "x"), "h1": k(8, 0, "x"), "n0": "count(*) FILTER (WHERE o = 0 AND nx IS NOT NULL AND ny IS NOT NULL)"}
    wide = ", ".join(f"{v} AS {n}" for n, v in names.items())
    speeds = [f"sqrt(pow(w{n + 1}x - w{n}x, 2) + pow(w{n + 1}y - w{n}y, 2)) / {pose.OFFSETS[n + 1] - pose.OFFSETS[n]}" for n in range(8)]

    def angle(a: int, b: int, c: int) -> str:
        tx, ty, wx, wy = (f"(k{i}{z} - k{b}{z})" for i in (a, c) for z in "xy")
        n = f"(sqrt({tx} * {tx} + {ty} * {ty}) * sqrt({wx} * {wx} + {wy} * {wy}))"
        return f"CASE WHEN {n} > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({tx} * {wx} + {ty} * {wy}) / {n})))) END"

    body = [speeds[4], f"greatest({', '.join(speeds)})", "k10y - k6y", "k10x", "w2x", angle(6, 8, 10), angle(11, 13, 15), angle(12, 14, 16), "CASE WHEN n0 = 17 THEN degrees(atan2(k5y + k6y - k11y - k12y, k5x + k6x - k11x - k12x)) END", "k15x - k16x", "k15y - k16y", "la1 - la0", "ra1 - ra0", "h1 - h0", "(k11y + k12y - k15y - k16y) / 2"]
    flight = ["ix", "iy", "ox", "oy", "sqrt(ox * ox + oy * oy)", "degrees(atan2(-oy, -ox))", "CASE WHEN ix IS NOT NULL THEN sqrt(ox * ox + oy * oy) / greatest(sqrt(ix * ix + iy * iy), 1e-3) END", "(ux - hx) / size * mirror", "(uy - hy) / size", "(uy - level - slope * ux) / size"]
    context = ["CASE WHEN begins THEN 1 ELSE 0 END", "since_s", "CASE WHEN (mirror < 0) = (racket = 'R') THEN 1 ELSE 0 END", "CASE WHEN mirror < 0 THEN 1 ELSE 0 END"]
    speed = lambda lo, hi, c: f"CASE WHEN count(*) FILTER (WHERE o >= {lo} AND o < {hi} AND ux IS NOT NULL) >= 2 THEN (arg_max(u{c}, o) FILTER (WHERE o >= {lo} AND o < {hi} AND ux IS NOT NULL) - arg_min(u{c}, o) FILTER (WHERE o >= {lo} AND o < {hi} AND ux IS NOT NULL)) / (count(*) FILTER (WHERE o >= {lo} AND o < {hi} AND ux IS NOT NULL) - 1) END"
    own = "sqrt(pow((x[6] + x[7]) / 2 - (x[12] + x[13]) / 2, 2) + pow((y[6] + y[7]) / 2 - (y[12] + y[13]) / 2, 2))"
    return f"""WITH {_POSE}, p AS (SELECT pose.video, pose.frame, x, y, {own} AS t, (x[12] + x[13]) / 2 AS mx, (y[12] + y[13]) / 2 AS my, CASE WHEN pose.vec_id % 11 <> 0 THEN v[35] END AS ux, CASE WHEN pose.vec_id % 11 <> 0 THEN v[36] END AS uy FROM pose JOIN p0 USING (video, frame)),
{contacts},
w AS (SELECT c.video, c.frame, median(p.t) AS t, median(p.mx) AS mx, median(p.my) AS my FROM c JOIN p ON p.video = c.video AND p.frame BETWEEN c.frame - 20 AND c.frame + 19 GROUP BY ALL),
b AS (SELECT c.*, CASE WHEN c.t >= 1 THEN c.t ELSE w.t END AS size, CASE WHEN c.t >= 1 THEN c.mx ELSE coalesce(w.mx, c.mx) END AS hx, CASE WHEN c.t >= 1 THEN c.my ELSE coalesce(w.my, c.my) END AS hy FROM c JOIN w USING (video, frame)),
f AS (SELECT b.video, b.frame, {', '.join(f"{speed(*r, z)} AS {n}{z}" for n, r in (('i', (-8, -1)), ('o', (1, 9))) for z in 'xy')} FROM (SELECT b.video, b.frame, p.frame - b.frame AS o, p.ux, p.uy FROM b JOIN p ON p.video = b.video AND p.frame BETWEEN b.frame - 8 AND b.frame + 8) b GROUP BY ALL),
o AS (SELECT b.video, b.frame, o, i, (p.x[m + 1] - hx) / size * mirror AS nx, (p.y[m + 1] - hy) / size AS ny
 FROM (SELECT *, CASE WHEN racket = 'R' OR i = 0 THEN i WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END AS m FROM b, (SELECT unnest([{', '.join(map(str, pose.OFFSETS))}]) AS o), (SELECT unnest(range(17)) AS i)) b LEFT JOIN p ON p.video = b.video AND p.frame = b.frame + o),
wide AS (SELECT video, frame, {wide} FROM o GROUP BY video, frame),
r AS (SELECT video, frame, (list_position([{', '.join(map(str, pose.OFFSETS))}], o) - 1) * 26 + CASE i WHEN 0 THEN 0 ELSE 2 * (i - 4) END AS i, nx, ny FROM o WHERE i = 0 OR i >= 5),
e AS (SELECT b.video, b.frame, [{', '.join(f"({v})::DOUBLE" for v in (*body, *[x.replace('ix', 'f.ix * mirror / size').replace('iy', 'f.iy / size').replace('ox', 'f.ox * mirror / size').replace('oy', 'f.oy / size') if n < 7 else x for n, x in enumerate(flight)], *context))}] AS vs FROM b JOIN wide USING (video, frame) JOIN f USING (video, frame)),
vals AS (SELECT video, frame, i::INTEGER AS i, round(nx, 5) AS value FROM r UNION ALL SELECT video, frame, (i + 1)::INTEGER, round(ny, 5) FROM r
UNION ALL SELECT video, frame, (233 + n)::INTEGER, round(vs[n], 5) FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS n FROM e) u)"""


QUERIES = {f.__name__: f for f in (joint_angles, torso_fallback, handedness, select_players, followed_players, filled_poses, iou_best, same_row, stroke_features, track_link, tracklet_paint, tracklet_scores, stroke_rf, heuristic_strokes, stream_sessions, stream_rallies, stream_crossings)}
SQL = {
    "joint_angles": f"WITH {_POSE} SELECT vec_id, {_angle_sql(6, 8, 10)} AS right_elbow, {_angle_sql(5, 7, 9)} AS left_elbow, {_angle_sql(12, 14, 16)} AS right_knee, {_angle_sql(11, 13, 15)} AS left_knee, round({_TORSO}, 4) AS torso FROM pose",
    "torso_fallback": f"""WITH {_POSE}, t AS (SELECT *, {_TORSO} AS t FROM pose)
SELECT vec_id, round(CASE WHEN t >= 1 THEN t ELSE quantile_cont(t, 0.5) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) END, 4) AS torso FROM t""",
    "handedness": f"""WITH {_POSE}, c AS (SELECT video, frame AS hit FROM pose WHERE frame % 9 = 4), j AS (SELECT c.video, hit, p.frame, x[11] AS rx, y[11] AS ry, x[10] AS lx, y[10] AS ly FROM c JOIN pose p ON p.video = c.video AND p.frame BETWEEN hit - 4 AND hit + 2),
s AS (SELECT video, sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) AS r, sqrt(pow(lx - lag(lx) OVER w, 2) + pow(ly - lag(ly) OVER w, 2)) AS l FROM j WINDOW w AS (PARTITION BY video, hit ORDER BY frame)),
t AS (SELECT video, coalesce(sum(r), 0) AS r, coalesce(sum(l), 0) AS l FROM s GROUP BY video) SELECT video, round(r, 4) AS "right", round(l, 4) AS "left", CASE WHEN l > r THEN 'L' ELSE 'R' END AS hand FROM t""",
    "select_players": f"""WITH {_BOXES}, s AS (SELECT *, CASE WHEN (x1 + x2) / 2 >= 68 THEN 'right' WHEN (x1 + x2) / 2 <= 52 THEN 'left' END AS side, y2 - y1 AS height FROM b)
SELECT video, frame, side, id, round(height, 6) AS height FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, side ORDER BY height DESC, id) AS rn FROM s WHERE side IS NOT NULL) t WHERE rn = 1""",
    "followed_players": f"""WITH RECURSIVE {_BOXES}, s AS (SELECT *, (x1 + x2) / 2 AS x, y2 - y1 AS height, CASE WHEN (x1 + x2) / 2 >= 68 THEN 'right' WHEN (x1 + x2) / 2 <= 52 THEN 'left' END AS side FROM b),
c AS (SELECT video, side, frame, id, x, height, dense_rank() OVER (PARTITION BY video, side ORDER BY frame) AS n FROM s WHERE side IS NOT NULL),
walk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, side ORDER BY height DESC, id) AS rn FROM c WHERE n = 1) t WHERE rn = 1
 UNION ALL SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.video, c.side ORDER BY c.height - 0.5::DOUBLE * abs(c.x - w.x) DESC, c.id) AS rn FROM walk w JOIN c ON c.video = w.video AND c.side = w.side AND c.n = w.n + 1) t WHERE rn = 1)
SELECT video, frame, side, id, round(x, 6) AS x, round(height, 6) AS height FROM walk""",
    "filled_poses": f"""WITH {_POSE}, k AS (SELECT video, frame, vec_id, i, x[i + 1] AS x, y[i + 1] AS y, CASE WHEN x[i + 1] IS NOT NULL THEN (vec_id + i) % 10 / 10 END AS conf, x[1] AS first FROM pose, (SELECT unnest(range(17)) AS i) r),
g AS (SELECT k.*, (SELECT max(frame) FROM k a WHERE a.video = k.video AND a.i = 0 AND a.frame <= k.frame AND a.first IS NOT NULL) AS a, (SELECT min(frame) FROM k b WHERE b.video = k.video AND b.i = 0 AND b.frame >= k.frame AND b.first IS NOT NULL) AS b FROM k),
j AS (SELECT g.video, g.frame, g.i, g.first IS NULL AND coalesce(g.b - g.a BETWEEN 2 AND 8, false) AND p.x IS NOT NULL AND q.x IS NOT NULL AS filled, g.first IS NULL AND coalesce(g.b - g.a BETWEEN 2 AND 8, false) AS gap, (g.frame - g.a) / (g.b - g.a) AS share, g.x, g.y, g.conf, p.x AS px, p.y AS py, p.conf AS pc, q.x AS qx, q.y AS qy, q.conf AS qc
 FROM g LEFT JOIN k p ON p.video = g.video AND p.frame = g.a AND p.i = g.i LEFT JOIN k q ON q.video = g.video AND q.frame = g.b AND q.i = g.i)
SELECT video, frame, i::INTEGER AS i,  {', '.join(f"round(CASE WHEN filled THEN p{c[0]} + share * (q{c[0]} - p{c[0]}) WHEN NOT gap THEN {c} END, 6) AS {c}" for c in ('x', 'y', 'conf'))} FROM j""",
    "iou_best": f"""WITH {_BOXES}, j AS (SELECT a.video, a.frame, a.id, c.id AS other, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS u
 FROM b a JOIN b c ON a.video = c.video AND a.frame = c.frame AND a.id <> c.id), r AS (SELECT video, frame, id, other, round(i / (u - i + 1e-9), 6) AS iou FROM j)
SELECT video, frame, id, iou, other FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, id ORDER BY iou DESC, other) AS rn FROM r WHERE iou > 0.1) t WHERE rn = 1""",
    "same_row": f"""WITH {_BOXES}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM b), m AS (SELECT *, first_value(y1) OVER w AS b1, first_value(y2) OVER w AS b2, first_value(area) OVER w AS ba FROM a WINDOW w AS (PARTITION BY video, frame ORDER BY area DESC, id))
SELECT video, frame, id FROM m WHERE least(y2, b2) - greatest(y1, b1) > 0.5 * least(y2 - y1, b2 - b1) AND area > 0.3 * ba""",
    "tracklet_scores": f"""WITH {FRAMES_SQL}, t AS (SELECT video, frame // 5 AS track, frame, k AS x, value AS y, 0.5::DOUBLE + (frame % 5) / 10 AS conf FROM frames WHERE kind <> 'error'),
v AS (SELECT *, (x - lag(x) OVER w) / (frame - lag(frame) OVER w) AS vx, (y - lag(y) OVER w) / (frame - lag(frame) OVER w) AS vy FROM t WINDOW w AS (PARTITION BY video, track ORDER BY frame)),
j AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, sqrt(pow(vx - lag(vx) OVER w, 2) + pow(vy - lag(vy) OVER w, 2)) AS jerk FROM v WINDOW w AS (PARTITION BY video, track ORDER BY frame)),
g AS (SELECT video, track, count(*) AS n, avg(conf) AS c, median(speed) AS s, coalesce(median(jerk), 0) AS j FROM j GROUP BY ALL)
SELECT video, track, n, round(n * c * greatest(0.0, least(1.5, s / 2.0 / 6.0)) / (1.0 + j / 2.0 / 4.0), 6) AS score FROM g WHERE n >= 3""",
    "stroke_features": f"{_stroke_sql()} SELECT video, frame, i, value FROM vals",
    "heuristic_strokes": f"WITH {FRAMES_SQL} SELECT video, frame, CASE WHEN frame < 5 THEN 'serve' ELSE 'unknown' END AS technique FROM frames WHERE kind = 'click'",
    "stream_rallies": """WITH e AS (SELECT user_id AS video, event_id AS id, epoch_us(ts) AS t, event_type = 'signup' AS serve FROM events WHERE event_type <> 'error'), w AS (SELECT max(t) // 1000 - 3600000 AS now FROM e),
g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND (serve OR t - p > 43200000000) THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY t, id) AS rally FROM (SELECT *, lag(t) OVER (PARTITION BY video ORDER BY t, id) AS p FROM e, w WHERE t // 1000 <= now) q),
r AS (SELECT video, rally, min(t) AS started, max(t) AS ended, count(*) AS n, arg_min(serve, (t, id)) AS with_serve, lead(rally) OVER (PARTITION BY video ORDER BY rally) IS NULL AS open FROM g GROUP BY video, rally)
SELECT video, started, ended, n, with_serve FROM r, w WHERE NOT open OR (ended + 43200000000) // 1000 < now""",
    "stream_crossings": """WITH e AS (SELECT user_id AS video, event_id AS id, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS x FROM events), w AS (SELECT max(t) // 1000 - 3600000 AS now FROM e),
c AS (SELECT video, t, id FROM (SELECT *, lag(x) OVER (PARTITION BY video ORDER BY t, id) AS p FROM e, w WHERE t // 1000 <= now) q WHERE (p - 50) * (x - 50) < 0),
f AS (SELECT video, list_reduce(list_transform(list_sort(list([t, id])), lambda r: [r]), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1][1] - acc[-1][1] > 36000000000 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[][]) AS kept FROM c GROUP BY video),
u AS (SELECT video, unnest(kept) AS k FROM f) SELECT video, k[1] AS "at", k[2] AS id FROM u""",
    "stream_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, sum(CASE WHEN t - p >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e) q),
r AS (SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM g GROUP BY user_id, s) SELECT user_id, started, ended, n FROM r WHERE ended + 43200000000 <= (SELECT max(t) FROM e) // 1000 * 1000 - 3600000000""",
}
