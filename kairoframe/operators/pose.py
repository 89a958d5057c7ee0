"""Pose operators: angles, wrist travel, handedness, player choice, stroke features.

A pose is an array of keypoints struct<x, y> in the usual 17-point order, null where a point is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import angle
from .signal import own, with_margin

# Indices of the 17-point order that are used.
NOSE, L_SHO, R_SHO, L_ELB, R_ELB, L_WRI, R_WRI, L_HIP, R_HIP, L_KNE, R_KNE, L_ANK, R_ANK = 0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16
USED = (NOSE, L_SHO, R_SHO, L_ELB, R_ELB, L_WRI, R_WRI, L_HIP, R_HIP, L_KNE, R_KNE, L_ANK, R_ANK)
MIRRORED = {a: b for p in ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16)) for a, b in (p, p[::-1])}
#: Frames around a contact, at 120 a second, at which a pose is sampled.
OFFSETS = (-16, -12, -8, -4, -2, 0, 2, 4, 8)


def point(pose: Column, i: int) -> Column:
    return F.get(pose, i)


def joint(pose: Column, a: int, b: int, c: int) -> Column:
    """Angle at keypoint b, in degrees."""
    p = [point(pose, i) for i in (a, b, c)]
    return angle(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"], p[2]["x"], p[2]["y"])


def torso(pose: Column) -> Column:
    """Length from the middle of the hips to the middle of the shoulders."""
    mid = lambda i, j, c: (point(pose, i)[c] + point(pose, j)[c]) / 2
    return F.hypot(mid(L_SHO, R_SHO, "x") - mid(L_HIP, R_HIP, "x"), mid(L_SHO, R_SHO, "y") - mid(L_HIP, R_HIP, "y"))


def torso_or_median(poses: DataFrame, key: str = "video", reach: int = 20) -> DataFrame:
    """poses with torso: its own if it is at least 1, else the median over the frames around it."""
    w = Window.partitionBy(key, "_bucket").orderBy("frame").rowsBetween(-reach, reach - 1)
    t = with_margin(poses, reach).withColumn("_t", torso(F.col("pose")))
    return own(t.withColumn("torso", F.when(F.col("_t") >= 1, F.col("_t")).otherwise(F.percentile("_t", 0.5).over(w)))).drop("_t")


def wrist_travel(poses: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """video, right, left: summed steps of the wrists in [t - before, t + after) of all contacts.

    Steps are taken inside each contact's own window, so overlapping windows count twice, and a missing pose breaks a step.
    Where hits have lo and hi (``sequence.in_segments``), only frames of a contact's own segment count, and contacts of none don't.
    """
    first, last = F.greatest(F.col("frame") - before, F.lit(0)), F.col("frame") + after - 1
    if {"lo", "hi"} <= set(hits.columns):
        hits = hits.where("lo is not null")
        first, last = F.greatest(first, F.col("lo")), F.least(last, F.col("hi"))
    span = hits.select("video", F.col("frame").alias("hit"), F.explode(F.sequence(first, last)).alias("frame"))
    j = span.join(poses.select("video", "frame", point(F.col("pose"), R_WRI).alias("r"), point(F.col("pose"), L_WRI).alias("l")), ["video", "frame"])
    w = Window.partitionBy("video", "hit").orderBy("frame")
    step = lambda c: F.when(F.col("frame") - F.lag("frame").over(w) == 1, F.hypot(F.col(c)["x"] - F.lag(F.col(c)["x"]).over(w), F.col(c)["y"] - F.lag(F.col(c)["y"]).over(w)))
    s = j.withColumns({"rs": step("r"), "ls": step("l")})
    return s.groupBy("video").agg(F.coalesce(F.sum("rs"), F.lit(0.0)).alias("right"), F.coalesce(F.sum("ls"), F.lit(0.0)).alias("left"))


def handedness(travel: DataFrame) -> DataFrame:
    """L only where the left wrist travels more."""
    return travel.withColumn("hand", F.when(F.col("left") > F.col("right"), "L").otherwise("R"))


def choose_players(people: DataFrame, net_x: float | Column, margin: float | Column, before: DataFrame | None = None) -> DataFrame:
    """The tallest person of each frame clearly on either side of the net. people: video, frame, id, x1, y1, x2, y2.

    Where ``before`` (video, side, x) says where a side's player was seen last, height loses half the distance from there.
    """
    c, height = (F.col("x1") + F.col("x2")) / 2, F.col("y2") - F.col("y1")
    p = people.withColumns({"side": F.when(c >= net_x + margin, "right").when(c <= net_x - margin, "left"), "_c": c}).where("side is not null")
    score = height
    if before is not None:
        p = p.join(before.select("video", "side", F.col("x").alias("_x")), ["video", "side"], "left")
        score = height - F.coalesce(0.5 * F.abs(F.col("_c") - F.col("_x")), F.lit(0.0))
    best = F.max(F.struct(score.alias("score"), (-F.col("id")).alias("i"), height.alias("height")))
    return p.groupBy("video", "frame", "side").agg(best.alias("b")).select("video", "frame", "side", (-F.col("b.i")).alias("id"), F.col("b.height").alias("height"))


def follow_players(people: DataFrame, net_x: float | Column, margin: float | Column, block: int = 256) -> DataFrame:
    """``choose_players`` frame by frame: height loses half the distance to where the side's player was chosen last.

    A frame's choice depends on the frame before it, and through it on all frames before. So a video is cut into blocks of
    frames, each worked through in one task for every place that the player can have had before it (one for each person on
    that side in the last frame with any). How blocks lead from place to place is then followed over a video's blocks, one row
    each, and picks one course of each block. The same sums are made as frame by frame, so the choice is exactly the same.
    Of equal scores the least id is chosen. ``net_x`` and ``margin`` may be columns, for videos of their own scale.
    """
    key = ["video", "side"]
    c = (F.col("x1") + F.col("x2")) / 2
    p = people.withColumns({"side": F.when(c >= net_x + margin, "right").when(c <= net_x - margin, "left"), "_c": c, "_h": F.col("y2") - F.col("y1")}).where("side is not null")
    seen = p.groupBy(*key, "frame").agg(F.sort_array(F.collect_list(F.struct("id", F.col("_c").alias("c"), F.col("_h").alias("h")))).alias("people"))
    blocks = seen.groupBy(*key, F.floor(F.col("frame") / block).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("frame", "people"))).alias("_frames"))
    before = Window.partitionBy(*key).orderBy("_block")
    last = F.element_at("_frames", -1)["people"]
    none = F.array(F.lit(None).cast("double"))
    blocks = blocks.withColumn("_from", F.coalesce(F.lag(F.transform(last, lambda x: x["c"])).over(before), none))

    def choose(people: Column, x: Column) -> Column:
        scored = F.transform(people, lambda q: F.struct((q["h"] - F.coalesce(0.5 * F.abs(q["c"] - x), F.lit(0.0))).alias("score"), (-q["id"]).alias("i"), q["c"].alias("c"), q["h"].alias("h")))
        return F.array_max(scored)

    def course(frames: Column, x: Column) -> Column:
        """frame, id, c, h of the choices of a block that begins with a player at x."""
        kind = "struct<x:double,out:array<struct<frame:bigint,id:bigint,c:double,h:double>>>"
        start = F.struct(x.alias("x"), F.array().alias("out")).cast(kind)

        def step(acc: Column, f: Column) -> Column:
            row = lambda b: F.struct(b["c"].alias("x"), F.concat(acc["out"], F.array(F.struct(f["frame"].cast("long").alias("frame"), (-b["i"]).cast("long").alias("id"), b["c"].alias("c"), b["h"].alias("h")))).alias("out")).cast(kind)
            return F.get(F.transform(F.array(choose(f["people"], acc["x"])), row), F.lit(0))

        return F.aggregate(frames, start, step)["out"]

    blocks = blocks.withColumn("_courses", F.transform("_from", lambda x: course(F.col("_frames"), x)))
    # Where a course ends, as a place among the people of the block's last frame: the next block's places to begin from.
    end_id = lambda run: F.element_at(run, -1)["id"]
    ends = F.transform("_courses", lambda run: F.array_position(F.transform(last, lambda q: q["id"].cast("long")), end_id(run)).cast("int"))
    chain = blocks.select(*key, "_block", ends.alias("_ends")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", "_ends"))).alias("_chain"))
    picks = F.aggregate(
        "_chain",
        F.array(F.lit(1)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(b["_ends"], F.element_at(acc, -1)))),
    )
    chain = chain.withColumn("_picks", picks).select(*key, F.posexplode(F.transform("_chain", lambda b: b["_block"])).alias("_n", "_block"), "_picks")
    chain = chain.select(*key, "_block", F.get("_picks", F.col("_n")).alias("_pick"))
    out = blocks.join(chain, [*key, "_block"]).select(*key, F.explode(F.element_at("_courses", F.col("_pick"))).alias("r"))
    return out.select("video", "r.frame", "side", "r.id", F.col("r.c").alias("x"), F.col("r.h").alias("height"))


def fill_poses(poses: DataFrame, max_gap: int = 8) -> DataFrame:
    """poses with gaps filled whole: every point's x, y and conf on the line between the poses around a gap.

    A pose counts where its first point is there. Two such poses 2 to ``max_gap`` frames apart have a gap; a point that either
    of them lacks stays missing, and nothing is extrapolated. poses: video, frame, pose (array of x, y, conf), dense frames.
    """
    here = F.get(F.col("pose"), NOSE)
    known = F.when(here.isNotNull() & here["x"].isNotNull(), F.struct(F.col("frame").alias("f"), F.col("pose").alias("p")))
    w = Window.partitionBy("video", "_bucket").orderBy("frame")
    df = with_margin(poses, max_gap)
    df = df.withColumns({"_a": F.last(known, True).over(w.rowsBetween(-max_gap, 0)), "_b": F.first(known, True).over(w.rowsBetween(0, max_gap))})
    gap = F.col("_b.f") - F.col("_a.f")
    share = (F.col("frame") - F.col("_a.f")) / gap
    between = lambda a, b, c: (a[c] + share * (b[c] - a[c])).alias(c)
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(*[between(a, b, c) for c in ("x", "y", "conf")]))
    missing = here.isNull() | here["x"].isNull()
    filled = F.when(missing & (gap > 1) & (gap <= max_gap), F.zip_with(F.col("_a.p"), F.col("_b.p"), both)).otherwise(F.col("pose"))
    return own(df.withColumn("pose", filled)).drop("_a", "_b")


def around_contacts(contacts: DataFrame, poses: DataFrame, ball: DataFrame, offsets: list[int], into: list[int], out: list[int], reach: int = 20) -> DataFrame:
    """contacts with what is seen around them.

    p0, p1, ...: the poses at ``offsets``; size, hip_x, hip_y: medians of torso and hips over the frames in [-reach, reach);
    ball: where it is at contact; into and out: its first and last sample in those frames, and their number. Every contact
    asks for its own few frames, so frames of a video are joined and never gathered.
    """
    key, o = ["video", "frame", "side"], F.col("_o")
    near = range(-reach, reach)
    asked = contacts.select(*key, F.explode(F.array(*[F.lit(x) for x in sorted({*near, *offsets, *into, *out, 0})])).alias("_o")).withColumn("_f", F.col("frame") + o)
    middle = lambda c: (point(F.col("pose"), L_HIP)[c] + point(F.col("pose"), R_HIP)[c]) / 2
    body = poses.select("video", F.col("frame").alias("_f"), "pose", torso(F.col("pose")).alias("_t"), middle("x").alias("_x"), middle("y").alias("_y"))
    place = ball.select("video", F.col("frame").alias("_f"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")).alias("_b"))
    seen = asked.join(body, ["video", "_f"], "left").join(place, ["video", "_f"], "left")
    is_near = o.between(-reach, reach - 1)
    median = lambda c: F.percentile(F.when(is_near, F.col(c)), 0.5)

    def flight(frames: list[int], name: str) -> Column:
        there = o.between(frames[0], frames[-1]) & F.col("_b").isNotNull()
        return F.struct(F.min_by("_b", F.when(there, o)).alias("first"), F.max_by("_b", F.when(there, o)).alias("last"), F.count_if(there).alias("n")).alias(name)

    found = seen.groupBy(*key).agg(
        *[F.first(F.when(o == x, F.col("pose")), ignorenulls=True).alias(f"p{i}") for i, x in enumerate(offsets)], median("_t").alias("size"), median("_x").alias("hip_x"), median("_y").alias("hip_y"),
        F.first(F.when(o == 0, F.col("_b")), ignorenulls=True).alias("ball"), flight(into, "into"), flight(out, "out"),
    )
    return contacts.join(found, key)


def stroke_features(contacts: DataFrame, poses: DataFrame, ball: DataFrame, kt: float = 1.0) -> DataFrame:
    """contacts with ``features``, 263 numbers, null where something is missing.

    contacts: video, frame, side, racket (L or R), first_of_rally, since_prev_s, slope and level (the table's surface is at
    level + slope * x; null without a table); one row per video, frame and side. poses: video, frame, pose; ball: video,
    frame, x, y. ``kt``: frames a second over 120. All coordinates are relative to the hips at contact in torso lengths
    (medians over the frames around it where the torso can't be told), x mirrored for left players, and left and right swapped
    for left-handers, so that the right arm holds the racket. In order: the 13 keypoints at the 9 offsets; wrist speed into
    contact and largest, wrist height over the shoulder, wrist x at contact and before, angles of the racket elbow, both knees
    and the trunk, stance width, foot heights, ankle travel, head travel, crouch; ball velocity in and out, speed out, angle
    out, speed ratio, ball position, height over the table; first of rally, seconds since the last hit, racket near the
    camera, left player.
    """
    sampled = [round(o * kt) for o in OFFSETS]
    rows = around_contacts(contacts, poses, ball, sampled, list(range(round(-8 * kt), round(-kt))), list(range(round(kt), round(9 * kt))))
    here = F.col(f"p{OFFSETS.index(0)}")
    own = torso(here) >= 1
    middle = lambda c: (point(here, L_HIP)[c] + point(here, R_HIP)[c]) / 2
    rows = rows.withColumns({
        "_size": F.when(own, torso(here)).otherwise(F.col("size")),
        "_hip": F.struct(*[F.when(own, middle(c)).otherwise(F.coalesce(f"hip_{c}", middle(c))).alias(c) for c in ("x", "y")]),
        "_mirror": F.when(F.col("side") == "left", -1.0).otherwise(1.0),
    })
    size, hip, mirror = F.col("_size"), F.col("_hip"), F.col("_mirror")
    per_torso = lambda v: F.try_divide(v, size)  # noqa: E731  nothing where the torso has no length
    norm = lambda p: F.struct((per_torso(p["x"] - hip["x"]) * mirror).alias("x"), per_torso(p["y"] - hip["y"]).alias("y"))

    def arms(p: Column) -> Column:
        return F.when(F.col("racket") == "L", F.array(*[point(p, MIRRORED.get(i, i)) for i in range(17)])).when(p.isNotNull(), p)

    def speed(ball: Column) -> Column:  # in torso lengths a frame at 120 a second
        step = lambda c: per_torso((ball["last"][c] - ball["first"][c]) / (ball["n"] - 1) / kt)
        return F.when(ball["n"] >= 2, F.struct((step("x") * mirror).alias("x"), step("y").alias("y")))

    rows = rows.withColumns({f"_k{i}": F.transform(arms(F.col(f"p{i}")), norm) for i in range(len(OFFSETS))} | {"_in": speed(F.col("into")), "_out": speed(F.col("out"))})
    k = lambda o, i: F.get(F.col(f"_k{OFFSETS.index(o)}"), i)
    steps = list(zip(OFFSETS[:-1], OFFSETS[1:], strict=True))
    speeds = [F.hypot(k(q, R_WRI)["x"] - k(p, R_WRI)["x"], k(q, R_WRI)["y"] - k(p, R_WRI)["y"]) / (q - p) for p, q in steps]
    k0, first, last, b0 = F.col(f"_k{OFFSETS.index(0)}"), OFFSETS[0], OFFSETS[-1], F.col("ball")
    whole = F.forall(k0, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    lean = lambda c: k(0, L_SHO)[c] + k(0, R_SHO)[c] - k(0, L_HIP)[c] - k(0, R_HIP)[c]
    v_in, v_out = F.col("_in"), F.col("_out")
    fast = F.hypot(v_out["x"], v_out["y"])
    body = [
        speeds[OFFSETS.index(0) - 1], F.greatest(*speeds), k(0, R_WRI)["y"] - k(0, R_SHO)["y"], k(0, R_WRI)["x"], k(-8, R_WRI)["x"],
        joint(k0, R_SHO, R_ELB, R_WRI), joint(k0, L_HIP, L_KNE, L_ANK), joint(k0, R_HIP, R_KNE, R_ANK), F.when(whole, F.degrees(F.atan2(lean("y"), lean("x")))),
        k(0, L_ANK)["x"] - k(0, R_ANK)["x"], k(0, L_ANK)["y"] - k(0, R_ANK)["y"], k(last, L_ANK)["y"] - k(first, L_ANK)["y"], k(last, R_ANK)["y"] - k(first, R_ANK)["y"],
        k(last, NOSE)["x"] - k(first, NOSE)["x"], (k(0, L_HIP)["y"] + k(0, R_HIP)["y"] - k(0, L_ANK)["y"] - k(0, R_ANK)["y"]) / 2,
    ]
    flight = [
        v_in["x"], v_in["y"], v_out["x"], v_out["y"], fast, F.degrees(F.atan2(-v_out["y"], -v_out["x"])), fast / F.greatest(F.hypot(v_in["x"], v_in["y"]), F.when(v_in.isNotNull(), F.lit(1e-3))),
        norm(b0)["x"], norm(b0)["y"], per_torso(b0["y"] - F.col("level") - F.col("slope") * b0["x"]),
    ]
    flag = lambda c: c.cast("double")
    context = [flag(F.col("first_of_rally")), F.col("since_prev_s"), flag((F.col("side") == "left") == (F.col("racket") == "R")), flag(F.col("side") == "left")]
    # Points by offset, keypoint and coordinate: loops over arrays, as hundreds of single expressions take long to compile.
    of_pose = lambda p: F.flatten(F.transform(F.array(*[F.lit(i) for i in USED]), lambda i: F.array(F.get(p, i)["x"], F.get(p, i)["y"])))
    points = F.flatten(F.transform(F.array(*[F.col(f"_k{i}") for i in range(len(OFFSETS))]), of_pose))
    rest = F.array(*[v.cast("double") for v in (*body, *flight, *context)])
    return rows.select(*contacts.columns, F.concat(points, rest).alias("features"))
