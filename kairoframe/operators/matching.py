"""Joins between sparse events: greedy tolerance matching, as-of landing, intervals, and the metrics on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import prf
from .sequence import islands, span_of, spans


def candidate_pairs(pred: DataFrame, gt: DataFrame, tol: int) -> DataFrame:
    """video, p, g with |p - g| <= tol: a range join on buckets of the tolerance, so that a long video is no single key."""
    size = tol + 1
    near = gt.select("video", F.col("frame").alias("g"), F.explode(F.array(*[F.floor(F.col("frame") / size) + d for d in (-1, 0, 1)])).alias("_b"))
    return pred.select("video", F.col("frame").alias("p"), F.floor(F.col("frame") / size).alias("_b")).join(near, ["video", "_b"]).where(F.abs(F.col("p") - F.col("g")) <= tol).select("video", "p", "g")


def match_greedy(pred: DataFrame, gt: DataFrame, tol: int) -> DataFrame:
    """One-to-one matches in order of (distance, prediction, truth): greedy on purpose, not optimal.

    Frames of a video are distinct. Pairs whose predictions lie more than twice the tolerance apart have nothing in
    common, so each island of them is folded by itself.
    """
    pairs = islands(candidate_pairs(pred, gt, tol), 2 * tol, at="p")
    order = F.array_sort(F.collect_list(F.struct(F.abs(F.col("p") - F.col("g")).alias("d"), "p", "g")))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("ps"), none.alias("gs"))

    def step(acc, x):
        free = ~F.array_contains(acc["ps"], x["p"]) & ~F.array_contains(acc["gs"], x["g"])
        return F.when(free, F.struct(F.concat(acc["ps"], F.array(x["p"])).alias("ps"), F.concat(acc["gs"], F.array(x["g"])).alias("gs"))).otherwise(acc)

    done = pairs.groupBy("video", "island").agg(F.aggregate(order, start, step, lambda a: F.arrays_zip(a["ps"], a["gs"])).alias("m"))
    return done.select("video", F.explode("m").alias("m")).select("video", F.col("m.ps").alias("p"), F.col("m.gs").alias("g"))


def matched_labels(matches: DataFrame, predicted: DataFrame, truth: DataFrame, *targets: str) -> DataFrame:
    """video, target, label, guess: for each match (video, p, g) the truth's label at g and what was predicted at p.

    predicted and truth: video, frame and a column per target; a match whose frame either lacks has no rows.
    """
    guess = predicted.select("video", F.col("frame").alias("p"), *[F.col(t).alias(f"_p_{t}") for t in targets])
    label = truth.select("video", F.col("frame").alias("g"), *[F.col(t).alias(f"_g_{t}") for t in targets])
    both = matches.join(guess, ["video", "p"]).join(label, ["video", "g"])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_g_{t}").alias("label"), F.col(f"_p_{t}").alias("guess")) for t in targets]))
    return both.select("video", each.alias("r")).select("video", "r.*")


def match_report(pred: DataFrame, gt: DataFrame, tol: int) -> DataFrame:
    """tp, fp, fn and rates per video and over all (video null): counts are summed before rates are taken."""
    m = match_greedy(pred, gt, tol)
    n = lambda df, name: df.groupBy("video").agg(F.count("*").alias(name))
    counts = n(pred, "n_pred").join(n(gt, "n_gt"), "video", "full").join(n(m, "tp"), "video", "left").na.fill(0, ["n_pred", "n_gt", "tp"])
    total = counts.groupingSets([[F.col("video")], []], F.col("video")).agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gt") - F.col("tp")).alias("fn"))
    return total.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def landings(hits: DataFrame, bounces: DataFrame) -> DataFrame:
    """hits with landing (frame) and landing_half: the first bounce strictly between a hit and the next one of either side.

    Both tables become one stream in order of frame: a bounce belongs to the last hit before it, so one window pass does
    it, without a range join. A bounce on a hit's own frame belongs to no one.
    """
    events = hits.select("video", "frame", F.lit(True).alias("hit"), F.lit(None).cast("string").alias("half")).unionByName(bounces.select("video", "frame", F.lit(False).alias("hit"), "half"))
    w = Window.partitionBy("video").orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)
    owned = events.withColumn("owner", F.max(F.when(F.col("hit"), F.col("frame"))).over(w)).where("not hit and owner < frame")
    first = owned.groupBy("video", "owner").agg(F.min(F.struct("frame", "half")).alias("b"))
    return hits.join(first.select("video", F.col("owner").alias("frame"), F.col("b.frame").alias("landing"), F.col("b.half").alias("landing_half")), ["video", "frame"], "left")


def endings_in_rallies(ends: DataFrame, rallies: DataFrame, slack: int) -> DataFrame:
    """Each ending with the first rally (by number) that holds it, start <= frame <= end + slack; nulls if none does."""
    r = spans(rallies.select(F.col("video").alias("_v"), "rally", "start", "end", F.col("point_winner").alias("predicted")), "start", F.col("end") + slack)
    j = ends.withColumn("_e", span_of("frame")).join(r, (F.col("video") == F.col("_v")) & (F.col("_e") == F.col("_span")) & F.col("frame").between(F.col("start"), F.col("end") + slack), "left")
    return j.groupBy("video", "frame", "winner").agg(F.min(F.when(F.col("rally").isNotNull(), F.struct("rally", "predicted"))).alias("r")).select("video", "frame", "winner", F.col("r.rally").alias("rally"), F.col("r.predicted").alias("predicted"))


def ball_counts(traj: DataFrame, gt: DataFrame, scale: float = 1.0) -> DataFrame:
    """Per video: rates over annotated frames only. gt: video, frame, gx, gy (null: labelled as not visible)."""
    j = gt.join(traj.select("video", "frame", "x", "y"), ["video", "frame"])
    seen, found = F.col("gx").isNotNull(), F.col("x").isNotNull()
    err = F.when(seen & found, F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) / scale)
    c = j.withColumn("err", err).groupBy("video").agg(
        F.count_if(seen).alias("n_visible"), F.count_if(F.col("err") <= 5).alias("tp5"), F.count_if(F.col("err") <= 10).alias("tp10"), F.count_if(seen & found).alias("found"),
        F.count_if(~seen).alias("n_invisible"), F.count_if(~seen & found).alias("fp"), F.round(F.median("err"), 2).alias("median_err"),
    )
    per = lambda a, n: F.round(F.col(a) / F.greatest(F.col(n), F.lit(1)), 4)
    return c.select("video", "n_visible", per("tp5", "n_visible").alias("recall5"), per("tp10", "n_visible").alias("recall10"), per("found", "n_visible").alias("detection_rate"), "median_err", per("fp", "n_invisible").alias("fp_rate_invisible"))


def classification_report(rows: DataFrame, truth: str, guess: str, *keys: str) -> DataFrame:
    """n, accuracy and macro F1 (over labels that occur as truth) of two label columns, per ``keys``; from one confusion table."""
    cells = rows.groupBy(*keys, truth, guess).agg(F.count("*").alias("n"))
    long = cells.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("t"), (F.col(truth) == F.col(guess)).alias("ok")), F.struct(F.col(guess).alias("label"), F.lit(False).alias("t"), F.lit(False).alias("ok")))).alias("s"), "n")
    s = F.col("s")
    by = long.groupBy(*keys, s["label"].alias("label")).agg(F.sum(F.when(s["t"], F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~s["t"], F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(s["ok"], F.col("n")).otherwise(0)).alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("guessed"))
    return by.where("support > 0").groupBy(*keys).agg(F.sum("support").alias("n"), F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg(f1), 4).alias("macro_f1"))


def unless_unlabelled(counts: DataFrame, unlabelled: tuple, *columns: str, key: str = "video") -> DataFrame:
    """counts with nulls in ``columns`` for videos that have no such labels: nothing is known of them, which isn't nothing found."""
    known = ~F.col(key).isin(*unlabelled) if unlabelled else F.lit(True)
    return counts.withColumns({c: F.when(known, F.col(c)) for c in columns})


def answer_accuracy(rows: DataFrame, targets: tuple[str, ...], answer: str = "answer", reply: str = "reply") -> DataFrame:
    """n, <target>_acc and bad_json of replies that should be JSON objects, against answers that are.

    A target counts as right if the reply's value as text, stripped and in lower case, is the answer's. A reply that isn't JSON
    is wrong in all of them. One row, also for an empty table (with null rates).
    """
    value = lambda c, t: F.lower(F.trim(F.coalesce(F.try_variant_get(c, f"$.{t}", "string"), F.lit(""))))
    r = rows.select(F.try_parse_json(answer).alias("a"), F.try_parse_json(reply).alias("r"))
    right = [F.round(F.avg((value(F.col("r"), t) == F.try_variant_get("a", f"$.{t}", "string")).cast("int")), 4).alias(f"{t}_acc") for t in targets]
    return r.agg(F.count("*").alias("n"), *right, F.count_if(F.col("r").isNull()).alias("bad_json"))
