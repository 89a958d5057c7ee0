"""Queries of texts, answers, scales and names around a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import boosting, matching, models, report
from ..sources import labels
from ..sources.views import FRAMES_SQL, frames, table
from . import poses as P
from . import reporting as R

_TARGETS = ("hand", "technique")


def notes_html(spark, d: str) -> DataFrame:
    """Notes in simple markdown, made of conversations, as HTML."""
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    note = F.concat(F.lit("## "), F.col("role"), F.lit(" & <co>\n- **"), F.substring("text", 1, 20), F.lit("** it's\n  2. *"), F.substring("text", 3, 9), F.lit("* \"x\"\n\n"), F.col("text"), F.when(F.col("turn") % 2 == 0, "\n* last").otherwise(""))
    return c.select("conv_id", "turn", F.md5(text.markdown_html(note)).alias("html"), F.length(text.markdown_html(note)).cast("long").alias("n"))


def image_urls(spark, d: str) -> DataFrame:
    """Bytes as addresses, and back."""
    p = table(spark, d, "part", "p_partkey", "p_name").withColumn("url", text.image_url(F.encode("p_name", "UTF-8")))
    return p.select("p_partkey", "url", F.decode(text.image_bytes(F.col("url")), "UTF-8").alias("name"))


def run_names(spark, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type")
    tag = F.concat(F.lit("a/"), F.col("event_type"))
    return e.select("event_id", text.run_name(F.col("ts"), tag).alias("name"), text.run_time(F.col("ts")).alias("time"))


def _answers(spark, d: str) -> DataFrame:
    """Answers, and replies of which some are cut off, wrong, padded or in upper case."""
    f = frames(spark, d)
    right = F.to_json(F.struct(F.col("kind").alias("hand"), F.col("k").cast("int").cast("string").alias("technique")))
    said = F.to_json(F.struct(F.concat(F.lit(" "), F.upper("kind")).alias("hand"), F.when(F.col("frame") % 3 != 0, F.col("k").cast("int").cast("string")).alias("technique")))
    cut = F.when(F.col("frame") % 7 == 0, F.expr("substring(said, 1, length(said) - 1)")).otherwise(F.col("said"))
    return f.withColumn("said", said).select(right.alias("answer"), cut.alias("reply"))


def answer_accuracy(spark, d: str) -> DataFrame:
    return matching.answer_accuracy(_answers(spark, d), _TARGETS)


def coaching_findings(spark, d: str) -> DataFrame:
    """Each finding of each player, with what it says and what it rests on."""
    return R.found(spark, d).select("player", F.posexplode("findings").alias("nth", "f")).select("player", "nth", "f.title", F.md5("f.detail").alias("detail"), "f.evidence")


def player_scale(spark, d: str) -> DataFrame:
    """Metres per pixel from the heights of the persons of a video."""
    s = report.metres_per_pixel(P._boxes(spark, d).withColumn("height", F.when(F.col("id") % 5 != 0, F.col("y2") - F.col("y1"))), least=50)
    return s.select("video", F.round("m_per_px", 8).alias("m_per_px"))


def _names(spark, d: str) -> DataFrame:
    v = table(spark, d, "events", "user_id").distinct()
    n = F.col("user_id")
    return v.select("user_id", F.when(n % 12 < 5, F.concat(F.lit("game_"), (n % 12 + 1).cast("string"))).otherwise(F.concat(F.lit("test_"), (n % 12 - 4).cast("string"))).alias("video"))


def label_files(spark, d: str) -> DataFrame:
    """Where each video's ball positions are."""
    v = F.col("video")
    return _names(spark, d).select("user_id", labels.ball_file(v).alias("ball"), labels.events_file(v).alias("events"), labels.video_file(v).alias("video"))


def racket_hands(spark, d: str) -> DataFrame:
    """The hand that each player of each named video holds the racket in."""
    return labels.racket_truth(_names(spark, d).select("video").distinct()).select("video", "side", "hand")


def bounce_scores(spark, d: str) -> DataFrame:
    """Events by video, unknown where the video has no such labels."""
    names = _names(spark, d).toDF("id", "name")
    c = frames(spark, d).join(names, F.col("video") == F.col("id")).groupBy("name").agg(F.count_if(F.col("kind") == "click").alias("tp"), F.count_if(F.col("kind") == "view").alias("fp"), F.count_if(F.col("kind") == "error").alias("fn"))
    return matching.unless_unlabelled(c, labels.NO_BOUNCE_LABELS, "tp", "fp", "fn", key="name")


def _boosted(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    rows = e.select("vec_id", F.col("label").cast("string").alias("label"), F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("side"), F.transform(F.slice("embedding", 1, 16), lambda x: F.when(F.abs(x) > 0.01, x.cast("double"))).alias("features"))
    model = boosting.fit(rows.where("vec_id % 3 <> 0"), "label", boost=boosting.Boost(iterations=2, leaves=4, rate=0.3))
    return boosting.predict(model, rows.where("vec_id % 3 = 0"), "label")


def stroke_boost(spark, d: str) -> DataFrame:
    """Held-out predictions of boosted trees, with missing values; a third of the vectors is held out."""
    return _boosted(spark, d).select("vec_id", "label", "side", "label_pred", "label_conf")


def boost_report(spark, d: str) -> DataFrame:
    """Held-out accuracy and macro F1 by side."""
    p = _boosted(spark, d)
    return models.side_report(p, "right", ("label",)).withColumn("side", F.lit("right")).unionByName(models.side_report(p, "left", ("label",)).withColumn("side", F.lit("left")))


def target_report(spark, d: str) -> DataFrame:
    """Held-out report of a forest for each of the four targets, over strokes of the right side; vectors stand for features."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    k = F.col("label").cast("int")
    named = {"hand": pick(("forehand", "backhand"), k), "technique": pick(("loop", "push", "serve"), k), "lean": pick(("neutral", "back_heavy"), k + F.col("vec_id") % 2), "feet": F.when(F.col("vec_id") % 5 != 0, pick(("both_feet_planted", "left_foot_lifted"), k))}
    rows = e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), *[v.alias(n) for n, v in named.items()])
    fitted = models.fit_all(rows.where("vec_id % 3 <> 0"), trees=3, depth=4)
    return models.side_report(models.predict_all(fitted, rows.where("vec_id % 3 = 0 and feet is not null")))


def _md_sql() -> str:
    esc = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    strong = lambda x: f"regexp_replace(regexp_replace({esc.replace('(x,', f'({x},')}, '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g'), '\\*(.+?)\\*', '<i>\\1</i>', 'g')"
    return f"""n AS (SELECT conv_id, turn, '## ' || role || ' & <co>' || chr(10) || '- **' || substr(text, 1, 20) || '** it''s' || chr(10) || '  2. *' || substr(text, 3, 9) || '* "x"' || chr(10) || chr(10) || text || CASE WHEN turn % 2 = 0 THEN chr(10) || '* last' ELSE '' END AS note FROM conversations),
l AS (SELECT conv_id, turn, unnest(lines) AS raw, unnest(range(len(lines))) AS i FROM (SELECT conv_id, turn, string_split(note, chr(10)) AS lines FROM n WHERE note IS NOT NULL) q),
t AS (SELECT conv_id, turn, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS x FROM l),
k AS (SELECT *, regexp_matches(x, '^([-*]|\\d+\\.)\\s+') AS item, regexp_matches(x, '^#{{1,4}}\\s') AS head FROM t),
h AS (SELECT conv_id, turn, i, item, coalesce(lag(item) OVER w, false) AS inside, lead(i) OVER w IS NULL AS last, CASE WHEN item THEN '<li>' || {strong("regexp_replace(x, '^([-*]|\\d+\\.)\\s+', '')")} || '</li>' WHEN head THEN '<h3>' || {strong("regexp_replace(x, '^#+\\s*', '')")} || '</h3>' WHEN x <> '' THEN '<p>' || {strong('x')} || '</p>' ELSE '' END AS html
  FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
o AS (SELECT conv_id, turn, string_agg(CASE WHEN item AND NOT inside THEN '<ul>' WHEN NOT item AND inside THEN '</ul>' ELSE '' END || html || CASE WHEN last AND item THEN '</ul>' ELSE '' END, '' ORDER BY i) AS html FROM h GROUP BY conv_id, turn)"""


_TIPS = f"""WITH {R._TOTALS}, c AS (SELECT player, count(*) FILTER (lean = 'back_heavy') AS back, count(*) FILTER (feet <> 'both_feet_planted') AS lifted, count(*) FILTER (technique = 'push') AS push, count(*) FILTER (technique = 'loop') AS loop,
 count(*) FILTER (n = 1 AND NOT won) AS lost, count(*) FILTER (n = 1 AND NOT won AND outcome = 'net') AS nets, count(*) FILTER (n = 1 AND NOT won AND outcome = 'out') AS outs FROM shots GROUP BY player),
r AS (SELECT player, strokes, list_filter([
  CASE WHEN forehand + backhand >= 6 AND backhand / (forehand + backhand) < 0.25 THEN ['Backhand is under-used', forehand || ' forehands, ' || backhand || ' backhands'] END,
  CASE WHEN forehand + backhand >= 6 AND backhand / (forehand + backhand) > 0.75 THEN ['Forehand is under-used', forehand || ' forehands, ' || backhand || ' backhands'] END,
  CASE WHEN back / strokes > 0.2 THEN ['Weight falling backwards at contact', round_even(back / strokes * 100, 0)::INT || '% of strokes'] END,
  CASE WHEN lifted / strokes > 0.45 THEN ['Balance at contact', round_even(lifted / strokes * 100, 0)::INT || '% of strokes with a foot lifted'] END,
  CASE WHEN push / strokes > 0.35 AND loop / strokes < 0.25 THEN ['Passive rallies', round_even(push / strokes * 100, 0)::INT || '% pushes, ' || round_even(loop / strokes * 100, 0)::INT || '% loops'] END,
  CASE WHEN forehand_avg > 0 AND backhand_avg > 0 AND backhand_avg < 0.75 * forehand_avg THEN ['Backhand lacks pace', forehand_avg || ' and ' || backhand_avg || ' km/h'] END,
  CASE WHEN lost >= 3 AND nets > outs THEN ['Errors into the net', nets || ' into the net, ' || outs || ' out'] END,
  CASE WHEN lost >= 3 AND outs > nets THEN ['Errors long or wide', nets || ' into the net, ' || outs || ' out'] END], lambda x: x IS NOT NULL) AS met FROM totals JOIN c USING (player)),
f AS (SELECT player, CASE WHEN strokes < 4 THEN [['Not enough strokes detected', strokes || ' strokes']] WHEN len(met) = 0 THEN [['Solid, balanced session', strokes || ' strokes']] ELSE met END AS fs FROM r)
SELECT player, (i - 1)::INTEGER AS nth, fs[i][1] AS title, md5(MAP {{{', '.join(f"'{k}': '{v.replace("'", "''")}'" for k, v in report.DETAILS.items())}}}[fs[i][1]]) AS detail, fs[i][2] AS evidence FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM f) q"""
_NAMES = "names AS (SELECT DISTINCT user_id, CASE WHEN user_id % 12 < 5 THEN 'game_' || (user_id % 12 + 1) ELSE 'test_' || (user_id % 12 - 4) END AS video FROM events)"

QUERIES = {f.__name__: f for f in (notes_html, image_urls, run_names, answer_accuracy, coaching_findings, player_scale, label_files, racket_hands, bounce_scores, stroke_boost, boost_report, target_report)}
SQL = {
    "notes_html": f"WITH {_md_sql()} SELECT conv_id, turn, md5(html) AS html, length(html) AS n FROM o",
    "image_urls": "SELECT p_partkey, 'data:image/jpeg;base64,' || to_base64(encode(p_name)) AS url, p_name AS name FROM part",
    "run_names": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '_a_' || event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events",
    "answer_accuracy": f"""WITH {FRAMES_SQL}, a AS (SELECT frame % 7 = 0 AS bad, frame % 3 <> 0 AS told FROM frames)
SELECT count(*) AS n, round(avg(CASE WHEN bad THEN 0 ELSE 1 END), 4) AS hand_acc, round(avg(CASE WHEN NOT bad AND told THEN 1 ELSE 0 END), 4) AS technique_acc, count(*) FILTER (WHERE bad) AS bad_json FROM a""",
    "coaching_findings": _TIPS,
    "player_scale": f"""WITH {FRAMES_SQL} SELECT video, CASE WHEN count(*) FILTER (WHERE frame % 5 <> 0) > 50 THEN round(1.55::DOUBLE / median(value + 10 + k / 4 - value) FILTER (WHERE frame % 5 <> 0), 8) END AS m_per_px FROM frames GROUP BY video""",
    "label_files": f"""WITH {_NAMES}, s AS (SELECT *, CASE WHEN video LIKE 'game%' THEN 'train' ELSE 'test' END AS split FROM names)
SELECT user_id, 'ball_data/' || split || '/' || replace(video, 'game_', 'train_') || '.json' AS ball, 'game_data/' || split || '/' || video || '.json' AS events, split || '/' || video || '.mp4' AS video FROM s""",
    "racket_hands": f"""WITH {_NAMES} SELECT video, side, CASE WHEN (video, side) IN (('test_3', 'right'), ('test_5', 'left'), ('test_5', 'right'), ('test_7', 'right')) THEN 'L' ELSE 'R' END AS hand
FROM (SELECT DISTINCT video FROM names) n, (VALUES ('left'), ('right')) s(side)""",
    "bounce_scores": f"""WITH {FRAMES_SQL}, {_NAMES}, c AS (SELECT n.video AS name, count(*) FILTER (WHERE kind = 'click') AS tp, count(*) FILTER (WHERE kind = 'view') AS fp, count(*) FILTER (WHERE kind = 'error') AS fn FROM frames f JOIN names n ON n.user_id = f.video GROUP BY n.video)
SELECT name, CASE WHEN name <> 'test_2' THEN tp END AS tp, CASE WHEN name <> 'test_2' THEN fp END AS fp, CASE WHEN name <> 'test_2' THEN fn END AS fn FROM c""",
}
