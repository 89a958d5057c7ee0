"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from kairoframe.plans import catalogue
from kairoframe.session import build_session

HEADLINE = [
    "rally_rollup", "rally_outcomes", "nms_hits", "detected_bounces", "net_crossings", "landing_asof", "prf_by_video", "ball_counts", "rally_coverage", "shot_speed",
    "report_totals", "technique_counts", "keyframes", "coaching_tips", "parse_labels", "mirror_jitter_expand", "segments_merge", "interpolate_gaps", "homography", "stroke_features", "tracklet_scores", "track_link",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=int(os.environ.get("BENCH_CPUS", "8")))
    seconds = {}
    catalogue.QUERIES["smooth3"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers, fills the file cache
    for name in HEADLINE:
        begin = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
