"""Around detectors: the interface that hosts them, and the table-shaped filters on what they find.

Detectors themselves (pixels, networks) are not part of this engine. One is any callable that takes a pandas frame of
images and gives candidates; it is built on the executor, once per task, by a registered factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_distance
from ..session import ship
from .report import top_k

CANDIDATES = "video long, frame long, x double, y double, conf double"
_FACTORIES: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register(name: str, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """Name a detector's factory."""
    _FACTORIES[name] = factory


def detect(images: DataFrame, name: str, schema: str = CANDIDATES) -> DataFrame:
    """Candidates of all images by a registered detector, batch by batch."""
    if name not in _FACTORIES:
        raise ValueError(f"no detector {name!r}; there are {sorted(_FACTORIES)}")
    factory = _FACTORIES[name]
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for b in batches:
            yield detector(b)

    return images.mapInPandas(run, schema)


def blob_candidates(blobs: DataFrame, scale: float, k: int = 8) -> DataFrame:
    """The k most certain blobs of each frame. blobs: video, frame, id, w, h, area, bright (0 to 1).

    Sizes are limited in pixels of the reference width, and no side is over four times the other.
    """
    small, large = F.least("w", "h"), F.greatest("w", "h")
    ok = F.col("area").between(12 * scale * scale, 900 * scale * scale) & (large <= 4.0 * F.greatest(small, F.lit(1)))
    conf = 0.5 * F.try_divide(F.col("area").cast("double"), (F.col("w") * F.col("h")).cast("double")) + 0.5 * F.col("bright")
    return top_k(blobs.where(ok).withColumn("conf", conf), ["video", "frame"], "conf", "id", k)


def table_contour(x: Column, y: Column, w: Column, h: Column, area: Column, width: float, height: float) -> Column:
    """Whether a contour's box may be half a table: below the top edge, wide, flat, large enough, not in the top third."""
    return (y > 2) & (w >= 0.12 * width) & (w >= 2.0 * h) & (area >= 0.005 * width * height) & (y + h / 2 >= height / 3)


def median_corners(found: DataFrame, tries: int = 8) -> DataFrame:
    """Element-wise median of corners over at most ``tries`` evenly spaced frames. found: video, frame, n_frames, corner, x, y."""
    step = (F.col("n_frames") - 1) / (tries - 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.floor(i * step))
    return found.where(F.array_contains(picked, F.col("frame"))).groupBy("video", "corner").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("n"))


def restrict_to_table(candidates: DataFrame, people: DataFrame, corners: list[tuple[float, float]], frame_height: float, keep: float = 0.5, margin: float = 1.0) -> DataFrame:
    """candidates (video, frame, x, y, conf) with removed: uncertain ones farther from the table than a player is tall.

    people: video, y1, y2. Without people in a video the distance is 0.4 of the frame's height. Tracks of what is left are
    ``tracker.link(found.where("not removed"), ...)``; the number removed is a count.
    """
    tall = people.groupBy("video").agg(F.percentile(F.col("y2") - F.col("y1"), 0.5).alias("_tall"))
    far = polygon_distance(F.col("x"), F.col("y"), corners) < -margin * F.coalesce("_tall", F.lit(0.4 * frame_height))
    return candidates.join(tall, "video", "left").withColumn("removed", F.coalesce((F.col("conf") < keep) & far, F.lit(False))).drop("_tall")
