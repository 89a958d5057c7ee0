import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoframe.functions import geometry
from kairoframe.operators import detection, presentation


def test_detectors_are_hosted_by_name(spark):
    def brightest():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            out = [(v, f, float(max(range(len(p)), key=p.__getitem__)), 0.0, max(p) / 255) for v, f, p in zip(batch["video"], batch["frame"], batch["pixels"], strict=True) if len(p)]
            return pd.DataFrame(out, columns=["video", "frame", "x", "y", "conf"])

        return run

    images = spark.createDataFrame([(1, 0, bytearray([1, 9, 3])), (1, 1, bytearray([]))], "video long, frame long, pixels binary")
    detection.register("brightest", brightest)
    assert [(r["frame"], r["x"]) for r in detection.detect(images, "brightest").collect()] == [(0, 1.0)]
    with pytest.raises(ValueError, match="no detector"):
        detection.detect(images, "other")


def test_surface_height(spark):
    t = geometry.TableShape([(20.0, 25.0), (80.0, 28.0), (95.0, 75.0), (5.0, 70.0)])
    assert [r[0] for r in spark.createDataFrame([(5.0,), (95.0,), (50.0,)], "x double").select(t.surface_y(F.col("x"))).collect()] == [70.0, 75.0, 72.5]


def test_label_is_shown_for_a_while(spark):
    f = spark.range(8).select(F.lit(1).alias("video"), F.col("id").alias("frame"))
    got = presentation.on_show(f, f.where("frame in (1, 6)"), 2).orderBy("frame").collect()
    assert [(r["frame"], r["shot"]) for r in got] == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
