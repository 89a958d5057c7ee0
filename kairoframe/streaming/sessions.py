"""Rally sessions over a stream: an addition, as the batch operator's gap rule suits event time.

Appending, a session is given out once the watermark has passed its end; sessions still open at the end of the input
are not, in contrast to the batch operator. Serves don't split sessions here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream, with ts as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """user_id, started, ended, n of sessions divided by more than ``gap``; late rows beyond ``delay`` are left out."""
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n"), F.max("ts").alias("ended")).select("user_id", F.col("w.start").alias("started"), "ended", "n")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, and read what it has appended. Files are under the checkpoint folder."""
    spark = stream.sparkSession
    shared_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
