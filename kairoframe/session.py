"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "kairoframe", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, pass your own session to the operators instead."""
    n = cores or os.cpu_count() or 8
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship_"), "kairoframe_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt_")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; it survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of a job's steps, written to the shared folder: they cut lineage as checkpoints do and survive lost executors.

    Columns are stored compressed and read one by one, a table is gone once it is dropped, and the shuffle files behind a
    table go when it is written, so that a job of many steps holds no more on disk than what its next steps read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` as a table."""
        path, self._n = f"{self.folder}/{self._n}", self._n + 1
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(clean, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            _, path = self._paths.pop(id(t), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
