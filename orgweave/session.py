"""Session factory and shared scratch tables.

Iterative operators cut their lineage by writing a table into the folder that
the cluster names in ``spark.checkpoint.dir``; that folder is shared, so a lost
executor costs a task retry and never the data.  A folder of our own is made
only where the setting is absent and the master is local (tests).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(app: str = "orgweave", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="orgweave-")
    return _LOCAL_FALLBACK[app]


class Scratch:
    """Tables of one operator run; dropped one by one or at the session's end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read back: a plan without history."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that ``cut`` returned and nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
