"""Tables that an operator writes between its stages, in the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own if Spark runs on one machine, else an error:
    what executors write to their own disks can't be read again by others."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own)
    return _own


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send whole texts to Python in smaller Arrow batches than Spark's default of 10,000 rows, which for documents of some
    kilobytes are tens of megabytes for each task, on both sides. A setting of the user's own, also one of 10,000, stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(rows))


class Scratch:
    """A folder of Parquet tables of one operator call. A written table cuts the lineage and survives lost executors.

    Results are read lazily, so what an operator has not dropped itself stays until the driver's Python ends, and goes then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be stopped already
            self._delete(self.path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more: what was made of them is written."""
        for name in names:
            self._delete(f"{self.path}/{name}")
        self.names = [n for n in self.names if n not in names]

    def release(self) -> None:
        """Let Spark remove the shuffle files of jobs whose results are written: its cleaner acts when the driver's garbage is
        collected, which a driver with little to do rarely does by itself. Without it an operator of several stages holds the
        shuffles of all of them on disk at once."""
        self.spark.sparkContext._jvm.System.gc()

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and delete all other tables."""
        before = list(self.names)
        df = self.save(df, name)
        self.drop(*before)
        return df
