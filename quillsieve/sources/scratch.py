"""Tables that an operator writes between its stages, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or, where that is unset and Spark runs on one machine, a temporary one."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own


class Tables:
    """Parquet tables of one call under the shared folder: they cut lineage, survive lost executors, and go when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.end)

    def end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be stopped already
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """batch: rows that go to Python at a time while this is written, for tables with large rows."""
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        if batch:
            self.spark.conf.set(setting, str(batch))
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            if batch:
                self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
