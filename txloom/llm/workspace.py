"""Tables written between stages, in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost
executor then costs its own tasks only. The setting is read from the session;
where it is unset and all runs on one machine (tests), a new folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a batch that goes to a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = "8m"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return "file://" + _own[app]


def bounded_batches(spark: SparkSession) -> None:
    """Rows are as long as their texts: bound what goes to Python at once by bytes, not only by rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


class Workspace:
    """A folder for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        bounded_batches(spark)

    def of(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and give the frame that reads it back."""
        df.write.option("compression", codec).mode("overwrite").parquet(self.of(name))
        return self.spark.read.schema(df.schema).parquet(self.of(name))

    def drop(self, name: str) -> None:
        """Delete a table that no returned frame reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.of(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
