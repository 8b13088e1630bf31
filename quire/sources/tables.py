"""Tables of a folder as streams, and what a stream that runs to its end has written."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.readwriter import DataStreamWriter


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one of this driver only in a local session without it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
    return own_folder()


@functools.cache
def own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files, be it one file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(path)


def run_to_end(spark: SparkSession, writer: DataStreamWriter, name: str) -> DataFrame:
    """Runs a stream over what there is now, exactly once, into a table of the shared folder, and reads that.

    Batches for timeouts alone are switched off meanwhile: with processing-time state they would never end.
    """
    out, key = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        writer.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before or "true")
    return spark.read.parquet(f"{out}/rows")
