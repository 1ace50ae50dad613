"""Where iterations keep their tables: the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and read back from the shared folder: no lineage, and a size that joins can be planned by."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_cut = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`cut` returned, if it is one; the frame can't be read afterwards."""
    path = getattr(df, "_loomgraph_cut", None)
    if path:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
