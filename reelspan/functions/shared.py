"""Tables in the folder that driver and executors share, by which long jobs cut their lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to SparkContext.setCheckpointDir. Where neither is set, a local session gets a temporary folder; on a
    cluster that would be one machine's, so that a ValueError says what to set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="reelspan-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
