"""Table access and the settings an operator takes from the session."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table *name* of *folder*; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir; a local one only where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(known)
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join("/tmp", f"attestia-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write *df* once as a table of the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table of *written* that nothing will read again."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
