"""Results cut from their lineage: Parquet in the folder that driver and executors share, deleted when the driver ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOCAL = "/tmp/checkpoints/babelframe"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process may go without: on a cluster a local folder would be each machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone already; its own clean-up is the cluster's matter
        pass


def store(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written and read again, and their number, counted while they are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]
