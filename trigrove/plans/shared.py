"""Tables written once and read many times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; on a single machine without one, a new temporary folder."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # ours alone, and gone with this process
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/trigrove-{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` from a table written now: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.parquet(folder)
