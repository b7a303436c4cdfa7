"""Tables between passes, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own where a local session names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or "file:///tmp/checkpoints/intervale").rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver ends."""
    base = f"{shared_folder(spark)}/intervale-passes/{spark.sparkContext.applicationId}"
    if base not in _made:
        _made[base] = spark
        atexit.register(_drop, base)
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


def settle(frame: DataFrame) -> DataFrame:
    """The frame's rows, worked out once and read from then on."""
    folder = fresh_folder(frame.sparkSession, "settled")
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _drop(base: str) -> None:
    spark = _made.pop(base, None)
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass
