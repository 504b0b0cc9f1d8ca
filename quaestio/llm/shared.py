"""Written tables in the shared folder, used to cut lineage between steps.

A written Parquet table survives the loss of any executor, is compressed and lets the
next step read only the columns it needs, so it is preferred to ``checkpoint()`` here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only where the session
    has none and runs on one machine (tests) a temporary folder is set; a cluster without
    the setting is an error, since executors cannot share a local folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaestio-llm-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if its size is under BROADCAST_BYTES;
    otherwise as it is, so that the join shuffles. ``row_bytes`` is the width of a row, as
    an expression where rows hold lists."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
