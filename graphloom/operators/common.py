"""Durable tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its plan is known to hold no more bytes than this.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, one of this machine in local mode; a cluster is
    refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df in the reliable checkpoint folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """What Spark's statistics say of the size of df; very large where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its size is known to be under limit; else Spark shuffles both sides."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
