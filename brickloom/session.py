"""Session helpers: durable lineage cuts and tunable limits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

MAX_GROUP_ROWS = 1_000_000


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one key that a single window task may hold."""
    return int(spark.conf.get("spark.brickloom.maxGroupRows", str(MAX_GROUP_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; fall back to a scratch one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brickloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
