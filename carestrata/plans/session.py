"""Session settings the operators count on, and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def configure(spark: SparkSession) -> SparkSession:
    """Settings that can change on a live session; sizes set by whoever started it stay."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # hash instead of sort-merge join once every partition of the build side is known to be small; the sizes known are
    # those of compressed shuffle files, and the table a task builds of one is many times larger and cannot spill
    conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "4MB")
    if is_local(spark) and conf.get("spark.sql.shuffle.partitions") == "200":
        conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one, for tables that cut a lineage.

    Only a local session without ``spark.checkpoint.dir`` (a test) gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/carestrata-{uuid.uuid4().hex}"
    if is_local(spark):
        return tempfile.mkdtemp(prefix="carestrata-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; else they stay until it collects."""
    gc.collect()
    spark._jvm.System.gc()
