"""Continuous record entry: each micro-batch is checked and written like a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carestrata.operators.ingest import record
from carestrata.sources.files import SharedFiles
from carestrata.sources.runs import KeyIndex

NO_ID = "submission_id is required"


def first_submissions(batch: DataFrame, submitted: str = "submitted_at") -> DataFrame:
    """One row per submission_id: the earliest submitted (rows without a time last), of equally early ones the one
    whose content has the smallest digest. An aggregate, so an id that fills the batch is no hot key."""
    columns = batch.columns
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    early = [F.col(submitted).isNull(), F.col(submitted)] if submitted in columns else []
    return (batch.groupBy("submission_id").agg(F.min_by(F.struct(*columns), F.struct(*early, digest)).alias("first"))
            .select("first.*"))


def start_entry(submissions: DataFrame, check: Callable[[DataFrame, int], DataFrame], directory: str,
                checkpoint: str, slice_keys: int = 50_000) -> StreamingQuery:
    """Check and record every submission once, whatever date it carries; a resubmission of any age is dropped.

    ``check(batch, batch_id)`` gets a plain batch. Repeats inside a batch settle by :func:`first_submissions`; repeats
    of earlier ones are found in an index of the ids recorded by smaller batch numbers (in ``_ids`` of the
    directory), of which a batch opens only the slices that may hold its ids, so no state and no time horizon is
    kept and the history is not read. Rows without a submission_id are recorded as rejected, each of them.
    Micro-batches overwrite their own folder: one that is run again after a failure does not add rows.
    """
    spark = submissions.sparkSession
    index = KeyIndex(spark, f"{directory}/_ids", slice_keys)

    def key(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("submission_id").alias("key"))

    def step(batch: DataFrame, n: int) -> None:
        if not index.log.runs() and n > 0 and SharedFiles(spark).exists(directory):
            earlier = spark.read.parquet(directory).filter(F.col("ingest_batch") < n)  # recorded before there was an index
            index.add(n - 1, key(earlier))
        index.compact(below=n)
        named = first_submissions(batch.filter(F.col("submission_id").isNotNull()))
        known = index.known(key(named), below=n)
        fresh = named.join(known.withColumnRenamed("key", "submission_id"), "submission_id", "left_anti")
        checked = check(fresh, n)
        nameless = batch.filter(F.col("submission_id").isNull())
        if not nameless.isEmpty():
            checked = checked.unionByName(check(nameless, n).withColumn("reason", F.lit(NO_ID)))
        record(checked, directory, n)
        index.add(n, key(spark.read.parquet(f"{directory}/ingest_batch={n}")))

    return (submissions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def recorded(spark: SparkSession, directory: str, status: str = "accepted",
             before_batch: int | None = None) -> DataFrame:
    """Rows recorded so far. A check for uniqueness passes its own batch number, so that what an
    earlier attempt of the same batch wrote does not count as taken."""
    df = spark.read.parquet(directory).filter(F.col("status_of_entry") == status)
    if before_batch is not None:
        df = df.filter(F.col("ingest_batch") < before_batch)
    return df.drop("status_of_entry", "ingest_batch")
