"""Intermediate tables in the cluster's shared folder, and connected groups over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carestrata.plans.session import release_shuffles, shared_folder
from carestrata.sources.files import SharedFiles

#: Text that goes to a Python worker at once; a batch of 10,000 very long documents would not fit.
BATCH_BYTES = 8 << 20
#: Largest table that Spark may collect in the driver by itself, in bytes of its files or rows; the driver holds the
#: collected rows, the table built of them and what it sends, and a file's rows are several times the file.
COLLECTED_BYTES = 2 << 20


class Workspace:
    """A folder of written tables for one operator call; a written table survives lost executors.

    Tables that nothing refers to any more are removed by :meth:`drop`; what a result is read from stays under
    ``spark.checkpoint.dir`` for whoever cleans that folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)
        self.count = 0
        self.paths: list[tuple[DataFrame, str]] = []
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > COLLECTED_BYTES:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(COLLECTED_BYTES))

    def cut(self, frame: DataFrame) -> DataFrame:
        """Write the frame and read it again, which ends its lineage."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        frame.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(frame.schema).parquet(path)
        self.paths.append((written, path))
        return written

    def drop(self, *frames: DataFrame) -> None:
        """Remove written tables that no later step reads, and let Spark remove the shuffles behind them."""
        files = SharedFiles(self.spark)
        for frame, path in [(f, p) for f, p in self.paths if any(f is x for x in frames)]:
            files.remove(path)
        self.paths = [(f, p) for f, p in self.paths if not any(f is x for x in frames)]
        release_shuffles(self.spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so other columns cannot clash."""
    return frame.select(*[frame[source].alias(name) for name, source in columns.items()])


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """Connected groups of the edges (a, b): one row (node, label) per node, label the smallest node.

    Alternates large-star and small-star steps until the edge set stands still. Each step is an
    aggregate and a join per node, so a node with very many neighbours is a partial aggregate before
    the shuffle and a skewed join side that adaptive execution splits. Labels never leave the executors;
    the driver sees a count and a checksum per round.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = work.cut(edges.select(high.alias("a"), low.alias("b")).filter("a != b").distinct())
    seen = _stamp(current)
    while seen[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(least, F.col("a") == F.col("k")).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b")).distinct()
        before, current = current, work.cut(small)
        work.drop(before)
        stamp = _stamp(current)
        if stamp == seen:
            break
        seen = stamp
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


BROADCAST_BYTES = 16 << 20


def written_bytes(frame: DataFrame) -> int:
    """Size of a frame that reads written files, as Spark's statistics have it."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def joined(wide: DataFrame, narrow: DataFrame, on, how: str, most: int | None = None) -> DataFrame:
    """Join wide rows (whole texts) with a written table: in place while that table's files are few MB, else by shuffle.

    With ``most`` the files may have that many bytes, and Spark may not collect larger ones either.
    """
    if written_bytes(narrow) <= (BROADCAST_BYTES if most is None else most):
        return wide.join(F.broadcast(narrow), on, how)
    return wide.join(narrow if most is None else narrow.hint("shuffle_hash"), on, how)
