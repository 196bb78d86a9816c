"""Ordered computations per group that stay distributed when one group is huge.

A window over a group runs in one task. Ordinary groups are left to that; the *hot* ones are cut
into steps (a stretch of time, a slice of the ids). Rows are then windowed inside a step, and one
summary row per step is windowed across the group. An ordinary group is a single step: it takes the
same road, at the cost of one shuffle of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups above SLICE_ROWS rows are hot and cut into steps. The order of rows is the same either way.
SLICE_ROWS = 10_000
#: Pieces that one crowded step is cut into at most, and sampled values per piece.
PIECES, SAMPLED = 64, 32


def id_digest(key: str) -> Column:
    """A digest that orders ids at random; ties in it are broken by the id."""
    return F.md5(F.col(key).cast("string"))


def id_slice(key: str) -> Column:
    """The first four hex digits of the digest, 0 … 65535: it does not decrease along the digest."""
    return F.conv(F.substring(id_digest(key), 1, 4), 16, 10).cast("bigint")


def hot_groups(df: DataFrame, group: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Keys of the groups that are too large for one task."""
    return (df.groupBy(*group).agg(F.count("*").alias("_rows"))
            .filter(F.col("_rows") > slice_rows)
            .select(*group, F.lit(True).alias("_hot")))


def _in_steps(df: DataFrame, hot: DataFrame, group: Sequence[str], step: Column, how: str) -> DataFrame:
    return (df.join(hot, list(group), how)
            .withColumn("_step", F.when(F.col("_hot"), step.cast("bigint")).otherwise(F.lit(0)))
            .drop("_hot"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], step: Column,
           position: str = "position", size: str | None = None, slice_rows: int = SLICE_ROWS,
           sized_by: DataFrame | None = None) -> DataFrame:
    """0-based ``position`` of each row in its group by ``order``, along which ``step`` must not decrease.

    ``size``, when named, receives the number of rows in the group. ``sized_by`` may stand in for
    ``df`` when group sizes are cheaper to tell from something else; a rough count will do.
    """
    cell = [*group, "_step"]
    hot = hot_groups(df if sized_by is None else sized_by, group, slice_rows)
    inside = Window.partitionBy(*cell)
    # hot groups are at most one per ``slice_rows`` rows; rows move once, to their cell, before digests widen them
    rows = (_in_steps(df, F.broadcast(hot), group, step, "left").repartition(*cell)
            .withColumn("_row", F.row_number().over(inside.orderBy(*order)) - 1))
    across = Window.partitionBy(*group)
    earlier = across.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    cells = _in_steps(df, hot, group, step, "inner").groupBy(*cell).agg(F.count("*").alias("_n"))
    offsets = [F.sum("_n").over(earlier).alias("_before")]
    if size:
        rows = rows.withColumn("_size", F.count("*").over(inside))
        offsets.append(F.sum("_n").over(across).alias("_hot_size"))
    placed = rows.join(cells.select(*cell, *offsets), cell, "left").withColumn(
        position, F.coalesce("_before", F.lit(0)) + F.col("_row"))
    if size:
        placed = placed.withColumn(size, F.coalesce("_hot_size", "_size"))
    return placed.drop("_step", "_row", "_before", "_size", "_hot_size")


def splitters(df: DataFrame, cell: Sequence[str], order: Sequence[str], slice_rows: int) -> DataFrame:
    """Where cells of more than ``slice_rows`` rows are to be cut: the cell's keys and ``_bounds``, ascending.

    The bounds are quantiles of a sample of the order's values, chosen by their hash, so every run has the same ones.
    A cell gets at most PIECES pieces and about PIECES * SAMPLED sampled values, however large it is.
    """
    pieces = F.least(F.ceil(F.col("_n") / slice_rows), F.lit(PIECES)).cast("int")
    sizes = (df.groupBy(*cell).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows)
             .withColumn("_pieces", pieces))
    sampled = df.join(sizes, list(cell)).filter(
        F.pmod(F.xxhash64(*order), F.col("_n")) < F.col("_pieces") * SAMPLED)
    marks = sampled.groupBy(*cell).agg(
        F.first("_pieces").alias("_pieces"), F.sort_array(F.collect_set(F.struct(*order))).alias("_marks"))
    at = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.element_at(
        "_marks", (F.floor(i * F.size("_marks") / F.col("_pieces")) + 1).cast("int")))
    return marks.select(*cell, at.alias("_bounds"))


def previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, step: Column,
             name: str = "previous_value", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Value of the row before in the group (a lag).

    ``step`` must not decrease along ``order``. A step that is still too large, down to a single point of time, is cut
    into pieces at sampled values of ``order``. Only the first row of a hot group's piece looks outside it: it takes
    the last row of the nearest earlier piece.
    """
    place = [*group, "_step"]
    cell = [*place, "_piece"]
    hot = hot_groups(df, group, slice_rows)
    stepped = _in_steps(df, hot, group, step, "inner")
    bounds = splitters(stepped, place, order, slice_rows)
    at = F.struct(*order)
    piece = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= at)), F.lit(0))

    def in_pieces(rows: DataFrame) -> DataFrame:
        return rows.join(bounds, place, "left").withColumn("_piece", piece).drop("_bounds")

    inside = Window.partitionBy(*cell).orderBy(*order)
    rows = (in_pieces(_in_steps(df, hot, group, step, "left"))
            .withColumn("_row", F.row_number().over(inside))
            .withColumn("_lag", F.lag(value).over(inside)))
    last = F.max_by(F.struct(F.col(value).alias("v")), at)
    carried = (in_pieces(stepped).groupBy(*cell).agg(last.alias("_last"))
               .select(*cell, F.lag("_last").over(
                   Window.partitionBy(*group).orderBy("_step", "_piece")).alias("_carry")))
    return (rows.join(carried, cell, "left")
            .withColumn(name, F.when(F.col("_row") == 1, F.col("_carry.v")).otherwise(F.col("_lag")))
            .drop("_row", "_lag", "_carry", "_step", "_piece"))


def report_rank(report: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """Competition rank over a whole report, highest value first and NULLs last.

    Rows are counted per distinct value first; only those counts (of rounded figures or head counts) are put in
    order together, and the rank is joined back on the value.
    """
    counts = report.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ahead = (Window.orderBy(F.col("_value").desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("_value", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1).alias(rank))
    return report.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
