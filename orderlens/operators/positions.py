"""Row numbers over a whole table, or within groups of any size, without one-task windows.

The rows are range-sorted and written once. Every stored row carries the sort
partition and its index there, so a position is that index plus the number of
rows in the partitions before: a join with one row per partition.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.scratch import materialize

# monotonically_increasing_id keeps the partition above bit 33, the row index below
INDEX_BITS = 33


def sorted_slots(df, keys, label):
    """``df`` sorted by range and written, with ``_part`` (sort partition) and ``_slot`` (place in it)."""
    stored = materialize(
        df.orderBy(*keys).withColumn("_slot", F.monotonically_increasing_id()), label
    )
    return stored.withColumn("_part", F.shiftright("_slot", INDEX_BITS).cast("int"))


def number_rows(df, keys, into="row_id", total_into="n_rows"):
    """Add the 1-based position of every row in the order ``keys`` and the row count.

    ``keys`` should end in a unique column. They may be sort expressions.
    """
    stored = sorted_slots(df, keys, "positions")
    by_part = Window.orderBy("_part")  # one row per sort partition
    before = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(
        "_part",
        (F.sum("_n").over(by_part) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias(total_into),
    )
    index = F.col("_slot").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    return (
        stored.join(F.broadcast(before), "_part")
        .withColumn(into, F.col("_before") + index + 1)
        .drop("_part", "_slot", "_before")
    )


def number_within(df, group, keys, into="row_id", total_into="n_rows"):
    """Add the 1-based position of a row within its group and the size of the group.

    A group may be larger than a task: each sort partition numbers its own stretch
    of the group, and the few groups that cross a partition border get the counts
    of their other stretches added.
    """
    g = F.col(group)
    stored = sorted_slots(df, [g, *keys], "grouped-positions")
    stretch = Window.partitionBy("_part", group)
    local = stored.withColumn("_i", F.row_number().over(stretch.orderBy("_slot"))).withColumn(
        "_m", F.count(F.lit(1)).over(stretch)
    )

    # at most one group crosses each border, so these frames hold O(partitions) rows
    key = F.struct(g.alias("_g"))  # a struct, so that a null group counts as an end too
    crossing = (
        stored.groupBy("_part")
        .agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_ends"))
        .select(F.inline("_ends"))
        .groupBy("_g")
        .agg(F.count(F.lit(1)).alias("_parts"))
        .filter("_parts > 1")
    )
    pieces = (
        stored.join(F.broadcast(crossing), g.eqNullSafe(F.col("_g")), "left_semi")
        .groupBy(F.col("_part").alias("_p"), g.alias("_g"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    of_group = Window.partitionBy("_g")
    pieces = pieces.select(
        "_p",
        "_g",
        (F.sum("_n").over(of_group.orderBy("_p")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(of_group).alias("_all"),
    )
    here = (F.col("_part") == F.col("_p")) & g.eqNullSafe(F.col("_g"))
    return (
        local.join(F.broadcast(pieces), here, "left")
        .withColumn(into, F.col("_i") + F.coalesce("_before", F.lit(0)))
        .withColumn(total_into, F.coalesce("_all", "_m"))
        .drop("_part", "_slot", "_i", "_m", "_p", "_g", "_before", "_all")
    )


def quintile_score(df, value, key, ascending=True, into="score"):
    """Score 1..5 by right-closed, linearly interpolated quintiles of the first-come rank.

    Ties in ``value`` are ranked by ``key`` ascending, in both directions.
    """
    first = F.col(value).asc() if ascending else F.col(value).desc()
    ranked = number_rows(df, [first, F.col(key).asc()], "_rank", "_total")
    # ceil(5 * (rank - 1) / (total - 1)) in whole numbers, never below 1
    step = F.greatest(F.col("_total") - 1, F.lit(1))
    score = F.floor((5 * (F.col("_rank") - 1) + step - 1) / step)
    return ranked.withColumn(into, F.greatest(F.lit(1), score).cast("int")).drop("_rank", "_total")
