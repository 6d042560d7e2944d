"""Exact order statistics from value counts.

Rows are counted per (group, value) first, so a hot group or value is combined
before the shuffle and no task ever holds the rows of a group. The counts are
sorted by range and written once; each sort partition sums its own stretch of a
group, and the stretches before it give the offset. How the values lie does not
matter: Spark draws the ranges from the counts themselves.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators.positions import sorted_slots


def tally(df, groups, value):
    """Count rows per (groups, value); null groups and null values are left out.

    The statistics below take such counts, so that several of them share one shuffle.
    """
    kept = df.dropna(subset=[*groups, value])
    return kept.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def sorted_counts(counts, groups, value):
    """Value counts sorted by (groups, value) and written; frames that are so already stay."""
    if "_part" in counts.columns:
        return counts
    return sorted_slots(counts, [*groups, value], "value-counts").drop("_slot")


def cumulate(counts, groups, value, n="n", wanted=None):
    """Add ``before`` (rows of the group with a smaller value) and ``total`` to value counts.

    ``wanted(first, last, total)`` may name the 0-based ranks of interest: sort partitions
    that hold none of them are left out.
    """
    groups = list(groups)
    stored = sorted_counts(counts, groups, value)
    # one row per sort partition and group in it
    stretches = stored.groupBy("_part", *groups).agg(F.sum(n).alias("_rows"))
    of_group = Window.partitionBy(*groups)
    stretches = stretches.select(
        "_part",
        *groups,
        (F.sum("_rows").over(of_group.orderBy("_part")) - F.col("_rows")).alias("_base"),
        "_rows",
        F.sum("_rows").over(of_group).alias("total"),
    )
    if wanted is not None:
        first = F.col("_base")
        stretches = stretches.filter(wanted(first, first + F.col("_rows") - 1, F.col("total")))
    stretch = Window.partitionBy("_part", *groups).orderBy(value)
    return (
        stored.join(stretches, ["_part", *groups])
        .withColumn("before", F.col("_base") + F.sum(n).over(stretch) - F.col(n))
        .drop("_part", "_base", "_rows")
    )


def _ranks(prob, total):
    """The two 0-based ranks around a quantile, and the weight of the upper one."""
    at = (total - 1) * F.lit(float(prob))
    low = F.floor(at)
    return low, F.ceil(at), at - low


def quantiles(counts, groups, value, probs):
    """Linearly interpolated quantiles per group from a ``tally``: columns q0, q1, ... as in probs."""

    def wanted(first, last, total):
        hits = F.lit(False)
        for p in probs:
            low, high, _ = _ranks(p, total)
            hits = hits | ((low <= last) & (high >= first))
        return hits

    running = cumulate(counts, groups, value, wanted=wanted)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    v = F.col(value).cast("double")
    picks = []
    for i, p in enumerate(probs):
        low, high, _ = _ranks(p, F.col("total"))
        picks.append(F.max(F.when((first <= low) & (low <= last), v)).alias(f"_lo{i}"))
        picks.append(F.max(F.when((first <= high) & (high <= last), v)).alias(f"_hi{i}"))
    found = running.groupBy(*groups).agg(F.max("total").alias("_total"), *picks)
    outs = []
    for i, p in enumerate(probs):
        weight = _ranks(p, F.col("_total"))[2]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + (hi - lo) * weight).alias(f"q{i}"))
    return found.select(*groups, *outs)


def quantile_scalar(counts, value, prob):
    """One quantile of a whole tallied column, as a scalar subquery."""
    return quantiles(counts, [], value, [prob]).select("q0").scalar()


def average_ranks(counts, groups, value, n="n"):
    """Add ``avg_rank``: the mean 1-based rank of the rows that share a value."""
    running = cumulate(counts, groups, value, n)
    return running.withColumn("avg_rank", F.col("before") + (F.col(n) + 1) / 2.0)


def box_stats(counts, groups, value):
    """Quartiles, 1.5 IQR whiskers and the number of points beyond them, per group of a tally."""
    counts = sorted_counts(counts, groups, value)
    quarts = quantiles(counts, groups, value, [0.25, 0.5, 0.75])
    quarts = quarts.select(
        *groups, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    v = F.col(value).cast("double")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    if groups:
        placed = counts.join(quarts, list(groups))
    else:
        names = ["q1", "median", "q3"]
        box = quarts.select(F.struct(*names).alias("s")).select("s").scalar()
        placed = counts.withColumn("_box", box).select(
            "*", *[F.col("_box")[c].alias(c) for c in names]
        )
    return placed.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        # a whisker does not end inside the box
        F.least(F.max("q1"), F.min(F.when(inside, v))).alias("whisker_low"),
        F.greatest(F.max("q3"), F.max(F.when(inside, v))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )


def outliers(df, value, box):
    """Rows beyond the whiskers of a one-row ``box_stats`` frame."""
    low = box.select("whisker_low").scalar()
    high = box.select("whisker_high").scalar()
    return df.filter((F.col(value) < low) | (F.col(value) > high))


def equal_width_bins(counts, value, bins=60):
    """Histogram of a tally over [min, max]; the last bin is closed; empty bins are kept."""
    v = F.col(value).cast("double")
    low, high = F.col("lo"), F.col("hi")
    flat = low == high
    # a single value gets a range of width one around it, as plotting libraries do
    limits = (
        counts.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        .select(
            F.when(flat, low - 0.5).otherwise(low).alias("lo"),
            F.when(flat, high + 0.5).otherwise(high).alias("hi"),
        )
        .select(F.struct("lo", "hi"))
        .scalar()
    )
    start, width = F.col("_s")["lo"], (F.col("_s")["hi"] - F.col("_s")["lo"])
    placed = counts.withColumn("_s", limits).select(
        F.least(F.lit(bins - 1), F.floor((v - start) * bins / width).cast("int")).alias("bin"), "n"
    )
    filled = placed.groupBy("bin").agg(F.sum("n").alias("n"))
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(filled, "bin", "left")
        .withColumn("_s", limits)
        .select(
            "bin",
            (start + width * F.col("bin") / bins).alias("bin_start"),
            (start + width * (F.col("bin") + 1) / bins).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
