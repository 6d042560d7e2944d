"""Frequency tables, descriptive statistics and ranked extracts."""

from functools import reduce

from pyspark.sql import functions as F

from orderlens.operators.histograms import quantiles, sorted_counts

def frequency(df, column, keep_null=False):
    """Count and percent of each value."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def describe(df, columns, probs=(0.25, 0.5, 0.75)):
    """Count, mean, sample deviation, min, exact quantiles and max of numeric columns."""
    cells = ", ".join(f"struct('{c}' as column, double(`{c}`) as v)" for c in columns)
    long = df.selectExpr(f"inline(array({cells}))").filter("v is not null")
    counts = sorted_counts(
        long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), ["column"], "v"
    )
    v, n = F.col("v"), F.col("n")
    moments = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        (F.sum(v * n) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    # second pass around the mean keeps the deviation exact for large values
    # (one row per requested column on the broadcast side)
    means = F.broadcast(moments.select("column", F.col("mean").alias("m")))
    around = counts.join(means, "column")
    deviation = around.groupBy("column").agg(
        F.sqrt(
            F.try_divide(F.sum(n * (v - F.col("m")) * (v - F.col("m"))), F.sum("n") - 1)
        ).alias("std")
    )
    cuts = quantiles(counts, ["column"], "v", probs)
    cuts = cuts.select(
        "column", *[F.col(f"q{i}").alias(f"p{p * 100:g}") for i, p in enumerate(probs)]
    )
    order = ["column", "count", "mean", "std", "min", *[f"p{p * 100:g}" for p in probs], "max"]
    return moments.join(deviation, "column").join(cuts, "column").select(*order)


def top(df, k, *order):
    """First k rows in a complete order."""
    return df.orderBy(*order).limit(k)


def stack(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def label_order(column, labels):
    """Sort key for a fixed list of labels; others come last."""
    key = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels))):
        key = F.when(column == label, i).otherwise(key)
    return key


def lookup_frame(spark, mapping, key, value):
    """Literal dictionary as a two-column frame."""
    rows = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in mapping.items()])
    return spark.range(1).select(F.inline(rows))
