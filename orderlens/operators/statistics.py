"""Correlations and rank tests, exact and tie-corrected, computed from value counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.functions.tails import (
    chi2_log_sf,
    chi2_sf,
    correlation_log_p,
    correlation_p,
    neg_log10,
    normal_log_sf,
    normal_sf,
)
from orderlens.operators.histograms import average_ranks
from orderlens.scratch import materialize


MOST_COLUMNS = 62  # one bit of a long each
LOST = 1e-8  # share of a sum of squares that its deviations must have


def pearson_pairs(df, columns, centers=None):
    """Pearson correlation of every pair i < j, over the rows where both are present.

    One aggregation: rows are grouped by which columns they have, and each group sums the
    products of all its columns; a pair then adds up the groups that have both. Long form
    (a, b, n, r); r is null when a column of the pair is constant. ``centers`` gives a value near the
    mean of a column whose mean is large beside its spread; where sums without it would lose
    the digits of r, the query fails and says so.
    """
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    span = range(len(columns))
    middle = [float((centers or {}).get(c, 0.0)) for c in columns]
    around = df.selectExpr(
        " + ".join(f"IF(`{c}` IS NULL, 0L, {1 << i}L)" for i, c in enumerate(columns)) + " as held",
        *[f"coalesce(double(`{c}`) - {m!r}D, 0D) as x{i}" for i, (c, m) in enumerate(zip(columns, middle))],
    )
    pairs = [(i, j) for i in span for j in span if i < j]
    single = [f"{f}(x{i}) as {name}{i}" for i in span for name, f in (("s", "sum"), ("l", "min"), ("h", "max"))]
    products = [f"sum(x{i} * x{j}) as p{i}_{j}" for i, j in [*pairs, *[(i, i) for i in span]]]
    sums = around.groupBy("held").agg(*map(F.expr, ["count(1) as n", *single, *products]))
    # one row per group of columns present and pair, not per row of data
    cells = ", ".join(
        f"IF(held & {1 << i | 1 << j}L = {1 << i | 1 << j}L, struct({i} as i, {j} as j, n, s{i} as x, s{j} as y, "
        f"p{i}_{i} as xx, p{j}_{j} as yy, p{i}_{j} as xy, l{i} as xl, h{i} as xh, l{j} as yl, h{j} as yh), NULL)"
        for i, j in pairs
    )
    named = F.array(*map(F.lit, columns))
    found = (
        sums.selectExpr(f"inline(array_compact(array({cells})))")
        .groupBy("i", "j")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(c).alias(c) for c in ("x", "y", "xx", "yy", "xy")],
            F.expr("min(xl) < max(xh) AND min(yl) < max(yh)").alias("varies"),
        )
        .withColumn("a", F.get(named, F.col("i")))
        .withColumn("b", F.get(named, F.col("j")))
    )
    moments = found.withColumn("dx", F.expr("xx - x * x / n")).withColumn("dy", F.expr("yy - y * y / n"))
    lost = F.expr(f"dx < xx * {LOST} OR dy < yy * {LOST}")
    message = F.concat(F.lit("pass centers for the columns "), F.col("a"), F.lit(" and "), F.col("b"))
    r = F.when(lost, F.raise_error(message).cast("double")).otherwise(F.expr("(xy - x * y / n) / sqrt(dx * dy)"))
    return moments.select("a", "b", "n", F.when(F.col("varies"), r).alias("r"))


def correlations_of(pairs, column):
    """The row of a pair matrix for one column: (other, n, r)."""
    other = F.when(F.col("a") == column, F.col("b")).otherwise(F.col("a"))
    return pairs.filter((F.col("a") == column) | (F.col("b") == column)).select(
        other.alias("other"), "n", "r"
    )


def spearman(df, features, target):
    """Spearman rho of each feature against one target, ranked inside the pairs
    where both are present, with the two-sided p-value: (feature, n, rho, p_value, neg_log10_p)."""
    cells = ", ".join(
        f"struct('{f}' as feature, double(`{f}`) as x, `{target}` as y)" for f in features
    )
    long = df.selectExpr(f"inline(array({cells}))")
    joint = materialize(
        long.filter("x is not null and y is not null")
        .groupBy("feature", "x", "y")
        .agg(F.count(F.lit(1)).alias("n")),
        "value-pairs",
    )
    # both sides are ranked together: one sort of their value counts
    sides = "inline(array(struct('x' as side, x as v, n), struct('y' as side, double(y) as v, n)))"
    margins = joint.selectExpr("feature", sides)
    margins = margins.groupBy("feature", "side", "v").agg(F.sum("n").alias("n"))
    ranked = average_ranks(margins, ["feature", "side"], "v")
    middle = (F.col("total") + 1) / 2.0

    def ranks(side):
        value = F.col("v").cast(joint.schema[side].dataType).alias(side)
        rows = ranked.filter(F.col("side") == side)
        return rows.select("feature", value, (F.col("avg_rank") - middle).alias(f"r{side}"))

    placed = joint.join(ranks("x"), ["feature", "x"]).join(ranks("y"), ["feature", "y"])
    n = F.col("n")
    sums = placed.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.sum(n * F.col("rx") * F.col("ry")).alias("_xy"),
        F.sum(n * F.col("rx") * F.col("rx")).alias("_xx"),
        F.sum(n * F.col("ry") * F.col("ry")).alias("_yy"),
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy")))
    return (
        sums.select("feature", "n", rho.alias("rho"))
        .withColumn("p_value", correlation_p("rho", "n"))
        .withColumn("neg_log10_p", neg_log10(correlation_log_p("rho", "n")))
    )


def _cubed_ties(t):
    t = t.cast("double")
    return F.sum(t * t * t - t)


def mann_whitney_greater(df, value, first, second):
    """One-sided Mann-Whitney U (first sample tends to be larger), large-sample form.

    ``first`` and ``second`` are conditions that pick the two samples. Also gives the
    sample means and the rank-biserial effect size 1 - 2U / (n1 n2).
    """
    picked = df.select(
        F.col(value).alias("v"),
        F.when(first, 1).otherwise(0).alias("i"),
        F.when(second, 1).otherwise(0).alias("j"),
    ).filter("v is not null and i + j > 0")
    counts = picked.groupBy("v").agg(
        F.sum("i").alias("n1"), F.sum("j").alias("n2"), F.count(F.lit(1)).alias("n")
    )
    v = F.col("v").cast("double")
    sums = average_ranks(counts, [], "v").agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.try_divide(F.sum(v * F.col("n1")), F.sum("n1")).alias("mean1"),
        F.try_divide(F.sum(v * F.col("n2")), F.sum("n2")).alias("mean2"),
        F.sum(F.col("avg_rank") * F.col("n1")).alias("_r1"),
        _cubed_ties(F.col("n")).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    return (
        sums.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2.0)
        .withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2.0 - 0.5, spread))
        .withColumn("p_value", normal_sf("z"))
        .withColumn("neg_log10_p", neg_log10(normal_log_sf("z")))
        .withColumn("rank_biserial", 1 - F.try_divide(2 * F.col("u"), n1 * n2))
        .drop("_r1", "_ties")
    )


def kruskal_wallis(df, value, group):
    """Tie-corrected Kruskal-Wallis H over the groups present: (n, groups, h, p_value,
    neg_log10_p)."""
    cells = materialize(
        df.dropna(subset=[value, group])
        .groupBy(F.col(value).alias("v"), F.col(group).alias("g"))
        .agg(F.count(F.lit(1)).alias("c")),
        "value-groups",
    )
    margin = average_ranks(cells.groupBy("v").agg(F.sum("c").alias("n")), [], "v")
    per_group = (
        cells.join(margin.select("v", "avg_rank"), "v")
        .groupBy("g")
        .agg(F.sum("c").alias("c"), F.sum(F.col("avg_rank") * F.col("c")).alias("r"))
    )
    ties = margin.agg(_cubed_ties(F.col("n"))).scalar()
    r, c = F.col("r"), F.col("c").cast("double")
    sums = per_group.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(r * r / c).alias("_s")
    ).withColumn("_ties", ties)
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    return (
        sums.withColumn("h", F.try_divide(raw, 1 - F.try_divide(F.col("_ties"), n * n * n - n)))
        .withColumn("p_value", chi2_sf("h", "groups - 1"))
        .withColumn("neg_log10_p", neg_log10(chi2_log_sf("h", "groups - 1")))
        .drop("_s", "_ties")
    )


def benjamini_hochberg(tests, p, key, alpha=0.05):
    """Add ``p_adjusted`` and ``significant`` to a frame with one row per test.

    A test without p-value (a constant feature) does not count and gets null for both. The
    window spans the list of tests that the caller named, not data rows.
    """
    by_p = Window.orderBy(F.col(p).asc_nulls_last(), F.col(key).asc())
    m = F.count(p).over(Window.partitionBy())
    scaled = tests.withColumn("_scaled", F.col(p) * m / F.row_number().over(by_p))
    onward = by_p.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_scaled").over(onward)))
    return (
        scaled.withColumn("p_adjusted", adjusted)
        .withColumn("significant", F.col("p_adjusted") <= alpha)
        .drop("_scaled")
    )
