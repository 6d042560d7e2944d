"""Data-quality reports: column profile, duplicates, shapes, violations."""

from functools import reduce

from pyspark.sql import functions as F


def _one_pass(df, label, value, cells):
    """One aggregate row turned into a frame (label, value): cells are (label, expression)."""
    rows = ", ".join(f"struct('{name}' as {label}, {expr} as {value})" for name, expr in cells)
    return df.agg(F.expr(f"array({rows})").alias("cells")).selectExpr("inline(cells)")


def _whole(column):
    """A column of whole numbers or dates as a long; None for other types."""
    kind = column.dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return f"bigint(`{column.name}`)"
    by_kind = {"boolean": "bigint(int({}))", "date": "bigint(unix_date({}))"}
    return by_kind[kind].format(f"`{column.name}`") if kind in by_kind else None


def _exact_counts(df):
    """(position, rows, nulls, distinct_values) of every column.

    Whole numbers are counted as bits: one row of the aggregation holds 64 neighbouring values. Other
    values are counted one by one, in a slot of their type.
    """
    types = sorted({c.dataType.simpleString() for c in df.schema if _whole(c) is None})
    slots = [f"v{i}" for i in range(len(types))]

    def cell(i, column):
        whole = _whole(column)
        own = column.dataType.simpleString()
        word = f"shiftright({whole}, 6) as word, shiftleft(1L, int({whole} & 63)) as bits"
        filled = [
            f"{f'`{column.name}`' if t == own else f'cast(null as {t})'} as {slot}"
            for t, slot in zip(types, slots)
        ]
        parts = [word if whole else "cast(null as bigint) as word, cast(null as bigint) as bits", *filled]
        return f"struct({i} as position, {', '.join(parts)})"

    cells = ", ".join(cell(i, c) for i, c in enumerate(df.schema))
    values = (
        df.selectExpr(f"inline(array({cells}))")
        .groupBy("position", "word", *slots)
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("bits"))
    )
    missing = F.expr(" and ".join(f"{slot} is null" for slot in ["word", *slots]))
    held = F.when(F.col("word").isNotNull(), F.bit_count("bits")).otherwise(F.when(missing, 0).otherwise(1))
    return values.groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(held).cast("long").alias("distinct_values"),
    )


def column_profile(df, approximate=False):
    """Per column: position, type, nulls, percent null, distinct values.

    The exact form counts values, combined before the shuffle. The approximate form needs one
    pass and no shuffle of values.
    """
    if approximate:
        cells = ", ".join(
            f"struct({i} as position, count(1) as rows, count_if(`{c}` is null) as nulls, "
            f"approx_count_distinct(`{c}`) as distinct_values)"
            for i, c in enumerate(df.columns)
        )
        sums = df.agg(F.expr(f"array({cells})").alias("cells")).selectExpr("inline(cells)")
    else:
        sums = _exact_counts(df)
    names = F.lit([c.name for c in df.schema])
    dtypes = F.lit([c.dataType.simpleString() for c in df.schema])
    percent = F.rint(F.col("nulls") / F.col("rows") * 100 * 100.0) / 100.0
    return sums.select(
        "position",
        names[F.col("position")].alias("column"),
        dtypes[F.col("position")].alias("dtype"),
        "nulls",
        percent.alias("null_pct"),
        "distinct_values",
    )


def residual_nulls(df):
    """Columns that hold nulls, with their count, in one pass."""
    cells = [(c, f"count_if(`{c}` is null)") for c in df.columns]
    return _one_pass(df, "column", "nulls", cells).filter("nulls > 0")


def duplicate_rows(df):
    """One row: number of rows and of rows that repeat an earlier one (null equals null)."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def per_table(tables, report):
    """Run a report on every table and stack the results under the table name."""
    named = [
        report(df).select(F.lit(name).alias("table"), "*") for name, df in sorted(tables.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), named)


def shape(df):
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def violations(df, checks):
    """Count the rows that break each named SQL condition: (check, violations)."""
    cells = [(name, f"count_if({bad})") for name, bad in checks.items()]
    return _one_pass(df, "check", "violations", cells)


def repeated_keys(df, key, name):
    """Rows in excess of one per key, as a row of a violations frame."""
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.lit(name).alias("check"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")
    )


def funnel(df, steps):
    """Rows that pass each step and all steps before it, and their share of the first.

    ``steps`` are (label, SQL condition) in order; a condition that is null does not pass.
    """
    cells, passed = [], []
    for i, (label, condition) in enumerate(steps):
        passed.append(f"({condition})")
        cells.append(f"struct({i} as step, '{label}' as label, count_if({' and '.join(passed)}) as rows)")
    counts = df.agg(F.expr(f"array({', '.join(cells)})").alias("cells"))
    share = "try_divide(line.rows * 100D, cells[0].rows) as pct_of_first"
    return counts.selectExpr("cells", "explode(cells) as line").selectExpr("line.*", share)
