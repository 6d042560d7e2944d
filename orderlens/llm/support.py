"""Helpers shared by the operators of this subpackage."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from orderlens.scratch import materialize, scratch_path

__all__ = ["checked_broadcast", "materialize", "scratch_path", "slices", "small_batches", "table"]

# ids sent whole to every executor: at most this many rows of a few bytes
BROADCAST_ROWS = 200_000


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches, rows=512):
    """Arrow batches cut into pieces of few rows, so that long texts stay within memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def small_batches(spark, rows=1000):
    """Arrow batches of at most ``rows`` rows for what runs inside the block.

    Both sides of a Python task hold a batch, in buffers that double as they grow.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:  # 0 or less: no limit
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checked_broadcast(df, most=BROADCAST_ROWS):
    """``df`` with a broadcast hint if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
