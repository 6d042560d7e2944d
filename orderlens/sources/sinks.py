"""Writing results."""

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from orderlens.operators.positions import number_rows


def _files(spark, path):
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _published(spark, path, write):
    """Let ``write`` fill a folder beside ``path`` and put it in the place of ``path`` by renaming.

    Until the new folder is whole the old one is not touched: a failed write leaves it as it was. A
    reader that lists the folder between the two renames finds none; a failed second rename puts the
    old one back.
    """
    path = path.rstrip("/")
    files, make = _files(spark, path)
    mark = uuid.uuid4().hex
    # names with a leading underscore are not read as tables beside this one
    parent, _, name = path.rpartition("/")
    fresh, old = f"{parent}/_new-{name}-{mark}", f"{parent}/_old-{name}-{mark}"
    try:
        write(fresh)
    except BaseException:
        files.delete(make(fresh), True)
        raise
    replaced = files.exists(make(path))
    if replaced and not files.rename(make(path), make(old)):
        files.delete(make(fresh), True)
        raise OSError(f"{path} could not be set aside")
    if not files.rename(make(fresh), make(path)):
        if replaced:
            files.rename(make(old), make(path))
        files.delete(make(fresh), True)
        raise OSError(f"{path} could not be replaced")
    if replaced:
        files.delete(make(old), True)


def replace_table(df, path, partition_by=None):
    """Replace a stored table by the frame, which may read the old table."""

    def write(folder):
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(folder)

    _published(df.sparkSession, path, write)


def write_ordered(df, path, order, into="position"):
    """Replace a stored table by the frame in a total order, with the 1-based position of each row.

    The rows are sorted by range, so the files follow each other and none is sorted in one task.
    ``order`` should end in a unique column.
    """
    numbered = number_rows(df, order, into, "_n").drop("_n")
    replace_table(numbered.repartitionByRange(into).sortWithinPartitions(into), path)


def write_csv(df, path, order=None):
    """CSV with a header; ``order`` gives the files a total order."""
    out = df.orderBy(*order) if order else df
    write = lambda folder: out.write.csv(folder, header=True, escape='"')
    _published(df.sparkSession, path, write)


def export(df, name, path, fmt="parquet", order=None):
    """Write and return a one-row receipt (name, rows, columns) counted during the write."""
    seen = Observation(f"export-{name}")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        write_csv(watched, path, order)
    else:
        replace_table(watched.orderBy(*order) if order else watched, path)
    receipt = [(name, int(seen.get["rows"]), len(df.columns))]
    return df.sparkSession.createDataFrame(receipt, "name string, rows bigint, columns int")
