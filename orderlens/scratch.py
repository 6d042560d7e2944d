"""Written intermediate tables.

A step whose rows are read more than once and must not change between reads
(positions after a range sort) is written as Parquet to the shared folder of
``spark.checkpoint.dir``. The files survive the loss of executors. Lazy results still read
them, so they stay until the ``scratch_scope`` they were made in ends, or until ``clear_scratch``.
"""

import tempfile
import uuid
from contextlib import contextmanager

DIR_KEY = "spark.checkpoint.dir"
_local = {}
_scopes = []


def _session_folder(spark):
    """Folder of this application; a machine-local one only for a local master."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get(DIR_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="orderlens-")
        base = _local[app]
    return f"{base.rstrip('/')}/orderlens-{app}"


def scratch_path(spark, label):
    """Fresh path below the folder of this application."""
    path = f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df, label):
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark):
    """Delete what is written inside the block when it ends; results must have been used by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def clear_scratch(spark):
    """Delete the written tables of this application once no result needs them."""
    _delete(spark, _session_folder(spark))
