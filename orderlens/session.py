"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


def build_session(app_name="orderlens", master=None, **conf):
    """Session with runtime re-planning on: coalescing, skew splitting, checked broadcasts."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where that costs one more shuffle after the join
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # a job of many small stages compiles more classes than the default cache keeps
        "spark.sql.codegen.cache.maxEntries": "4000",
        # no Python call-site capture per column: plans are built from many small expressions
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
