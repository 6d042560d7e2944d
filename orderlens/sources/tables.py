"""Loading and storing the source tables, and running SQL scripts over them."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schemas import TABLES
from orderlens.sources.sinks import replace_table

RESCUED = T.MapType(T.StringType(), T.StringType())

# free text with line breaks; files of the other tables stay splittable
MULTI_LINE = ("order_reviews",)


# column that keeps the texts of values that do not parse, by column name
RESCUE = "_rejected"


def typed_columns(df):
    """Columns of a loaded table that came from text of another type."""
    return [f.name for f in df.schema if f.dataType not in (T.StringType(), RESCUED)]


def read_csv(spark, path, schema, multi_line=False, rescue=False):
    """CSV with a header, in any column order; a value that does not parse becomes null.

    With ``rescue`` a row keeps the texts of such values in the column RESCUE: a map from column to
    text, null where all values parse. An empty value is null and not rejected.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    types = {f.name: f.dataType for f in schema}
    parsed = {c: F.col(c).try_cast(types[c]) if c in types else F.col(c) for c in raw.columns}
    columns = list(parsed.values())
    if rescue:
        failed = [
            F.when(
                F.col(c).isNotNull() & parsed[c].isNull(),
                F.struct(F.lit(c).alias("key"), F.col(c).alias("value")),
            )
            for c in raw.columns
            if types.get(c, T.StringType()) != T.StringType()
        ]
        found = F.array_compact(F.array(*failed)) if failed else None
        kept = F.lit(None) if found is None else F.when(F.size(found) > 0, F.map_from_entries(found))
        columns.append(kept.cast(RESCUED).alias(RESCUE))
    return raw.select(*columns)


def _existing(spark, folder, files, schemas, rescue=False):
    tables = {}
    for name, file in files.items():
        try:
            path = f"{folder.rstrip('/')}/{file}"
            tables[name] = read_csv(spark, path, schemas[name], name in MULTI_LINE, rescue)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return tables


def load_tables(spark, folder, files=None, schemas=None):
    """Load every table whose file exists.

    ``files`` maps table name to file name, ``<table>.csv`` by default. Returns the
    tables and a lazy report frame (table, status, rows).
    """
    schemas = schemas or TABLES
    files = files or {name: f"{name}.csv" for name in schemas}
    tables = _existing(spark, folder, files, schemas)
    lines = []
    for name in files:
        if name in tables:
            counted = tables[name].agg(F.count(F.lit(1)).alias("rows"))
        else:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
        status = F.lit("loaded" if name in tables else "skipped")
        lines.append(counted.select(F.lit(name).alias("table"), status.alias("status"), "rows"))
    return tables, reduce(lambda a, b: a.unionByName(b), lines)


def ingest(spark, folder, target, files=None, schemas=None, rescue=False):
    """Store every table whose CSV file exists as Parquet below ``target``, replacing it.

    Rows are counted while they are written. Returns a report frame (table, status, rows). With
    ``rescue`` the tables keep rejected values (see ``read_csv``), and the report has ``rejected``, a map
    from each typed column to the number of its values that did not parse.
    """
    files = files or {name: f"{name}.csv" for name in schemas or TABLES}
    tables = _existing(spark, folder, files, schemas or TABLES, rescue)
    report = []
    for name in files:
        rows, rejected = None, None
        if name in tables:
            seen = Observation(f"ingest-{name}")
            typed = typed_columns(tables[name]) if rescue else []
            counts = [F.count_if(F.col(RESCUE)[c].isNotNull()).alias(c) for c in typed]
            counted = tables[name].observe(seen, F.count(F.lit(1)).alias("_rows"), *counts)
            replace_table(counted, f"{target.rstrip('/')}/{name}")
            rows = int(seen.get["_rows"])
            rejected = {c: int(seen.get[c]) for c in typed}
        line = (name, "loaded" if name in tables else "skipped", rows)
        report.append((*line, rejected) if rescue else line)
    kind = "table string, status string, rows bigint"
    return spark.createDataFrame(report, f"{kind}, rejected map<string, bigint>" if rescue else kind)


def read_parquet_tables(spark, folder, names=None):
    """Lazy scans: a table that no job uses is never read."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names or TABLES}


def run_script(spark, text, tables):
    """Run one SQL statement over the given tables, bound by name as {table}."""
    return spark.sql(text, **tables)
