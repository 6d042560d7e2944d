"""Vectors as bytes, for the operators on embeddings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def usable(table):
    """(vec_id, vector binary): rows whose vector can be compared, as little-endian doubles.

    A vector that is null, empty, zero or holds null, NaN or infinite components takes no part.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    some = F.expr("exists(embedding, x -> x <> 0)")
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound & some, F.lit(False)))
    return rows.mapInArrow(_packed, "vec_id long, vector binary")


def _packed(batches):
    for batch in batches:
        column = batch.column("embedding")
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        ends = np.cumsum([0, *(len(x) for x in column)])
        packed = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "vector"])


def matrix(packed):
    """Rows of equal length from their bytes."""
    packed = list(packed)
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def drawn_vectors(vectors, most, salt):
    """At most about ``most`` distinct vectors drawn by a hash of their bytes, as a matrix."""
    rows = vectors.select("vector").distinct()
    share = min(1.0, most / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64(F.lit(salt), "vector"), F.lit(1 << 30)) < int(share * (1 << 30))
    packed = sorted(bytes(r.vector) for r in rows.where(drawn).collect())
    return matrix(packed) if packed else np.zeros((0, 0))
