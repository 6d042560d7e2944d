"""Samples of an exact size, fixed by the keys of the rows.

Every row has a place, a whole number that scatters its key. A sample holds the rows with the
smallest places, so it does not depend on how the rows are dealt out. The place of the
last one is found by counts in ever finer buckets, a bounded number per group, and the rows are
then kept by a comparison with it: no task sorts or gathers the rows of a group.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators.positions import number_within
from orderlens.scratch import materialize

# every value 0 .. MODULUS-1 is hit once by key * STEP mod MODULUS: a cheap fixed shuffle of keys
STEP, MODULUS = 48271, 2147483647
# bits of the place below each level of buckets: 2,048, then 1,024, then 1,024 per bucket chosen
LEVELS = (20, 10, 0)


def scattered(key, seed=42):
    """Fixed pseudo-random order of integer keys; text keys are hashed first."""
    return F.pmod((F.pmod(key, F.lit(MODULUS)) + seed) * F.lit(STEP), F.lit(MODULUS))


def _same(left, right, groups):
    pairs = [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in groups]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def cut_offs(places, groups, n):
    """(groups, cut, below, at): the place of the n-th row of each group with more than n rows,
    and how many of its rows have smaller and equal places. ``places``: (groups, place)."""
    running = Window.partitionBy(*groups).orderBy("bucket")
    rows = places.withColumn("below", F.lit(0).cast("long"))
    for level, shift in enumerate(LEVELS):
        if level:
            inside = F.shiftright("p.place", LEVELS[level - 1]) == F.col("c.bucket")
            rows = places.alias("p").join(chosen.alias("c"), _same("p", "c", groups) & inside)
            rows = rows.select(*[F.col(f"p.{g}") for g in groups], "place", "below")
        counts = rows.groupBy(*groups, F.shiftright("place", shift).alias("bucket")).agg(
            F.count(F.lit(1)).alias("at"), F.max("below").alias("below")
        )
        until = F.col("below") + F.sum("at").over(running)
        marked = counts.withColumn("until", until)
        # the last level also knows whether rows are left over; a group without is whole
        chosen = marked.filter((F.col("until") >= n) & (F.col("until") - F.col("at") < n)).select(
            *groups, "bucket", (F.col("until") - F.col("at")).alias("below"), "at"
        )
    return chosen.withColumnRenamed("bucket", "cut")


def _sample(df, n, groups, key, by):
    if n <= 0:
        return df.limit(0)
    place = scattered(F.xxhash64(key)) if by is None else by
    place = F.coalesce(place, F.lit(MODULUS)).cast("long")
    keyed = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))] or ["_all"]
    keyed = keyed or [F.lit(0).alias("_all")]
    places = materialize(df.select(*keyed, place.alias("place")), "places")
    cuts = materialize(cut_offs(places, names, n), "cut-offs")
    marked = df.select("*", *keyed, place.alias("_place")).alias("d")
    # one row per group with more than n rows
    marked = marked.join(cuts.alias("c"), _same("d", "c", names), "left")
    own = [F.col(f"d.{c}") for c in df.columns]
    whole = F.col("cut").isNull() | (F.col("_place") < F.col("cut"))
    shared = F.col("below") + F.col("at") > n  # more rows at the cut than are wanted
    if cuts.filter(shared).isEmpty():
        return marked.filter(whole | (F.col("_place") == F.col("cut"))).select(*own)
    kept = marked.filter(whole | (F.col("_place") == F.col("cut")) & ~shared).select(*own)
    ties = marked.filter((F.col("_place") == F.col("cut")) & shared)
    group = F.struct(*[F.col(f"d.{g}") for g in names]).alias("_group")
    ties = ties.select(*own, group, (F.lit(n) - F.col("below")).alias("_left"))
    numbered = number_within(ties, "_group", [F.col(key)], "_i", "_n")
    return kept.unionByName(numbered.filter("_i <= _left").select(*df.columns))


def sample_exact(df, n, key, by=None):
    """Exactly min(n, rows) rows, fixed by the key values.

    ``by`` may give the places, whole numbers from 0 to MODULUS - 1; of equal places the
    smaller keys come first.
    """
    return _sample(df, n, [], key, by)


def sample_per_group(df, n, group, key, by=None):
    """min(n, rows) rows of each group, fixed by the key values; a null group is one too."""
    return _sample(df, n, [group], key, by)
