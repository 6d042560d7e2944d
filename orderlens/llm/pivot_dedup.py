"""Embedding near-dedup with a pivot-permutation index.

PIVOTS reference vectors (their number follows the square root of the table, at least 64 and at
most MOST_PIVOTS) are drawn from the table. Of drawn vectors with a cosine of APART or more only one
stays a pivot: a dense group of near copies, whatever its size, has few pivots, so that its vectors meet
in one list and the order of their other pivots is not left to chance. A vector is described by its NEAREST pivots in order.
It is stored in the inverted list of its first pivot and visits the lists of all its NEAREST pivots.
A visitor and a stored vector that share at least SHARED of their NEAREST pivots are candidates, and
those with a cosine of at least COSINE, in double precision, link.

Equal vectors are one entry with a number of copies. The stored vectors of a list are cut into blocks
of BLOCK to MOST_TILES * BLOCK, and so are its visitors; every pair of blocks is a group of its own,
compared in tiles of BLOCK, so no group grows with a hot list. All pairs of a hot list are compared. A group returns, per vector, how many links it found and one link towards
its component within the group: links of large groups of copies are counted, not emitted.

The search finds pairs whose descriptions are close, so a link can be missed; README has the
recall against brute force. Verified links are exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component, kept. Vectors of other lengths than the most common one link
with nothing. Rows that repeat a vec_id are compared like other rows; copies of one vec_id count as
links. A null vec_id gives a null component and takes no part. An empty table gives an empty result.
Other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm.components import components
from orderlens.llm.support import checked_broadcast, materialize
from orderlens.llm.vectors import drawn_vectors, matrix, usable

COSINE = 0.95
NEAREST = 12
SHARED = 2
MOST_PIVOTS = 4096
APART = 0.8
BLOCK = 2048
MOST_TILES = 8
_FOUND = "entry long, links long, other long"


def pivot_count(rows):
    return int(min(MOST_PIVOTS, max(64, 2 * np.sqrt(rows))))


def spread(drawn, apart=APART):
    """The unit vectors of ``drawn`` without those that an earlier one is as near as ``apart`` to."""
    free, kept = np.ones(len(drawn), np.bool_), []
    for i in range(len(drawn)):
        if free[i]:
            kept.append(i)
            free &= drawn @ drawn[i] < apart
    return drawn[kept]


def _described(pivots, nearest):
    """(entry, vector, near): unit vectors and their nearest pivots in order, as int16 bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vector").to_pylist())
            rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            near = np.argsort(-(rows @ pivots.value.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entry"),
                    batch.column("copies"),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                    pa.array([n.tobytes() for n in near], pa.binary()),
                    pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())),
                ],
                names=["entry", "copies", "vector", "near", "lists"],
            )

    return run


def _roots(first, second, size):
    """Smallest member of each component of a graph on 0..size-1, by pointer halving."""
    up = np.arange(size)
    while True:
        low = np.minimum(up[first], up[second])
        before = up.copy()
        np.minimum.at(up, first, low)
        np.minimum.at(up, second, low)
        up = up[up]
        if (up == before).all():
            return up


def _shared(a, b):
    """Number of pivots that each pair of descriptions has in common."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = place.reshape(len(a) + len(b), -1)
    marks = np.zeros((len(place), len(used)), np.float32)
    np.put_along_axis(marks, place, 1, axis=1)
    return marks[: len(a)] @ marks[len(a) :].T


def _tile(cosine, shared, stored, guests):
    """(entry, links, other) of some stored vectors of a list against some visitors."""
    (x, s, near_s, a), (y, g, near_g, b) = stored, guests
    found = (_shared(near_s, near_g) >= min(shared, near_s.shape[1])) & (s @ g.T >= cosine)
    i, j = np.nonzero(found)
    # a pair met in both first lists counts in the smaller one; within one list, once
    here, own = near_s[i, 0], near_g[j, 0]
    both = (near_s[i] == own[:, None]).any(1)
    good = np.where(here == own, x[i] < y[j], ~both | (here < own))
    i, j = i[good], j[good]
    return _united(x[i], y[j], b[j], a[i])


def _united(x, y, of_x, of_y):
    """(entry, links, other) of the links x - y: sums of ``of_x`` and ``of_y`` and one link to the root."""
    ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    links = np.bincount(place, np.concatenate([of_x, of_y]), len(ids)).astype(np.int64)
    root = _roots(place[: len(x)], place[len(x) :], len(ids))
    return ids, links, ids[root]


def _verified(cosine, shared, tile):
    """Links of one group: stored vectors of a list's block against visitors of a block."""

    def parts(rows):
        for at in range(0, len(rows), tile):
            some = rows[at : at + tile]
            near = np.frombuffer(b"".join(some["near"]), np.int16).reshape(len(some), -1)
            yield some["entry"].to_numpy(), matrix(some["vector"]), near, some["copies"].to_numpy()

    def run(group):
        guests = list(parts(group[~group["home"]]))
        found = [_tile(cosine, shared, s, g) for s in parts(group[group["home"]]) for g in guests]
        found = [f for f in found if len(f[0])]
        if not found:
            return pd.DataFrame({"entry": [], "links": [], "other": []}).astype("int64")
        entry, links, other = (np.concatenate(f) for f in zip(*found))
        if len(found) > 1:
            entry, links, other = _united(entry, other, links, np.zeros_like(links))
        return pd.DataFrame({"entry": entry, "links": links, "other": other})

    return run


def near_duplicates(table, cosine=COSINE, nearest=NEAREST, shared=SHARED, pivots=None, block=BLOCK):
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding)."""
    spark = table.sparkSession
    rows = materialize(usable(table), "vectors")
    entries = rows.groupBy("vector").agg(F.min("vec_id").alias("entry"), F.count("*").alias("copies"))
    # one entry per distinct vector; rows that repeat a vec_id with other vectors share none
    entries = materialize(entries.withColumn("entry", F.xxhash64("vector")), "entries")
    widths = entries.groupBy(F.octet_length("vector").alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").first()
    if width is None:
        alone = table.select(F.col("vec_id").cast("long").alias("vec_id"))
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    comparable = entries.where(F.octet_length("vector") == width["width"])
    chosen = drawn_vectors(comparable, pivots or pivot_count(width["count"]), "pivot")
    if not len(chosen):
        chosen = matrix([bytes(comparable.select("vector").orderBy("entry").first().vector)])
    chosen = spread(chosen / np.linalg.norm(chosen, axis=1, keepdims=True))
    sent = spark.sparkContext.broadcast(chosen)
    kinds = "entry long, copies long, vector binary, near binary, lists array<int>"
    described = materialize(comparable.mapInArrow(_described(sent, nearest), kinds), "described")

    # blocks of a list: by its counts of stored and visiting vectors, one row per pivot
    visits = described.select("entry", F.posexplode("lists").alias("place", "list"))
    size = F.greatest(F.lit(block), F.least(F.lit(MOST_TILES * block), F.ceil(F.count("*") / MOST_TILES)))
    counts = visits.groupBy("list").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("place") == 0) / size)).cast("int").alias("homes"),
        F.ceil(F.count("*") / size).cast("int").alias("guests"),
    )
    counts = F.broadcast(materialize(counts, "lists"))  # at most MOST_PIVOTS rows
    placed = described.select("entry", "copies", "vector", "near", F.posexplode("lists").alias("place", "list")).join(counts, "list")
    mine = F.pmod("entry", "homes").cast("int")
    seat = F.pmod(F.xxhash64("entry"), "guests").cast("int")
    fields = ["list", "entry", "copies", "vector", "near"]
    stored = placed.where("place = 0").select(*fields, F.lit(True).alias("home"), mine.alias("h"), F.explode(F.expr("sequence(0, guests - 1)")).alias("g"))
    guests = placed.select(*fields, F.lit(False).alias("home"), F.explode(F.expr("sequence(0, homes - 1)")).alias("h"), seat.alias("g"))
    groups = stored.unionByName(guests).groupBy("list", "h", "g")
    found = materialize(groups.applyInPandas(_verified(cosine, shared, block), _FOUND), "found")

    links = found.select(F.col("entry").alias("a"), F.col("other").alias("b"))
    counted = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots = components(links).withColumnRenamed("node", "entry")
    state = entries.select("entry", "copies").join(counted, "entry", "left").join(roots, "entry", "left")
    state = state.select("entry", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"), F.coalesce("root", "entry").alias("root"))
    state = materialize(state, "state")
    members = rows.select("vec_id", F.xxhash64("vector").alias("entry")).join(state, "entry")
    members = materialize(members.select("vec_id", "n_links", "root"), "members")
    lowest = materialize(members.groupBy("root").agg(F.min("vec_id").alias("component_id")), "lowest")
    linked = members.join(lowest, "root").select("vec_id", "n_links", "component_id")
    rest = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("coalesce(forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0), false)")
    rest = rest.where(~sound | F.col("vec_id").isNull())
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked.unionByName(rest)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
