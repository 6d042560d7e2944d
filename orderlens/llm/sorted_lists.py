"""Exact top-k by inner product through no-random-access aggregation over sorted lists.

A vector becomes whole numbers, floor(scale * component). Blocks of vectors keep one list
per component: the values in ascending order and whose they are. For a query each list is read in the order
of falling contribution (from its end where the query's component is negative), stretch
by stretch, down to a common contribution. What has been read gives every vector of the block a
lower bound (the least of a list for each value not read) and an upper bound (the contribution reached,
for each). Reading stops when only a few vectors can still reach the k-th best lower bound, or the k-th
best score of earlier blocks where there is one; their scores are then computed in full. Nothing is approximate.

The lists are built once and written. Queries are sent out in pieces of at most PIECE_ROWS rows and
PIECE_BYTES bytes; each task meets several blocks and returns at most k rows per query.

Defined cases. Vectors that are null, empty, or hold null, NaN or infinite components take no part,
nor do rows without vec_id. Zero vectors do. A vector meets those of its own length only. Of rows that
repeat a vec_id the one with the smallest packed vector counts. Equal scores go by vec_id. Scaled
components are cut at +-2**((62 - log2 length) / 2) and +-2**30, 2**28 for 64 of them, so that scores fit a long. Fewer candidates
than k give fewer rows; an empty table gives none. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.llm.support import materialize, scratch_path

SCALE, EVERY, WANTED = 256, 50, 5
BLOCK = 2048  # vectors whose lists are kept together; at most 65,536
PIECE_ROWS, PIECE_BYTES = 16_384, 1 << 25
# contributions at which reading pauses, in root mean squares of the query's contributions
PAUSES = (0.4, 0.0, -0.15, -0.3, -0.5, -1.0)
RESOLVED = 256  # so few open vectors are resolved at once
LISTS = "width long, n long, ids binary, order binary, values binary"
FOUND = "query_id long, vec_id long, score long"


def _packed(scale):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum([0, *(len(x) for x in column)])
            packed = []
            for a, b in zip(ends[:-1], ends[1:]):
                most = min(2.0**30, 2.0 ** ((62 - int(b - a - 1).bit_length()) // 2))
                packed.append(np.clip(flat[a:b], -most, most).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "vector"])

    return run


def whole_vectors(table, scale=SCALE):
    """(vec_id, vector): one row per vec_id, components as 64-bit whole numbers in bytes."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.mapInArrow(_packed(scale), "vec_id long, vector binary").groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _listed(wanted):
    def run(rows):
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids)
        vectors = np.frombuffer(b"".join(v.as_buffer() for v in rows.column("vector")), np.int64).reshape(len(ids), -1)
        ids, vectors = ids[order], vectors[order]
        # of equal vectors only the first ids can be among the best, one more for the query itself
        _, same = np.unique(vectors, axis=0, return_inverse=True)
        by_value = np.argsort(same.ravel(), kind="stable")
        begin = np.searchsorted(same.ravel()[by_value], np.arange(same.max() + 1))
        place = np.arange(len(ids)) - begin[same.ravel()[by_value]]
        kept = np.sort(by_value[place <= wanted])
        ids, columns = ids[kept], vectors[kept].T
        order = np.argsort(columns, axis=1, kind="stable")
        values = np.take_along_axis(columns, order, 1)
        row = [[len(columns)], [len(ids)], [ids.tobytes()], [order.astype(np.uint16).tobytes()], [values.astype(np.int32).tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in LISTS.split(", ")])

    return run


def sorted_lists(vectors, wanted=WANTED, block=BLOCK):
    """One row of LISTS per block of ``vectors``."""
    blocks = max(1, -(-vectors.count() // block))
    where = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    keyed = vectors.select("vec_id", "vector", F.octet_length("vector").alias("width"), where)
    # lists of 16-bit places and 32-bit values: a longer block or a larger value cannot occur
    return keyed.groupBy("width", "block").applyInArrow(_listed(wanted), LISTS)


class Block:
    """The sorted lists of a block, read by one query after the other."""

    def __init__(self, n, width, ids, order, values):
        self.n, self.ids = n, np.frombuffer(ids, np.int64)
        self.order = np.frombuffer(order, np.uint16).reshape(width, n).astype(np.int64)
        self.values = np.frombuffer(values, np.int32).reshape(width, n).astype(np.float64)
        self.rows = np.empty((n, width), np.int64)
        np.put_along_axis(self.rows.T, self.order, self.values.astype(np.int64), 1)
        self.lists = np.arange(width)
        # contributions are taken from the middle of each list, so that one level suits all lists
        self.middle = np.round(self.values.mean(1))
        self.values -= self.middle[:, None]
        self.squares = (self.values**2).mean(1)
        self.ends = self.values[:, [0, -1]]

    def pauses(self, queries):
        """Places at which reading pauses: (query, pause, list), and the contributions reached there.

        Lists with a positive factor are read from their end down to the place, the others from 0 up to it.
        """
        spread = np.sqrt((queries**2 * self.squares).mean(1))
        # halves lie between all contributions, which are whole numbers
        reached = np.floor(spread[:, None] * np.array(PAUSES)) + 0.5
        places = np.empty((*reached.shape, len(self.lists)), np.int64)
        for i in self.lists:
            factor = queries[:, i]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = reached / factor[:, None]
            places[:, :, i] = np.where(factor[:, None] > 0, np.searchsorted(self.values[i], border), np.searchsorted(self.values[i], border, "right"))
        return places, reached

    def best(self, query, places, reached, own, floor, wanted):
        """(scores, ids) of the best rows with a score of ``floor`` or more; also the number of values read."""
        used = np.flatnonzero(query)
        factor, ahead = query[used].astype(np.float64), query[used] > 0
        ends = self.ends[used]
        least = factor * np.where(ahead, ends[:, 0], ends[:, 1])
        base = factor @ self.middle[used]
        slack = 1e-13 * np.abs(factor) @ (np.abs(ends).max(1) + np.abs(self.middle[used]))
        known, count = np.full(self.n, base), np.zeros(self.n)
        # scores of earlier blocks bound the k-th best from below; without them the least values do
        unread = np.full(self.n, least.sum()) if np.isneginf(floor) else None
        at = np.where(ahead, self.n, 0)
        open_, read = self.ids != own, 0
        for to, level in [*zip(places[:, used], reached), (np.where(ahead, 0, self.n), None)]:
            low, high = np.minimum(to, at), np.maximum(to, at)
            size = high - low
            if size.any():
                stretches = list(zip(used.tolist(), low.tolist(), high.tolist()))
                whose = np.concatenate([self.order[i, a:b] for i, a, b in stretches])
                gained = np.concatenate([self.values[i, a:b] for i, a, b in stretches])
                gained *= np.repeat(factor, size)
                known += np.bincount(whose, gained, self.n)
                count += np.bincount(whose, minlength=self.n)
                if unread is not None:
                    unread -= np.bincount(whose, np.repeat(least, size), self.n)
                at, read = to, read + len(whose)
            if unread is not None:
                lower = (known + unread)[open_]
                if len(lower) > wanted:
                    floor = max(floor, np.partition(lower, len(lower) - wanted)[len(lower) - wanted] - slack)
            upper = known if level is None else known + (len(used) - count) * level
            open_ &= upper + slack >= floor
            if np.count_nonzero(open_) <= RESOLVED:
                break
        left = np.flatnonzero(open_)
        scores = self.rows[left] @ query
        first = np.lexsort((self.ids[left], -scores))[:wanted]
        return scores[first], self.ids[left[first]], read


def _searched(sent, wanted):
    nothing = np.iinfo(np.int64).min

    def run(batches):
        ids, packed = sent.value
        by_width = {}
        for i, vector in enumerate(packed):
            by_width.setdefault(len(vector) // 8, []).append(i)
        asked = {w: (np.array(at), np.frombuffer(b"".join(packed[i] for i in at), np.int64).reshape(len(at), w)) for w, at in by_width.items()}
        scores, found = np.full((len(ids), wanted), nothing), np.full((len(ids), wanted), -1)
        held = np.zeros(len(ids), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if row["width"] not in asked:
                    continue
                block = Block(row["n"], row["width"], row["ids"], row["order"], row["values"])
                numbers, queries = asked[row["width"]]
                for low in range(0, len(numbers), 512):
                    some = slice(low, low + 512)
                    for i, query, *stops in zip(numbers[some], queries[some], *block.pauses(queries[some].astype(np.float64))):
                        floor = scores[i, -1] if held[i] == wanted else -np.inf
                        new, who, _ = block.best(query, *stops, ids[i], floor, wanted)
                        s, v = np.concatenate([scores[i, : held[i]], new]), np.concatenate([found[i, : held[i]], who])
                        first = np.lexsort((v, -s))[:wanted]
                        held[i] = len(first)
                        scores[i, : len(first)], found[i, : len(first)] = s[first], v[first]
        real = np.arange(wanted) < held[:, None]
        columns = [np.repeat(ids, held), found[real], scores[real]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_scores(table, every=EVERY, wanted=WANTED, scale=SCALE, block=BLOCK, piece_rows=PIECE_ROWS):
    """(query_id, rank, vec_id, score): the ``wanted`` highest scores for every vec_id divisible by ``every``."""
    spark = table.sparkSession
    vectors = materialize(whole_vectors(table, scale), "whole-vectors")
    lists = materialize(sorted_lists(vectors, wanted, block), "lists")
    blocks = lists.count()
    lists = lists.repartition(max(1, min(blocks, spark.sparkContext.defaultParallelism)))
    queries = vectors.where(F.col("vec_id") % every == 0)
    n, most = queries.agg(F.count(F.lit(1)), F.max(F.octet_length("vector"))).first()
    pieces = max(1, -(-n // piece_rows), -(-n * (most or 0) // PIECE_BYTES))
    path = scratch_path(spark, "scores")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for piece in range(pieces if n else 0):
        rows = queries.where(F.pmod(F.xxhash64(F.lit("piece"), "vec_id"), F.lit(pieces)) == piece).collect()
        ids = np.array([r.vec_id for r in rows], np.int64)
        sent = spark.sparkContext.broadcast((ids, [bytes(r.vector) for r in rows]))
        lists.mapInArrow(_searched(sent, wanted), FOUND).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(FOUND).parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", "vec_id", "score")
