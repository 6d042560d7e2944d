"""Approximate nearest neighbours by multi-index hashing.

Codes. A rotation is learnt on a bounded sample of SAMPLE vectors: principal axes, then BITS / width
random starts turned by alternating fits of codes and rotation, so that the signs of the rotated
vector lose least. A code has BITS bits in BITS / 8 substrings of one byte. Vectors are centred
before, queries are not: that takes the same number off all inner products of a query.

Index. The table is dealt into blocks of about BLOCK distinct vectors. Within a block every substring
has an inverted list per byte value. A code within Hamming radius r of a query must agree with it up to
floor(r / substrings) bits in some substring, so probing all byte values within that distance in every
substring retrieves every code within r. Where the lists to probe hold more rows than the block, its
codes are compared one by one. Codes within r are reranked by their inner products in double precision.

Radius. A query's first radius in a block is the smallest that holds the block's share of CANDIDATES
codes, and at least the wanted number, counted over all codes of the block while the probes widen.
The worst of the best rows found says which angle a row of a given length must have to be better; the
second radius is the number of bits by which such a row differs, and DEVIATIONS standard deviations more.
It follows the length of the row (LENGTHS classes), so long rows are found at wider angles, and the
crowd that a query lives in. A table of any size has this one rule; README has the recall against
brute force.

Queries are matched with every block (a stated query set against all rows, in blocks), and each block
names as many rows as are wanted, or all it has. A table of no more than CANDIDATES rows lies within
every radius.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or are of
another length than the most common one, take no part. Of equal vectors the smallest wanted + 1
vec_ids are kept, which are all that a result can name. Ties go to the smaller vec_id. Rows that
repeat a vec_id are one row. Fewer rows than wanted: all of them are returned. An empty
table gives an empty result. Other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.llm.support import materialize
from orderlens.llm.vectors import drawn_vectors, matrix, usable

BITS = 256
SAMPLE = 4096
TURNS = 15
CANDIDATES = 2500
BLOCK = 16384
WANTED = 20
QUERY_BLOCK = 4096
DEVIATIONS = 3
LENGTHS = 64
_FOUND = "query_id long, vec_id long, score double"
_BYTES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def learn_rotation(sample, bits=BITS, turns=TURNS, seed=0):
    """Matrix that turns vectors (less the sample's mean) into ``bits`` signed numbers."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.svd(centred, full_matrices=False)[2]
    data, parts = centred @ axes.T, []
    width = data.shape[1]
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(turns):
            signs = np.where(data @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ data)
            turn = (u @ v).T
        parts.append(axes.T @ turn)
    return mean, np.hstack(parts)[:, :bits]


def codes(rows, learnt):
    """Bytes of the codes, one row each."""
    mean, turn = learnt
    return np.ascontiguousarray(np.packbits((rows - mean) @ turn >= 0, axis=1))


def distances(query, others):
    """Hamming distances of one code to others; the codes have a multiple of 8 bytes."""
    return np.bitwise_count(others.view(np.uint64) ^ query.view(np.uint64)).sum(1, dtype=np.int32)


class SubstringIndex:
    """Inverted lists of the codes of one block, per substring and byte value."""

    def __init__(self, coded):
        self.coded = coded
        self.words = [np.ascontiguousarray(w) for w in coded.view(np.uint64).T]
        self.lists = [np.argsort(coded[:, s], kind="stable") for s in range(coded.shape[1])]
        self.lengths = np.array([np.bincount(coded[:, s], minlength=256) for s in range(coded.shape[1])])

    def probed(self, query, reach):
        """(rows, distances) of all codes that differ from the query's by at most ``reach`` bits in
        some substring; of all codes, if the lists to probe hold as many."""
        open_ = _BYTES[query] <= reach
        if self.lengths[open_].sum() >= len(self.coded):
            rows, words = np.arange(len(self.coded)), self.words
        else:
            met = np.zeros(len(self.coded), np.bool_)
            for listed, lengths, some in zip(self.lists, self.lengths, open_):
                met[listed[np.repeat(some, lengths)]] = True
            rows = np.flatnonzero(met)
            words = [w[rows] for w in self.words]
        found = np.zeros(len(rows), np.uint16)
        for word, own in zip(words, query.view(np.uint64)):
            found += np.bitwise_count(word ^ own)
        return rows, found

    def within(self, query, radius):
        """Rows whose code is at most ``radius`` from the query's, by pigeonhole probing."""
        rows, found = self.probed(query, radius // self.coded.shape[1])
        return rows[found <= radius]

    def closest(self, query, least):
        """Rows within the smallest radius that holds ``least`` codes (all rows, if there are fewer)."""
        substrings = self.coded.shape[1]
        for reach in range(9):
            rows, found = self.probed(query, reach)
            # every code up to this distance has been probed
            sure = 8 * substrings if len(rows) == len(self.coded) else substrings * (reach + 1) - 1
            inside = np.bincount(found, minlength=8 * substrings + 1).cumsum()
            if inside[sure] >= least or sure >= 8 * substrings:
                return rows[found <= np.searchsorted(inside, least)]


def length_classes(lengths, classes=LENGTHS):
    """(upper edges, class of each): lengths sorted into classes of about equal numbers."""
    edges = np.unique(np.quantile(lengths, np.linspace(0, 1, classes + 1)[1:], method="higher"))
    return edges, np.searchsorted(edges, lengths)


def bits_to_beat(score, lengths, bits, deviations=DEVIATIONS):
    """Bits by which codes of vectors of these ``lengths`` may differ from the code of a query of
    length 1 if their inner product with it is ``score`` or more; -1 if they are too short for it."""
    at = score / np.maximum(lengths, 1e-300)
    turned = np.arccos(np.clip(at, -1, 1)) / np.pi
    expected = bits * turned + deviations * np.sqrt(bits * turned * (1 - turned))
    return np.where(at > 1 + 1e-9, -1, np.ceil(expected)).astype(np.int32)


def _best(rows, ids, vector, query_id, near, wanted):
    """(rows, scores): the ``wanted`` best of the rows ``near``, without the query's own."""
    near = near[ids[near] != query_id]
    if len(near) > 4 * wanted:
        rough = rows[near] @ vector
        least = np.partition(rough, len(near) - wanted)[len(near) - wanted]
        near = near[rough >= least - 1e-9 * np.abs(rough).max()]
    score = (rows[near] * vector).sum(1)
    best = np.lexsort((ids[near], -score))[:wanted]
    return near[best], score[best]


def _search(learnt, share, wanted):
    """Best rows of one index block for one block of queries."""

    def run(group):
        asked, held = group[group["query"]], group[~group["query"]]
        out = []
        if len(asked) and len(held):
            held = held.sort_values("vec_id")
            rows, ids = matrix(held["vector"]), held["vec_id"].to_numpy()
            mean, turn = learnt.value
            index = SubstringIndex(codes(rows, learnt.value))
            edges, sort = length_classes(np.linalg.norm(rows - mean, axis=1))
            questions = matrix(asked["vector"])
            # a row more than wanted, since one may be the query itself
            least = max(wanted + 1, int(np.ceil(share * len(rows))))
            for query_id, vector, code in zip(asked["vec_id"].to_numpy(), questions, codes(questions, (0, turn))):
                near = index.closest(code, least)
                best, score = _best(rows, ids, vector, query_id, near, wanted)
                if len(near) < len(rows) and len(best) == wanted:
                    limits = bits_to_beat((score[-1] - vector @ mean) / np.linalg.norm(vector), edges, turn.shape[1])
                    wide, found = index.probed(code, max(0, limits.max()) // len(code))
                    met = np.zeros(len(rows), np.bool_)
                    met[near] = met[wide[found <= limits[sort[wide]]]] = True
                    best, score = _best(rows, ids, vector, query_id, np.flatnonzero(met), wanted)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest_neighbours(table, every=20, wanted=WANTED, bits=BITS, candidates=CANDIDATES):
    """(query_id, rank, vec_id, score): the ``wanted`` rows of largest inner product found for every
    row of ``table`` (vec_id, embedding) whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(table).dropDuplicates(["vec_id"])
    rows = materialize(rows, "vectors")
    widths = rows.groupBy(F.octet_length("vector").alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.octet_length("vector") == width["width"])
    sample = drawn_vectors(rows, SAMPLE, "rotation")
    if len(sample) < 2:
        sample = matrix([bytes(r.vector) for r in rows.select("vector").limit(SAMPLE).collect()])
    sent = spark.sparkContext.broadcast(learn_rotation(sample, bits))

    same = Window.partitionBy("vector").orderBy("vec_id")
    indexed = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= wanted + 1)
    indexed = materialize(indexed.select("vec_id", "vector"), "indexed")
    held = indexed.count()
    blocks = max(1, -(-held // BLOCK))
    queries = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    index = indexed.select("vec_id", "vector", F.lit(False).alias("query"), block.alias("block"), numbers(parts).alias("part"))
    asked = queries.select("vec_id", "vector", F.lit(True).alias("query"), numbers(blocks).alias("block"), part.alias("part"))
    share = min(1.0, candidates / max(1, held))
    groups = index.unionByName(asked).groupBy("block", "part")
    found = groups.applyInPandas(_search(sent, share, wanted), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", "vec_id", "score")
