"""N-gram Jaccard join: near-duplicate texts by rare-first prefix filtering.

A text's set holds its distinct shingles of ``WORDS`` words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased) as 64-bit hashes; a text of fewer words has its whole word sequence as the one
shingle. Texts of equal sets are one node (a 64-bit digest of the set). Two nodes link when
100 * shared >= PERCENT * union.

1. ``describe``: one pass over the texts gives set size, node and a bitmap of each text, and a
   sketch of the shingles: BUCKETS counters per input partition, each of the texts that hold a shingle
   of that hash range. The sketches are summed by blocks of counters as a stream, so the sum is a table of
   fixed size, one byte a counter (eight steps a doubling), and may be broadcast.
2. ``postings``: shingles are ordered rare first, by counter and then by hash, and each node posts its
   prefix, |x| - ceil(t |x|) + 1 shingles. Two linked nodes share a posted shingle whatever the order
   is, so counters shared by several shingles only cost work. A counter never is below the number of texts, so
   every shingle of HOT_LEAST texts (and HOT_MEANS times the mean counter) is known to be frequent at any
   partitioning and is dealt over SALTS lists.
3. Every node is first tested against the list head it shares most postings with (the head of a list has
   the fewest rarer shingles: of a group of near copies, the one least edited), and then, in rounds
   for as long as a round links one node in ROUND_GAIN of those it tests, nodes of lists that still hold
   several components against a head of another one. That joins large groups of near copies without
   looking at all their pairs.
4. All pairs that share a posted shingle and are not joined yet pass the length filter, the
   positional filter (at the first posting a pair shares, the only one it is made at unless shared
   ones lie more than EARLIER apart) and the suffix filter (a bound on the shared shingles from two
   bitmaps: SIGNED bits within the join, bitmaps that follow the set size behind it) and are verified
   on whole sets. A pair that a step has tested is left out of all later ones. No partner or candidate
   is capped.

Defined cases: a null, empty or blank text has no shingles and links with nothing; its
component is its own doc_id. Rows that repeat a doc_id each get a row; equal texts share a
component. A null doc_id gets its set size, a null component, and makes no links. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.llm.components import components
from orderlens.llm.support import checked_broadcast, materialize, slices, small_batches

WORDS = 5
PERCENT = 75
BUCKETS = 1 << 22  # counters of the sketch, one byte each when broadcast
BLOCK = 1 << 14  # counters summed in one row
HOT_LEAST = 1000  # a shingle of fewer texts is never called frequent
HOT_MEANS = 4
SALTS = 64
ROUND_GAIN = 20
SIGNED = 512  # bits of the signature that postings of open lists carry
EARLIER = 8  # open postings before each of a node that tell whether a pair has met already
CACHED_WORDS = 1 << 17

_DESCRIBED = "doc_id long, n long, node long, bits binary, sign array<long>, block int, counters binary"
_POSTED = "shingle long, node long, n int, pos int, hot boolean"
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())
_EMPTY = np.zeros(0, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word; forgets all words when there are too many."""

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text, hashes, size=WORDS):
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return _EMPTY
    coded = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(coded))
    count = len(coded) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ coded[i : i + count]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def node_of(shingles):
    """64-bit digest of a set; None for the empty one."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles):
    """One bit per hash bin; twice to four times as many bins as shingles, 64 at least."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.bool_)
    bits[shingles & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def signature(shingles):
    """The set in SIGNED bits, by hash bins, as 64-bit numbers."""
    bits = np.zeros(SIGNED, np.bool_)
    bits[shingles & np.uint64(SIGNED - 1)] = True
    return np.packbits(bits).view(np.int64)


def _needed(x, y, percent):
    """Smallest number of shared shingles that links sets of x and y shingles."""
    return -(-percent * (x + y) // (100 + percent))


def _may_link(x, bits_x, y, bits_y, percent):
    """Suffix filter: False only if the bitmaps prove that too few shingles are shared."""
    a, b = np.frombuffer(bits_x, np.uint8), np.frombuffer(bits_y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = int(np.bitwise_count(a & b).sum())
    only_x = int(np.bitwise_count(a).sum()) - both
    only_y = int(np.bitwise_count(b).sum()) - both
    return min(x - only_x, y - only_y) >= _needed(x, y, percent)


def packed_counters(counts):
    """Counts as bytes of eight steps a doubling, rounded up."""
    return zlib.compress(np.ceil(8 * np.log2(1.0 + counts)).clip(0, 255).astype(np.uint8).tobytes(), 1)


def unpacked_counters(packed):
    return np.exp2(np.frombuffer(zlib.decompress(packed), np.uint8) / 8) - 1


def _describe(size):
    def run(batches):
        hashes, seen, counts = WordHashes(), set(), np.zeros(BUCKETS, np.uint32)
        names = ["doc_id", "n", "node", "bits", "sign", "block", "counters"]
        signs = pa.list_(pa.int64())
        for part in slices(batches):
            sets = [shingle_set(t, hashes, size) for t in part.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            for node, s in zip(nodes, sets):
                if node is not None and node not in seen:
                    seen.add(node)
                    np.add.at(counts, s >> _SHIFT, 1)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s) if len(s) else None for s in sets], signs),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
        blocks = [k for k in range(BUCKETS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        n = len(blocks)
        packed = [packed_counters(counts[k * BLOCK : (k + 1) * BLOCK]) for k in blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.binary()), pa.nulls(n, signs), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())],
            names=names,
        )

    return run


def _summed(batches):
    """Sums of the sketches' blocks; a task holds the counters of its blocks, however many sketches there are."""
    sums = {}
    for batch in batches:
        for k, packed in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist()):
            sums[k] = sums.get(k, 0) + unpacked_counters(packed)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([packed_counters(c) for c in sums.values()], pa.binary())],
        names=["block", "counters"],
    )


def shingle_counters(described):
    """(counters, least): the summed sketch, one byte a counter, and the byte from which a shingle is frequent."""
    rows = described.where("block IS NOT NULL").select("block", "counters").repartition("block")
    counters = np.zeros(BUCKETS, np.uint8)
    for r in rows.mapInArrow(_summed, "block int, counters binary").collect():
        counters[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.counters), np.uint8)
    texts = max(HOT_LEAST, HOT_MEANS * (np.exp2(counters / 8) - 1).mean())
    return counters, int(np.ceil(8 * np.log2(1 + texts)))


def _postings(size, percent, counters, least):

    def run(batches):
        hashes, seen = WordHashes(), set()
        for part in slices(batches):
            out = []
            for text in part.column("text").to_pylist():
                s = shingle_set(text, hashes, size)
                node = node_of(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                length = len(s) - -(-percent * len(s) // 100) + 1
                held = counters.value[s >> _SHIFT]
                first = np.argsort(held, kind="stable")[:length]
                out.append((s[first], node, len(s), held[first] >= least))
            if out:
                each = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
                        pa.array(np.repeat(np.array([o[1] for o in out], np.int64), each)),
                        pa.array(np.repeat(np.array([o[2] for o in out], np.int32), each)),
                        pa.array(np.concatenate([np.arange(e, dtype=np.int32) for e in each])),
                        pa.array(np.concatenate([o[3] for o in out])),
                    ],
                    names=["shingle", "node", "n", "pos", "hot"],
                )

    return run


def _sets(size):
    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingle_set(t, hashes, size) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            joined = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), joined], names=["node", "shingles"])

    return run


def _suffix_filter(percent):
    def run(batches):
        for part in slices(batches, 4096):
            cols = [part.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")]
            mask = pa.array([_may_link(*row, percent) for row in zip(*cols)], pa.bool_())
            yield part.select(["a", "b"]).filter(mask)

    return run


def _verified(both, percent):
    """The pairs (a, b) that link, of rows (a, b, set_a, set_b).

    Compared row by row in Spark: a batch of whole sets sent to Python may outgrow a task's memory.
    """
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(f"100 * shared >= {percent} * (size(set_a) + size(set_b) - shared)").select("a", "b")


def _linked(pairs, tested, nodes, sets, percent):
    """(links, tested): the pairs (a, b) of nodes that link, and all pairs verified by now.

    Pairs that are not ``wide``, if they have that column, need no suffix filter.
    """
    if "wide" not in pairs.columns:
        pairs = pairs.withColumn("wide", F.lit(True))
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "wide").distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    wide = pairs.where("wide").join(left, "a").join(right, "b")
    wide = wide.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    wide = wide.mapInArrow(_suffix_filter(percent), "a long, b long")
    pairs = materialize(wide.union(pairs.where("NOT wide").select("a", "b")), "pairs")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    links = materialize(_verified(pairs.join(a, "a").join(b, "b"), percent), "links")
    return links, pairs if tested is None else tested.union(pairs)


def _open_lists(lists, roots):
    """Postings of shingles whose nodes are in several components, with the nodes' ``root``."""
    rows = lists.select("shingle", "node", "n", "pos").join(checked_broadcast(roots), "node", "left")
    rows = rows.withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("p"), F.max("root").alias("q"))
    mixed = materialize(mixed.where("p <> q").select("shingle"), "mixed")
    # equal texts of several input partitions have posted the same rows
    return materialize(rows.join(checked_broadcast(mixed), "shingle", "left_semi").distinct(), "open")


def _other_heads(lists, turn):
    """(a, b): each node and the head of another component that it shares most open lists with.

    A list has two heads, of the smallest and the largest draw of the turn.
    """
    drawn = lists.withColumn("draw", F.xxhash64("node", F.lit(turn)))
    heads = drawn.groupBy("shingle").agg(
        F.min_by("node", "draw").alias("b"),
        F.min_by("root", "draw").alias("root_b"),
        F.max_by("node", "draw").alias("c"),
        F.max_by("root", "draw").alias("root_c"),
    )
    heads = materialize(heads, "heads")
    rows = lists.select("shingle", F.col("node").alias("a"), "root").join(heads, "shingle")
    rows = rows.withColumn("b", F.expr("CASE WHEN root <> root_b THEN b WHEN root <> root_c THEN c END"))
    times = rows.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("times"))
    return times.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))


_SIGNS = [f"sign{i}" for i in range(SIGNED // 64)]


def _with_earlier(lists, nodes):
    """Open postings with the last EARLIER ones before each of its node, and the node's signature in plain columns."""
    before = Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1)
    lists = lists.withColumn("earlier", F.collect_list("shingle").over(before))
    signed = nodes.select("node", *[F.col("sign")[i].alias(c) for i, c in enumerate(_SIGNS)])
    # plain columns and one sum keep the condition small enough to be compiled
    ones = F.expr(" + ".join(f"bit_count({c})" for c in _SIGNS))
    return lists.join(signed.withColumn("over", ones), "node").withColumn("over", F.col("over") - F.col("n"))


def _first_shared(lists, percent):
    """Pairs of postings of nodes in different components that may link, where the pair first shares one.

    All nodes order shingles alike. At the first shared posting no shared shingle lies before either
    position, which bounds what is shared; a row with a shared posting among the EARLIER ones is not the
    first. Rows that are first of all postings pass both tests if their nodes link, so no link is lost;
    a pair comes again only if more than EARLIER open postings of a node lie between two shared ones.
    """
    fields = ("node", "n", "pos", "root", "over", "earlier", *_SIGNS)
    x, y = (lists.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in fields]) for k in "ab")
    # a bit that only one set has is at least one shingle that only it has
    both = " + ".join(f"bit_count({c}_a & {c}_b)" for c in _SIGNS)
    enough = f"ceil({percent} * (n_a + n_b) / {100 + percent}.0)"
    return x.join(y, "shingle").where(
        f"node_a < node_b AND root_a <> root_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" AND least(n_a - pos_a, n_b - pos_b) >= {enough}"
        f" AND {both} >= greatest(over_a, over_b) + {enough}"
        " AND NOT arrays_overlap(earlier_a, earlier_b)"
    )


def jaccard_classes(docs, size=WORDS, percent=PERCENT):
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    with small_batches(docs.sparkSession):  # all Python steps are written inside
        return _classes(docs, size, percent)


def _classes(docs, size, percent):
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(texts.mapInArrow(_describe(size), _DESCRIBED), "described")
    rows = described.where("block IS NULL")
    counters, least = shingle_counters(described)
    counters = spark.sparkContext.broadcast(counters)

    own = rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
    heads = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialize(own.join(heads, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).select("node", "doc_id", "n", "bits", "sign"), "nodes")

    posted = texts.where("doc_id IS NOT NULL").select("text").mapInArrow(_postings(size, percent, counters, least), _POSTED)
    posted = posted.withColumn("salt", F.expr(f"IF(hot, pmod(node, {SALTS}), 0)"))
    listed = Window.partitionBy("shingle", "salt")
    # the head of a list has the fewest rarer shingles: of a group of near copies, the one least edited
    ends = {"first": F.min("node"), "last": F.max("node"), "head": F.min(F.struct("pos", "node"))}
    posted = posted.withColumns({name: end.over(listed) for name, end in ends.items()})
    lists = materialize(posted.where("hot OR first <> last").drop("first", "last", "salt"), "lists")

    # whole sets of all nodes that share a posting, written once for all steps
    listed = materialize(nodes.select("node", "doc_id").join(lists.select("node").distinct(), "node", "left_semi"), "listed")
    sets = texts.join(checked_broadcast(listed.select("doc_id")), "doc_id", "left_semi").select("text")
    sets = sets.mapInArrow(_sets(size), "node long, shingles array<long>")
    sets = materialize(sets.join(checked_broadcast(listed.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")

    # the head of its lists that a node meets most often, and the heads of one salted shingle
    met = lists.where("head.node <> node").groupBy("node", F.col("head.node").alias("head")).agg(F.count("*").alias("times"))
    best = met.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("times", "head")).alias("b"))
    salted = lists.where("hot").select("shingle", "head").distinct()
    top = salted.groupBy("shingle").agg(F.min("head").alias("top"))
    across = salted.join(top, "shingle").select(F.col("head.node").alias("a"), F.col("top.node").alias("b")).where("a <> b")
    across = across.groupBy("a", "b").agg(F.count("*").alias("times"))
    across = across.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    links, tested = _linked(best.union(across), None, nodes, sets, percent)

    # nodes of lists that are not in one component yet: other heads first, then all pairs
    turn = 0
    while True:
        lists = _open_lists(lists, components(links))
        heads = materialize(_other_heads(lists, turn), "heads")
        found, tested = _linked(heads, tested, nodes, sets, percent)
        links = links.union(found)
        gain = found.count()
        if not gain:
            break
        if gain * ROUND_GAIN < heads.count():
            lists = _open_lists(lists, components(links))
            break
        turn += 1
    pairs = _first_shared(_with_earlier(lists, nodes), percent)
    # the bitmap of a set of at most SIGNED / 2 shingles is no wider than the signature, which has been compared
    wide = F.expr(f"greatest(n_a, n_b) > {SIGNED // 2}")
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), wide.alias("wide"))
    found, _ = _linked(pairs, tested, nodes, sets, percent)
    links = links.union(found)

    roots = components(links)
    placed = nodes.select("node", "doc_id").join(roots, "node", "left")
    placed = placed.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = materialize(placed.join(lowest, "root").select("node", "component_id"), "placed")
    result = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(placed, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"))
