"""Interaction audit of text filters: what each removes in every order of application.

Texts are measured by a table-driven byte transducer. ``AFTER[byte]`` is the state that a byte
leads to and ``SAYS[state, byte]`` what is put out on the way: the start or end of a word, a
capital, a code point (any byte but a UTF-8 continuation), a symbol. The state is fixed by the
byte before, whatever came earlier, so a whole run is two table look-ups per byte and is done for
a portion of texts at a time. The word spans go into ``SpanTable``, an open-addressing hash table over
the bytes of the portion: a span that meets a held one of equal hash is compared byte by byte.

Documents are then counted per (text digest, part, failures, labels), which combines before the
shuffle, so a text held by a third of the rows is one row per part. The first holder of each digest
passes the repetition filter. What is left per part is at most 32 counts of failure sets, from
which all 600 rows of orders and steps follow.

Defined cases. A null text is empty: no words, no code points. A null language is the part "",
as an empty one. Rows that repeat a doc_id count each; if they share a text and no smaller doc_id
has it, all of them pass the repetition filter. A null doc_id is not smaller than any other, is never
a repetition, and has no labels. A document is good or toxic if any of its label rows says 1. An
empty table gives no rows. Other columns are ignored.
"""

import hashlib
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"  # short, repetitive, capitals, symbols, text of an earlier document
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
PORTION = 1 << 20  # bytes of text measured together; a longer text is a portion of its own
PIECE = 1 << 20  # bytes that the transducer looks up at once
SPANS = 1 << 16  # word spans that enter the table at once
LONG = 64  # longer words are hashed and compared one by one
MEASURES = "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"

# fixed values: blanks, capitals and symbols of the filters
BLANKS, CAPITALS, SYMBOLS = b" \t\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
OUTSIDE, INSIDE = 0, 1
START, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16


def transducer():
    """(AFTER, SAYS): state after each byte, and outputs for each state and byte."""
    after = np.full(256, INSIDE, np.uint8)
    after[list(BLANKS)] = OUTSIDE
    says = np.zeros((2, 256), np.uint8)
    says[OUTSIDE, after == INSIDE] |= START
    says[INSIDE, after == OUTSIDE] |= END
    says[:, list(CAPITALS)] |= CAPITAL
    says[:, list(SYMBOLS)] |= SYMBOL
    says[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    return after, says


AFTER, SAYS = transducer()


def transduce(data, offsets):
    """Word spans and counts of texts laid end to end.

    ``data`` holds the bytes, ``offsets`` the borders of the texts. Gives (start, size, text number)
    of each word, in order, and the counts of capitals, code points and symbols per text.
    """
    starts, ends = [], []
    counts = {flag: np.zeros(len(offsets) - 1, np.int64) for flag in (CAPITAL, POINT, SYMBOL)}
    edges = offsets[:-1][np.diff(offsets) > 0]  # first bytes of the texts that have any
    for low in range(0, len(data), PIECE):
        high = min(low + PIECE, len(data))
        to = AFTER[data[low:high]]
        state = np.empty_like(to)
        state[1:] = to[:-1]
        state[0] = AFTER[data[low - 1]] if low else OUTSIDE
        first = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)]
        # a text that ends inside a word ends the word; the next one starts outside
        ends.append(first[(state[first - low] == INSIDE) & (first > 0)])
        state[first - low] = OUTSIDE
        said = SAYS[state, data[low:high]]
        starts.append(low + np.flatnonzero(said & START))
        ends.append(low + np.flatnonzero(said & END))
        for flag, count in counts.items():
            count += np.diff(np.searchsorted(np.flatnonzero(said & flag) + low, offsets))
    if len(data) and AFTER[data[-1]] == INSIDE:
        ends.append(np.array([len(data)]))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.sort(np.concatenate(ends)) if ends else start
    text = np.searchsorted(offsets, start, "right") - 1
    return start, end - start, text, counts[CAPITAL], counts[POINT], counts[SYMBOL]


class SpanTable:
    """Hash table of word spans, apart for each text; spans of equal hash are compared."""

    KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # first n of 8 bytes

    def __init__(self, data):
        self.bytes = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, np.uint64, self.bytes, strides=(1,))
        self.slots = np.full(1 << 12, -1, np.int64)
        # start, size and text of the spans held, and their hashes; room for as many as may be held
        self.count = 0
        self.held = np.zeros((1 << 11, 3), np.int64)
        self.hash = np.zeros(1 << 11, np.uint64)

    def _parts(self, start, size, at):
        return self.eight[start + at] & self.KEEP[np.minimum(size - at, 8)]

    def hashes(self, start, size, text):
        out = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        for at in range(0, LONG, 8):
            live = np.flatnonzero((size > at) & (size <= LONG))
            if not len(live):
                break
            h = (out[live] ^ self._parts(start[live], size[live], at)) * np.uint64(0xBF58476D1CE4E5B9)
            out[live] = h ^ (h >> np.uint64(29))
        for i in np.flatnonzero(size > LONG):
            out[i] ^= np.uint64(zlib.crc32(self.bytes[start[i] : start[i] + size[i]]))
        return out ^ (out >> np.uint64(32))

    def equal(self, a, b, size):
        """Whether spans of equal ``size`` that start at ``a`` and at ``b`` have equal bytes."""
        out = np.ones(len(a), np.bool_)
        for at in range(0, LONG, 8):
            live = np.flatnonzero(out & (size > at) & (size <= LONG))
            if not len(live):
                break
            out[live] = self._parts(a[live], size[live], at) == self._parts(b[live], size[live], at)
        for i in np.flatnonzero(size > LONG):
            out[i] = np.array_equal(self.bytes[a[i] : a[i] + size[i]], self.bytes[b[i] : b[i] + size[i]])
        return out

    def _grow(self, more):
        size = len(self.slots)
        while size < 2 * (self.count + more):
            size *= 2
        if size == len(self.slots):
            return
        n = self.count
        held, hashes = self.held[:n], self.hash[:n]
        self.held, self.hash = np.zeros((size // 2, 3), np.int64), np.zeros(size // 2, np.uint64)
        self.held[:n], self.hash[:n] = held, hashes
        self.slots = np.full(size, -1, np.int64)
        todo = np.arange(n)
        slot = (hashes & np.uint64(size - 1)).astype(np.int64)
        while len(todo):  # all differ, so nothing is compared
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = free
            todo = todo[self.slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def insert(self, start, size, text):
        """Whether each span is new to its text; of equal new ones exactly one is."""
        self._grow(len(start))
        hashes, last = self.hashes(start, size, text), len(self.slots) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        new, todo = np.zeros(len(start), np.bool_), np.arange(len(start))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = -2 - free  # several may claim a slot; one stays
            winners = free[self.slots[slot[free]] == -2 - free]
            new[winners] = True
            numbers = self.count + np.arange(len(winners))
            self.count += len(winners)
            self.slots[slot[winners]] = numbers
            self.held[numbers] = np.stack([start[winners], size[winners], text[winners]], 1)
            self.hash[numbers] = hashes[winners]
            todo = todo[~new[todo]]
            held = self.slots[slot[todo]]
            other, other_size, other_text = self.held[held].T
            alike = (self.hash[held] == hashes[todo]) & (other_size == size[todo]) & (other_text == text[todo])
            met = np.flatnonzero(alike)
            alike[met] = self.equal(start[todo[met]], other[met], size[todo[met]])
            todo = todo[~alike]
            slot[todo] = (slot[todo] + 1) & last
        return new


def measure(data, offsets):
    """(words, distinct words, capitals, code points, symbols) per text, as arrays."""
    start, size, text, capitals, points, symbols = transduce(data, offsets)
    n, table = len(offsets) - 1, SpanTable(data)
    distinct = np.zeros(n, np.int64)
    for at in range(0, len(start), SPANS):
        s, z, t = start[at : at + SPANS], size[at : at + SPANS], text[at : at + SPANS]
        distinct += np.bincount(t[table.insert(s, z, t)], minlength=n)
    return np.bincount(text, minlength=n), distinct, capitals, points, symbols


def portions(batch, column, most=PORTION):
    """Slices of an Arrow batch with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def laid_out(column):
    """(data, offsets): bytes of the texts end to end, nulls empty, and their borders."""
    texts = [t.as_buffer() if t.is_valid else b"" for t in column.cast(pa.binary())]
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.cumsum([0, *map(len, texts)], dtype=np.int64)


def _measured(batches):
    for batch in batches:
        for part in portions(batch, "text"):
            data, offsets = laid_out(part.column("text"))
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [part.column("doc_id"), part.column("part"), *map(pa.array, measure(data, offsets)), pa.array(digests, pa.binary())]
            names = [c.split()[0] for c in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def text_measures(docs):
    """One row of MEASURES for every row of ``docs`` (doc_id, lang, text)."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text").mapInArrow(_measured, MEASURES)


def failures(measures):
    """``measures`` with ``fails``: bits 1, 2, 4, 8 for the filters that look at one text."""
    tests = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    return measures.withColumn("fails", sum(F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)))


def failure_sets(failing, labels):
    """(part, fails, n, n_good, n_toxic): documents per part and set of failed filters."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    judged = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    judged = judged.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(said("quality"), said("toxic"))
    rows = failing.groupBy("doc_id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.join(judged, F.col("doc_id") == F.col("_id"), "left").na.fill(0, ["_quality", "_toxic"])

    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_c"))).alias("_first")
    without_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("_c")).otherwise(0)).alias("_loose")
    alike = rows.groupBy("digest", "part", "fails", "_quality", "_toxic").agg(F.sum("_c").alias("_n"), first, without_id)
    # a digest has one set of failures, so at most four rows per part
    of_digest = Window.partitionBy("digest")
    leads = F.col("_first.doc_id") == F.min("_first.doc_id").over(of_digest)
    passing = F.col("_loose") + F.when(leads, F.col("_first._c")).otherwise(0)
    split = alike.withColumn("_passing", passing).select(
        "part",
        "_quality",
        "_toxic",
        F.inline(
            F.array(
                F.struct(F.col("fails").alias("fails"), F.col("_passing").alias("_n")),
                F.struct((F.col("fails") + 16).alias("fails"), (F.col("_n") - F.col("_passing")).alias("_n")),
            )
        ),
    )
    return split.groupBy("part", "fails").agg(
        F.sum("_n").alias("n"),
        F.sum(F.col("_n") * F.col("_quality")).alias("n_good"),
        F.sum(F.col("_n") * F.col("_toxic")).alias("n_toxic"),
    )


def audit(sets):
    """One row per part, order of the filters and step, from ``failure_sets``."""
    orders = ["".join(p) for p in permutations(LETTERS)]
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "n_good", "n_toxic")).alias("sets"))
    steps = parts.select("part", "sets", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * len(LETTERS) - 1))).alias("_i"))
    steps = steps.select(
        "part",
        "sets",
        F.element_at(F.array(*map(F.lit, orders)), F.expr(f"_i div {len(LETTERS)} + 1").cast("int")).alias("filter_order"),
        (F.col("_i") % len(LETTERS) + 1).cast("int").alias("step"),
    )
    bit = "shiftleft(1, instr('{0}', substr(filter_order, {1}, 1)) - 1)".format
    earlier = f"aggregate(sequence(1, {len(LETTERS)}), 0, (b, i) -> b + IF(i < step, {bit(LETTERS, 'i')}, 0))"
    steps = steps.withColumn("_bit", F.expr(bit(LETTERS, "step"))).withColumn("_earlier", F.expr(earlier))

    def total(count, condition="true"):
        return F.expr(f"aggregate(sets, 0L, (a, s) -> a + IF({condition}, {count}, 0L))")

    here = "s.fails & _bit != 0 AND s.fails & _earlier = 0"
    rounds = 1
    for k in range(2, len(LETTERS) + 1):
        rounds *= k
    # of the filters that a document fails, each comes first in an equal share of all orders
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("s.n", "s.fails & (_earlier | _bit) = 0").alias("kept"),
        total("s.n", here).alias("removed"),
        total("s.n", "s.fails & _bit != 0 AND s.fails & _earlier != 0").alias("redundant"),
        total("s.n", "s.fails = _bit").alias("unique_fails"),
        total("s.n_good", here).alias("good_lost"),
        total("s.n_toxic", here).alias("toxic_lost"),
        total(f"s.n * {rounds} div bit_count(s.fails)", "s.fails & _bit != 0").alias("shapley"),
    )


def filter_audit(docs, labels):
    """The audit of all rows of ``docs`` (doc_id, lang, text) with ``labels`` (doc_id, quality, toxic)."""
    return audit(failure_sets(failures(text_measures(docs)), labels))
