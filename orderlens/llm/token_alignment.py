"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a merge-type SentencePiece (B).

The tokens of a text are byte ranges, so each tokenizer gives a sorted list of end offsets. The
shorter list is driven through the longer by galloping: from the place of the last end, steps
double until the next end is reached, and a binary search closes in between. Ends that both lists
hold cut the tokens into groups, and the difference of the ranks of a token's two borders in the
other list is the range of tokens that it overlaps. ``gallop`` runs many stretches of the short list
beside each other, each from its own place.

Texts are cut at single blanks between two other characters. Neither tokenizer has a token
across such a place (``Coder`` checks B's pieces), so the libraries encode each distinct chunk
once per worker and cache period. The bytes of the tokens are compared with the text.

One pass over the texts writes, per document, its counts, the digest of its groups and its
distinct id pairs with their numbers; documents that follow each other form a block, whose distinct pairs
are added up before any shuffle. The corpus counts of the pairs are joined back to
the blocks, and each block meets its documents. A block holds at most ``block_pairs`` entries of documents and ``block_keys`` distinct pairs, or one portion.

Defined cases. A text that is null or empty, or whose tokens do not spell a blank and the text
(it holds U+2581, say), has no tokens: zeros and ''. Rows that repeat each get a result and count
each. A null doc_id stays. An empty table gives no rows. Other columns are ignored.
"""

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from orderlens.llm.filter_audit import portions
from orderlens.llm.support import materialize
from orderlens.llm.token_counts import byte_letters

MARK = "▁"
LANES = 4096  # stretches of the short list that gallop beside each other
CACHED, CACHED_CHARS = 200_000, 64  # chunks in the newer and in the older half of the cache, and their length
BLOCK_PAIRS, BLOCK_KEYS = 4_000_000, 1_000_000  # entries of documents, and distinct pairs, of a block
FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = f"block long, {FACTS}, pairs binary, times binary, block_pairs array<long>, block_times array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def gallop(short, long, lanes=LANES):
    """rank[i]: how many values of ``long`` are below ``short[i]``; both ascend strictly."""
    n = len(short)
    if not n:
        return np.zeros(0, np.int64)
    width = -(-n // lanes)
    padded = np.full(-(-n // width) * width, short[-1], np.int64)
    padded[:n] = short
    steps = np.ascontiguousarray(padded.reshape(-1, width).T)  # one column per lane
    last = len(long)
    long = np.append(long, np.iinfo(np.int64).max)
    rank = np.empty_like(steps)
    rank[0] = at = np.searchsorted(long, steps[0])
    for i in range(1, width):
        wanted = steps[i]
        low, high, jump = at, at, 1
        far = np.flatnonzero(long[high] < wanted)
        if len(far):
            low, high = low.copy(), high.copy()
        while len(far):
            low[far] = high[far] + 1
            high[far] = np.minimum(high[far] + jump, last)
            jump *= 2
            far = far[long[high[far]] < wanted[far]]
        between = np.flatnonzero(low < high)
        while len(between):
            middle = (low[between] + high[between]) >> 1
            below = long[middle] < wanted[between]
            low[between[below]] = middle[below] + 1
            high[between[~below]] = middle[~below]
            between = between[low[between] < high[between]]
        rank[i] = at = low
    return rank.T.ravel()[:n]


class Alignment:
    """Groups and links of two ascending lists of end offsets whose last ends are equal."""

    def __init__(self, ends_a, ends_b):
        self.swapped = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if self.swapped else (ends_a, ends_b)
        rank = gallop(short, long)
        common = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(0, np.bool_)
        #: places of the common ends in both lists
        places = np.flatnonzero(common), rank[common]
        self.cuts_a, self.cuts_b = places[::-1] if self.swapped else places
        first = np.zeros(len(short), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        self._first, self._count = first, rank - first + 1

    def links(self):
        """(place in A, place in B) of every pair of tokens whose ranges overlap."""
        one = np.repeat(np.arange(len(self._count)), self._count)
        begin = np.cumsum(self._count) - self._count
        other = np.arange(len(one)) + np.repeat(self._first - begin, self._count)
        return (other, one) if self.swapped else (one, other)


class Coder:
    """Both tokenizers, the bytes of their tokens, and a cache of coded chunks."""

    def __init__(self, path_a, path_b):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        raw = {letter: byte for byte, letter in byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(raw[c] for c in t) for t in names]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # an id as it is written inside its group and at its end
        ends = [(self.bytes_a, b",|"), (self.bytes_b, b",;")]
        self.written = np.array([b"%d%c" % (i, mark) for t, marks in ends for i in range(len(t)) for mark in marks], object)
        self.newer, self.older = {}, {}
        self.beside = re.compile(r"\s | \s|^ | $").search  # a blank that is no place to cut

    def chunks(self, text):
        """The parts of a text between the single blanks that both tokenizers begin a token with."""
        return re.split(r"(?<=\S) (?=\S)", text) if self.beside(text) else text.split(" ")

    def _encode(self, chunks):
        coded_a = self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)
        coded_b = self.b.encode(chunks, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for chunk, a, b in zip(chunks, coded_a, coded_b):
            a, spelt = a.ids, (" " + chunk).encode()
            sound = b"".join(map(of_a, a)) == spelt and b"".join(map(of_b, b)) == spelt
            yield chunk, array("i", a).tobytes(), array("i", b).tobytes(), sound

    def encode(self, texts):
        """Per text the int32 ids of A and B as bytes; empty if the tokens do not spell it."""
        cut = [self.chunks(t) if t else [] for t in texts]
        new = set().union(*cut) - self.newer.keys()
        if len(self.newer) + len(new) > CACHED:
            self.older, self.newer = self.newer, {}
            new = set().union(*cut)
        again = new & self.older.keys()
        self.newer.update((c, self.older[c]) for c in again)
        once = {}
        for chunk, a, b, sound in self._encode(list(new - again)):
            (self.newer if len(chunk) <= CACHED_CHARS else once)[chunk] = (a, b, sound)
        known = {**self.newer, **once} if once else self.newer
        for text, chunks in zip(texts, cut):
            coded = [known[c] for c in chunks]
            a, b = b"".join([c[0] for c in coded]), b"".join([c[1] for c in coded])
            yield (a, b) if all([c[2] for c in coded]) else (b"", b"")


@lru_cache(maxsize=1)
def coder(path_a, path_b):
    """The coder of two files; tasks that follow each other in a worker keep its cache."""
    return Coder(path_a, path_b)


def group_digests(code, alignment, ids_a, ids_b, borders):
    """SHA-256 of each document's groups; ``borders``: (A tokens, B tokens) before each document."""
    starts_a, starts_b = (np.concatenate([[0], c + 1]) for c in (alignment.cuts_a, alignment.cuts_b))
    ended_a, ended_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ended_a[alignment.cuts_a] = ended_b[alignment.cuts_b] = 1
    group_a, group_b = np.cumsum(ended_a) - ended_a, np.cumsum(ended_b) - ended_b
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    # the tokens of A come behind the B tokens of earlier groups, those of B also behind their own A tokens
    written[np.arange(len(ids_a)) + starts_b[group_a]] = 2 * ids_a + ended_a
    written[np.arange(len(ids_b)) + starts_a[group_b + 1]] = 2 * (len(code.bytes_a) + ids_b) + ended_b
    edges = borders.sum(1).tolist()
    for low, high in zip(edges, edges[1:]):
        joined = b"".join(code.written[written[low:high]].tolist())
        yield hashlib.sha256(joined[:-1]).hexdigest() if joined else ""


def align(code, texts):
    """Facts per text, as columns, and its distinct pairs: (facts, borders of the texts in pairs, pairs, times).

    A pair is one number, id in A times the size of B's vocabulary plus id in B, in ascending order.
    """
    coded = list(code.encode(texts))
    ids_a, ids_b = (np.frombuffer(b"".join(c[i] for c in coded), np.int32).astype(np.int64) for i in (0, 1))
    counts = np.array([[len(a) // 4, len(b) // 4] for a, b in coded], np.int64).reshape(-1, 2)
    borders = np.concatenate([[[0, 0]], np.cumsum(counts, 0)])
    ends_a, ends_b = np.cumsum(code.size_a[ids_a]), np.cumsum(code.size_b[ids_b])
    alignment = Alignment(ends_a, ends_b)
    n_groups = np.diff(np.searchsorted(alignment.cuts_a, borders[:, 0]))
    place_a, place_b = alignment.links()
    text = np.searchsorted(borders[:, 0], place_a, "right") - 1
    n_links = np.bincount(text, minlength=len(coded))
    space = len(code.bytes_a) * len(code.bytes_b)
    pairs, times = np.unique(text * space + ids_a[place_a] * len(code.bytes_b) + ids_b[place_b], return_counts=True)
    edges = np.searchsorted(pairs, np.arange(len(coded) + 1) * space)
    digests = list(group_digests(code, alignment, ids_a, ids_b, borders))
    return [counts[:, 0], counts[:, 1], n_groups, n_links, digests], edges, pairs % space, times


def pair_type(code):
    return np.uint32 if len(code.bytes_a) * len(code.bytes_b) <= 1 << 32 else np.int64


def _stored(path_a, path_b, block_pairs, block_keys):
    names = [c.split()[0] for c in STORED.split(", ")]

    def run(batches):
        code = coder(path_a, path_b)
        kind, listed = pair_type(code), pa.list_(pa.int64())
        task = TaskContext.get()
        block, entries = (task.partitionId() if task else 0) << 33, 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def closed():
            """A row without a document that holds the block's pairs."""
            row = [[block], *[[None]] * 8, [keys], [sums]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=names)

        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), listed, listed]
        for batch in batches:
            for part in portions(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                facts, edges, pairs, times = align(code, texts)
                if entries and (entries + len(pairs) > block_pairs or len(keys) + len(np.unique(pairs)) > block_keys):
                    yield closed()
                    block, entries, keys, sums = block + 1, 0, keys[:0], sums[:0]
                entries += len(pairs)
                keys, at = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, times]), len(keys)).astype(np.int64)
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                row = [[block] * len(texts), part.column("doc_id"), *facts, cut(pairs.astype(kind)), cut(times.astype(np.uint32)), [None] * len(texts), [None] * len(texts)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(row, kinds)], names=names)
        if entries:
            yield closed()

    return run


def _summed(kind):
    def run(docs, found):
        pairs = found.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, n, best = pairs[order], found.column("n").to_numpy()[order], found.column("best").to_numpy()[order]
        sums, bests = [], []
        for held, times in zip(docs.column("pairs"), docs.column("times")):
            at = np.searchsorted(pairs, np.frombuffer(held.as_buffer(), kind))
            times = np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64)
            sums.append(int(n[at] @ times))
            bests.append(int(best[at] @ times))
        facts = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        columns = [*facts, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    return run


def pair_counts(stored, size_b):
    """(pair, n, best): links of every id pair, and 1 where no pair of its B id has more."""
    pairs = stored.where("block_pairs IS NOT NULL").select(F.inline(F.arrays_zip("block_pairs", "block_times")).alias("pair", "n"))
    pairs = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    piece = (F.col("pair") % size_b).alias("piece")
    most = F.broadcast(pairs.groupBy(piece).agg(F.max("n").alias("most")))  # at most one row per piece of B
    return pairs.withColumn("piece", piece).join(most, "piece").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def token_alignment(docs, path_a, path_b, block_pairs=BLOCK_PAIRS, block_keys=BLOCK_KEYS):
    """One row of ALIGNED for every row of ``docs`` (doc_id, text); the files are on all executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = materialize(rows.mapInArrow(_stored(path_a, path_b, block_pairs, block_keys), STORED), "alignment")
    code = coder(path_a, path_b)
    counts = pair_counts(stored, len(code.bytes_b))
    held = stored.where("block_pairs IS NOT NULL").select(F.col("block").alias("holder"), F.explode("block_pairs").alias("pair"))
    found = held.join(counts, "pair").select("holder", "pair", "n", "best").groupBy("holder")
    aligned = stored.where("block_pairs IS NULL").drop("block_pairs", "block_times").groupBy("block")
    return aligned.cogroup(found).applyInArrow(_summed(pair_type(code)), ALIGNED)
