"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs. The pair whose union has the best score is
merged first, the leftmost of equal ones; a merge puts its two new neighbour pairs on the
agenda, and entries whose symbols have changed since are skipped. Symbols that are no piece in the
end become the byte pieces of their UTF-8 form.

No piece of such a vocabulary holds a word mark behind another character (``Pieces`` checks
it), so merges never cross the place in front of a run of marks. Texts are cut there, and each
distinct chunk is encoded once per worker and cache period; short chunks keep their agenda as a
list in place, long ones as a heap. Every chunk that enters the cache is compared with the sentencepiece library, all of an Arrow slice in one call, and so is the decoded
text of every document with the library's ``decode``. A difference raises an error.

Defined cases: null and empty texts give the end id alone and decode to "". Rows that repeat
each get their result. An empty table gives an empty result. Other columns are ignored.
"""

import re
from array import array
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm.support import slices

MARK = "▁"
CACHED_CHUNKS = 250_000  # of the newer and of the older half of the cache each
LISTED = 48  # a longer chunk keeps its agenda as a heap
NEVER = float("inf")
NONE = np.iinfo(np.int32).max  # rank of a pair that spells no piece
_MIX = np.uint64(0x9E3779B97F4A7C15)
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """Scores, ids and surfaces of a model file, and its library processor as the check."""

    def __init__(self, model):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(len(names))]
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.costs = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.end = sp.eos_id()
        self.surfaces = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b""
            for i, p in enumerate(names)
        ]
        self.digits = [str(i).encode() for i in range(len(names))]
        self._pairs()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark behind another character")
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary lacks byte pieces")

    def _pairs(self):
        """Symbols (characters of pieces, and pieces) as numbers, and the pairs of symbols that spell a piece."""
        symbols = sorted(set(self.ids).union(*self.ids))
        number = {s: k for k, s in enumerate(symbols)}
        other = len(symbols)  # the number of all characters that no piece holds
        self.symbol_ids = np.array([self.ids.get(s, -1) for s in symbols] + [-1], np.int32)
        self.characters = np.full(max(ord(s) for s in symbols if len(s) == 1) + 2, other, np.int64)  # by code point
        for s in symbols:
            if len(s) == 1:
                self.characters[ord(s)] = number[s]
        order = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = [
            (number[p[:i]] * (other + 1) + number[p[i:]], order[self.costs[p]], number[p])
            for p in self.ids
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        ]
        self.symbols = other + 1
        # an open-addressing table of pairs: a key's slot, or the next free one
        self.bits = max(4, (4 * len(pairs)).bit_length())
        slots, keys = 1 << self.bits, np.array([k for k, _, _ in pairs], np.int64)
        self.keys, self.ranks, self.unions = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int32), np.zeros(slots, np.int64)
        for (key, rank, union), at in zip(pairs, self._slot(keys).tolist()):
            while self.keys[at] != -1:
                at = (at + 1) % slots
            self.keys[at], self.ranks[at], self.unions[at] = key, rank, union

    def _slot(self, keys):
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).view(np.int64)

    def _ranked(self, left, right):
        """(rank of the cost, union) of each pair of symbols; NONE for pairs that spell no piece."""
        keys = left * self.symbols + right
        at = self._slot(keys)
        held = self.keys[at]
        other = np.flatnonzero((held != keys) & (held != -1))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[other]]
            other = other[(held != keys[other]) & (held != -1)]
        return self.ranks[at], self.unions[at]

    def encode_chunks(self, chunks):
        """Piece ids of each chunk. Short ones are merged together: each round takes the best pair, the
        leftmost of equal ones, from the agenda of every chunk."""
        coded = [None if len(c) <= LISTED else self.encode_chunk(c) for c in chunks]
        short = [k for k, ids in enumerate(coded) if ids is None]
        text = "".join([chunks[k] for k in short])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        owners = np.repeat(np.array(short, np.int64), np.array([len(chunks[k]) for k in short], np.int64))
        symbols = self.characters[np.minimum(points, len(self.characters) - 1)]
        # the agenda: of each symbol and the one behind it, if both are of one chunk
        ranks, unions = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owners[1:] == owners[:-1])
        ranks[inner], unions[inner] = self._ranked(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(symbols)]))
            over = best == NONE
            if over.any():
                self._spell(coded, owners[over], symbols[over], points[over])
                more = ~over
                symbols, points, owners = symbols[more], points[more], owners[more]
                ranks, unions, best = ranks[more], unions[more], best[more]
            at = np.flatnonzero(ranks == best)
            at = at[np.r_[True, owners[at[1:]] != owners[at[:-1]]][: len(at)]]
            symbols[at] = unions[at]
            kept = np.ones(len(symbols), np.bool_)
            kept[at + 1] = False
            symbols, points, owners, ranks, unions = symbols[kept], points[kept], owners[kept], ranks[kept], unions[kept]
            at -= np.arange(len(at))  # each chunk before has one symbol less
            ranks[at] = NONE
            for first in (at, at - 1):
                first = first[(first >= 0) & (first + 1 < len(symbols))]
                first = first[owners[first] == owners[first + 1]]
                ranks[first], unions[first] = self._ranked(symbols[first], symbols[first + 1])
        return coded

    def _spell(self, coded, owners, symbols, points):
        """Put the ids of the chunks' symbols into ``coded``; a symbol that is no piece is one character."""
        ids = self.symbol_ids[symbols]
        lost = np.flatnonzero(ids < 0)
        listed, starts = ids.tolist(), np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        chunks = owners[starts].tolist()
        for k, a, b in zip(chunks, starts.tolist(), [*starts[1:].tolist(), len(listed)]):
            coded[k] = listed[a:b]
        if len(lost):
            letters = dict(zip(lost.tolist(), map(chr, points[lost].tolist())))
            for j in np.unique(np.searchsorted(starts, lost, "right") - 1).tolist():
                a = int(starts[j])
                coded[chunks[j]] = [
                    i for at, known in enumerate(coded[chunks[j]], a)
                    for i in ([known] if known >= 0 else [self.bytes[b] for b in letters[at].encode()])
                ]

    def encode_chunk(self, chunk):
        """Piece ids of one chunk, merged by the agenda."""
        symbols = self._merged(list(chunk)) if len(chunk) <= LISTED else self._merged_by_heap(list(chunk))
        ids = []
        for s in symbols:
            known = self.ids.get(s)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.bytes[b] for b in s.encode()]
        return ids

    def _merged(self, symbols):
        """Symbols in the end; the agenda is the list of the costs of all adjacent pairs."""
        cost = self.costs.get
        agenda = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)  # the leftmost of equal ones
            symbols[i] = union = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost(union + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + union, NEVER)
        return symbols

    def _merged_by_heap(self, symbols):
        """Symbols in the end; the agenda is a heap, whose outdated entries are skipped."""
        costs, last = self.costs, len(symbols)
        agenda = []
        for i in range(last - 1):
            cost = costs.get(symbols[i] + symbols[i + 1])
            if cost is not None:
                agenda.append((cost, i, i + 1, symbols[i] + symbols[i + 1]))
        heapify(agenda)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        while agenda:
            _, i, j, union = heappop(agenda)
            # entries whose symbols have been merged meanwhile no longer spell the union
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != union:
                continue
            symbols[i], symbols[j] = union, None
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                cost = costs.get(union + symbols[k])
                if cost is not None:
                    heappush(agenda, (cost, i, k, union + symbols[k]))
            h = before[i]
            if h >= 0:
                cost = costs.get(symbols[h] + union)
                if cost is not None:
                    heappush(agenda, (cost, h, i, symbols[h] + union))
        return [s for s in symbols if s is not None]

    def decode(self, ids):
        """Text of the ids; the mark in front of the first piece is dropped."""
        return shown(b"".join(map(self.surfaces.__getitem__, ids)))


def shown(surface):
    """Text of the joined surfaces of pieces."""
    return (surface[1:] if surface[:1] == b" " else surface).decode("utf-8", "replace")


_CUT = re.compile(f"{MARK}+[^{MARK}]*")


def chunks_of(text):
    """Runs of word marks with what follows them; all pieces lie within one."""
    marked = MARK + text.replace(" ", MARK)
    if MARK + MARK in marked:
        return _CUT.findall(marked)
    return [MARK + c for c in marked[1:].split(MARK)]


class ChunkCache(dict):
    """What a chunk is coded to: its int32 ids as bytes, the same in decimal digits, and its decoded bytes.

    Chunks of the older half come back when they are met again.
    """

    def __init__(self, pieces):
        super().__init__()
        self.pieces, self.older = pieces, {}

    def learn(self, texts):
        """Encode the chunks of ``texts`` that are new and compare them with the library."""
        needed = set().union(*texts)
        new = {c for c in needed if c not in self}  # the cache is larger than a slice
        if len(self) + len(new) > CACHED_CHUNKS:
            self.older = dict(self)
            self.clear()
            new = needed
        older = self.older
        again = new & older.keys()
        self.update(zip(again, map(older.__getitem__, again)))
        new = list(new - again)
        # the library puts one mark in front of a text, which is the chunk's first
        wanted = self.pieces.library.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)
        surfaces, digits = self.pieces.surfaces.__getitem__, self.pieces.digits.__getitem__
        for chunk, ids, library in zip(new, self.pieces.encode_chunks(new), wanted):
            if ids != library and chunk != MARK:  # the library gives no ids for an empty text
                raise ValueError(f"{chunk!r}: {ids} here, {library} in the library")
            self[chunk] = (array("i", ids).tobytes(), b" ".join(map(digits, ids)), b"".join(map(surfaces, ids)))


@lru_cache(maxsize=1)
def chunk_cache(model):
    """The cache of a model file; tasks that follow each other in a worker keep it."""
    return ChunkCache(Pieces(model))


def encode_text(text, cache):
    """int32 ids of the chunks of a text without an end id, as bytes."""
    return b"".join([cache[c][0] for c in text])


def _coded(batches, model):
    """Per slice: its rows, and per text the coded chunks, the int32 ids as bytes and the decoded text."""
    cache = chunk_cache(model)
    pieces = cache.pieces
    end = array("i", [pieces.end]).tobytes()
    for part in slices(batches, 128):
        texts = [t or "" for t in part.column("text").to_pylist()]
        cut = [chunks_of(t) if t else [] for t in texts]
        cache.learn(cut)
        chunks = [[cache[c] for c in text] for text in cut]
        ids = [b"".join([c[0] for c in text]) + end for text in chunks]
        decoded = [shown(b"".join([c[2] for c in text])) for text in chunks]
        library = pieces.library.decode([array("i", x).tolist() for x in ids], num_threads=1)
        for text, wanted in zip(decoded, library):
            if text != wanted:
                raise ValueError(f"decoded {text[:80]!r} here, {wanted[:80]!r} in the library")
        yield part, chunks, ids, decoded


def _encode(model):
    def run(batches):
        for part, _, coded, decoded in _coded(batches, model):
            offsets = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), ids, pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return run


def _digested(model):
    def run(batches):
        last = str(chunk_cache(model).pieces.end).encode()
        for part, chunks, coded, decoded in _coded(batches, model):
            written = [b" ".join([*[c[1] for c in text], last]) for text in chunks]
            columns = [
                part.column("doc_id").cast(pa.int64()),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([sha256(w).hexdigest() for w in written]),
                pa.array([sha256(t.encode()).hexdigest() for t in decoded]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGESTS.split(", ")])

    return run


def encode_decode(docs, model):
    """(doc_id, ids, decoded) for every row of ``docs`` (doc_id, text); ``model``: a file that all
    executors have."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model), ENCODED)


def encoded_digests(docs, model):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``, made where the ids are."""
    return docs.select("doc_id", "text").mapInArrow(_digested(model), DIGESTS)


def digests(encoded):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
