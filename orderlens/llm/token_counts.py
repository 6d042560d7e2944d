"""Token counts of byte-level BPE texts by prefix dynamic programming.

The last token of every byte prefix of a pretoken is found from left to right. A token that
spans b[j:i] ends the encoding of b[:i] exactly if it is compatible with the last token of
b[:j], that is, if the two encoded together stay as they are. One token per prefix fits, so
``count[i] = count[j] + 1`` is the exact number of tokens of every prefix.

``prefix_table`` stores the counts at chunk ends (a chunk is a word with its blank), and
``tokens_before`` and ``longest_within`` answer how many tokens a prefix has and how much of a
text fits into a budget. They look at the stored ends and at the one chunk that the cut falls
into, which is encoded again for each length tried.

A chunk starts at a single blank between two other characters. The pretokeniser always
starts a token there and never looks back, so chunks are counted apart and kept in a cache.

Defined cases: a null or empty text has no bytes and no tokens. Rows that repeat each get
their result. An empty table gives an empty result. Other columns are ignored.
"""

import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from orderlens.llm.support import slices

LIMIT = 512
CACHED = 400_000
COUNTED = "doc_id long, n_bytes long, n_tokens long"
TABLE = "doc_id long, text string, ends array<int>, counts array<int>"

# fixed value: the pretokeniser of the byte-level vocabulary; White_Space as its library has it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters():
    """Letter that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(own)))
    return letters


class Vocabulary:
    """Tokens, merges and special strings of a tokenizers JSON file.

    Tokens are numbers here. ``made`` is the rank of the merge that makes a token (-1: a byte),
    ``halves`` the two tokens it is made of. ``step`` leads from a prefix of tokens (0: the empty
    one) and a byte to the longer prefix, and ``ends`` has the token that a prefix is, if any.
    """

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        raw = {letter: byte for byte, letter in byte_letters().items()}
        plain = lambda s: bytes(raw[c] for c in s)
        merges = {}
        for i, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault((plain(a), plain(b)), i)
        special = [t["content"] for t in data["added_tokens"]]
        names = [plain(t) for t in data["model"]["vocab"] if t not in special]
        # a token that its own bytes do not encode to never occurs
        split = {t: merged(t, merges) for t in names}
        self.tokens = {t: i for i, t in enumerate(t for t in names if len(split[t]) <= 2 and (len(t) == 1 or split[t] in merges))}
        self.rank = {(self.tokens[a], self.tokens[b]): r for (a, b), r in merges.items() if a in self.tokens and b in self.tokens}
        self.halves = [(self.tokens[split[t][0]], self.tokens[split[t][1]]) if len(t) > 1 else None for t in self.tokens]
        self.made = [self.rank[h] if h else -1 for h in self.halves]
        self.step, self.ends = {}, [None]
        for token, number in self.tokens.items():
            at = 0
            for byte in token:
                after = self.step.get(at << 8 | byte)
                if after is None:
                    after = self.step[at << 8 | byte] = len(self.ends)
                    self.ends.append(None)
                at = after
            self.ends[at] = number
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def compatible(self, x, y):
        """Whether the bytes of two tokens together encode to these two tokens.

        The merges inside both are undone, the last one first. If the two tokens at the border
        had a merge that comes before the one undone, it would have joined them. Of equal
        merges the left one comes first.
        """
        limit = len(self.made) << 8
        while True:
            if self.rank.get((x, y), limit) < limit:
                return False
            if self.made[x] > self.made[y]:
                limit, x = self.made[x], self.halves[x][1]
            elif self.made[y] >= 0:
                limit, y = self.made[y] + 1, self.halves[y][0]
            else:
                return True


def merged(data, merges):
    """Parts of a token's bytes after repeated best merges, stopped at two parts."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 2:
        ranks = [merges.get(p, 1 << 60) for p in zip(parts, parts[1:])]
        best = min(ranks)
        if best == 1 << 60:
            break
        at, out = 0, []
        while at < len(parts):
            if at < len(ranks) and ranks[at] == best:
                out.append(parts[at] + parts[at + 1])
                at += 2
            else:
                out.append(parts[at])
                at += 1
        if len(out) == 1:
            break
        parts = out
    return tuple(parts)


class PrefixCounter:
    """Exact token counts of all prefixes, with bounded caches."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        self.fits, self.pretokens, self.words = {}, {}, {}
        self.find = regex.compile(PATTERN).findall
        self.beside = re.compile(r"\s | \s|^ | $").search  # a blank that is no chunk start

    def prefix_counts(self, data):
        """count[i]: tokens of data[:i], for bytes of one pretoken."""
        step, ends, fits, n = self.vocabulary.step.get, self.vocabulary.ends, self.fits, len(data)
        if len(fits) >= CACHED:
            fits.clear()
        last, count = [None] * (n + 1), [0] * (n + 1)
        for j in range(n):
            left, at = last[j], 0
            for i in range(j, n):
                at = step(at << 8 | data[i])
                if at is None:
                    break
                token = ends[at]
                if token is None or last[i + 1] is not None:
                    continue
                if left is not None:
                    key = left << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self.vocabulary.compatible(left, token)
                    if not fit:
                        continue
                last[i + 1], count[i + 1] = token, count[j] + 1
        return count

    def pretoken(self, text):
        known = self.pretokens.get(text)
        if known is None:
            if len(self.pretokens) >= CACHED:
                self.pretokens.clear()
            known = self.pretokens[text] = self.prefix_counts(text.encode())[-1]
        return known

    def span(self, text):
        """Tokens of a stretch of text that starts where the pretokeniser starts a token."""
        special = self.vocabulary.special
        if special and special.search(text):
            return len(special.findall(text)) + sum(self.span(s) for s in special.split(text))
        return sum(map(self.pretoken, self.find(text)))

    def chunk(self, text):
        known = self.words.get(text)
        if known is None:
            if len(self.words) >= CACHED:
                self.words.clear()
            known = self.words[text] = self.span(text)
        return known

    def chunks(self, text):
        """The chunks of a text, in order; together they are the text."""
        special = self.vocabulary.special
        if special and special.search(text) and any(" " in s for s in special.findall(text)):
            return [text]
        if self.beside(text):
            parts = re.split(r"(?<=\S) (?=\S)", text)
        else:
            parts = text.split(" ")
        return [parts[0], *(" " + p for p in parts[1:])]

    def count(self, text):
        if not text:
            return 0
        chunks = self.chunks(text)
        counts = list(map(self.words.get, chunks))
        if None in counts:
            counts = map(self.chunk, chunks)
        return sum(counts)


@lru_cache(maxsize=1)
def shared_counter(path):
    """The counter of a vocabulary file; tasks that follow each other in a worker keep its caches."""
    return PrefixCounter(Vocabulary(path))


def tokens_before(counter, text, ends, counts, length):
    """Tokens of the first ``length`` characters, from a stored row."""
    length = min(length, len(text))
    k = bisect_right(ends, length) - 1  # chunks that end within the prefix
    done, at = (counts[k], ends[k]) if k >= 0 else (0, 0)
    return done + counter.chunk(text[at:length]) if length > at else done


def longest_within(counter, text, ends, counts, budget):
    """Most characters whose prefix has at most ``budget`` tokens, from a stored row."""
    within = [e for e, c in zip(ends, counts) if c <= budget]
    at = within[-1] if within else 0
    k = len(within)
    stop = ends[k] if k < len(ends) else at
    # the next chunk does not fit whole; its longest prefix that does
    for length in range(stop, at, -1):
        if tokens_before(counter, text, ends, counts, length) <= budget:
            return length
    return at


def _counted(path):
    def run(batches):
        counter = shared_counter(path)
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def _tabled(path):
    def run(batches):
        counter = shared_counter(path)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            cut = [counter.chunks(t) if t else [] for t in texts]
            ends = [np.cumsum([len(c) for c in x], dtype=np.int32).tolist() for x in cut]
            counts = [np.cumsum([counter.chunk(c) for c in x], dtype=np.int32).tolist() for x in cut]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(ends, kind), pa.array(counts, kind)],
                names=["doc_id", "text", "ends", "counts"],
            )

    return run


def _truncated(path, budget):
    def run(batches):
        counter = shared_counter(path)
        for part in slices(batches):
            rows = zip(*(part.column(c).to_pylist() for c in ("text", "ends", "counts")))
            texts = [t and t[: longest_within(counter, t, e, c, budget)] for t, e, c in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return run


def token_counts(docs, path, limit=LIMIT):
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text)."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted(path), COUNTED)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs, path):
    """(doc_id, text, ends, counts): tokens of the text up to each chunk end, in characters."""
    return docs.select("doc_id", "text").mapInArrow(_tabled(path), TABLE)


def truncated(table, path, budget):
    """(doc_id, text) cut to the longest prefix of at most ``budget`` tokens, from a prefix table."""
    return table.mapInArrow(_truncated(path, budget), "doc_id long, text string")
