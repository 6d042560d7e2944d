"""Hashed words, structure statistics and metadata of texts, for the classifiers."""

import zlib

import numpy as np

CACHED_WORDS = 300_000
STATISTICS = 12


class WordSlots(dict):
    """Slot of a word (bytes) in a table of 2**bits rows; forgets all words when there are too many."""

    def __init__(self, bits):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = slot = zlib.crc32(word) & self.mask
        return slot


def statistics(data, words, distinct):
    """STATISTICS numbers from 0 to 1 about the shape of a text (bytes, its words, distinct words)."""
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    lower, upper, digits = int(count[97:123].sum()), int(count[65:91].sum()), int(count[48:58].sum())
    high, lines = int(count[128:].sum()), int(count[10])
    marks = {m: int(count[ord(m)]) for m in "|!#$%&*.,?"}
    odd = marks["#"] + marks["$"] + marks["%"] + marks["&"] + marks["*"]
    total = max(1, len(words))
    return [
        upper / max(1, upper + lower),
        min(1.0, 5 * odd / n),
        min(1.0, 5 * marks["|"] / total),
        min(1.0, 2 * marks["!"] / total),
        min(1.0, 5 * digits / n),
        high / n,
        min(1.0, (marks["."] + marks["?"]) / total * 4),
        distinct / total,
        min(1.0, np.log1p(total) / 12),
        min(1.0, np.log1p(n) / 15),
        min(1.0, n / total / 20),
        min(1.0, lines / total * 4),
    ]
