"""Substring dedup: repeated passages found by hashed windows of words, wherever they begin.

Words are runs of letters and digits, case folded; a character of a script without blanks is a word.
Of all windows of WINDOW words those with the smallest hash among as many neighbours as a stretch of
MIN_WORDS words holds are anchors: every stretch of MIN_WORDS words has one, and equal
stretches have the same, whatever lines, punctuation or case surround them. Anchors are hashed to 128
bits and grouped globally; the occurrence in the smallest doc_id, and there the first one, is kept.
An anchor that is kept elsewhere is extended word by word against the kept occurrence, as far as the
neighbouring anchor must begin (24 bits of each word's hash are compared). Extended anchors that
touch are a passage; passages of at least MIN_WORDS words are removed, with their offsets in the
original text and the punctuation behind them. Shorter stretches (a header line, a licence line) stay.
A stretch is compared with the first occurrence of each of its anchors only.

``repeated_spans`` is the coarser form by whole units: a unit is a sentence of a line that ends at a line
break, behind a word that ends in ``.``, ``!`` or ``?``, or in front of a capitalised word that follows
one in lower case or a comma. It loses a passage's edge units where foreign words join them.

Defined cases: null, empty and blank texts have no words and are returned as they are. Rows that repeat a doc_id with the same text
are one document; their texts lose the same spans. Rows that repeat a doc_id with another text are other
documents, ranked by the hash of their text. A null doc_id is ranked last and keeps its text.
An empty table gives an empty result. Other columns are ignored by ``repeated_spans`` and ``shared_passages`` and kept by
``without_repeats``.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.llm.support import materialize, slices

MIN_WORDS = 40
WINDOW = 20
UNITS = "doc_id long, unit int, start int, stop int, words int, high long, low long"
_NAMES = ["doc_id", "unit", "start", "stop", "words", "high", "low"]
_CUT = re.compile(r"\n+|(?<=[.!?])[ \t]+|(?<=(?:[^\W\d_A-Z]|[,;:]))[ \t]+(?=[^\W\d_a-z])")
_SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
_TAIL = re.compile(r"[^\s\w]*")
ANCHORS = "doc_id long, copy long, at int, high long, low long, before binary, after binary"
_PLAIN = re.compile(r"[\W_]+")


def units_of(text):
    """(start, stop, words, digest) of the units of a text, in order, without blank ones."""
    out, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        stop, after = (cut.start(), cut.end()) if cut else (len(text), len(text))
        if cut and text[cut.end() : cut.end() + 1].islower() and cut.group()[0] != "\n" and text[cut.start() - 1] not in ".!?":  # a small letter beyond ASCII
            continue
        plain = _PLAIN.sub(" ", text[at:stop]).strip().lower()
        if plain:
            digest = hashlib.blake2b(plain.encode(), digest_size=16).digest()
            out.append((at, stop, plain.count(" ") + 1, digest))
        at = after
    return out


def _units(batches):
    for part in slices(batches, 256):
        ids = part.column("doc_id").to_pylist()
        found = [units_of(t) if t and i is not None else [] for i, t in zip(ids, part.column("text").to_pylist())]
        each = [len(f) for f in found]
        flat = [u for f in found for u in f]
        words = np.frombuffer(b"".join(u[3] for u in flat), np.int64).reshape(-1, 2)
        numbers = np.concatenate([np.arange(e, dtype=np.int32) for e in each]) if each else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([i or 0 for i in ids], np.int64), each)),
                pa.array(numbers),
                *[pa.array([u[k] for u in flat], pa.int32()) for k in range(3)],
                pa.array(words[:, 0].copy()),
                pa.array(words[:, 1].copy()),
            ],
            names=_NAMES,
        )


def repeated_spans(docs, min_words=MIN_WORDS):
    """(doc_id, start, stop, words, kept_in) for every passage to remove from ``docs``
    (doc_id, text): character offsets in the original text, and the documents that keep its units.

    Both shuffles go by digest. The first counts digests with partial sums; the second joins units
    with the written table of repeated digests, whose hot ones the adaptive join splits.
    """
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_units, UNITS)
    groups = units.groupBy("high", "low").agg(F.min("doc_id").alias("kept_in"), F.count("*").alias("times"))
    again = materialize(groups.where("times > 1").drop("times"), "digests")
    seen = materialize(units.join(again, ["high", "low"]), "units")
    # within the keeping document only its first occurrence stays
    own = seen.where("doc_id = kept_in").groupBy("high", "low").agg(F.min("unit").alias("first"))
    own = materialize(own, "firsts")
    inside = seen.where("doc_id = kept_in").join(own, ["high", "low"]).where("unit > first").drop("first")
    gone = seen.where("doc_id > kept_in").unionByName(inside)
    gone = gone.select(*_NAMES[:5], "kept_in").dropDuplicates(["doc_id", "unit", "start"])
    order = Window.partitionBy("doc_id").orderBy("unit")
    gone = gone.withColumn("stretch", F.col("unit") - F.row_number().over(order))
    spans = gone.groupBy("doc_id", "stretch").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("words"),
        F.array_sort(F.collect_set("kept_in")).alias("kept_in"),
    )
    return spans.where(F.col("words") >= min_words).drop("stretch")


class _Hashes(dict):
    """64-bit hashes of words, kept for a batch."""

    def __missing__(self, word):
        found = self[word] = int.from_bytes(hashlib.blake2b(word.encode(errors="replace"), digest_size=8).digest(), "little")
        return found


def words_of(text):
    """Words of a text as they are compared."""
    return " ".join(_WORD.findall(text)).lower().split()


def _rolled(hashes, window, base):
    out = np.zeros(len(hashes) - window + 1, np.uint64)
    for j in range(window):
        out = out * np.uint64(base) + hashes[j : j + len(out)]
    return out


def anchors_of(texts, window=WINDOW, min_words=MIN_WORDS):
    """(text, at, high, low, before, after) of the anchors of ``texts``, in order: numbers of the text
    and of the first word, the digest, and 3 bytes of each word near it on both sides."""
    cache, size = _Hashes(), min_words - window + 1
    listed = [words_of(t) if t else [] for t in texts]
    each = np.array([len(w) for w in listed], np.int64)
    starts = np.concatenate([[0], np.cumsum(each)])
    hashes = np.fromiter((cache[w] for x in listed for w in x), np.uint64, starts[-1])
    if len(hashes) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
    of = np.repeat(np.arange(len(texts)), each)
    high, low = _rolled(hashes, window, 0x9E3779B97F4A7C15), _rolled(hashes, window, 0xC2B2AE3D27D4EB4F)
    order = (high ^ (high >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    views = np.lib.stride_tricks.sliding_window_view(order, size)
    whole = np.flatnonzero(of[: len(views)] == of[min_words - 1 : min_words - 1 + len(views)])
    least = [views[whole[k : k + 65536]].argmin(1) + whole[k : k + 65536] for k in range(0, len(whole), 65536)]
    at = np.unique(np.concatenate(least)) if least else np.zeros(0, np.int64)
    text = of[at]
    near = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()
    first, last = np.maximum(starts[text], at - size), np.minimum(starts[text + 1], at + window + size)
    before = [near[3 * a : 3 * b] for a, b in zip(first.tolist(), at.tolist())]
    after = [near[3 * (a + window) : 3 * b] for a, b in zip(at.tolist(), last.tolist())]
    return text, (at - starts[text]).astype(np.int32), high[at].view(np.int64), low[at].view(np.int64), before, after


def _anchored(window, min_words):
    def run(batches):
        for part in slices(batches, 256):
            ids = part.column("doc_id").to_pylist()
            texts = [t if i is not None else None for i, t in zip(ids, part.column("text").to_pylist())]
            text, *rest = anchors_of(texts, window, min_words)
            ids = np.array([i or 0 for i in ids], np.int64)[text]
            copies = np.asarray(part.column("copy"))[text]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(copies), *[pa.array(r, k) for r, k in zip(rest, kinds)]],
                names=["doc_id", "copy", "at", "high", "low", "before", "after"],
            )

    return run


def _equal(a, b):
    """Number of words at the start of both."""
    n = min(len(a), len(b)) // 3
    if a[: 3 * n] == b[: 3 * n]:
        return n
    return next(k for k in range(n) if a[3 * k : 3 * k + 3] != b[3 * k : 3 * k + 3])


def _extended(window):
    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("at"))
            # from the anchor outwards: bytes turned round on both sides keep words comparable
            left = [_equal(a[::-1], b[::-1]) for a, b in zip(batch.column("before").to_pylist(), batch.column("before_kept").to_pylist())]
            right = [_equal(a, b) for a, b in zip(batch.column("after").to_pylist(), batch.column("after_kept").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("copy"),
                    pa.array(at - np.array(left, np.int32), pa.int32()),
                    pa.array(at + np.array(right, np.int32) + window, pa.int32()),
                    batch.column("kept_in"),
                ],
                names=["doc_id", "copy", "first", "last", "kept_in"],
            )

    return run


def _placed(batches):
    for part in slices(batches, 256):
        out = []
        for i, copy, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "copy", "text", "spans"))):
            found = [m.span() for m in _WORD.finditer(text or "")]
            for s in spans:
                stop = _TAIL.match(text, found[s["last"] - 1][1]).end()
                out.append((i, copy, found[s["first"]][0], stop, s["last"] - s["first"], s["kept_in"]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "copy", "start", "stop", "words", "kept_in"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def shared_passages(docs, min_words=MIN_WORDS):
    """(doc_id, start, stop, words, kept_in) for every passage to remove from ``docs``
    (doc_id, text), as ``repeated_spans`` has them, wherever a passage begins and ends.

    Digests are counted with partial sums first; only anchors whose digest is repeated are written.
    """
    return _passages(docs, min_words).drop("copy").distinct()


def _copy_of(text):
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _passages(docs, min_words):
    """The passages with ``copy``, the hash of the text they are in."""
    window = max(1, min(WINDOW, min_words // 2))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _copy_of("text").alias("copy"))
    anchors = docs.mapInArrow(_anchored(window, min_words), ANCHORS)
    again = anchors.groupBy("high", "low").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    again = materialize(again, "digests")
    seen = materialize(anchors.join(again, ["high", "low"]), "anchors")
    kept = seen.groupBy("high", "low").agg(F.min(F.struct("doc_id", "copy", "at", "before", "after")).alias("k"))
    kept = materialize(kept.select("high", "low", F.expr("k.doc_id AS kept_in"), F.expr("k.copy AS copy_kept"), F.expr("k.at AS at_kept"), F.expr("k.before AS before_kept"), F.expr("k.after AS after_kept")), "kept")
    gone = seen.join(kept, ["high", "low"]).where("struct(doc_id, copy, at) > struct(kept_in, copy_kept, at_kept)")
    gone = gone.select("doc_id", "copy", "at", "before", "after", "kept_in", "before_kept", "after_kept")
    gone = gone.mapInArrow(_extended(window), "doc_id long, copy long, first int, last int, kept_in long").distinct()
    order = Window.partitionBy("doc_id", "copy").orderBy("first", "last", "kept_in")
    gone = gone.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gone = gone.withColumn("stretch", F.sum(F.expr("int(reach IS NULL OR first > reach)")).over(order))
    spans = gone.groupBy("doc_id", "copy", "stretch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set("kept_in")).alias("kept_in")
    )
    spans = spans.where(F.col("last") - F.col("first") >= min_words)
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(
        F.collect_list(F.struct("first", "last", "kept_in")).alias("spans")
    )
    spans = materialize(spans, "passages")
    found = docs.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("doc_id", "copy", "text", "spans")
    return found.mapInArrow(_placed, "doc_id long, copy long, start int, stop int, words long, kept_in array<long>").distinct()


def without_repeats(docs, min_words=MIN_WORDS):
    """``docs`` (doc_id, text, n_chars, ...) with the passages cut out and n_chars as it is then."""
    spans = _passages(docs, min_words).distinct()
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    spans = materialize(spans, "spans")
    return cut_spans(docs, spans)


def cut_spans(docs, spans):
    """Rows of ``docs`` without the spans of (_id, _copy, _spans array<struct<start, stop>>)."""
    columns = docs.columns
    packed = docs.select(F.col("doc_id").cast("long").alias("_key"), _copy_of("text").alias("_text_copy"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    # character offsets of Python, which Spark's substring shares
    pieces = (
        "concat_ws('', transform(sequence(0, size(_cut)), i -> CASE"
        " WHEN i = 0 THEN substring(_row.text, 1, _cut[0].start)"
        " WHEN i = size(_cut) THEN substring(_row.text, _cut[i - 1].stop + 1)"
        " ELSE substring(_row.text, _cut[i - 1].stop + 1, _cut[i].start - _cut[i - 1].stop) END))"
    )
    cuts = spans.select("_id", "_copy", F.array_sort("_spans").alias("_cut"))
    joined = packed.join(cuts, (F.col("_key") == F.col("_id")) & (F.col("_text_copy") == F.col("_copy")), "left")
    text = F.expr(f"IF(_cut IS NULL OR _row.text IS NULL, _row.text, {pieces})")
    joined = joined.withColumn("_text", text)
    out = []
    for c in columns:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(F.col("_cut").isNotNull(), F.char_length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)
