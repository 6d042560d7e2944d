"""Quality classifier: a factorisation machine.

A text is scored by ``bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j``. The features are
its distinct words hashed into 2**BITS slots, each weighing 1 / sqrt(distinct words), statistics of
its shape, each also as one of BUCKETS steps, and its length as metadata. Neither language, source, ids nor
labels are inputs. The pair sum is half of (sum v_i x_i)^2 - sum (v_i x_i)^2, so a score
costs time in proportion to the features.

The model is fitted on the driver on at most SAMPLE labelled rows, drawn by a hash of their
ids (documented bound; the table of weights has a fixed size). Every text is scored whole.

Defined cases: null and empty texts have no words and are scored by their statistics. Rows that
repeat each get their score. Labels other than 0 and 1, or null, are not learnt from. Without
any label, or with one kind only, every score is the share of label 1 (0.5 without labels).
A null doc_id is scored, and held out is null. An empty table gives an empty result. Other columns
are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm.features import STATISTICS, WordSlots, statistics
from orderlens.llm.support import slices

BITS = 16
BUCKETS = 16
RANK = 8
SAMPLE = 8000
PASSES = 12
BATCH = 64
SLOTS = (1 << BITS) + STATISTICS * (BUCKETS + 1)


def encoded(text, slots):
    """Feature slots and values of one text."""
    data = (text or "").encode()
    words = data.lower().split()
    distinct = set(words)
    shape = np.array(statistics(data, words, len(distinct)), np.float32)
    own = np.fromiter(map(slots.__getitem__, distinct), np.int32, len(distinct))
    first = (1 << BITS) + np.arange(STATISTICS, dtype=np.int32)
    step = (1 << BITS) + STATISTICS + np.arange(STATISTICS, dtype=np.int32) * BUCKETS
    step = step + np.minimum((shape * BUCKETS).astype(np.int32), BUCKETS - 1)
    weight = np.float32(1 / np.sqrt(max(1, len(distinct))))
    values = np.concatenate([np.full(len(own), weight, np.float32), shape, np.full(STATISTICS, 0.5, np.float32)])
    return np.concatenate([own, first, step]).astype(np.int32), values


class FactorisationMachine:
    def __init__(self, slots=SLOTS, rank=RANK, seed=0):
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.linear = np.zeros(slots, np.float32)
        self.factors = rng.normal(0, 0.05, (slots, rank)).astype(np.float32)

    def sums(self, index, value, starts):
        """Margins of several texts, and their factor sums, by the sum-of-squares identity."""
        part = self.factors[index] * value[:, None]
        total = np.add.reduceat(part, starts)
        squares = np.add.reduceat((part * part).sum(1), starts)
        line = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + line + 0.5 * ((total * total).sum(1) - squares), total, part

    def scores(self, rows):
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        margin = self.sums(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)[0]
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def fit(self, rows, labels, passes=PASSES, rate=0.1, decay=1e-5, seed=0):
        """Adaptive gradient steps on the logistic loss."""
        rng = np.random.default_rng(seed)
        speed_w, speed_v, speed_b = np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        labels = np.asarray(labels, np.float32)
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                index = np.concatenate([rows[k][0] for k in picked])
                value = np.concatenate([rows[k][1] for k in picked])
                each = np.array([len(rows[k][0]) for k in picked])
                margin, total, part = self.sums(index, value, np.cumsum(each) - each)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]
                wide = np.repeat(error, each)
                used, place = np.unique(index, return_inverse=True)
                grad_w = np.bincount(place, wide * value, len(used)) / len(picked)
                cross = (wide * value)[:, None] * (np.repeat(total, each, axis=0) - part)
                order_by = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order_by], np.arange(len(used)))
                grad_v = np.add.reduceat(cross[order_by], edges) / len(picked)
                grad_w += decay * self.linear[used]
                grad_v += decay * self.factors[used]
                speed_w[used] += grad_w**2
                speed_v[used] += grad_v**2
                self.linear[used] -= rate * grad_w / np.sqrt(speed_w[used])
                self.factors[used] -= 0.3 * rate * grad_v / np.sqrt(speed_v[used])
                speed_b += error.mean() ** 2
                self.bias -= np.float32(rate * error.mean() / np.sqrt(speed_b))
        return self


def labelled_sample(docs, labels, column, fold, most=SAMPLE):
    """(text, label) of about ``most`` rows, and never many more, outside the held-out fold."""
    known = labels.where(F.col(column).isin(0, 1) & ~fold).select("doc_id", F.col(column).cast("int").alias("label"))
    known = known.dropDuplicates(["doc_id"])
    share = min(1.0, most / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # bounded by ``most``: ids and labels of the sample only
    picked = F.broadcast(known.where(drawn).withColumnRenamed("doc_id", "_known"))
    return docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_known")).select("text", "label")


def held_out(divisor, remainder):
    """Fold of a row: remainder of the CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder


def _features(batches):
    slots = WordSlots(BITS)
    for part in slices(batches, 256):
        rows = [encoded(t, slots) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i.tobytes() for i, _ in rows]), pa.array([v.tobytes() for _, v in rows]), part.column("label")],
            names=["slots", "weights", "label"],
        )


def fit_quality(docs, labels, fold):
    """(model, base): a model fitted on labelled rows outside ``fold``, or None and the constant score."""
    sample = labelled_sample(docs, labels, "quality", fold)
    found = sample.mapInArrow(_features, "slots binary, weights binary, label int").toPandas()
    truth = found["label"].to_numpy()
    if len(set(truth)) < 2:
        return None, float(truth.mean()) if len(truth) else 0.5
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(found["slots"], found["weights"])]
    order = sorted(range(len(rows)), key=lambda k: (found["slots"][k], truth[k]))  # reruns see one order
    return FactorisationMachine().fit([rows[k] for k in order], truth[order]), 0.5


def scorer(spark, fitted):
    """Function from a list of texts to their scores, for use within tasks."""
    model, base = fitted
    sent = spark.sparkContext.broadcast(model)

    def score(texts, slots):
        if sent.value is None:
            return np.full(len(texts), base)
        return sent.value.scores([encoded(t, slots) for t in texts])

    return score


def quality_scores(docs, labels, fold=None):
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    fold = held_out(3, 1) if fold is None else fold
    score = scorer(docs.sparkSession, fit_quality(docs, labels, fold))

    def run(batches):
        slots = WordSlots(BITS)
        for part in slices(batches, 256):
            found = score(part.column("text").to_pylist(), slots)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs, labels, fold=None):
    """The whole rows of ``docs`` whose score is at least 0.5."""
    fold = held_out(3, 1) if fold is None else fold
    score = scorer(docs.sparkSession, fit_quality(docs, labels, fold))

    def run(batches):
        slots = WordSlots(BITS)
        for part in slices(batches, 256):
            keep = score(part.column("text").to_pylist(), slots) >= 0.5
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
