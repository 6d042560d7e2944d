"""Toxicity by weak supervision.

Voters. Words, and word beginnings of PREFIXES letters, that occur in labelled toxic texts far more
often than in others, dealt over LEXICONS lexicon voters and as many pattern voters; and voters on
the share and the number of such hits. Each votes 1 or 0 on every text.

Label model. The votes of all texts are counted as patterns (at most 2**voters, so bounded). A
model with one hidden label is fitted to the counts by expectation maximisation: each voter has its
two accuracies. Votes that agree beyond what the label explains are correlated; a voter's weight
is divided by one plus its correlations given the label, so that many similar voters do not
count as many witnesses. The posterior label of a pattern follows.

Classifier. A logistic model on hashed words and word beginnings, with weights drawn to zero,
is trained on the posterior labels of at most SAMPLE texts of the training fold and scores every
text in time proportional to its distinct words.

Neither language, source, ids nor labels are inputs of a score. Defined cases: null and empty texts get
the score of a text without features. Rows that repeat each get their score. Labels other than 0
and 1 are not learnt from. Without toxic labels there are no voters and all scores are 0. A null
doc_id is scored. An empty table gives an empty result. Other columns are ignored.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm.quality_model import held_out, labelled_sample
from orderlens.llm.support import materialize, slices

PREFIXES = (4, 5, 6)
LEXICONS = 5
TERMS = 400  # words and beginnings of each kind that voters use
SAMPLE = 12_000
BITS = 18
CACHED_WORDS = 300_000
PASSES = 8
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # letters and digits; any non-ASCII byte


def words_of(text):
    """Distinct words of a text, lower-cased, as bytes."""
    return set(_WORD.findall((text or "").lower().encode()))


def beginnings(word):
    """Beginnings of a word that is longer than they are, counted in letters."""
    letters = word.decode("utf-8", "ignore")
    return [letters[:k].encode() for k in PREFIXES if len(letters) > k]


def _term_counts(batches):
    """(term, kind, toxic, clean): texts of the sample that hold a term, summed per task."""
    found = {}
    for part in slices(batches, 256):
        for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
            words = words_of(text)
            for key in {(w, 0) for w in words} | {(b, 1) for w in words for b in beginnings(w)}:
                found.setdefault(key, [0, 0])[label] += 1
    rows = list(found.items())
    yield pa.RecordBatch.from_pydict(
        {
            "term": [k[0] for k, _ in rows],
            "kind": [k[1] for k, _ in rows],
            "toxic": [v[1] for _, v in rows],
            "clean": [v[0] for _, v in rows],
        },
        pa.schema([("term", pa.binary()), ("kind", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())]),
    )


def lexicons(sample):
    """Per kind, the terms that mark toxic texts, strongest first: [[words], [beginnings]]."""
    counts = sample.mapInArrow(_term_counts, "term binary, kind int, toxic long, clean long")
    counts = counts.groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    if not total.t or total.t == total.n:
        return [[], []]
    ratio = ((F.col("toxic") + 0.1) / total.t) / ((F.col("clean") + 0.1) / (total.n - total.t))
    marked = counts.where((F.col("toxic") >= 3) & (ratio >= 20)).withColumn("gain", F.col("toxic") * F.log(ratio))
    out = []
    for kind in (0, 1):
        rows = marked.where(F.col("kind") == kind).orderBy(F.desc("gain"), "term").limit(TERMS).collect()
        out.append([bytes(r.term) for r in rows])
    return out


class Voters:
    """Votes of a text as bits, from the two term lists."""

    def __init__(self, lists):
        self.count = 2 * LEXICONS + 2
        self.bit = [{t: 1 << (k % LEXICONS + kind * LEXICONS) for k, t in enumerate(terms)} for kind, terms in enumerate(lists)]
        self.cache = {}

    def word(self, word):
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            known = self.bit[0].get(word, 0)
            for b in beginnings(word):
                known |= self.bit[1].get(b, 0)
            self.cache[word] = known
        return known

    def votes(self, words):
        hits = [b for b in map(self.word, words) if b]
        out = 0
        for b in hits:
            out |= b
        if len(hits) >= 3:
            out |= 1 << (2 * LEXICONS)
        if hits and len(hits) >= 0.02 * len(words):
            out |= 1 << (2 * LEXICONS + 1)
        return out


class LabelModel:
    """Posterior of the hidden label from vote patterns and their counts."""

    def __init__(self, voters, patterns, counts, rounds=200):
        votes = ((patterns[:, None] >> np.arange(voters)) & 1).astype(float)
        share = counts / counts.sum()
        post = np.clip(votes.mean(1) * 2, 0.02, 0.98)  # the start: voters are better than chance
        for _ in range(rounds):
            prior = float(np.clip((share * post).sum(), 1e-4, 1 - 1e-4))
            hit = np.clip((share * post) @ votes / prior, 1e-3, 1 - 1e-3)
            false = np.clip((share * (1 - post)) @ votes / (1 - prior), 1e-4, 1 - 1e-3)
            new = self._posterior(votes, prior, hit, false, np.ones(voters))
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        # correlations given the label, as the larger of the two classes' excesses
        excess = np.zeros((voters, voters))
        for weight, mean in ((share * post, hit), (share * (1 - post), false)):
            centred = votes - mean
            cov = (centred * weight[:, None]).T @ centred / max(weight.sum(), 1e-9)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            excess = np.maximum(excess, np.clip(cov / np.outer(scale, scale), 0, 1))
        np.fill_diagonal(excess, 0)
        self.correlation, self.hit, self.false, self.prior = excess, hit, false, prior
        self.discount = 1 / (1 + excess.sum(1))
        self.table = dict(zip(patterns.tolist(), self._posterior(votes, prior, hit, false, self.discount).tolist()))

    @staticmethod
    def _posterior(votes, prior, hit, false, discount):
        yes = (votes * np.log(hit / false) + (1 - votes) * np.log((1 - hit) / (1 - false))) @ discount
        return 1 / (1 + np.exp(-np.clip(yes + np.log(prior / (1 - prior)), -30, 30)))


class TermSlots(dict):
    """int32 slots of a word and its beginnings."""

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        terms = [b"w" + word, *(b"p" + b for b in beginnings(word))]
        self[word] = found = [zlib.crc32(t) & ((1 << BITS) - 1) for t in terms]
        return found


def fit_linear(rows, target, passes=PASSES, rate=0.2, shrink=2e-4, seed=0):
    """Weights and bias of a logistic model on presence features, shrunk towards zero."""
    rng = np.random.default_rng(seed)
    weights, speed = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, speed_b = 0.0, 1e-2
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            index = rows[k]
            error = 1 / (1 + np.exp(-np.clip(weights[index].sum() + bias, -30, 30))) - target[k]
            speed[index] += error * error
            step = rate / np.sqrt(speed[index])
            moved = weights[index] - step * error
            weights[index] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            speed_b += error * error
            bias -= rate * error / np.sqrt(speed_b)
        weights[np.abs(weights) < 0.05] = 0  # hashed words without a lasting effect
    return weights, bias


def _voted(voters):
    def run(batches):
        for part in slices(batches, 256):
            found = [voters.votes(words_of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "votes"]
            )

    return run


def _slotted(batches):
    slots = TermSlots()
    for part in slices(batches, 256):
        rows = []
        for text in part.column("text").to_pylist():
            words = words_of(text)
            rows.append(np.unique(np.array([s for w in words for s in slots[w]], np.int32)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), part.column("votes")], names=["slots", "votes"]
        )


def fit_toxicity(docs, labels, fold, sample=SAMPLE):
    """(weights, bias) of the classifier, or None without toxic labels."""
    lists = lexicons(materialize(labelled_sample(docs, labels, "toxic", fold, sample), "sample"))
    if not any(lists):
        return None
    voters = Voters(lists)
    texts = docs.select("doc_id", "text").where(F.coalesce(~fold, F.lit(False)))
    voted = materialize(texts.mapInArrow(_voted(voters), "doc_id long, votes long"), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()
    model = LabelModel(voters.count, counted["votes"].to_numpy(), counted["n"].to_numpy(float))
    # an even draw of texts with and without votes, so that both classes are seen
    some, none = int(counted.loc[counted["votes"] > 0, "n"].sum()), int(counted.loc[counted["votes"] == 0, "n"].sum())
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30))
    share = F.when(F.col("votes") > 0, min(1.0, sample / 2 / max(1, some))).otherwise(min(1.0, sample / 2 / max(1, none)))
    picked = voted.where(draw < share * (1 << 30)).select(F.col("doc_id").alias("_picked"), "votes").dropDuplicates(["_picked"])
    chosen = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_picked")).select("text", "votes")
    rows = chosen.mapInArrow(_slotted, "slots binary, votes long").toPandas()
    rows = rows.sort_values(["slots", "votes"]).reset_index(drop=True)  # reruns see one order
    target = np.array([model.table[v] for v in rows["votes"]])
    return fit_linear([np.frombuffer(s, np.int32) for s in rows["slots"]], target)


def toxicity_scores(docs, labels, fold=None):
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    fold = held_out(5, 0) if fold is None else fold
    fitted = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, fold))

    def run(batches):
        terms, effect = TermSlots(), {}
        weights, bias = fitted.value or (None, 0.0)
        for part in slices(batches, 256):
            scores = []
            for text in part.column("text").to_pylist():
                if weights is None:
                    scores.append(0.0)
                    continue
                total, seen = bias, set()
                for word in words_of(text):
                    known = effect.get(word)
                    if known is None:
                        if len(effect) >= CACHED_WORDS:
                            effect.clear()
                        known = effect[word] = [s for s in terms[word] if weights[s]]
                    for slot in known:
                        if slot not in seen:
                            seen.add(slot)
                            total += weights[slot]
                scores.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
