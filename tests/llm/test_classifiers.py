import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import quality_model as Q
from orderlens.llm import toxicity as T


def test_sum_of_squares_identity():
    model = Q.FactorisationMachine(slots=50, rank=4, seed=1)
    model.linear = np.random.default_rng(2).normal(size=50).astype(np.float32)
    index, value = np.array([3, 7, 20, 41]), np.array([0.5, 1.0, 0.2, 0.7], np.float32)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[i + 1 :])
    want = 1 / (1 + np.exp(-(model.linear[index] @ value + pairs)))
    assert model.scores([(index, value)])[0] == pytest.approx(want, rel=1e-4)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.mark.parametrize("scores, column, least", [(Q.quality_scores, "quality", 0.97), (T.toxicity_scores, "toxic", 0.93)])
def test_held_out_accuracy(corpus, scores, column, least):
    docs, labels = corpus
    found = scores(docs, labels)
    assert found.count() == docs.count()
    held = found.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0] >= least
    assert found.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


@pytest.mark.parametrize("scores", [Q.quality_scores, T.toxicity_scores])
def test_odd_rows(spark, corpus, scores):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word", None), (5, "long " * 30000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert scores(docs, labels).count() == 5
    assert scores(docs, labels.limit(0)).count() == 5
    assert scores(docs.limit(0), labels).count() == 0


def test_correlated_voters_count_less():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.3
    alone = [np.where(rng.random(5000) < 0.9, truth, ~truth) for _ in range(3)]
    same = np.where(rng.random(5000) < 0.8, truth, ~truth)
    votes = np.stack([*alone, same, same, same], 1).astype(int)
    patterns, counts = np.unique(votes @ (1 << np.arange(6)), return_counts=True)
    model = T.LabelModel(6, patterns, counts.astype(float))
    assert model.discount[3:].max() < model.discount[:3].min()
    assert min(model.table.values()) >= 0 and max(model.table.values()) <= 1
