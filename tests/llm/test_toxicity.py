import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_samples import documents, odd_rows, prose  # noqa: F401
from tillwise.llm import toxicity
from tillwise.llm.learning import fold

DATA = "/root/testdata/sf0.1"
LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)


def test_marginals_are_those_of_all_labellings():
    draw = np.random.default_rng(1)
    sentence = np.array([0, 5, 6, 9])
    emission, start, pairs = draw.normal(size=9), draw.normal(size=2), draw.normal(size=(2, 2))
    got, joint, first = toxicity.marginals(emission, sentence, start, pairs, np.ones(9))
    expected, joint_sum, first_sum = np.zeros(9), np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(sentence[:-1], sentence[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            total = start[y[0]] + sum(emission[a + k] * v for k, v in enumerate(y)) + sum(pairs[p] for p in zip(y, y[1:]))
            weights[y] = np.exp(total)
        norm = sum(weights.values())
        for y, w in weights.items():
            expected[a:b] += np.array(y) * w / norm
            first_sum[y[0]] += w / norm
            for p in zip(y, y[1:]):
                joint_sum[p] += w / norm
    assert np.allclose(got, expected) and np.allclose(joint, joint_sum) and np.allclose(first, first_sum)


def test_held_out_documents(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = toxicity.scored(docs, model).where(fold(F.col("doc_id"), 4) == 2)
    got = held.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    said = got.score >= 0.3
    assert got.score.between(0, 1).all()
    assert said[got.toxic == 1].mean() > 0.75 and said[got.toxic == 0].mean() < 0.02


def test_offending_offsets_are_code_points(model):
    text = "Éñ 漢字 the idiot moron. And é clown"
    scores, tokens, toxic = toxicity.tagged(pa.array([None, text]), model)
    assert scores[1] > 0.9 > 0.1 > scores[0]
    assert [text[a:b] for a, b in toxicity.offending(tokens, toxic)[1]] == ["idiot moron", "clown"]


def test_odd_rows(spark, documents, odd_rows, model):
    docs = documents([*odd_rows, (20, "you idiot " * 20)], extra=True)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert 20 not in left and left.count(None) == 2 and left.count(7) == 2 and {1, 2, 3, 4, 5, 6, 8, 10, 11} <= set(left)
    assert toxicity.scored(documents([]), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, None), (None, 0, 1)], [(7, 1, 0), (99, 1, 1)]])
def test_nothing_to_learn(spark, documents, odd_rows, labels):
    docs = documents(odd_rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABEL), F.lit(True))
    scores = {round(r.score, 9) for r in toxicity.scored(docs, model).collect()}
    assert len(scores) == 1 and 0 < scores.pop() <= 0.5


def test_labels_of_the_other_fold_are_not_used(spark, documents):
    rows = [(k, ("awful " if k % 2 else "") + prose(20, k)) for k in range(80)]
    labels = [(k, 1, k % 2) for k in range(80)]
    wrong = [(k, 1, t if k % 4 else 1 - t) for k, _, t in labels]
    docs, learn = documents(rows), F.col("doc_id") % 4 != 0
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, LABEL), learn) for x in (labels, wrong))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.curve, two.curve)
