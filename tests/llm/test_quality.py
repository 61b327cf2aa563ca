import numpy as np
import pyarrow as pa
import pytest
from llm_samples import documents, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from tillwise.llm import quality, trees
from tillwise.llm.learning import bounded_sample, fold

DATA = "/root/testdata/sf0.1"
LABEL = "doc_id long, quality int, toxic int"


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.3)).astype(float)
    model = trees.fit(x[:2000], y[:2000], n_trees=40, depth=3)
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_traversal_is_that_of_each_row():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 4))
    model = trees.fit(x, (x[:, 0] + x[:, 1] ** 2 > 1).astype(float), n_trees=5, depth=3)
    for row, score in zip(x[:50], model.raw(x)[:50]):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert score == pytest.approx(total)


def test_statistics_do_not_depend_on_the_company():
    texts = ["One two, two.\nOne two, two.", None, "", "A!! B!! ### $$$", "é " * 30, prose(200, 1)]
    together = quality.statistics(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert np.allclose(together[k], quality.statistics(pa.array([text], pa.string()))[0])
    assert np.isfinite(together).all()


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    split = fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels, "quality", split != 0)
    got = quality.scored(docs, model).where(split == 0).join(labels, "doc_id").select("score", "quality").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.97 and got.score.between(0, 1).all()


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 0), (None, 1, 0), (99, 0, 0), (8, None, None), (7, 1, 0)], LABEL)
    got = quality.scored(docs, quality.fit(docs, labels, "quality", F.lit(True))).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(docs, labels.limit(0), "quality", F.lit(True))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(documents([]), none).count() == 0


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(5000)
    one = bounded_sample(rows, F.col("id"), 500)
    ids = sorted(r.id for r in one.collect())
    assert 350 < len(ids) <= 500 and ids == sorted(r.id for r in bounded_sample(rows.repartition(7), F.col("id"), 500).collect())
    assert bounded_sample(rows, F.col("id"), 5000).count() == 5000
