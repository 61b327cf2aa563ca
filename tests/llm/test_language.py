import numpy as np
import pyarrow as pa
import pytest
from llm_samples import documents, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from tillwise.llm import language
from tillwise.llm.learning import fold

DATA = "/root/testdata/sf0.01"


def test_counts_are_those_of_all_grams():
    texts = ["Ab c", "", None, "é!é", "the cat, the hat"]
    got = language.counted(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode())
        grams = [folded[k : k + n] for n in language.SIZES for k in range(len(folded) - n + 1) if folded[k : k + n].strip()]
        assert row.sum() == len(grams)
    assert got[4].max() >= 3


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    split = fold(F.col("doc_id"), 5)
    model = language.fit(docs.where(split != 0))
    assert len(model.centroids) > len(model.names)
    found = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(split == 0).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


def test_far_texts_are_rejected(documents):
    rows = [(k, f"the cat and the dog number {'abc'[k % 3]} went to the house", "en") for k in range(30)]
    rows += [(100 + k, f"der Hund und die Katze {'abc'[k % 3]} gingen zum Haus", "de") for k in range(30)]
    model = language.fit(documents(rows))
    asked = documents([(1, "the house and the cat"), (2, "qqqq xxxx zzzz jjjj vvvv"), (3, "der Hund und die Katze gingen zum Haus"), (4, "漢字漢字漢字")])
    got = {r.doc_id: r for r in language.identified(asked, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["en", "und", "de", "und"]
    sure = {r.doc_id: r for r in language.identified(asked, model, reject=False).collect()}
    assert sure[2].lang_pred in ("en", "de") and sure[2].rejected and not sure[1].rejected


def test_odd_rows(documents, odd_rows):
    docs = documents([*odd_rows, (50, "1234 !? -"), (51, "the one", "en"), (52, "el uno", "es"), (52, "el uno", "es")], extra=True)
    model = language.fit(docs)
    assert model.names == ["en", "es"]
    got = {r.doc_id: r for r in language.identified(docs, model, reject=False).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 50))
    assert got[51].lang_pred == "en" and got[52].lang_pred == "es" and got[9].lang_pred in ("en", "es")
    assert language.identified(docs, model).count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(1, "text", None)], [(1, None, "en")]])
def test_nothing_to_learn(documents, rows):
    model = language.fit(documents(rows))
    asked = documents([(1, "some text"), (2, None)])
    assert {(r.lang_pred, r.score) for r in language.identified(asked, model).collect()} == {("und", 0.0)}
    assert language.identified(documents([]), model).count() == 0


def test_clusters_are_unit_vectors():
    x = np.random.default_rng(1).random((50, 20)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(language.clustered(x, 4), axis=1), 1, atol=1e-5)
    assert len(language.clustered(x[:2], 4)) == 2


def test_every_language_is_learned(documents):
    """Also rare ones beside a common one, and more than a few hundred."""
    rows = [(k, f"aa bb cc {k}", "common") for k in range(1500)]
    rows += [(10_000 + k, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} text", f"l{k:03}") for k in range(300)]
    model = language.fit(documents(rows))
    assert len(model.names) == 301
    asked = documents([(1, f"{chr(0x4E00 + 7)}{chr(0x4E00 + 7)}"), (2, "aa bb cc")])
    assert {r.doc_id: r.lang_pred for r in language.identified(asked, model).collect()} == {1: "l007", 2: "common"}
