import shutil
from pathlib import Path

import corpus_pipeline
import pytest
from llm_samples import DOCUMENT, documents, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillwise.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, path, rows, columns=DOCUMENT):
    """A data folder with the given documents beside the other small tables."""
    path = Path(path)
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", path)
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "benchmark decontamination", "personal data", "source mixing"]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_stages_take_effect(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    rows += [
        (9001, prose(200, 1), "en", "s1", 1),
        (9002, prose(200, 1) + " end", "en", "s1", 1),
        (9003, f"{prose(40, 2)} {passage} {prose(40, 3)}", "en", "s1", 1),
        (9004, f"{prose(90, 4)} a@b.example.com", "en", "s2", 1),
    ]
    sf_dir, docs = folder(spark, tmp_path, rows), None
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == (COLUMNS if k < 4 else [*COLUMNS, "copies"])
    assert {9001, 9002, 9003, 9004} <= kept[0]
    assert kept[1] & {9001, 9002, 9003, 9004} == {9001, 9003, 9004}
    assert kept[2] & {9001, 9003, 9004} == {9001, 9004} and kept[3] == kept[2]
    texts = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert texts[9004][0].endswith(" <email>") and texts[9004][1] == len(texts[9004][0])
    assert not any("@" in (t or "") and ".example.com" in t for t, _ in texts.values())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_tables(spark, tmp_path, odd_rows, kind):
    rows = [(*r, None, "ab"[k % 2], None, 7, 7, 7) for k, r in enumerate(odd_rows)] if kind == "odd" else []
    extra = f"{DOCUMENT}, row int, copies int, key int"
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, rows, extra))
    assert out.columns == [*COLUMNS, "row", "key", "copies"]
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len([x for x in ids if x is None]) + len(set(ids) - {None})  # repeats are gone
    assert (len(ids) > 0) == (kind == "odd")
