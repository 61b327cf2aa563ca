"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, many documents at once; scoring sends the
matrix of a chunk down the flattened trees level by level. Trees are fitted in the driver
on the statistics of about SAMPLE labelled rows at most, picked by a hash; scoring shuffles
nothing.

Null and empty texts have the statistics of an empty text and are scored like any other.
Very long texts are scored whole. Documents with several label rows learn from each; label
rows that are null, or whose document is missing, teach nothing. With no label rows, or
labels of one class, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm import trees
from tillwise.llm.learning import bounded_sample
from tillwise.llm.text import LOWER, WHITE, Words, arrow, batch_of, chunks, grams, mixed

SAMPLE = 6000

CLASSES = {
    "lower": range(ord("a"), ord("z") + 1),
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "other letter": range(0x80, 0x100),
    "white": (9, 10, 11, 12, 13, 32),
    "line": (10,),
    "stop": b".!?",
    "pause": b",;:",
    "bracket": b"()[]{}<>",
    "symbol": b"#$%&*+=@\\^_|~/",
    "shout": b"!",
    "pipe": b"|",
}
MEMBER = np.zeros((256, len(CLASSES)))
for _k, _values in enumerate(CLASSES.values()):
    MEMBER[list(_values), _k] = 1


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many different keys, and how often its commonest one stands."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    bits = max(1, n - 1).bit_length()
    tagged = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits)))
    new = np.flatnonzero(np.concatenate(([True], tagged[1:] != tagged[:-1])))
    of = (tagged[new] >> np.uint64(64 - bits)).astype(np.int64)
    docs = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    most = np.zeros(n)
    most[of[docs]] = np.maximum.reduceat(np.diff(np.append(new, len(tagged))), docs)
    return np.bincount(of, minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers per text."""
    words = Words.of(column)
    n, size = len(column), np.diff(words.offsets)
    byte_owner = np.repeat(np.arange(n), size)
    classes = np.bincount(byte_owner * 256 + words.data, minlength=n * 256).reshape(n, 256)
    by_class = classes @ MEMBER
    lengths, owner, counts = words.ends - words.starts, words.owner, words.counts
    hashes = words.hashes(LOWER)
    n_distinct, most_word = distinct(hashes, owner, n)
    pairs = np.ones(len(hashes), bool)
    pairs[words.first[1:][counts > 0] - 1] = False
    two, two_owner = grams(hashes, 2)[pairs], owner[pairs]
    n_pairs, most_pair = distinct(two, two_owner, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & pairs[:-1]
    lines = Words.of(column, np.arange(256) != 10)
    line_sum = np.cumsum(np.concatenate(([0], mixed(words.data.astype(np.uint64) + np.uint64(1)))), dtype=np.uint64)
    line_owner, line_size = lines.owner, lines.ends - lines.starts
    line_hash = line_sum[lines.ends] - line_sum[lines.starts] + line_size.astype(np.uint64)
    n_lines, most_line = distinct(line_hash, line_owner, n)
    share_of = share(classes, size[:, None])
    entropy = -np.sum(np.where(share_of > 0, share_of * np.log2(np.where(share_of > 0, share_of, 1)), 0), axis=1)
    per_doc = lambda values: np.bincount(owner, values, n)
    first, last = words.data[words.starts], words.data[words.ends - 1] if len(words.ends) else words.data[:0]
    upper_all = (first >= 65) & (first <= 90) & (lengths > 1)
    upper_all[upper_all] = (words.data[words.starts[upper_all] + 1] >= 65) & (words.data[words.starts[upper_all] + 1] <= 90)
    odd_end = MEMBER[last][:, list(CLASSES).index("symbol")]
    columns = [
        np.log1p(size),
        np.log1p(counts),
        *(by_class / np.maximum(size, 1)[:, None]).T,
        share(per_doc(lengths), counts),
        np.sqrt(np.maximum(share(per_doc(lengths.astype(float) ** 2), counts) - share(per_doc(lengths), counts) ** 2, 0)),
        share(per_doc(lengths <= 3), counts),
        share(per_doc(lengths > 12), counts),
        share(n_distinct, counts),
        share(most_word, counts),
        share(n_pairs, counts - 1),
        share(most_pair, counts - 1),
        share(per_doc(same), counts),
        share(per_doc(upper_all), counts),
        share(per_doc(odd_end), counts),
        np.log1p(lines.counts),
        share(n_lines, lines.counts),
        share(most_line, lines.counts),
        share(counts, lines.counts),
        entropy,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> trees.Trees:
    """Trees for the 0/1 column `label` of `labels`, learned from the documents for which
    `learn` holds."""
    rows = labelled(docs.where(learn), labels, label, doc_id, text)
    schema = "y int, x array<double>"
    out = arrow(schema)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch_of(out, y=batch.column("y"), x=list(statistics(batch.column("text"))))

    # the texts stay in the tasks, the driver gets rows of one size
    rows = rows.transform(bounded_sample, F.col("id"), sample).select("text", "y")
    found = rows.mapInArrow(measure, schema).toArrow()
    y = found.column("y").to_numpy().astype(float)
    x = np.array(found.column("x").to_pylist()) if found.num_rows else np.zeros((0, 1))
    order = np.lexsort((y, *x.T))  # so that the fit doesn't depend on the order of the rows
    return trees.fit(x[order], y[order])


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> DataFrame:
    """id, text and y (0 or 1) of the documents with labels."""
    y = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(y, "id")


def scored(docs: DataFrame, model: trees.Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every row."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double"
    out, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch_of(out, doc_id=batch.column("doc_id"), score=shared.value.predict(statistics(batch.column("text"))))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)
