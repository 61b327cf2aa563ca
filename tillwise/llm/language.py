"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector counts its n-grams of 1 to 3 bytes of UTF-8, ASCII letters folded and every
other ASCII character read as a space, hashed to DIMENSIONS places; counts enter as
1 + ln(count), times the inverse document frequency, at length 1. Document frequencies come
from all learnable documents. A language has CENTROIDS centroids, from spherical k-means
over a sample of about SAMPLE of its documents (repeated rows being one), found in a task
each. A text gets the language of the centroid with the
highest cosine; it is rejected if that cosine is below the language's limit, half of the
cosine that 99 % of its sample reach.

Null texts and texts without a letter are "und" with score 0, as is everything if nothing
could be learned. Texts are read whole. Rows with a null language teach nothing; repeated
rows count as often as they occur in the document frequencies; of equal cosines the first
language by name wins; empty texts have no letter. Every language is learned: the model has
a few vectors for each. Only sums of vectors and the samples' vectors are shuffled. Columns
other than those named are not looked at; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.learning import unit
from tillwise.llm.text import arrow, batch_of, chunks, utf8

DIMENSIONS = 4096
SIZES = (1, 2, 3)
CENTROIDS = 4
#: Documents of a language to learn from, about.
SAMPLE = 600
UNKNOWN = "und"

FOLDED = np.full(256, 32, np.uint64)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def counted(column: pa.Array) -> np.ndarray:
    """How often each text has the n-grams of each place."""
    data, offsets = utf8(column)
    n, letters = len(column), FOLDED[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out = np.zeros(n * DIMENSIONS, np.int64)
    for size in SIZES:
        if len(letters) < size:
            break
        m = len(letters) - size + 1
        code = np.zeros(m, np.uint64)
        blank = np.ones(m, bool)
        for k in range(size):
            code = code * np.uint64(257) + letters[k : k + m]
            blank &= letters[k : k + m] == 32
        place = ((code + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
        fits = np.flatnonzero((np.arange(m) + size <= ends[:m]) & ~blank)
        out += np.bincount(owner[fits] * DIMENSIONS + place[fits].astype(np.int64), minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    counts = counted(column)
    there = counts > 0
    x = np.zeros(counts.shape, np.float32)
    x[there] = 1 + np.log(counts[there])
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Languages:
    names: list[str]
    centroids: np.ndarray  # centroid, place
    owner: np.ndarray  # the language of each centroid
    limits: np.ndarray  # per language
    idf: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest language, and the cosine."""
        close = vectors(column, self.idf) @ self.centroids.T
        best = close.argmax(1)
        return self.owner[best], np.clip(close[np.arange(len(best)), best], 0, 1)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1; the first is the mean's nearest row, each next the row
    farthest from all so far."""
    mean = x.mean(0)
    centroids = x[[int((x @ mean).argmax())]]
    while len(centroids) < min(k, len(x)):
        centroids = np.vstack([centroids, x[int((x @ centroids.T).max(1).argmin())]])
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def frequencies(texts: DataFrame) -> np.ndarray:
    """ln(1 + N / df) of each place, over all texts."""
    schema = "place int, n long"
    out = arrow(schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in chunks(batches, "text"):
            df += (counted(batch.column("text")) > 0).sum(0)
            n += batch.num_rows
        yield batch_of(out, place=np.arange(-1, DIMENSIONS), n=np.append(n, df))

    total = dict(texts.mapInArrow(count, schema).groupBy("place").agg(F.sum("n")).collect())
    df = np.array([total.get(k, 0) for k in range(DIMENSIONS)])
    return np.log1p(total.get(-1, 0) / np.maximum(df, 1)).astype(np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Languages:
    """Centroids of the languages of the documents with a text and a language."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        none = np.zeros((0, DIMENSIONS), np.float32)
        return Languages([], none, np.zeros(0, int), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    idf = frequencies(rows.select("text"))
    draw = unit(F.col("id"), F.col("text"), seed=5)
    share = F.create_map([F.lit(v) for lang, n in counts.items() for v in (lang, 2.0 if n <= SAMPLE else SAMPLE / n)])
    some = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).dropDuplicates(["lang", "draw"])
    found = some.select("lang", "draw", "text").mapInArrow(_measured(arrow(VECTORS), idf), VECTORS)
    found = found.groupBy("lang").applyInArrow(_centroids(arrow(CENTRES)), CENTRES).orderBy("lang").toArrow()
    names = found.column("lang").to_pylist()
    sets = [np.frombuffer(x, np.float32).reshape(-1, DIMENSIONS) for x in found.column("centroids").to_pylist()]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in sets])
    return Languages(names, np.concatenate(sets), owner, found.column("least").to_numpy(), idf)


VECTORS = "lang string, draw double, vector binary"
CENTRES = "lang string, least double, centroids binary"


def _measured(schema: pa.Schema, idf: np.ndarray):
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x = vectors(batch.column("text"), idf)
            yield batch_of(schema, lang=batch.column("lang"), draw=batch.column("draw"), vector=[row.tobytes() for row in x])

    return measure


def _centroids(schema: pa.Schema):
    """One language's centroids and limit, from its sample."""

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("draw")
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        centroids = clustered(x, CENTROIDS).astype(np.float32)
        least = 0.5 * float(np.quantile((x @ centroids.T).max(1), 0.01))
        found = batch_of(schema, lang=[rows.column("lang")[0].as_py()], least=[least], centroids=[centroids.tobytes()])
        return pa.Table.from_batches([found])

    return find


def identified(docs: DataFrame, model: Languages, reject: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row. A rejected text is "und", unless
    `reject` is false."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    out, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, UNKNOWN], object)
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            lang, score = (model.predict(batch.column("text")) if model.names else (np.zeros(n, int), np.zeros(n)))
            readable = batch.column("readable").to_numpy(zero_copy_only=False) & bool(model.names)
            far = ~readable | (score < np.append(model.limits, 0)[lang])
            shown = np.where(~readable | (far & reject), len(model.names), lang)
            yield batch_of(out, doc_id=batch.column("doc_id"), lang_pred=names[shown].tolist(), score=np.where(readable, score, 0).astype(float), rejected=far)

    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), readable.alias("readable")).mapInArrow(identify, schema)
