"""Whole columns of text as numpy arrays of bytes and words.

Tasks of this subpackage get text as Arrow batches and work on the UTF-8 bytes of many
documents at once, without a Python string per document or word. A word is a maximal run
of bytes other than space and \\t \\n \\v \\f \\r; these never occur inside a multi-byte
character, so the words are those of the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 1024

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, all bits spread."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text and CHUNK_ROWS rows at most.

    Documents stay whole: one longer than the limit is a chunk of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = 0
        while first < batch.num_rows:
            reach = np.cumsum(sizes[first : first + CHUNK_ROWS])
            n = max(1, int(np.searchsorted(reach, CHUNK_BYTES, "right")))
            yield batch.slice(first, n)
            first += n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null being empty, and the rows' offsets in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of some documents: bytes starts[i]:ends[i] of data, document d having
    the words first[d]:first[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, inside: np.ndarray | None = None) -> Words:
        """inside: which byte values belong to words, by default all but white space."""
        data, offsets = utf8(column)
        inside = (~WHITE if inside is None else inside)[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets < len(data))]
        before[edges] = False
        edges = offsets[offsets > 0]
        after[edges - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return cls(data, offsets, starts, ends, np.searchsorted(starts, offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, folded: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, after the byte table `folded` if given."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = self.data[np.repeat(self.starts, sizes) + within]
        if folded is not None:
            letters = folded[letters]
        terms = powers(BASE, int(sizes.max()))[within]
        terms *= letters.astype(np.uint64) + np.uint64(1)
        return mixed(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))

    def words(self, first: int, last: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last])]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` hashes in a row; the last size - 1 places run over the end
    and hash what is left."""
    out = np.zeros(len(hashes), np.uint64)
    for k, factor in enumerate(powers(MIX_2, size + 1)[1:]):
        out[: len(hashes) - k] += hashes[k:] * factor
    return mixed(out)


def shingled(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed shingles of each document and each one's document, in text order.

    A document of fewer words than `size` is one shingle of all its words; one without
    words has none.
    """
    owner, counts = words.owner, words.counts
    ahead = words.first[1:][owner] - np.arange(len(owner))
    out = grams(hashes, size)
    keep = ahead >= size
    for n in range(1, size):
        places = words.first[:-1][counts == n]
        if len(places):
            keep[places] = True
            part = sum((hashes[places + k] * f for k, f in enumerate(powers(MIX_2, n + 1)[1:])), np.zeros(len(places), np.uint64))
            out[places] = mixed(part)
    return out[keep], owner[keep]


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the named arrays in the schema's order."""
    arrays = (columns[f.name] for f in schema)
    arrays = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
