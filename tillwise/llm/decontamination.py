"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

A benchmark item of L words is compared with every window of L consecutive words of
every document (the whole document where it is shorter). Words are compared without
ASCII case; a shingle is five words and weighs as often as it occurs.

1. A window is worth fingerprinting only if it holds a shingle of an item of its length;
   windows without one have similarity 0. The places of such shingles are found with one
   probe per word, so most documents end here.
2. The 64-bit SimHash of each such window comes from running sums over the document.
3. Each item's fingerprint is cut into 8 blocks of 8 bits. Two fingerprints at most RADIUS
   (23) bits apart agree up to 2 bits in at least one block, so the union of the 8 block
   lists holds every item within the radius; the full distance then decides. At similarity
   0.8 the distance is 10 +- 3 bits.
4. The weighted Jaccard similarity of the shingles themselves decides, on the words, not
   on hashes.

Nothing is shuffled: items go to the documents. They are sent in slices of bounded size
(SLICE_ROWS items, about SLICE_BYTES), each of which reads the documents once, so a
benchmark of any size is handled with the same memory.

Null and empty texts, and items or documents of fewer than five words, match nothing.
Repeated rows and ties in similarity: each row of the documents is judged by itself; an
item keeps the earliest of its best windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.text import LOWER, Words, arrow, batch_of, chunks, grams

SHINGLE = 5
RADIUS, BLOCKS = 23, 8
SLICE_ROWS, SLICE_BYTES = 4096, 8 << 20
GATE_BITS = 20
WINDOWS_AT_ONCE = 4096


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each `size` shingles in a row, of hashed shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(sums[size:] > sums[:-size], axis=1).view(np.uint64).ravel()


def blocks(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint8).reshape(-1, BLOCKS)


@dataclass
class SameLength:
    """Items of one length: their fingerprints and the block lists."""

    items: np.ndarray
    prints: np.ndarray
    near: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        values = np.arange(256, dtype=np.uint8)
        apart = np.bitwise_count(values[None, :, None] ^ blocks(self.prints).T[:, None, :])
        self.near = apart <= RADIUS // BLOCKS  # block, value, item

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius."""
        for first in range(0, len(prints), WINDOWS_AT_ONCE):
            part = prints[first : first + WINDOWS_AT_ONCE]
            parts = blocks(part)
            listed = reduce(np.logical_or, (self.near[b][parts[:, b]] for b in range(BLOCKS)))
            window, item = np.nonzero(listed)
            close = np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS
            yield from zip((window[close] + first).tolist(), self.items[item[close]].tolist())


class ItemIndex:
    """What a task needs to know of a slice of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        words = Words.of(pa.array(texts, pa.string()))
        hashes = words.hashes(LOWER)
        all_shingles = grams(hashes, SHINGLE)
        self.ids, self.bags = ids, {}
        lengths, of_shingle = {}, []
        for item, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            if b - a < SHINGLE:
                continue
            shingles = all_shingles[a : b - SHINGLE + 1]
            self.bags[item] = bag(words, a, b)
            lengths.setdefault(b - a, []).append((item, fingerprints(shingles, len(shingles))[0]))
            of_shingle += [(s, b - a) for s in np.unique(shingles)]
        self.lengths = {
            n: SameLength(np.array([i for i, _ in x]), np.array([p for _, p in x], np.uint64)) for n, x in lengths.items()
        }
        self.shingles = np.array([s for s, _ in of_shingle], np.uint64)
        self.shingle_length = np.array([n for _, n in of_shingle], np.int64)
        order = np.argsort(self.shingles, kind="stable")
        self.shingles, self.shingle_length = self.shingles[order], self.shingle_length[order]
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[self.shingles >> np.uint64(64 - GATE_BITS)] = True

    def hits(self, shingles: np.ndarray) -> Iterator[tuple[int, set[int]]]:
        """(place, lengths of the items that hold the shingle there)."""
        maybe = np.flatnonzero(self.gate[shingles >> np.uint64(64 - GATE_BITS)])
        left = np.searchsorted(self.shingles, shingles[maybe], "left")
        right = np.searchsorted(self.shingles, shingles[maybe], "right")
        for place, a, b in zip(maybe.tolist(), left.tolist(), right.tolist()):
            if b > a:
                yield place, set(self.shingle_length[a:b].tolist())


def bag(words: Words, first: int, last: int) -> Counter:
    """The shingles of the words first:last with their numbers."""
    texts = [w.lower() for w in words.words(first, last)]
    return Counter(zip(*(texts[k:] for k in range(SHINGLE))))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (a.total() + b.total() - shared)


def matches(words: Words, index: ItemIndex, similarity: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first word, words, similarity) of each match."""
    if not len(index.shingles):
        return
    shingles = grams(words.hashes(LOWER), SHINGLE)
    wanted: dict[tuple[int, int], list[int]] = {}
    bounds = words.first
    for place, lengths in index.hits(shingles):
        doc = int(np.searchsorted(bounds, place, "right")) - 1
        if place + SHINGLE <= bounds[doc + 1]:
            for n in lengths:
                wanted.setdefault((doc, n), []).append(place)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for (doc, n), places in wanted.items():
        first, last = int(bounds[doc]), int(bounds[doc + 1])
        size = min(n, last - first)
        for start, stop in spans(places, first, last, size):
            prints = fingerprints(shingles[start : stop + size - SHINGLE], size - SHINGLE + 1)
            for window, item in index.lengths[n].candidates(prints):
                at = start + window
                close = weighted_jaccard(bag(words, at, at + size), index.bags[item])
                if close >= similarity and (doc, item) not in best or close > best.get((doc, item), (2.0,))[0]:
                    best[doc, item] = (close, at - first, size)
    for (doc, item), (close, at, size) in sorted(best.items()):
        yield doc, item, at, size, close


def spans(places: list[int], first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """The starts of the windows of `size` words that hold a shingle at one of the places,
    as ranges [start, stop)."""
    begin = None
    for place in places:
        low, high = max(first, place - size + SHINGLE), min(place, last - size) + 1
        if begin is not None and low <= end:
            end = max(end, high)
            continue
        if begin is not None:
            yield begin, end
        begin, end = low, high
    if begin is not None:
        yield begin, end


def slices(items: DataFrame, item_id: str, text: str) -> Iterator[ItemIndex]:
    """The benchmark as indexes of bounded size, one at a time."""
    items = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    n = max(1, -(-total.n // (SLICE_ROWS // 2)), -(-total.b // (SLICE_BYTES // 2)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield ItemIndex([r.i for r in rows], [r.t for r in rows])


MATCH = "doc_id {id}, item_id {item}, start_word long, n_words long, similarity double"


def contaminated(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """One row per document and item that a window of the document resembles: doc_id,
    item_id, start_word, n_words, similarity (of its best window)."""
    schema = MATCH.format(id=docs.schema[doc_id].dataType.simpleString(), item=items.schema[item_id].dataType.simpleString())
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = [docs.mapInArrow(_matcher(docs, index, similarity, arrow(schema)), schema) for index in slices(items, item_id, text)]
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of the documents, all columns unchanged, that match no item."""
    for index in slices(items, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text):
                found = {m[0] for m in matches(Words.of(batch.column(text)), shared.value, similarity)}
                yield batch.filter(pa.array([d not in found for d in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _matcher(docs: DataFrame, index: ItemIndex, similarity: float, out: pa.Schema):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = list(matches(Words.of(batch.column("text")), shared.value, similarity))
            yield batch_of(
                out,
                doc_id=batch.column("doc_id").take(pa.array([m[0] for m in found], pa.int64())),
                item_id=[shared.value.ids[m[1]] for m in found],
                start_word=[m[2] for m in found],
                n_words=[m[3] for m in found],
                similarity=[m[4] for m in found],
            )

    return find
