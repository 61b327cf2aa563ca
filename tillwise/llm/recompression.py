"""Repeated passages by recompression.

A window is 35 consecutive words of a document; a word goes if a window over it has a word
sequence that also starts anywhere else, in another document or the same one.

Rounds. The words of a document are rewritten in rounds. A run round names each maximal run
of equal symbols by symbol and length; a pair round deals symbols into left and right by a
hash and names each left symbol followed by a right one. Names are 64-bit hashes of what
they stand for, so all tasks give the same name to the same thing without a dictionary.
A symbol's context is the stretch of words that decides it: two stretches of equal words
hold the same symbols wherever the context lies inside. A window's key is, of the symbols
whose context lies inside it, one of the highest round, the smallest by hash. Equal windows
have equal keys at equal places; in words without structure the lowest round, the words
themselves, always gives one.

Spark. Consecutive windows with the same key symbol are one block.
1. Keys are counted. Those that stand once in the whole corpus end here with all their
   windows: they are most.
2. Blocks with the same key and the same hash of all their words are repeated as a whole.
3. Of the other keys with several different blocks, each different block is taken once,
   with its number, and its windows are compared by (key, hash of the 35 words).
Counts combine before they are shuffled, so a passage that a third of all documents share
is one row per task; the joins that bring results back to documents are split by AQE.

Hashes decide equality: 64 bits of the key and 64 of the words.

Null, empty and short texts keep all their words. Texts are read whole. Repeated rows are
rows of their own, so their windows repeat. Columns other than id and text are not read.
`docs` has to be read from files, as rows are known by their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.staging import Stages
from tillwise.llm.text import Words, arrow, batch_of, chunks, mixed, powers

WINDOW = 35
#: A sixth round's symbol stands for about 6 words and needs 17 to be decided. Symbols of
#: higher rounds fit into few windows.
ROUNDS = 6
#: Rounds that begin with naming runs. Each costs a symbol of context on both sides.
RUN_ROUNDS = (0,)
FIRST, SECOND, STEP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)
UNSTEP = np.uint64(pow(int(STEP), -1, 1 << 64))


class Symbols(NamedTuple):
    """A round's symbols, in text order: name, first and last word + 1, context, document."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def neighbours(at: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context that knowing the left and the right neighbour takes. At the bounds of a
    document it reaches beyond, into no window."""
    left, right = first[:-1][at.doc] - 1, first[1:][at.doc] + 1
    same = at.doc[1:] == at.doc[:-1]
    left[1:][same] = at.low[:-1][same]
    right[:-1][same] = at.high[1:][same]
    return left, right


def runs(at: Symbols, first: np.ndarray) -> Symbols:
    """Each maximal run of equal symbols as one symbol; a single one keeps its name."""
    same = (at.name[1:] == at.name[:-1]) & (at.doc[1:] == at.doc[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    tail = np.append(head[1:], len(at.name)) - 1
    left, right = neighbours(at, first)
    n = (tail - head + 1).astype(np.uint64)
    name = np.where(n == 1, at.name[head], mixed(at.name[head] * FIRST + n))
    return Symbols(name, at.start[head], at.end[tail], left[head], right[tail], at.doc[head])


def pairs(at: Symbols, first: np.ndarray, salt: np.uint64) -> Symbols:
    """Each left symbol and right symbol in a row as one symbol."""
    is_left = mixed(at.name + salt) >> np.uint64(63) == 1
    paired = np.zeros(len(at.name), bool)
    paired[:-1] = is_left[:-1] & ~is_left[1:] & (at.doc[1:] == at.doc[:-1])
    absorbed = np.zeros(len(at.name), bool)
    absorbed[1:] = paired[:-1]
    left, right = neighbours(at, first)
    # Alone, a left symbol depends on what follows it, a right one on what stands before.
    low, high = np.where(is_left, at.low, left), np.where(is_left, right, at.high)
    name, end = at.name.copy(), at.end.copy()
    one = np.flatnonzero(paired)
    name[one] = mixed(at.name[one] * FIRST + at.name[one + 1] * SECOND + np.uint64(1))
    end[one], low[one], high[one] = at.end[one + 1], at.low[one], at.high[one + 1]
    keep = ~absorbed
    return Symbols(name[keep], at.start[keep], end[keep], low[keep], high[keep], at.doc[keep])


def rounds(hashes: np.ndarray, first: np.ndarray) -> list[Symbols]:
    """The symbols of all rounds, the words first. first: the first word of each document."""
    place = np.arange(len(hashes))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = [Symbols(hashes, place, place + 1, place, place + 1, doc)]
    for k, salt in enumerate(powers(STEP, ROUNDS + 1)[1:]):
        at = runs(levels[-1], first) if k in RUN_ROUNDS else levels[-1]
        levels.append(pairs(at, first, salt))
    return levels


def least(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the (first) smallest value of each range [low, high), none empty."""
    size = high - low
    step = np.zeros(int(size.max()) + 1, np.int64)
    step[1:] = np.log2(np.arange(1, len(step))).astype(np.int64)
    tables = [np.arange(len(value))]
    for k in range(int(step[-1])):
        a, b = tables[-1][: -(1 << k)], tables[-1][1 << k :]
        tables.append(np.where(value[a] <= value[b], a, b))
    out = np.empty(len(low), np.int64)
    of = step[size]
    for k, table in enumerate(tables):
        mine = np.flatnonzero(of == k)
        if len(mine):
            a, b = table[low[mine]], table[high[mine] - (1 << k)]
            out[mine] = np.where(value[a] <= value[b], a, b)
    return out


def keys(levels: list[Symbols], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, first word and round of the key symbol of the windows at `starts`."""
    name, place, level = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    n = len(levels[0].name)
    for k in range(len(levels) - 1, -1, -1):
        at = levels[k]
        before = np.cumsum(np.bincount(at.low + 1, minlength=n + 2))
        until = np.cumsum(np.bincount(at.high, minlength=n + 2))
        low, high = before[starts[open_]], until[starts[open_] + WINDOW]
        some = high > low
        if some.any():
            mine = open_[some]
            best = least(mixed(at.name ^ SECOND), low[some], high[some])
            name[mine], place[mine], level[mine] = at.name[best], at.start[best], k
            open_ = open_[~some]
        if not len(open_):
            break
    return name, place, level


class Stretches:
    """Hashes of stretches of words [a, b), wherever they stand."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(STEP, len(hashes)), out=self.sums[1:])
        self.back = powers(UNSTEP, len(hashes) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


class Blocks(NamedTuple):
    """Windows in a row with the same key symbol: key, hash of all words and of the key's
    place, document, and the windows first..last, counted from the document's first word."""

    key: np.ndarray
    block: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


def blocks(words: Words) -> tuple[Blocks, Stretches]:
    """The blocks of the documents that have windows."""
    hashes = words.hashes()
    stretches = Stretches(hashes)
    windows = np.maximum(words.counts - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return Blocks(none.view(np.uint64), none.view(np.uint64), none, none, none), stretches
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + words.first[:-1][doc]
    name, place, level = keys(rounds(hashes, words.first), starts)
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (level[1:] != level[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    a, b = starts[head], starts[tail]
    whole = mixed(stretches.of(a, b + WINDOW) + (place[head] - a).astype(np.uint64) * FIRST)
    base = words.first[:-1][doc[head]]
    return Blocks(name[head], whole, doc[head], a - base, b - base), stretches


BLOCK = "row long, key long, block long, first int, last int"


def found_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of the documents (row, text)."""
    out = arrow(BLOCK)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found, _ = blocks(Words.of(batch.column("text")))
            rows = batch.column("row").to_numpy()[found.doc]
            yield batch_of(out, row=rows, key=found.key.view(np.int64), block=found.block.view(np.int64), first=found.first, last=found.last)

    return docs.select("row", "text").mapInArrow(find, BLOCK)


WINDOW_ROW = "key long, block long, place int, hash long, n long"


def window_hashes(samples: DataFrame) -> DataFrame:
    """The windows of the sample blocks of each text (text, blocks: key, block, first, last
    and n); place counts from the block's first window."""
    out = arrow(WINDOW_ROW)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words.of(batch.column("text"))
            stretches = Stretches(words.hashes())
            lists = batch.column("blocks")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            parts = lists.flatten()
            key, block, first, last, n = (parts.field(f).to_numpy(zero_copy_only=False) for f in ("key", "block", "first", "last", "n"))
            size = (last - first + 1).astype(np.int64)
            of = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            start = words.first[:-1][doc[of]] + first[of] + place
            yield batch_of(out, key=key[of], block=block[of], place=place, hash=stretches.of(start, start + WINDOW).view(np.int64), n=n[of])

    return samples.select("text", "blocks").mapInArrow(hashes, WINDOW_ROW)


KEPT = "doc_id {id}, n_words long, n_removed long, kept_sha256 string, kept_text string"


def without(docs: DataFrame, with_text: bool) -> DataFrame:
    """The documents (doc_id, text, runs: first and last repeated window) without the words
    that the windows cover."""
    schema = KEPT.format(id=docs.schema["doc_id"].dataType.simpleString())
    out = arrow(schema)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n, removed, digest, texts = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if spans:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        edges[span["first"]] += 1
                        edges[span["last"] + WINDOW] -= 1
                    kept = list(compress(words, np.cumsum(edges)[:-1] == 0))
                left = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if with_text else None)
            yield batch_of(out, doc_id=batch.column("doc_id"), n_words=n, n_removed=removed, kept_sha256=digest, kept_text=texts)

    return docs.select("doc_id", "text", "runs").mapInArrow(remove, schema)


def repeated_windows(docs: DataFrame, stages: Stages) -> DataFrame:
    """row and runs (first and last) of repeated windows of the documents (row, text).

    What rows are joined with is written first: AQE splits a hot key's join partition only
    where both sides come straight from a shuffle.
    """
    every = stages.write(found_blocks(docs), "blocks")
    shared = stages.write(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    some = stages.write(every.join(shared, "key", "left_semi"), "shared")
    stages.drop("blocks", "keys")
    kinds = some.groupBy("key", "block").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("sample"))
    kinds = stages.write(kinds.withColumnRenamed("n", "copies"), "kinds")
    # Keys with several different blocks: look at the windows of each.
    several = stages.write(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key"), "several")
    samples = kinds.join(several, "key", "left_semi").select(
        "sample.row", F.struct("key", "block", "sample.first", "sample.last", F.col("copies").alias("n")).alias("b")
    )
    samples = samples.groupBy("row").agg(F.collect_list("b").alias("blocks"))
    windows = stages.write(window_hashes(docs.select("row", "text").join(samples, "row")), "windows")
    again = stages.write(windows.groupBy("key", "hash").agg(F.sum("n").alias("m")).where("m > 1").select("key", "hash"), "again")
    places = windows.where("n = 1").select("key", "hash", "block", "place").join(again, ["key", "hash"], "left_semi")
    places = places.groupBy("key", "block").agg(F.sort_array(F.collect_set("place")).alias("places"))
    whole = kinds.where("copies > 1").select("key", "block", F.lit(None).cast("array<int>").alias("places"))
    hits = some.join(whole.unionByName(places), ["key", "block"])
    run = F.when(F.isnull("places"), F.array(F.struct("first", "last"))).otherwise(
        F.transform("places", lambda p: F.struct((F.col("first") + p).alias("first"), (F.col("first") + p).alias("last")))
    )
    runs = stages.write(hits.select("row", run.alias("run")).groupBy("row").agg(F.flatten(F.collect_list("run")).alias("runs")), "runs")
    stages.drop("shared", "kinds", "windows", "several", "again")
    return runs


def deduplicated(docs: DataFrame, with_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (on demand) kept_text of every row: the
    words that no repeated window covers, joined by one space."""
    stages = Stages(docs.sparkSession, "recompression")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = without(rows.join(repeated_windows(rows, stages), "row", "left"), with_text)
    return out if with_text else out.drop("kept_text")
