"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is the bag of its five-word shingles (all its words, if fewer), each weighing
its number times ln(1 + N / max(df, floor * N)): rare shingles weigh the same, those in
more than 1 % of all documents less. Two documents are linked if the weighted Jaccard
similarity of their bags is 0.8 or more; classes are the connected components of links.

1. Document frequencies. Only shingles above the floor need one. All shingles are counted
   in 2 ** 18 hash buckets, of which few hold 1 % of all documents; a second pass counts
   the shingles of those buckets exactly, over all documents. The floor rises above 1 %
   where documents are so long that more than FREQUENT shingles could pass it, so the
   table that tasks get is bounded.
2. Sampling. BANDS x ROWS samples of each document, drawn by ICWS (the shingle, and the
   step of its weight, with the smallest a = c / (y e^r)). Draws of r, c and beta come from
   quantile tables of 65,536 points, indexed by the shingle's hash. The rows of a band make
   a bucket; a pair at 0.8 shares one of the 16 x 5 buckets with probability 0.998, at 0.9
   with 0.9999998. Equal texts are one node from here on.
3. Verification. Buckets are not expanded into pairs. Each member is compared with one
   leader, which connects most copies. Buckets whose members don't all follow one leader
   are compared in full, but in tasks: their members are dealt into blocks of about BLOCK, each
   pair of blocks is one small group, whose similarities come from one matrix product, and
   what leaves the task is at most one link per member. Members that one component already
   holds are not compared with each other. So no bucket size is cut off, and rows grow with
   members times blocks of strays, not with pairs.

Documents without words (null, empty, blank) link with nothing and stay. Repeated rows and
ties: equal texts are one class; its id is the smallest doc_id (null ids last).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.components import components
from tillwise.llm.staging import Stages
from tillwise.llm.text import BASE, Words, arrow, batch_of, chunks, mixed, powers, shingled

SHINGLE = 5
BANDS, ROWS = 16, 5
BUCKET_BITS = 18
#: The inverse document frequency is flat below this share of the documents.
FLOOR = 0.01
#: Bits of a shingle's hash; the others hold its document's place in the chunk.
BITS = 54
POINTS = 1 << 16
BLOCK = 256


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, shingle hash and number of the different shingles of each text, by owner,
    then hash."""
    words = Words.of(column)
    shingles, owner = shingled(words, words.hashes(), SHINGLE)
    tagged = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | (shingles >> np.uint64(64 - BITS)))
    tagged, number = np.unique(tagged, return_counts=True)
    return (tagged >> np.uint64(BITS)).astype(np.int64), tagged & np.uint64((1 << BITS) - 1), number


@dataclass
class Weights:
    """ln(1 + N / df): the frequent shingles', and the one of all others."""

    shingles: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, shingles: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingles, shingles), max(len(self.shingles) - 1, 0))
        if not len(self.shingles):
            return number * self.rare
        return number * np.where(self.shingles[at] == shingles, self.values[at], self.rare)


def frequencies(texts: DataFrame, stages: Stages) -> Weights:
    """Weights from the document frequencies of all texts."""
    spark = texts.sparkSession
    sums = stages.write(texts.mapInArrow(_bucketed(arrow(SUMS)), SUMS).groupBy("bucket").agg(F.sum("n").alias("n")), "sums")
    n, occurrences = texts.count(), sums.agg(F.sum("n")).first()[0]
    if not occurrences:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), float(np.log1p(1.0)))
    heavy = np.zeros(1 << BUCKET_BITS, bool)
    heavy[[r.bucket for r in sums.where(F.col("n") > FLOOR * n).collect()]] = True
    shared, out = spark.sparkContext.broadcast(np.packbits(heavy)), arrow(COUNTS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in chunks(batches, "text"):
            _, shingles, _ = bags(batch.column("text"))
            found, df = np.unique(shingles[wanted[shingles >> np.uint64(BITS - BUCKET_BITS)]], return_counts=True)
            yield batch_of(out, shingle=found.view(np.int64), df=df)

    frequent = texts.mapInArrow(count, COUNTS).groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") > FLOOR * n).toArrow()
    shingles, df = frequent.column("shingle").to_numpy().view(np.uint64), frequent.column("df").to_numpy()
    order = np.argsort(shingles)
    return Weights(shingles[order], np.log1p(n / df[order]), float(np.log1p(1 / FLOOR)))


SUMS, COUNTS = "bucket int, n long", "shingle long, df long"


def _bucketed(out: pa.Schema):
    """How many shingles of the task's documents are in each bucket."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in chunks(batches, "text"):
            words = Words.of(batch.column("text"))
            shingles, _ = shingled(words, words.hashes(), SHINGLE)
            at, n = np.unique((shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
            counts[at] += n
        some = np.flatnonzero(counts)
        yield batch_of(out, bucket=some, n=counts[some])

    return find


def quantiles() -> tuple[np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1) and ln c, c ~ Gamma(2, 1), at POINTS equally likely points."""
    share = (np.arange(POINTS) + 0.5) / POINTS
    low, high = np.zeros(POINTS), np.full(POINTS, 60.0)
    for _ in range(60):  # the distribution function is 1 - (1 + x) e^-x
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def sampled(
    owner: np.ndarray, shingles: np.ndarray, weight: np.ndarray, tables: tuple[np.ndarray, np.ndarray], bands: int = BANDS, rows: int = ROWS
) -> np.ndarray:
    """A row of `bands` bucket numbers for each owner that has shingles, in order."""
    if not len(owner):
        return np.zeros((0, bands), np.uint64)
    gamma, log_gamma = tables
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    log_w = np.log(weight).astype(np.float32)
    place, low = np.arange(len(owner)), np.uint64(POINTS - 1)
    spread = shingles * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    out = np.zeros((len(starts), bands), np.uint64)
    for k, salt in enumerate(mixed(np.arange(1, bands * rows + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))):
        x = spread * (salt | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        r = gamma[x >> np.uint64(48)]
        log_c = log_gamma[(x >> np.uint64(32)) & low]
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / POINTS)
        t = np.floor(log_w / r + beta)
        # ln a, moved above 0 so that its bits sort as whole numbers; ties go to the
        # smaller hash, which stands first.
        a = log_c - r * (t - beta + 1) + np.float32(4096)
        best = np.minimum.reduceat((a.view(np.int32).astype(np.int64) << 32) | place, starts) & 0xFFFFFFFF
        picked = shingles[best] * np.uint64(0xFF51AFD7ED558CCD) + t[best].astype(np.int64).view(np.uint64)
        band = k // rows
        out[:, band] = mixed(out[:, band] * np.uint64(3) + picked + np.uint64(band))
    return out


SIGNED = "key binary, doc_id {id}, row long, weight double, buckets array<long>"


def signed(docs: DataFrame, weights: Weights, bands: int, rows: int) -> DataFrame:
    """key (of the text), doc_id, row, weight and buckets of the documents with words."""
    schema = SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())
    out, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = quantiles()
        for batch in chunks(batches, "text"):
            owner, shingles, number = bags(batch.column("text"))
            weight = shared.value.of(shingles, number)
            buckets = sampled(owner, shingles, weight, tables, bands, rows)
            there, at = np.unique(owner, return_index=True)
            flat = pa.array(buckets.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * bands), flat)
            kept = batch.take(pa.array(there))
            total = np.add.reduceat(weight, at) if len(at) else np.zeros(0)
            yield batch_of(out, key=kept.column("key"), doc_id=kept.column("doc_id"), row=kept.column("row"), weight=total, buckets=lists)

    return docs.select(key_of(F.col("text")).alias("key"), "doc_id", "row", "text").mapInArrow(sign, schema)


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def similar(pairs: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """u and v of the pairs (u, v, of, with) whose texts `of` and `with` are similar."""
    out, shared = arrow(LINK), pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "of"):
            close = weighted_jaccard(batch.column("of"), batch.column("with"), shared.value)
            linked = batch.filter(pa.array(close >= similarity))
            yield batch_of(out, u=linked.column("u"), v=linked.column("v"))

    return pairs.select("u", "v", "of", "with").mapInArrow(compare, LINK)


def weighted_jaccard(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """The similarity of each row's two texts."""
    sides = []
    for column in (a, b):
        owner, shingles, number = bags(column)
        tagged = (owner.astype(np.uint64) << np.uint64(BITS)) | shingles
        sides.append((tagged, owner, weights.of(shingles, number)))
    (tag_a, owner_a, weight_a), (tag_b, owner_b, weight_b) = sides
    _, at_a, at_b = np.intersect1d(tag_a, tag_b, assume_unique=True, return_indices=True)
    n = len(a)
    shared = np.bincount(owner_a[at_a], np.minimum(weight_a[at_a], weight_b[at_b]), n)
    total = np.bincount(owner_a, weight_a, n) + np.bincount(owner_b, weight_b, n)
    return shared / np.maximum(total - shared, 1e-300)


def classes(docs: DataFrame, stages: Stages, similarity: float, bands: int, rows: int) -> DataFrame:
    """row, doc_id, component and class_id of the documents (row, doc_id, text) that have
    words."""
    texts = docs.select("text")
    weights = frequencies(texts, stages)
    marks = stages.write(signed(docs, weights, bands, rows), "signed")
    nodes = marks.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("buckets").alias("buckets"))
    member = nodes.select("key", "weight", F.explode("buckets").alias("bucket"))
    leaders = member.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1")
    member = stages.write(member.join(leaders, "bucket").select("bucket", "leader", "n", "key", "weight"), "members")
    known = _Verifier(docs, member, weights, similarity, stages)
    # One leader per member first: most copies are connected by that.
    known.lead(member.where("key <> leader").groupBy(F.col("key").alias("u")).agg(F.min("leader").alias("v")))
    known.finish()
    ids = marks.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(known.found.withColumnRenamed("node", "key"), "key", "left")
    ids = ids.select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classed = ids.join(smallest, "component").select("key", "component", "class_id")
    return marks.select("key", "row", "doc_id").join(classed, "key").select("row", "doc_id", "component", "class_id")


class _Verifier:
    """Tests pairs of nodes; `found` has the components of all links."""

    def __init__(self, docs: DataFrame, member: DataFrame, weights: Weights, similarity: float, stages: Stages) -> None:
        self.member, self.weights, self.similarity, self.stages = member, weights, similarity, stages
        wanted = member.select("key").distinct()
        keyed = docs.select(key_of(F.col("text")).alias("key"), "text")
        # Copies combine before the shuffle, so that a text that many documents have is one
        # row per task where it meets the wanted keys.
        once = keyed.groupBy("key").agg(F.first("text").alias("text"))
        self.texts = stages.write(once.join(wanted, "key", "left_semi"), "texts")

    def lead(self, pairs: DataFrame) -> None:
        """Compare each u with its leader v."""
        text = lambda name, as_: self.texts.select(F.col("key").alias(name), F.col("text").alias(as_))
        both = pairs.join(text("u", "of"), "u").join(text("v", "with"), "v")
        self.led = self.stages.write(similar(both, self.weights, self.similarity), "led")

    def finish(self) -> None:
        """Compare all members of the buckets that don't follow one leader, and connect."""
        further = self.led.select(F.col("u").alias("v"), F.col("v").alias("w"))
        of = self.led.join(further, "v", "left").select(F.col("u").alias("key"), F.coalesce("w", "v").alias("component"))
        now = self.member.join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))
        several = now.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
        now = self.stages.write(now.join(several, "bucket", "left_semi").select("bucket", "n", "key", "component"), "open")
        now = dealt(now)
        grouped = now.join(self.texts, "key").groupBy("bucket", "i", "j")
        links = grouped.applyInArrow(_linker(self.weights, self.similarity, self.stages.spark), LINK)
        links = self.stages.write(links, "links")
        self.found = components(self.led.unionAll(links), self.stages)
        self.stages.drop("open", "texts", "links")


def dealt(members: DataFrame) -> DataFrame:
    """bucket, i, j, key, component: the groups (bucket, i, j) in which any two members
    (bucket, n, key, component) of a bucket meet that are not of one component yet.

    Members of a bucket's largest component are together already. They are dealt into blocks
    -1, -2, ..., all others into blocks 0, 1, ..., and each block of others meets every block
    of both sides. A bucket of n members with s others makes up to about n + 2 n s / BLOCK
    rows, whatever pairs are alike. A bucket of one block is one group.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"))
    split = f"n > {BLOCK}"
    sides = members.join(most, "bucket").selectExpr(
        "bucket", "key", "component", f"{split} AS split", f"{split} AND component = most.component AS inside",
        f"CAST(ceil(most.size / {BLOCK}D) AS INT) AS inner_blocks",
        f"CAST(IF({split}, ceil((n - most.size) / {BLOCK}D), 1) AS INT) AS outer_blocks",
    )
    placed = sides.withColumn("mine", F.expr("CAST(pmod(xxhash64(key), IF(inside, inner_blocks, outer_blocks)) AS INT)"))
    outer, inner = "sequence(0, outer_blocks - 1)", "sequence(0, inner_blocks - 1)"
    met = (
        f"IF(inside, transform({outer}, o -> struct(-1 - mine AS i, o AS j)), "
        f"concat(transform({outer}, o -> struct(least(mine, o) AS i, greatest(mine, o) AS j)), "
        f"IF(split, transform({inner}, o -> struct(-1 - o AS i, mine AS j)), array())))"
    )
    return placed.select("bucket", "key", "component", F.explode(F.expr(met)).alias("at")).select("bucket", "at.i", "at.j", "key", "component")


LINK = "u binary, v binary"


def _linker(weights: Weights, similarity: float, spark):
    shared = spark.sparkContext.broadcast(weights)

    def link(table: pa.Table) -> pa.Table:
        """Of the group's links between components, enough to connect what they connect."""
        table = table.combine_chunks()
        names, part = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)
        u, v = [], []
        if len(names) > 1:
            close = all_jaccard(table.column("text"), shared.value)
            root = np.arange(len(names))
            key = table.column("key")
            for a, b in np.argwhere(np.triu(close >= similarity, 1)).tolist():
                x, y = root[part[a]], root[part[b]]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    u.append(key[a])
                    v.append(key[b])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return link


def all_jaccard(texts: pa.ChunkedArray, weights: Weights, columns: int = 4096) -> np.ndarray:
    """The similarity of each two of some texts. A shingle that stands n times counts as n
    different ones, so the shared weight is a product of 0/1 matrices."""
    batches = chunks(pa.table({"text": texts}).to_batches(), "text")
    parts, n = [], 0
    for batch in batches:
        owner, shingles, number = bags(batch.column("text"))
        parts.append((owner + n, shingles, number))
        n += batch.num_rows
    owner, shingles, number = (np.concatenate(x) for x in zip(*parts))
    total = np.bincount(owner, weights.of(shingles, number), n)
    copy = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    owner, value = np.repeat(owner, number), np.repeat(weights.of(shingles, np.ones(len(number))), number)
    _, place, seen = np.unique(mixed(np.repeat(shingles, number) + copy.astype(np.uint64) * BASE), return_inverse=True, return_counts=True)
    both = np.flatnonzero(seen[place] > 1)
    order = both[np.argsort(place[both], kind="stable")]
    _, column = np.unique(place[order], return_inverse=True)
    shared = np.zeros((n, n))
    for first in range(0, int(column.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        there = np.zeros((n, columns))
        there[owner[order[a:b]], column[a:b] - first] = np.sqrt(value[order[a:b]])
        shared += there @ there.T
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-300)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (doc_id = class_id) of
    every row."""
    stages = Stages(docs.sparkSession, "near-duplicates")
    texts = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    found = classes(texts, stages, similarity, bands, rows).select("row", "class_id")
    out = texts.select("row", "doc_id").join(found, "row", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number `row`, the same whenever the same files are read."""
    return docs.select("*", F.monotonically_increasing_id().alias("row"))


def deduplicated(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, with the smallest doc_id and of these the first, and all rows
    without words; all columns unchanged. `docs` is read from files."""
    stages = Stages(docs.sparkSession, "near-duplicates")
    found = classes(numbered(docs.select("doc_id", "text")), stages, similarity, bands, rows)
    order = F.struct(F.isnull("doc_id"), "doc_id", "row")
    first = found.groupBy("component").agg(F.min(order)["row"].alias("row"))
    gone = stages.write(found.select("row").join(first, "row", "left_anti"), "gone")
    name = "row"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, F.monotonically_increasing_id()).join(gone.withColumnRenamed("row", name), name, "left_anti").select(*docs.columns)
