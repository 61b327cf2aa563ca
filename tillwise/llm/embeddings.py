"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping shards.

Vectors are compared by cosine in double precision within a label (and dimension); pairs at
0.93 or more are linked. Equal vectors of a label are one node with a number of copies.

1. Shards. Labels of more than SHARD nodes are clustered: spherical k-means on a bounded
   sample, one centroid per SHARD nodes (CENTROIDS at most). A node lives in the shard of
   its nearest centroid and is also a vertex of the next nearest, so shards overlap. A shard
   of more than SHARD vertices is dealt into parts by a hash, so no task grows with it.
2. Graph. In each part every vertex keeps up to DEGREE neighbours by robust pruning (the
   nearest first; a candidate goes if a kept one is ALPHA times nearer to it). Reverse edges
   are added, and a vertex that cannot be reached from the medoids gets an edge from its
   nearest reachable one. Adjacency lists of a node from all its parts are united.
3. Search. Every node is a query in all parts of the shards it may have links in: those of
   its NEAREST nearest centroids and all whose centroid is within 1.5 times the link angle.
   A search starts at the part's medoids, goes greedily to the BEAM best, then expands
   everything within the link range (and a little below) until nothing new is in range.
   Queries of a part are dealt into blocks of bounded size. Links are only counted towards
   vertices in their home shard, so no link counts twice.
4. Verification is the cosine of the vectors in double precision. An audit finds the true
   links of a sample of all nodes, found or not, by brute force over their labels. It draws
   until AUDIT of them have links, at most AUDIT_MOST nodes or AUDIT_BYTES of vectors.
   Where the search found less than 0.98 of these links, it is repeated with twice as many
   shards per query. Where links are too rare for AUDIT linked nodes, it is also repeated
   until twice the shards find at most a fiftieth more links.

No link table leaves a task: a task returns the number of links per query and one edge per
node to the smallest node it is connected with. Components are found in Spark rounds.

Vectors that are null, empty, zero or hold null or non-finite components, and those without
a label, link with nothing. Repeated rows are vectors of their own that link with each
other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.components import components
from tillwise.llm.learning import unit
from tillwise.llm.staging import Stages
from tillwise.llm.text import arrow, batch_of

SHARD, CENTROIDS, SAMPLE_BYTES = 1000, 16_384, 64 << 20
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
MEDOIDS, BEAM, NEAREST, SLACK = 24, 32, 3, 0.05
AUDIT, AUDIT_MOST, AUDIT_BYTES, RECALL = 256, 16_384, 64 << 20, 0.98
#: What a search or an audit holds at once.
NEIGHBOURS_AT_ONCE, PAIRS_AT_ONCE, AUDIT_AT_ONCE = 1 << 19, 1 << 14, 1 << 21


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, value) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows far from each other; the first is the medoid."""
    picked = [int((x @ x.mean(0)).argmax())]
    close = x @ x[picked[0]]
    while len(picked) < min(n, len(x)) and close.min() < 1 - 1e-9:
        picked.append(int(close.argmin()))
        close = np.maximum(close, x @ x[picked[-1]])
    return np.array(picked)


def pruned(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency (row, row) of a robust-pruned graph."""
    n = len(x)
    edges = np.zeros((n, n), bool)
    if n < 2:
        return edges
    close = x @ x.T
    np.fill_diagonal(close, -2)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(-close, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, 8))
    listed = np.concatenate([near, far], axis=1)
    rows = np.arange(n)[:, None]
    apart = 1 - close[rows, listed]
    apart[listed == rows] = np.inf
    for _ in range(DEGREE):
        best = apart.argmin(1)
        there = np.flatnonzero(np.isfinite(apart[np.arange(n), best]))
        if not len(there):
            break
        kept = listed[there, best[there]]
        edges[there, kept] = True
        between = 1 - close[kept[:, None], listed[there]]
        apart[there] = np.where(ALPHA * between <= apart[there], np.inf, apart[there])
        apart[there, best[there]] = np.inf
    edges |= edges.T
    return connected(edges, close, spread(x, MEDOIDS))


def connected(edges: np.ndarray, close: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The edges, with one more into each part that the roots don't reach."""
    reached = reach(edges, roots)
    while not reached.all():
        outside, inside = np.flatnonzero(~reached), np.flatnonzero(reached)
        between = close[np.ix_(outside, inside)]
        o, i = np.unravel_index(between.argmax(), between.shape)
        edges[inside[i], outside[o]] = edges[outside[o], inside[i]] = True
        reached |= reach(edges, outside[[o]])
    return edges


def reach(edges: np.ndarray, roots: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[roots] = True
    front = roots
    while len(front):
        front = np.flatnonzero(edges[front].any(0) & ~seen)
        seen[front] = True
    return seen


def in_range(queries: np.ndarray, x: np.ndarray, edges: np.ndarray, least: float) -> np.ndarray:
    """(query, vertex) found with a cosine of `least` or more, by greedy search from the
    medoids and expansion of the range."""
    m, n = len(queries), len(x)
    close = np.full((m, n), -2.0)
    roots = spread(x, MEDOIDS)
    close[:, roots] = queries @ x[roots].T
    opened = np.zeros((m, n), bool)
    bounds, lists = np.concatenate(([0], np.cumsum(edges.sum(1)))), np.nonzero(edges)[1]
    active = np.arange(m)
    width = min(BEAM, n)
    while len(active):
        # The best vertices seen so far; open the best four that are not yet open.
        best = np.argpartition(-close[active], width - 1, axis=1)[:, :width]
        waiting = np.where(opened[active[:, None], best], -2.0, close[active[:, None], best])
        order = np.argsort(-waiting, axis=1)[:, :4]
        value = np.take_along_axis(waiting, order, 1)
        q, k = np.nonzero(value > -2)
        look(queries, x, close, opened, bounds, lists, active[q], best[q, order[q, k]])
        active = active[(value > -2).any(1)]
    while True:
        q, v = np.nonzero((close >= least - SLACK) & ~opened)
        if not len(q):
            return close >= least
        look(queries, x, close, opened, bounds, lists, q, v)


def look(
    queries: np.ndarray, x: np.ndarray, close: np.ndarray, opened: np.ndarray, bounds: np.ndarray, lists: np.ndarray, q: np.ndarray, v: np.ndarray
) -> None:
    """Open vertices v for queries q: compare the queries with the vertices' neighbours,
    vertex k's being lists[bounds[k] : bounds[k + 1]]."""
    opened[q, v] = True
    degree = bounds[v + 1] - bounds[v]
    total = np.concatenate(([0], np.cumsum(degree)))
    first = 0
    while first < len(q):
        last = max(first + 1, int(np.searchsorted(total, total[first] + NEIGHBOURS_AT_ONCE, "right")) - 1)
        of = np.repeat(np.arange(first, last), degree[first:last])
        near = lists[bounds[v[of]] + np.arange(total[first], total[last]) - total[of]]
        pair = q[of] * len(x) + near
        pair = np.unique(pair[close.ravel()[pair] < -1.5])
        for k in range(0, len(pair), PAIRS_AT_ONCE):
            a, b = np.divmod(pair[k : k + PAIRS_AT_ONCE], len(x))
            close[a, b] = np.einsum("ij,ij->i", queries[a], x[b])
        first = last


@dataclass
class Shards:
    """Centroids of the labels that have several."""

    centroids: dict[tuple, np.ndarray]

    def places(self, label, x: np.ndarray, nearest: int, angle: float) -> list[list[int]]:
        """Per vector the numbers of the shards to search, the nearest first."""
        centroids = self.centroids.get((label, x.shape[1]))
        if centroids is None:
            return [[0]] * len(x)
        close = x @ centroids.T
        order = np.argsort(-close, axis=1, kind="stable")
        within = (np.take_along_axis(close, order, 1) >= np.cos(min(1.5 * angle, np.pi / 2))).sum(1)
        return [row[: max(nearest, w)].tolist() for row, w in zip(order, within.tolist())]


def clustered(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Spherical k-means from random rows, so that dense regions get more centroids."""
    centroids = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        nearest = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def sharded(nodes: DataFrame) -> Shards:
    """Shards fitted on a bounded sample of the nodes of large labels."""
    large = nodes.groupBy("label", "dimension").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    large = large.orderBy(F.desc("n"), "label", "dimension").limit(CENTROIDS // 2).collect()
    if not large:
        return Shards({})
    most = max(SAMPLE_BYTES // (8 * max(r.dimension for r in large)), 1)
    total = sum(r.n for r in large)
    draw = unit(F.col("node"), seed=9)
    some = nodes.where(draw < most / total) if most < total else nodes
    some = some.join(F.broadcast(nodes.sparkSession.createDataFrame([(r.label, r.dimension) for r in large], _of(nodes, "label", "dimension"))), ["label", "dimension"])
    some = some.orderBy(draw, "node").limit(most).select("label", "dimension", "vector").toArrow()
    out, share = {}, min(1.0, CENTROIDS / 2 / max(total / SHARD, 1))
    for r in large:
        mask = pa.compute.and_(pa.compute.equal(some.column("label"), r.label), pa.compute.equal(some.column("dimension"), r.dimension))
        rows = some.filter(mask)
        if rows.num_rows > 1:
            out[r.label, r.dimension] = clustered(matrix(rows.column("vector")), min(-(-int(r.n * share) // SHARD) + 1, rows.num_rows))
    return Shards(out)


def _of(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def placed(nodes: DataFrame, shards: Shards, nearest: int, angle: float) -> DataFrame:
    """The nodes with the list `places` of shard numbers, the home first."""
    schema = f"{_of(nodes, *nodes.columns)}, places array<int>"
    out, shared = arrow(schema), nodes.sparkSession.sparkContext.broadcast(shards)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list = [None] * batch.num_rows
            label, dimension = batch.column("label").to_pylist(), batch.column("dimension").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(label, dimension)):
                groups.setdefault(key, []).append(k)
            for (name, _), rows in groups.items():
                for first in range(0, len(rows), 1024):
                    part = rows[first : first + 1024]
                    found = shared.value.places(name, matrix(batch.column("vector").take(pa.array(part))), nearest, angle)
                    for k, row in zip(part, found):
                        places[k] = row
            yield batch_of(out, **{c: batch.column(c) for c in batch.schema.names}, places=places)

    return nodes.mapInArrow(place, schema)


GRAPH = "node long, adjacent array<long>"


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("node").to_numpy())
    table = table.take(pa.array(order))
    node = table.column("node").to_numpy()
    edges = pruned(matrix(table.column("vector")))
    return pa.table({"node": node, "adjacent": pa.array([node[row].tolist() for row in edges], pa.list_(pa.int64()))})


FOUND = "node long, links long, root long"


def _searcher(least: float):
    def search(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        vertex = table.column("vertex").to_numpy(zero_copy_only=False)
        graph, asked = table.filter(pa.array(vertex)), table.filter(pa.array(~vertex))
        node, query = graph.column("node").to_numpy(), asked.column("node").to_numpy()
        if not len(node) or not len(query):
            return pa.table({name: np.zeros(0, np.int64) for name in ("node", "links", "root")})
        edges = np.zeros((len(node), len(node)), bool)
        lists = graph.column("adjacent").combine_chunks()
        to = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(node, to), len(node) - 1)
        there = node[at] == to
        edges[of[there], at[there]] = True
        edges |= edges.T
        found = in_range(matrix(asked.column("vector")), matrix(graph.column("vector")), edges, least)
        found &= query[:, None] != node[None, :]
        counted = found & graph.column("home").to_numpy(zero_copy_only=False)
        links = counted @ graph.column("copies").to_numpy()
        some = links > 0
        joined, low = _smallest(found, query, node)
        none = np.zeros(len(joined), np.int64)
        return pa.table(
            {
                "node": np.concatenate([query[some], joined]),
                "links": np.concatenate([links[some].astype(np.int64), none]),
                "root": np.concatenate([query[some], low]),
            }
        )

    return search


def _smallest(found: np.ndarray, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their part, as the links connect them: passed along
    the links until nothing changes. Nodes that are smallest themselves are left out."""
    q_low, n_low = query.copy(), node.copy()
    rows, columns = np.nonzero(found)
    before = None
    while len(rows):
        np.minimum.at(q_low, rows, n_low[columns])
        np.minimum.at(n_low, columns, q_low[rows])
        now = q_low.sum() + n_low.sum()
        if now == before:
            break
        before = now
    nodes, low = np.concatenate([query, node]), np.concatenate([q_low, n_low])
    return nodes[low < nodes], low[low < nodes]


def searched(nodes: DataFrame, shards: Shards, stages: Stages, name: str, least: float, nearest: int) -> DataFrame:
    """node, links and root of all searches."""
    at = stages.write(placed(nodes, shards, nearest, float(np.arccos(least))), f"{name}-places")
    shard = ["label", "dimension", "shard"]
    member = at.select("node", "label", "dimension", "copies", "vector", F.posexplode(F.slice("places", 1, 2)).alias("rank", "shard"))
    sizes = member.groupBy(*shard).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(2.0 * SHARD)).cast("int").alias("parts")
    asked = at.select("node", "label", "dimension", "vector", F.explode("places").alias("shard"))
    visits = asked.groupBy(*shard).agg(F.count("*").alias("visits"))
    blocks = F.ceil(F.col("visits") / F.lit(1.0 * SHARD)).cast("int").alias("blocks")
    plan = stages.write(sizes.join(visits, shard).select(*shard, parts, blocks), f"{name}-plan")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    vertices = member.join(plan, shard).withColumn("part", dealt(1, "parts"))
    graph = vertices.select(*shard, "part", "node", "vector").groupBy(*shard, "part").applyInArrow(_build, GRAPH)
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"))
    united = stages.write(united, f"{name}-graph")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vertices = vertices.join(united, "node").select(
        *shard, "part", every("blocks").alias("block"), "node", "vector", "copies", (F.col("rank") == 0).alias("home"), "adjacent", F.lit(True).alias("vertex")
    )
    queries = asked.join(plan, shard).withColumn("block", dealt(2, "blocks")).select(
        *shard, every("parts").alias("part"), "block", "node", "vector",
        F.lit(0).cast("long").alias("copies"), F.lit(False).alias("home"), F.lit(None).cast("array<long>").alias("adjacent"), F.lit(False).alias("vertex"),
    )
    return vertices.unionByName(queries).groupBy(*shard, "part", "block").applyInArrow(_searcher(least), FOUND)


def audited(nodes: DataFrame, least: float) -> tuple[dict[int, int], bool]:
    """The true links, by brute force, of those of a sample of all nodes that have some, and
    whether these are AUDIT or more. Nodes are drawn until they are, or up to AUDIT_MOST."""
    size = nodes.agg(F.count("*"), F.max("dimension")).first()
    if not size[0]:
        return {}, True
    most = max(min(AUDIT_MOST, AUDIT_BYTES // (8 * size[1])), AUDIT)
    draw = F.xxhash64(F.lit(21), "node")
    sample = min(4 * AUDIT, most)
    while True:
        asked = nodes.orderBy(draw).limit(sample).select("node", "label", "dimension", "vector").toArrow()
        truth = _true_links(nodes, asked, least)
        if len(truth) >= AUDIT or sample >= size[0]:
            return truth, True
        if sample >= most:
            return truth, False
        sample = min(4 * sample, most)


def _groups(table: pa.Table | pa.RecordBatch) -> dict[tuple, list[int]]:
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(table.column("label").to_pylist(), table.column("dimension").to_pylist())):
        groups.setdefault(key, []).append(k)
    return groups


def _true_links(nodes: DataFrame, asked: pa.Table, least: float) -> dict[int, int]:
    """node and links of the asked nodes that have links, by brute force."""
    parts = {key: (asked.column("node").to_numpy()[rows], matrix(asked.take(pa.array(rows)).column("vector"))) for key, rows in _groups(asked).items()}
    schema = "node long, n long"
    out, shared = arrow(schema), nodes.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {key: np.zeros(len(node), np.int64) for key, (node, _) in shared.value.items()}
        for batch in batches:
            for key, rows in _groups(batch).items():
                if key not in n:
                    continue
                node, x = shared.value[key]
                step = max(AUDIT_AT_ONCE // len(node), 1)
                for first in range(0, len(rows), step):
                    some = batch.take(pa.array(rows[first : first + step]))
                    hit = (x @ matrix(some.column("vector")).T >= least) & (node[:, None] != some.column("node").to_numpy()[None, :])
                    n[key] += hit @ some.column("copies").to_numpy()
        for key, links in n.items():
            if links.any():
                yield batch_of(out, node=shared.value[key][0][links > 0], n=links[links > 0])

    return dict(nodes.mapInArrow(count, schema).groupBy("node").agg(F.sum("n")).collect())


def recall(truth: dict[int, int], found: DataFrame) -> float:
    """The share of the true links that were found; nodes without a found link count 0."""
    if not truth:
        return 1.0
    asked = found.sparkSession.createDataFrame([(k,) for k in truth], "node long")
    links = dict(found.join(asked, "node").select("node", "links").collect())
    return sum(min(n, links.get(k, 0)) for k, n in truth.items()) / sum(truth.values())


def near_duplicates(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept
    (vec_id = component_id) of every row."""
    stages = Stages(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & usable(F.col("vector")))
    key = [F.when(F.col("usable"), F.xxhash64(F.lit(seed), "label", "vector")).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    rows = stages.write(rows.select("*", *key), "rows")
    nodes = rows.where("usable").groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    nodes = stages.write(nodes.withColumn("dimension", F.size("vector")), "nodes")
    shards, nearest = sharded(nodes), NEAREST
    widest = max((len(c) for c in shards.centroids.values()), default=1)
    slim = nodes.select("node", "copies", "label", "dimension", "vector")
    truth, enough = audited(slim, least) if nearest < widest else ({}, True)
    before = -1
    while True:
        found = stages.write(searched(slim, shards, stages, f"search-{nearest}", least, nearest), f"found-{nearest}")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        if nearest >= widest:
            break
        if recall(truth, links) >= RECALL:
            now = 0 if enough else links.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
            if enough or before >= RECALL * now:
                break
            before = now
        nearest *= 2
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), stages)
    named = nodes.select("h1", "h2", "node", "copies", "first").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").join(links, "node", "left")
    named = named.select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
