"""Histogram gradient-boosted trees for two classes, flattened for numpy traversal.

`fit` learns from arrays, `learned` from all rows of a table: its tasks count values and sum
gradients, and only histograms, whose size does not depend on the number of rows, reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tillwise.llm.text import arrow, batch_of

#: Rows of a task that sums gradients.
TASK_ROWS = 100_000
#: Gradients are summed as whole multiples of 1 / UNIT, so that sums do not depend on the order.
UNIT = float(1 << 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Trees:
    """Complete binary trees of one depth: inner node i of a tree has the children 2i + 1
    (value <= threshold) and 2i + 2; leaves are numbered from the left."""

    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray  # tree, inner node
    leaf: np.ndarray  # tree, leaf
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows go down one level at a time."""
        inner = self.feature.shape[1]
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(
    x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, smallest: float = 5.0
) -> Trees:
    """Boosted trees for labels y in {0, 1}, by the log loss.

    Values are cut into quantile bins; each level's best splits come from one histogram of
    gradients per feature. A node without a useful split sends all rows to the left.
    Without rows, or with one class, the trees say the (smoothed) share of label 1.
    """
    n, width = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(n, base)
    for t in range(n_trees):
        p = sigmoid(total)
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width_now = 2**level - 1, 2**level
            at = node - first
            g_all, h_all = np.bincount(at, slope, width_now), np.bincount(at, curve, width_now)
            count = np.bincount(at, minlength=width_now)
            gain = np.full(width_now, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cells, size = at * bins + binned[:, f], width_now * bins
                g = np.bincount(cells, slope, size).reshape(-1, bins).cumsum(1)[:, : len(cuts[f])]
                h = np.bincount(cells, curve, size).reshape(-1, bins).cumsum(1)[:, : len(cuts[f])]
                m = np.bincount(cells, minlength=size).reshape(-1, bins).cumsum(1)[:, : len(cuts[f])]
                rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
                gains = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                gains[(m < smallest) | (count[:, None] - m < smallest)] = -1
                best = gains.argmax(1)
                value = gains[np.arange(width_now), best]
                better = value > gain
                gain[better] = value[better]
                feature[t, first : first + width_now][better] = f
                threshold[t, first : first + width_now][better] = cuts[f][best[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, slope, leaves) / (np.bincount(at, curve, leaves) + ridge)
        total += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


VALUES = "feature int, near double, value double, n long"
BLOCK = "rows int, y binary, bins binary"


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The numbers of the column x (doubles as bytes), a row each."""
    packed = batch.column("x").to_pylist()
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _cuts(rows: DataFrame, bins: int) -> tuple[int, float, list[np.ndarray]]:
    """How many rows there are, the sum of y, and each feature's quantiles. Values are counted
    by their half precision, of which there are not many; the highest stands for all of one."""
    schema = arrow(VALUES)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = np.vstack([rows_of(batch).T, batch.column("y").to_numpy()])
                for f, values in enumerate(columns):
                    values = np.sort(values)
                    with np.errstate(over="ignore"):
                        near, first, n = np.unique(values.astype(np.float16).astype(float), return_index=True, return_counts=True)
                    yield batch_of(schema, feature=np.full(len(n), f), near=near, value=values[first + n - 1], n=n)

    sums = rows.mapInArrow(counted, VALUES).groupBy("feature", "near").agg(F.max("value").alias("value"), F.sum("n").alias("n"))
    feature, value, n = (c.to_numpy() for c in sums.select("feature", "value", "n").toArrow().columns)
    if not len(n):
        return 0, 0.0, []
    cuts, order = [], np.lexsort((value, feature))
    feature, value, n = feature[order], value[order], n[order]
    total = int(n[feature == 0].sum())
    for f in range(feature[-1]):
        values, reach = value[feature == f], np.cumsum(n[feature == f])
        places = np.floor(np.linspace(0, 1, bins + 1)[1:-1] * (total - 1))
        cuts.append(np.unique(values[np.searchsorted(reach, places, "right")]))
    return total, float((value * n)[feature == feature[-1]].sum()), cuts


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Batches of rows as y and the bin of every value, feature by feature."""
    schema = arrow(BLOCK)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = rows_of(batch), batch.column("y").to_numpy().astype(np.uint8)
                bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.uint8)
                yield batch_of(schema, rows=[len(y)], y=[y.tobytes()], bins=[bins.tobytes()])

    return rows.mapInArrow(packed, BLOCK)


def _histograms(blocks: RDD, model: Trees, edge: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Sums of gradients, of their slopes and of rows by feature, node of the last tree's level
    and bin. A value goes right where its bin is above the node's `edge`."""
    width_now, grown, inner = 2**level, len(model.feature) - 1, model.feature.shape[1]
    depth = (inner + 1).bit_length() - 1

    def down(binned: np.ndarray, tree: int, levels: int) -> np.ndarray:
        node, at = np.zeros(binned.shape[1], np.int64), np.arange(binned.shape[1])
        for _ in range(levels):
            node = 2 * node + 1 + (binned[model.feature[tree, node], at] > edge[tree, node])
        return node

    def summed(rows: Iterable[Row]) -> Iterator[np.ndarray]:
        sums = 0
        for n, labels, packed in rows:
            y, binned = np.frombuffer(labels, np.uint8), np.frombuffer(packed, np.uint8).reshape(-1, n)
            total = np.full(n, model.base)
            for tree in range(grown):
                total += model.leaf[tree][down(binned, tree, depth) - inner]
            p = sigmoid(total)
            slope, curve = np.rint((p - y) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-9) * UNIT)
            at, size = (down(binned, grown, level) - (width_now - 1)) * bins, width_now * bins
            cells = [at + b for b in binned]
            sums = sums + np.array([[np.bincount(c, w, size) for c in cells] for w in (slope, curve, None)]).astype(np.int64)
        if not isinstance(sums, int):
            yield sums.reshape(3, -1, width_now, bins)

    return blocks.mapPartitions(summed).treeReduce(np.add)


def learned(rows: DataFrame, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, smallest: float = 5.0) -> Trees:
    """The trees of `fit` from all rows of a table: y (0 or 1) and x, the numbers as bytes
    (float64, little endian). The same rows give the same trees however they are partitioned."""
    n, positive, cuts = _cuts(rows, bins)
    width, inner, leaves = len(cuts), 2**depth - 1, 2**depth
    mean = (positive + 0.5) / (n + 1)
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(mean / (1 - mean))))
    if positive in (0, n):
        return none
    blocks = _blocks(rows.select("y", "x").repartition(-(-n // TASK_ROWS)), cuts).rdd.persist(StorageLevel.MEMORY_AND_DISK)
    model, edge = none, np.zeros((0, inner), np.int64)
    try:
        for t in range(n_trees):
            model = replace(
                model,
                feature=np.vstack([model.feature, np.zeros((1, inner), np.int64)]),
                threshold=np.vstack([model.threshold, np.full((1, inner), np.inf)]),
                leaf=np.vstack([model.leaf, np.zeros((1, leaves))]),
            )
            edge = np.vstack([edge, np.full((1, inner), bins)])
            for level in range(depth):
                first, width_now = 2**level - 1, 2**level
                g, h, m = _histograms(blocks, model, edge, level, bins).cumsum(3)
                g, h = g / UNIT, h / UNIT
                gain, ends = np.full(width_now, 1e-6), np.zeros((width_now, 2, 2))
                ends[:, 0] = np.stack([g[0, :, -1], h[0, :, -1]], axis=1)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    k = len(cuts[f])
                    (gf, hf, mf), (ga, ha, ma) = (a[f, :, :k] for a in (g, h, m)), (a[f, :, -1:] for a in (g, h, m))
                    gains = gf**2 / (hf + ridge) + (ga - gf) ** 2 / (ha - hf + ridge) - ga**2 / (ha + ridge)
                    gains[(mf < smallest) | (ma - mf < smallest)] = -1
                    best = gains.argmax(1)
                    for j in np.flatnonzero(gains[np.arange(width_now), best] > gain):
                        b = best[j]
                        gain[j] = gains[j, b]
                        model.feature[t, first + j], model.threshold[t, first + j], edge[t, first + j] = f, cuts[f][b], b
                        ends[j] = [[gf[j, b], hf[j, b]], [ga[j, 0] - gf[j, b], ha[j, 0] - hf[j, b]]]
            # behind the last level a leaf for each side of its nodes
            model.leaf[t] = (-rate * ends[..., 0] / (ends[..., 1] + ridge)).ravel()
    finally:
        blocks.unpersist()
    return model
