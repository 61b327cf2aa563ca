import math

import numpy as np
import pytest
from llm_samples import documents  # noqa: F401

from tillwise.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    def build(rows):
        path = str(tmp_path_factory.mktemp("vectors") / "embeddings.parquet")
        spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return build


def brute(rows, least=0.93):
    x = np.array([v if v is not None else [0.0] * 8 for _, v, _ in rows], np.float32).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    label = np.array([l if l is not None else -k - 1 for k, (_, _, l) in enumerate(rows)])  # noqa: E741
    linked = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = np.array([r[0] for r in rows])
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], 1 << 40).min(1))
        if (low == root).all():
            return {r[0]: (int(n), int(c), r[0] == c) for r, n, c in zip(rows, linked.sum(1), root)}
        root = low


def clusters(n, seed, dimension=8, groups=40, noise=0.25):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(groups, dimension))
    rows = []
    for k in range(n):
        v = centre[draw.integers(groups)] + noise * draw.normal(size=dimension)
        rows.append((k, (v if k % 9 else centre[k % 3]).tolist(), int(k % 2)))
    return rows


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_links_and_components(vectors):
    rows = clusters(900, 1)
    expected = brute(rows)
    assert sum(n for n, _, _ in expected.values()) > 5000
    assert found(embeddings.near_duplicates(vectors(rows))) == expected


def test_many_small_shards_parts_and_blocks(vectors, monkeypatch):
    """Recall is audited; a link that is found is right."""
    monkeypatch.setattr(embeddings, "SHARD", 60)
    rows = clusters(900, 2)
    expected, got = brute(rows), found(embeddings.near_duplicates(vectors(rows)))
    links, true = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in expected.values())
    assert all(got[k][0] <= expected[k][0] for k in got)
    assert links >= 0.95 * true


def test_a_dense_group_larger_than_a_shard(vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 50)
    rows = clusters(400, 3, groups=1, noise=0.02)
    assert found(embeddings.near_duplicates(vectors(rows))) == brute(rows)


def test_the_graph_is_sparse_and_reaches_everything():
    x = np.array([v for _, v, _ in clusters(500, 4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = embeddings.pruned(np.unique(x, axis=0))
    assert edges.sum(1).mean() < 40
    assert embeddings.reach(edges, np.array([0])).all() or embeddings.reach(edges, embeddings.spread(np.unique(x, axis=0), embeddings.MEDOIDS)).all()


def test_odd_rows(vectors):
    one = [1.0, 0.0, 0.5]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, [2.0, 0.0, 1.0], 0), (4, one, 1), (5, one, None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0, 0.0], 0), (9, [math.nan, 1.0, 1.0], 0), (10, [math.inf, 1.0, 1.0], 0), (11, [None, 1.0, 1.0], 0),
        (12, [1.0, 0.0], 0), (None, one, 0), (13, [3e38, 0.0, 1.5e38], 0), (14, [1e-40, 0.0, 5e-41], 0),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors(rows)).collect()), key=lambda r: (r[0] is None, r))
    linked = [(1, 6, 1, True), (2, 6, 1, False), (2, 6, 1, False), (3, 6, 1, False)]
    alone = [(k, 0, k, True) for k in range(4, 13)]
    assert got == [*linked, *alone, (13, 6, 1, False), (14, 6, 1, False), (None, 6, 1, False)]
    assert embeddings.near_duplicates(vectors([])).count() == 0


def test_pairs_split_over_shards(vectors, monkeypatch):
    """The shards nearest to a vector are all far from its only near copy, on both sides."""
    draw, axis = np.random.default_rng(6), np.eye(48)[0]
    rows = []
    for _ in range(300):
        other = draw.normal(size=48) * (axis == 0)
        other /= np.linalg.norm(other)
        rows += [(len(rows) + k, (np.cos(0.17) * other + sign * np.sin(0.17) * axis).tolist(), 0) for k, sign in enumerate((1, -1))]
    centroids = np.repeat([[1.0], [-1.0]], 4, axis=0) * axis + 0.01 * draw.normal(size=(8, 48))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    monkeypatch.setattr(embeddings, "sharded", lambda nodes: embeddings.Shards({(0, 48): centroids}))
    expected = brute(rows)
    assert {n for n, _, _ in expected.values()} == {1}
    assert found(embeddings.near_duplicates(vectors(rows))) == expected


def test_the_audit_counts_vectors_without_a_found_link(vectors):
    rows = [(2 * k + j, [math.cos(k / 9 + j / 90), math.sin(k / 9 + j / 90)], 0) for k in range(20) for j in range(2)]
    nodes = vectors(rows).selectExpr("vec_id AS node", "label", "embedding AS vector", "1L AS copies", "2 AS dimension")
    truth, enough = embeddings.audited(nodes, 0.9999)
    assert enough and truth == {k: 1 for k in range(40)}
    links = nodes.selectExpr("node", "1L AS links")
    assert embeddings.recall(truth, links) == 1 and embeddings.recall(truth, links.where("node < 30")) == 0.75
