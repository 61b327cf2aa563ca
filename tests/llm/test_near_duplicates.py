import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import documents, odd_rows, prose, words  # noqa: F401
from pyspark.sql import functions as F

from tillwise.llm import near_duplicates as near
from tillwise.llm.staging import Stages


def brute(rows, similarity=0.8, floor=0.01):
    """The smallest id of each row's class, by comparing all pairs."""
    bags = []
    for _, text in rows:
        w = (text or "").encode().split()
        k = min(5, len(w))
        bags.append(Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter())
    df = Counter(s for b in bags for s in b)
    weight = {s: math.log1p(len(rows) / max(d, floor * len(rows))) for s, d in df.items()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = [sum(n * weight[s] for s, n in b.items()) for b in bags]
    for a in range(len(rows)):
        for b in range(a):
            shared = sum(n * weight[s] for s, n in (bags[a] & bags[b]).items())
            if shared and shared / (total[a] + total[b] - shared) >= similarity:
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), math.inf), math.inf if doc is None else doc)
    return [None if math.isinf(least[find(k)]) else least[find(k)] for k in range(len(rows))]


def families():
    """Exact copies, near copies, chains of small changes, and documents that only share a
    passage."""
    draw, rows = random.Random(2), []
    passage = words(25, 77)
    for k in range(40):
        base = words(draw.randint(30, 200), 1000 + k)
        for copy in range(k % 5):
            text = list(base)
            for _ in range(copy * len(base) // 120):
                text[draw.randrange(len(text))] = f"new{draw.randrange(1000)}"
            rows.append(" ".join(text))
        rows += [" ".join(base)] * (k % 3)
        rows.append(" ".join(base[:5] + passage + words(30, 3000 + k)))
    chain = words(150, 5)
    for k in range(25):
        chain[6 * k : 6 * k + 2] = [f"c{k}", f"d{k}"]
        rows.append(" ".join(chain))
    draw.shuffle(rows)
    return list(enumerate(rows, 100))


def test_classes_are_those_of_all_pairs(documents):
    rows = families()
    got = {r.doc_id: r for r in near.near_duplicates(documents(rows)).collect()}
    expected = brute(rows)
    assert [got[d].class_id for d, _ in rows] == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert sorted(r.doc_id for r in near.deduplicated(documents(rows, extra=True)).collect()) == sorted(set(expected))


def test_a_crowded_bucket_loses_no_link(documents, monkeypatch):
    """Bands of one row: buckets hold documents that are not alike, in several blocks."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rows = families()
    got = {r.doc_id: r.class_id for r in near.near_duplicates(documents(rows), bands=40, rows=1).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


def open_bucket(spark, n, strays, bucket=1):
    """A bucket with n members of which all but some strays are of one component."""
    key = F.encode(F.concat(F.lit(f"{bucket}:"), F.col("id").cast("string")), "utf-8")
    one = F.encode(F.lit("one"), "utf-8")
    return spark.range(n).select(
        F.lit(bucket).cast("long").alias("bucket"), F.lit(n).cast("long").alias("n"), key.alias("key"), F.when(F.col("id") < strays, key).otherwise(one).alias("component")
    )


def test_blocks_grow_with_the_members(spark):
    """Copies with one percent of strays: a row for each member, and the strays once for each
    block of the others, in groups of bounded size."""
    rows = {}
    for n in (1000, 2000, 4000, 16_000):
        out = near.dealt(open_bucket(spark, n, n // 100))
        rows[n] = out.count()
        assert out.groupBy("bucket", "i", "j").count().agg(F.max("count")).first()[0] < 3 * near.BLOCK
    assert all(rows[n] < 1.2 * n for n in (1000, 2000, 4000))
    assert rows[16_000] < 16_000 + 2 * 16_000 * 160 / near.BLOCK


@pytest.mark.parametrize("n,strays", [(30, 30), (30, 1), (5, 2), (4, 4), (21, 9)])
def test_members_of_different_components_meet(spark, monkeypatch, n, strays):
    monkeypatch.setattr(near, "BLOCK", 4)
    groups = {}
    for r in near.dealt(open_bucket(spark, n, strays)).collect():
        groups.setdefault((r.i, r.j), []).append((bytes(r.key), bytes(r.component)))
    met = {frozenset((a, b)) for g in groups.values() for a, x in g for b, y in g if x != y}
    members = [(f"1:{k}".encode(), f"1:{k}".encode() if k < strays else b"one") for k in range(n)]
    assert met == {frozenset((a, b)) for a, x in members for b, y in members if x != y}
    apart = [g for (i, _), g in groups.items() if i < 0]
    assert n <= 4 or strays == n or apart


def test_samples_agree_as_often_as_the_weights_do():
    draw = np.random.default_rng(3)
    shingles = np.sort(draw.integers(0, 1 << near.BITS, 400, dtype=np.uint64))
    a, b = draw.choice([0.5, 1, 2.0], 400), draw.choice([0.5, 1, 2.0], 400)
    in_a, in_b = np.arange(400) < 320, np.arange(400) >= 60
    expected = np.minimum(a * in_a, b * in_b).sum() / np.maximum(a * in_a, b * in_b).sum()
    tables = near.quantiles()
    one, two = (near.sampled(np.zeros(m.sum(), np.int64), shingles[m], w[m], tables, 4000, 1)[0] for m, w in ((in_a, a), (in_b, b)))
    assert abs((one == two).mean() - expected) < 0.03


def test_frequencies_are_exact_above_the_floor(spark, documents):
    common, rows = "once upon a time there was", []
    for k in range(300):
        rows.append((k, f"{common} {prose(40, k)}" if k % 3 == 0 else f"{prose(50, k)} {'you may read this line' if k % 30 == 1 else ''}"))
    weights = near.frequencies(documents(rows).select("text"), Stages(spark, "test"))
    df = Counter()
    for _, text in rows:
        w = text.split()
        df.update({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    expected = sorted(round(math.log1p(300 / n), 9) for n in df.values() if n > 3)
    assert sorted(np.round(weights.values, 9).tolist()) == expected and len(expected) > 2
    assert weights.rare == pytest.approx(math.log1p(100))


def test_weighted_jaccard_of_texts():
    none = near.Weights(np.zeros(0, np.uint64), np.zeros(0), 2.0)
    a, b = pa.array(["a b c d e f", None, "a b", "x"]), pa.array(["a b c d e g", "a", "a b", None])
    assert near.weighted_jaccard(a, b, none).tolist() == pytest.approx([1 / 3, 0, 1, 0])


def test_all_of_a_block_at_once():
    texts = ["a b c d e f a b c d e f", "a b c d e f", None, "x y", "x y", "a b c d e g a b c d e f"]
    none = near.Weights(np.zeros(0, np.uint64), np.zeros(0), 1.5)
    close = near.all_jaccard(pa.chunked_array([texts]), none, columns=3)
    for k, one in enumerate(texts):
        expected = near.weighted_jaccard(pa.array([one] * len(texts), pa.string()), pa.array(texts), none)
        others = np.arange(len(texts)) != k
        assert close[k][others].tolist() == pytest.approx(expected[others].tolist())


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows)
    classes = Counter((r.doc_id, r.class_id, r.kept) for r in got)
    assert classes[7, 7, True] == 2 and classes[8, 7, False] == 1 and classes[None, None, True] == 2
    assert all(classes[d, d, True] == 1 for d in (1, 2, 3, 4, 5, 6, 9, 10, 11))
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, None, *range(1, 8), 9, 10, 11])
    none = documents([])
    assert near.near_duplicates(none).count() == 0 and near.deduplicated(none).count() == 0
