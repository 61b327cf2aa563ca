import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import documents, odd_rows, prose  # noqa: F401

from tillwise.llm import mixing


def level(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    """Targets by sharing what is cut off again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit >= epochs * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 80))
def test_the_nearest_sum_is_found(groups, goal):
    lengths, counts = [g[0] for g in groups], [g[1] for g in groups]
    taken = mixing.nearest_sum(lengths, counts, goal)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    sums = {sum(a * n for a, n in zip(lengths, some)) for some in itertools.product(*(range(c + 1) for c in counts))}
    limit = goal + min(lengths, default=0)
    best = min(abs(s - goal) for s in sums if s <= limit)
    assert abs(sum(a * n for a, n in zip(lengths, taken)) - goal) == best


@pytest.mark.parametrize("seed", range(5))
def test_large_budgets_are_met(seed):
    draw = np.random.default_rng(seed)
    lengths = np.unique(draw.integers(1, 30_000, 400))
    counts = draw.integers(1, 200, len(lengths))
    goal = float((lengths * counts).sum() * draw.random())
    taken = mixing.fitted(lengths, counts, goal)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs((lengths * taken).sum() - goal) <= 1


@pytest.mark.parametrize("lengths", [range(1000, 4000), range(1, 401), [*range(1, 2000), 300_000, 900_000]])
def test_single_lengths_have_their_share(lengths):
    lengths = np.array(lengths)
    for share in (0.3, 0.5, 0.8):
        goal = round(lengths.sum() * share)
        taken = mixing.fitted(lengths, np.ones(len(lengths), int), goal)
        assert set(taken.tolist()) <= {0, 1} and abs((lengths * taken).sum() - goal) <= 1
        if lengths[-1] < 5000:
            assert (lengths * taken).sum() / taken.sum() == pytest.approx(lengths.mean(), rel=0.06)


def corpus():
    draw = random.Random(6)
    rows = []
    for k in range(600):
        source = draw.choice(["b", "a", "Z", "é", None, "tiny"] if k % 100 else ["tiny"])
        rows.append((k, prose(draw.randint(0, 80), k), "en", source, None))
    return rows


def test_targets_and_choice(documents):
    rows = corpus()
    docs = documents(rows, extra=True)
    got = mixing.mixed(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = level(sizes)
    assert {r.doc_id: r.size for r in got} == {r[0]: len(r[1].split()) for r in rows}
    for source, total in sizes.items():
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == total and r.target == pytest.approx(expected[source]) for r in mine)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in mine)
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
        assert abs(sum(r.taken for r in mine) - expected[source]) <= 1
    assert sorted(got, key=lambda r: r.doc_id) == sorted(mixing.mixed(docs).collect(), key=lambda r: r.doc_id)
    mix = mixing.mixture(docs)
    assert mix.columns == [*(c for c in docs.columns if c != "copies"), "copies"]
    assert {r.doc_id: r.copies for r in mix.collect()} == {r.doc_id: r.copies for r in got if r.copies}


def test_odd_rows(documents, odd_rows):
    rows = [(d, t, None, "ab"[k % 2] if k % 3 else None, None) for k, (d, t) in enumerate(odd_rows)]
    docs = documents(rows, extra=True)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size and 0 <= r.target <= 2 * r.source_size for r in got)
    assert all(r.size == 0 for r in got if r.doc_id in (1, 2, 3))
    assert sum(r.copies for r in got if r.doc_id == 7) <= 4
    assert mixing.mixture(docs).count() <= len(rows)
    none = documents([])
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0
    empty = mixing.mixed(documents([(1, None, None, "a", None), (2, "", None, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_documents_with_one_id_are_told_apart(documents):
    """Equal ids have one draw; still the number of documents wanted is taken."""
    rows = [(None, "one two three", "en", "a")] * 400 + [(7, "four five", "en", "b")] * 200 + [(k, prose(3, k), "en", "c") for k in range(50)]
    got = mixing.mixed(documents(rows)).toPandas()
    for _, of in got.groupby("source"):
        assert abs(of.taken.sum() - of.target.iloc[0]) <= 3 and (of.taken <= 2 * of["size"]).all()
