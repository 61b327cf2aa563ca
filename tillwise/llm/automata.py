"""Probabilistic automata inferred from strings by merging compatible states.

An automaton grows from its first state. In each round all strings run through it as far as
it is known; counted are the next DEPTH symbols (or the end) at every state they pass and
behind every edge that leads nowhere yet. These edges are taken in order of their states: one
whose frequencies of ends and of next symbols, and those of all states up to DEPTH symbols
behind it, are within the Hoeffding bound of an accepted state's leads to that, its counts
being added; otherwise it leads to a new state. What remains is a deterministic automaton
with the frequencies as probabilities, so that what all strings have in common (a prefix, an
alphabet, a length) stays and what varies becomes a loop.

`learned` counts in Spark over all strings of a table, `inferred` those of a list; only
counts by state and next symbols reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.text import arrow, batch_of

#: How sure the test for a difference has to be, as the chance of one by accident.
ALPHA = 0.01
#: Counts given to each symbol and to the end in every state, for what was never seen.
UNSEEN = 0.05
#: Symbols behind a state that are compared.
DEPTH = 4


class _State:
    """How often strings end here, and each next symbol's state and count."""

    __slots__ = ("ended", "next")

    def __init__(self) -> None:
        self.ended: int = 0
        self.next: dict[int, list] = {}

    def total(self) -> int:
        return self.ended + sum(n for _, n in self.next.values())


@dataclass
class Automaton:
    """follow[s, c] is the state behind symbol c in state s, cost[s, c] its log-likelihood;
    the last column is that of an end. The last state is for strings unlike all others."""

    follow: np.ndarray
    cost: np.ndarray

    def likelihood(self, symbols: bytes) -> float:
        """The log-likelihood of a string of symbol numbers."""
        if not hasattr(self, "lists"):
            self.lists = self.follow.tolist(), self.cost.tolist()
        follow, cost = self.lists
        state, total = 0, 0.0
        for c in symbols:
            total += cost[state][c]
            state = follow[state][c]
        return total + cost[state][-1]


def _add(state: _State, symbols: Iterable[int], end: int, n: int) -> None:
    """Adds n strings that go on by the symbols, up to an end if there is one."""
    for c in symbols:
        if c == end:
            state.ended += n
            return
        edge = state.next.setdefault(c, [None, 0])
        if edge[0] is None:
            edge[0] = _State()
        edge[1] += n
        state = edge[0]


def _compatible(a: _State, b: _State, bound: float) -> bool:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        n, m = a.total(), b.total()
        if not n or not m:  # as far as is known
            continue
        allowed = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(a.ended / n - b.ended / m) > allowed:
            return False
        for c in a.next.keys() | b.next.keys():
            x, f = a.next.get(c, (None, 0))
            y, g = b.next.get(c, (None, 0))
            if abs(f / n - g / m) > allowed:
                return False
            if x and y and x is not y:
                todo.append((x, y))
    return True


def _merge(into: _State, tree: _State) -> None:
    """Adds the counts of a part of the tree, which no other state leads into."""
    todo = [(into, tree)]
    while todo:
        into, tree = todo.pop()
        into.ended += tree.ended
        for c, (child, n) in tree.next.items():
            if c in into.next:
                into.next[c][1] += n
                todo.append((into.next[c][0], child))
            else:
                into.next[c] = [child, n]


def _tails(strings: list[bytes], n: np.ndarray, state: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings run from their first states: how often which symbols are next, as keys of
    a place (a state, or behind all states an edge that leads nowhere) and DEPTH symbols."""
    states, symbols = follow.shape
    base, sizes = symbols + 2, np.array([len(s) for s in strings])
    width = int(sizes.max()) + 1
    text = np.full((len(strings), width + DEPTH), symbols + 1, np.int64)
    text[np.arange(width + DEPTH) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    text[np.arange(len(strings)), sizes] = symbols
    next_ones = np.zeros((len(strings), width), np.int64)
    for k in range(DEPTH):
        next_ones = next_ones * base + text[:, k : k + width]
    row, keys, counts = np.arange(len(strings)), [], []
    for at in range(width):
        keys.append(state * base**DEPTH + next_ones[row, at])
        counts.append(n[row])
        going = text[row, at] < symbols
        row, state = row[going], state[going]
        if not len(row):
            break
        c = text[row, at]
        then = follow[state, c]
        lost = then < 0
        keys.append((states + state[lost] * symbols + c[lost]) * base**DEPTH + next_ones[row[lost], at + 1])
        counts.append(n[row[lost]])
        row, state = row[~lost], then[~lost]
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _grown(roots: int, symbols: int, counted: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], alpha: float) -> list[Automaton | None]:
    """The automaton of each root, from a function that counts the tails of all strings; None
    for a root without strings."""
    bound, base = math.sqrt(0.5 * math.log(2 / alpha)), symbols + 2
    powers = base ** np.arange(DEPTH)[::-1]
    follow, root = np.full((roots, symbols), -1, np.int64), list(range(roots))
    while True:
        states, places = len(follow), defaultdict(_State)
        keys, counts = counted(follow)
        tails = keys[:, None] // powers % base
        for place, tail, n in zip((keys // base**DEPTH).tolist(), tails.tolist(), counts.tolist()):
            _add(places[place], tail, symbols, n)
        known = [places[k] for k in range(states)]
        open_edges = sorted(place for place in places if place >= states)
        if not open_edges:
            break
        for place in open_edges:
            state, c = divmod(place - states, symbols)
            reached = places[place]
            like = next((k for k, other in enumerate(known) if root[k] == root[state] and _compatible(other, reached, bound)), None)
            if like is None:
                like = len(known)
                known.append(reached)
                root.append(root[state])
                follow = np.vstack([follow, np.full((1, symbols), -1)])
            else:
                _merge(known[like], reached)
            follow[state, c] = like
    return [_automaton([k for k, r in enumerate(root) if r == own], known, follow) if known[own].total() else None for own in range(roots)]


def _automaton(mine: list[int], known: list[_State], follow: np.ndarray) -> Automaton:
    lost, symbols = len(mine), follow.shape[1]
    place = {k: i for i, k in enumerate(mine)}
    out, seen = np.full((lost + 1, symbols + 1), lost, np.int32), np.zeros((lost + 1, symbols + 1))
    for i, k in enumerate(mine):
        seen[i, -1] = known[k].ended
        for c, (_, n) in known[k].next.items():
            out[i, c], seen[i, c] = place[int(follow[k, c])], n
    seen += UNSEEN
    return Automaton(out, np.log(seen / seen.sum(1, keepdims=True)))


def inferred(counted: Iterable[tuple[bytes, int]], symbols: int, alpha: float = ALPHA) -> Automaton:
    """The automaton of (string of symbol numbers, how often), whatever their order."""
    strings, n = zip(*counted)
    [found] = _grown(1, symbols, lambda follow: _tails(list(strings), np.array(n), np.zeros(len(n), np.int64), follow), alpha)
    return found


TAILS = "key long, n long"


def learned(strings: DataFrame, kinds: list[str], symbols: int, alpha: float = ALPHA) -> dict[str, Automaton]:
    """The automaton of each kind that has strings, from a table of kind, shape (a string of
    symbol numbers) and n (how often). It is read once a round."""
    schema = arrow(TAILS)

    def counted(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    kind, shapes = (batch.column(c).to_pylist() for c in ("kind", "shape"))
                    keys, n = _tails(shapes, batch.column("n").to_numpy(), np.array([kinds.index(k) for k in kind]), follow)
                    yield batch_of(schema, key=keys, n=n)

        sums = strings.select("kind", "shape", "n").mapInArrow(count, TAILS).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        return sums.column("key").to_numpy(), sums.column("n").to_numpy()

    return {kind: found for kind, found in zip(kinds, _grown(len(kinds), symbols, counted, alpha)) if found}
