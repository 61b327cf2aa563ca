"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters and digits; a sentence ends with a line or with . ! or ?.
The field has the states clean (0) and toxic (1). A token's features are hashes of its
lower-case form, its first 3 to 6 and last 3 bytes, the two neighbours' forms, and its
shape; the weights of feature and state pair are added up, as are those of each state pair
in a row.

Learning. Labels belong to documents, so tokens are labelled first: in a toxic document, a
token is labelled toxic if one of its features stands in so many toxic documents and so
few clean ones that chance is ruled out at the 1 % level over all features; all other
tokens are clean. Features that say nothing about the token's label (by a likelihood ratio
test) get no weight. The field is then fitted to the labelled sentences by the likelihood,
with exact forward-backward gradients, and a logistic curve from a document's marginals to
its label. This is done on about SAMPLE labelled documents at most, picked by a hash. Tasks
count their features and find their sentences; the driver fits the field to about SENTENCES
of them, those without toxic tokens weighing as many as they stand for, and longer ones than
LONGEST tokens in pieces.

Scoring. Forward-backward runs over all sentences of a chunk of documents at once, one step
per token position. A document's evidence is its highest marginal and its expected number
of toxic tokens; its score is the curve's value. Neighbouring tokens of marginal 0.5 or more
make one offending span, given in code points. Nothing is shuffled.

Null, empty and wordless texts have no tokens and get the score of a document without
evidence. Texts are tagged whole, whatever their length. Repeated rows are scored alike.
Null labels teach nothing; without toxic labels every score is the same small share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.learning import bounded_sample
from tillwise.llm.quality import labelled
from tillwise.llm.staging import Stages
from tillwise.llm.text import LOWER, Words, arrow, batch_of, chunks, mixed, powers
from tillwise.llm.trees import sigmoid

SAMPLE = 8000
SENTENCES = 24_000
#: Tokens of a sentence that are learned from as one.
LONGEST = 1000
BITS = 20
FEATURES = ("word", "first 3", "first 4", "first 5", "first 6", "last 3", "before", "after")
SALTS = powers(np.uint64(0x9E3779B97F4A7C15), len(FEATURES))
#: Features by which tokens may be labelled: those of the token itself.
OWN = 6
SHAPES = 6

INSIDE = np.zeros(256, bool)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(0x80, 0x100)):
    INSIDE[list(_part)] = True
FULL_STOP = np.zeros(256, bool)
FULL_STOP[list(b".!?\n")] = True


@dataclass
class Tokens:
    """Tokens of some documents, their feature numbers, and the sentences' bounds."""

    words: Words
    features: np.ndarray  # token, feature: an index of the weights
    shapes: np.ndarray  # token
    sentence: np.ndarray  # first token of each sentence, and the number of tokens

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        words = Words.of(column, INSIDE)
        n = len(words.starts)
        form = words.hashes(LOWER)
        parts = [form]
        data = LOWER[words.data]
        prefix, suffix = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sizes = words.ends - words.starts
        for k, factor in enumerate(powers(np.uint64(0x100000001B3), 6)):
            there = np.flatnonzero(sizes > k)
            prefix[there] += (data[words.starts[there] + k].astype(np.uint64) + np.uint64(1)) * factor
            if k < 3:
                suffix[there] += (data[words.ends[there] - 1 - k].astype(np.uint64) + np.uint64(1)) * factor
            if k >= 2:
                parts.append(prefix.copy())
        parts.append(suffix)
        stops = np.concatenate(([0], np.cumsum(FULL_STOP[words.data])))
        new = np.ones(n, bool)
        new[1:] = stops[words.starts[1:]] > stops[words.ends[:-1]]
        new[words.first[:-1][words.counts > 0]] = True
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        inner = np.flatnonzero(~new)
        before[inner], after[inner - 1] = form[inner - 1], form[inner]
        parts += [before, after]
        features = np.empty((n, len(FEATURES)), np.int32)
        for k, (part, salt) in enumerate(zip(parts, SALTS)):
            features[:, k] = mixed(part + salt) >> np.uint64(64 - BITS)
        letters = words.data
        upper = lambda at: (letters[at] >= 65) & (letters[at] <= 90)
        digit = (letters[words.starts] >= 48) & (letters[words.starts] <= 57)
        shapes = np.where(digit, 2, np.where(upper(words.starts), np.where(upper(words.ends - 1) & (sizes > 1), 3, 1), 0))
        shapes = np.where((shapes == 0) & (sizes <= 2), 4, shapes)
        shapes = np.where(sizes > 15, 5, shapes)
        return cls(words, features, shapes, np.append(np.flatnonzero(new), n))


@dataclass
class Field:
    """Weights: of features and shapes for the toxic state (the clean one has 0), of the
    first token's state, of state pairs; and the curve from evidence to score."""

    weights: np.ndarray
    shapes: np.ndarray
    start: np.ndarray
    pairs: np.ndarray
    curve: np.ndarray

    def emissions(self, tokens: Tokens) -> np.ndarray:
        total = self.shapes[tokens.shapes].astype(float)
        for k in range(tokens.features.shape[1]):
            total += self.weights[tokens.features[:, k]]
        return total


def by_length(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and lengths of the sentences, the longest first."""
    starts, sizes = sentence[:-1], np.diff(sentence)
    order = np.argsort(-sizes, kind="stable")
    return starts[order], sizes[order]


def marginals(emission: np.ndarray, sentence: np.ndarray, start: np.ndarray, pairs: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token and, given the tokens' weights, the expected number of each
    state pair in a row and of first states. All sentences advance together; shorter ones
    drop out."""
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    score = np.exp(np.stack([np.zeros(n), np.clip(emission, -30, 30)], axis=1))
    step, first = np.exp(pairs), np.exp(start)
    starts, sizes = by_length(sentence)
    # How many sentences have a token at each position.
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
    for k, m in enumerate(active):
        at = starts[:m] + k
        now = score[at] * (first if k == 0 else alpha[at - 1] @ step)
        alpha[at] = now / now.sum(1, keepdims=True)
    for k in range(len(active) - 2, -1, -1):
        at = starts[: active[k + 1]] + k
        now = (score[at + 1] * beta[at + 1]) @ step.T
        beta[at] = now / now.sum(1, keepdims=True)
    both = alpha * beta
    both /= np.maximum(both.sum(1, keepdims=True), 1e-300)
    if weight is None:
        return both[:, 1], pairs, start
    inner = np.ones(n, bool)
    inner[sentence[:-1]] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * step[None] * (score[at] * beta[at])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return both[:, 1], np.einsum("i,ijk->jk", weight[at], joint), weight[sentence[:-1]] @ both[sentence[:-1]]


def evidence(toxic: np.ndarray, words: Words) -> np.ndarray:
    """Per document: the log odds of its highest marginal, the log of the expected number
    of toxic tokens."""
    n = len(words.counts)
    out = np.tile([-8.0, 0.0], (n, 1))
    some = words.counts > 0
    if some.any():
        starts = words.first[:-1][some]
        highest = np.clip(np.maximum.reduceat(toxic, starts), 3.4e-4, 1 - 3.4e-4)
        out[some, 0] = np.log(highest / (1 - highest))
        out[some, 1] = np.log1p(np.add.reduceat(toxic, starts))
    return out


def curve_of(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the constant comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, slope)
    return w


COUNTS = "place int, n long, bad long"


def _counted(schema: pa.Schema):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in chunks(batches, "text"):
            tokens, y = Tokens.of(batch.column("text")), batch.column("y").to_numpy()
            for k in range(OWN):
                seen = np.unique(tokens.features[:, k].astype(np.int64) * len(y) + tokens.words.owner)
                n += np.bincount(seen // len(y), minlength=1 << BITS)
                bad += np.bincount(seen // len(y), y[seen % len(y)], 1 << BITS).astype(np.int64)
        place = np.flatnonzero(n)
        yield batch_of(schema, place=place, n=n[place], bad=bad[place])

    return count


def sure_features(rows: DataFrame, toxic: int, every: int) -> np.ndarray:
    """Which of the tokens' own features tell a toxic document, from rows(text, y) with
    `toxic` of `every` documents labelled so. Documents are counted in the tasks; the driver
    gets the features of which nine in ten are toxic."""
    counts = rows.mapInArrow(_counted(arrow(COUNTS)), COUNTS).groupBy("place").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    places = max(counts.count(), 1)
    counts = counts.where("bad >= 0.9 * n").toArrow()
    n, bad = (counts.column(c).to_numpy().astype(float) for c in ("n", "bad"))
    share, rate = (toxic + 0.5) / (every + 1), bad / n
    # The chance of so many toxic documents among n, by the Chernoff bound.
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = n * (np.nan_to_num(rate * np.log(rate / share)) + np.nan_to_num((1 - rate) * np.log((1 - rate) / (1 - share))))
    sure = np.zeros(1 << BITS, bool)
    sure[counts.column("place").to_numpy()[apart > np.log(places / 0.01)]] = True
    return sure


def label_tokens(tokens: Tokens, toxic: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Whether each token is labelled toxic."""
    return sure[tokens.features[:, :OWN]].any(1) & toxic[tokens.words.owner].astype(bool)


def telling(features: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float = 25.0) -> np.ndarray:
    """Which feature numbers go along with a token label beyond chance."""
    rate = max((weight * y).sum() / max(weight.sum(), 1), 1e-9)
    out = np.zeros(1 << BITS, bool)
    for k in range(features.shape[1]):
        n = np.bincount(features[:, k], weight, 1 << BITS)
        bad = np.bincount(features[:, k], weight * y, 1 << BITS)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = bad * np.log(bad / (n * rate)), (n - bad) * np.log((n - bad) / (n * (1 - rate)))
        out |= np.nan_to_num(ratio[0], posinf=0, neginf=0) + np.nan_to_num(ratio[1], posinf=0, neginf=0) > least
    return out


def fit_field(tokens: Tokens, labels: np.ndarray, weight: np.ndarray, rounds: int = 50, rate: float = 1.0, ridge: float = 1e-6) -> Field:
    """The field of highest (penalised) likelihood for labelled, weighted sentences, by
    AdaGrad over the telling features."""
    y = labels.astype(int)
    known = np.flatnonzero(telling(tokens.features, y, weight))
    place = np.zeros(1 << BITS, np.int64)  # 0: not telling
    place[known] = np.arange(1, len(known) + 1)
    few = Tokens(tokens.words, place[tokens.features], tokens.shapes, tokens.sentence)
    share = max((weight * y).sum() / weight.sum(), 1e-9)
    field = Field(np.zeros(len(known) + 1), np.full(SHAPES, np.log(share / (1 - share))), np.zeros(2), np.zeros((2, 2)), np.zeros(3))
    inner = np.ones(len(y), bool)
    inner[tokens.sentence[:-1]] = False
    at, heads = np.flatnonzero(inner), tokens.sentence[:-1]
    pairs_seen = np.bincount(y[at - 1] * 2 + y[at], weight[at], 4).reshape(2, 2)
    first_seen = np.bincount(y[heads], weight[heads], 2)
    parts = (field.weights, field.shapes, field.start, field.pairs)
    squares, scale = [np.full_like(w, 1e-10) for w in parts], max((weight * y).sum(), 1)
    for _ in range(rounds):
        toxic, pairs, first = marginals(field.emissions(few), tokens.sentence, field.start, field.pairs, weight)
        off = weight * (toxic - y)
        slope = sum(np.bincount(few.features[:, k], off, len(known) + 1) for k in range(few.features.shape[1]))
        slope[0] = 0
        for w, g, s in zip(parts, (slope, np.bincount(tokens.shapes, off, SHAPES), first - first_seen, pairs - pairs_seen), squares):
            g = g / scale + ridge * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = field.weights[1:]
    field.weights = weights
    return field


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Field:
    """A field learned from the documents for which `learn` holds. Texts stay in the tasks:
    the driver gets counts of features, the tokens' features of SENTENCES sentences, and two
    numbers a document."""
    stages = Stages(docs.sparkSession, "toxicity")
    rows = labelled(docs.where(learn), labels, label, doc_id, text)
    rows = stages.write(rows.transform(bounded_sample, F.col("id"), sample).select("text", "y"), "sample")
    every, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic:
        share = (toxic + 0.5) / (every + 1)
        return Field(np.zeros(1 << BITS), np.zeros(SHAPES), np.zeros(2), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    field = fit_field(*chosen(rows, sure_features(rows, toxic, every)))
    schema = "x0 double, x1 double, y int"
    facts = rows.mapInArrow(_evident(arrow(schema), field), schema).orderBy("x0", "x1", "y").toArrow()
    x0, x1, y = (column.to_numpy().astype(float) for column in facts.columns)
    field.curve = curve_of(np.column_stack([x0, x1]), y)
    stages.drop("sample")
    return field


def _evident(schema: pa.Schema, field: Field):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            tokens = Tokens.of(batch.column("text"))
            toxic = marginals(field.emissions(tokens), tokens.sentence, field.start, field.pairs)[0]
            x = evidence(toxic, tokens.words)
            yield batch_of(schema, x0=x[:, 0], x1=x[:, 1], y=batch.column("y"))

    return find


SENTENCE = "draw double, marked boolean, features binary, shapes binary, labels binary"


def _sentences(schema: pa.Schema, sure: np.ndarray, shares: tuple[float, float] | None):
    """The sentences of some documents, in pieces of LONGEST tokens: those whose draw is
    below the share of the unmarked or marked ones, with their tokens; without shares a
    count of each."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0, 0]
        for batch in chunks(batches, "text"):
            tokens = Tokens.of(batch.column("text"))
            if not len(tokens.shapes):
                continue
            labels = label_tokens(tokens, batch.column("y").to_numpy(), sure)
            long = np.flatnonzero(np.diff(tokens.sentence) > LONGEST)
            cuts = [np.arange(tokens.sentence[k], tokens.sentence[k + 1], LONGEST) for k in long]
            bounds = np.unique(np.concatenate([tokens.sentence, *cuts]))
            marked = np.maximum.reduceat(labels, bounds[:-1])
            total[0] += int((~marked).sum())
            total[1] += int(marked.sum())
            if shares is None:
                continue
            # by what the sentence says: its features, whatever document it is in
            said = np.add.reduceat(mixed(tokens.features[:, 0].astype(np.uint64) + np.uint64(1)), bounds[:-1])
            said += np.add.reduceat(mixed(tokens.features[:, 6].astype(np.uint64) ^ np.uint64(1 << 40)), bounds[:-1])
            draws = mixed(said) / 2.0**64
            picked = np.flatnonzero(draws < np.where(marked, shares[1], shares[0]))
            spans = [(bounds[k], bounds[k + 1]) for k in picked]
            yield batch_of(
                schema,
                draw=draws[picked],
                marked=marked[picked],
                features=[tokens.features[a:b].tobytes() for a, b in spans],
                shapes=[tokens.shapes[a:b].astype(np.uint8).tobytes() for a, b in spans],
                labels=[labels[a:b].astype(np.uint8).tobytes() for a, b in spans],
            )
        if shares is None:
            yield batch_of(schema, marked=[0, 1], n=total)

    return find


def chosen(rows: DataFrame, sure: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """About SENTENCES sentences to learn from, half of them with labelled tokens if there
    are so many; their token labels; and how many tokens each token stands for."""
    counts = "marked int, n long"
    found = rows.mapInArrow(_sentences(arrow(counts), sure, None), counts).groupBy("marked").agg(F.sum("n")).collect()
    total = dict(map(tuple, found))
    n_bad = min(total.get(1, 0), SENTENCES // 2)
    n_good = min(total.get(0, 0), SENTENCES - n_bad)
    shares = n_good / max(total.get(0, 0), 1), n_bad / max(total.get(1, 0), 1)
    shares = tuple(2.0 if share >= 1 else share for share in shares)
    picked = rows.mapInArrow(_sentences(arrow(SENTENCE), sure, shares), SENTENCE).orderBy("draw", "marked", "features", "labels").toArrow()
    joined = [np.frombuffer(b"".join(picked.column(c).to_pylist()), kind) for c, kind in (("features", np.int32), ("shapes", np.uint8), ("labels", np.uint8))]
    features, shapes, labels = joined[0].reshape(-1, len(FEATURES)), joined[1].astype(np.int64), joined[2].astype(bool)
    lengths = pa.compute.binary_length(picked.column("shapes")).to_numpy().astype(np.int64)
    marked = picked.column("marked").to_numpy()
    stands = [total.get(k, 0) / max(int((marked == bool(k)).sum()), 1) for k in (0, 1)]
    none = np.zeros(0, np.int64)
    tokens = Tokens(Words(none, none, none, none, none), features, shapes, np.cumsum(np.concatenate(([0], lengths))))
    return tokens, labels, np.repeat(np.where(marked, stands[1], stands[0]), lengths)


def tagged(column: pa.Array, field: Field) -> tuple[np.ndarray, Tokens, np.ndarray]:
    """Scores of the documents, their tokens, and the tokens' marginals."""
    tokens = Tokens.of(column)
    toxic, _, _ = marginals(field.emissions(tokens), tokens.sentence, field.start, field.pairs)
    facts = evidence(toxic, tokens.words)
    return sigmoid(field.curve[0] + facts @ field.curve[1:]), tokens, toxic


def offending(tokens: Tokens, toxic: np.ndarray, least: float = 0.5) -> list[list[tuple[int, int]]]:
    """Per document, the code points [start, end) of the runs of toxic tokens."""
    words = tokens.words
    hits = np.flatnonzero(toxic >= least)
    heads = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    breaks = set(tokens.sentence.tolist())
    out: list[list[tuple[int, int]]] = [[] for _ in words.counts]
    last = -2
    for hit, doc in zip(hits.tolist(), (np.searchsorted(words.first, hits, "right") - 1).tolist()):
        base = heads[words.offsets[doc]]
        start, end = int(heads[words.starts[hit]] - base), int(heads[words.ends[hit]] - base)
        if hit == last + 1 and hit not in breaks:
            out[doc][-1] = (out[doc][-1][0], end)
        else:
            out[doc].append((start, end))
        last = hit
    return out


def scored(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_toxic (tokens, as an expectation) and spans (start and end in code
    points) of every row."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, n_toxic double, spans array<struct<start:int,end:int>>"
    out, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            scores, tokens, toxic = tagged(batch.column("text"), shared.value)
            found = [[{"start": a, "end": b} for a, b in row] for row in offending(tokens, toxic)]
            total = np.bincount(tokens.words.owner, toxic, len(scores))
            yield batch_of(out, doc_id=batch.column("doc_id"), score=scores, n_toxic=total, spans=found)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)


def accepted(docs: DataFrame, field: Field, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows with a score below the threshold, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            scores, _, _ = tagged(batch.column(text), shared.value)
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
