"""Secrets by automata inferred from labelled credentials.

Base spans follow fixed rules and always count, leftmost and not overlapping within a kind,
a match that fails its check being dropped: assign (a name such as password or api_key, `:`
or `=`, and a value of 12 characters or more), access (AKIA and capitals or digits, 18 or
more in all) and hex (16 or more of 0-9a-f).

The method adds spans. The credentials of the base spans (of an assignment the value) are
the labelled ones. Their formats are strings over character classes: digits, a-f and g-z in
either case, and each sign; a token in capitals has the format of its lowercase form. From the formats of each kind a probabilistic automaton is
inferred by merging compatible states (`automata`), and so are two
of other tokens, with and without digits. Every run of LEAST or more of the signs that
credentials consist of, less sentence marks at its ends, is a candidate; its score is the
log-likelihood of its format in the best kind less that in the better automaton of other
tokens, by character. A candidate that overlaps no base span is added, as its best kind,
where it scores above what PASSED of the kind's held-out credentials reach and above all but
SPILL of the held-out other tokens. A kind without credentials adds nothing; neither does
any where there are no other tokens to compare with.

Formats are counted over all documents. An automaton learns from all of its kind's formats,
three quarters of them by their hash for the fit and the rest for the thresholds; formats
over LONGEST characters are scored, but not learned from.

All spans are in code points, end exclusive. Null and empty texts have none. Texts are
searched whole in time linear in their length. Repeated rows give the same spans each, and
equal formats the same score. Spans of one start follow in the order of the kinds, then by
end. Columns other than doc_id and text are not looked at. On an empty table there are no
rows. Only counts, of formats, of their parts and of scores, are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.automata import Automaton, learned
from tillwise.llm.text import arrow, batch_of, chunks

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: A candidate has so many characters at least.
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
BEFORE, BEHIND = "+/_.=-", "/_.-"

#: Characters of a format that an automaton learns from.
LONGEST = 256
PASSED, SPILL = 0.95, 0.001
#: Steps of a score of 1 in which thresholds are looked for.
STEPS = 1 << 12

OTHERS = ("word", "number")
SIGNS = "+/_.=-"
CLASSES = 5 + len(SIGNS)
FORMAT = bytes.maketrans(
    bytes(range(ord("0"), ord("9") + 1)) + b"abcdef" + b"ghijklmnopqrstuvwxyz" + b"ABCDEF" + b"GHIJKLMNOPQRSTUVWXYZ" + SIGNS.encode(),
    bytes([0] * 10 + [1] * 6 + [2] * 20 + [3] * 6 + [4] * 20 + list(range(5, CLASSES))),
)

Span = tuple[int, int, int]


def shape(token: str) -> bytes:
    """The format of a token of candidate characters: the class of each. Tokens whose letters
    are all capitals have the format of the lowercase ones."""
    return (token.lower() if token.isupper() else token).encode("ascii").translate(FORMAT)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, str]]]:
    """The base spans (start, kind, end) in listed order, and each one's credential."""
    spans, values = [], []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append((0, m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                spans.append((m.start(), 1, m.end()))
                values.append((1, m[0]))
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append((2, m[0]))
    return sorted(spans), values


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int, str]]:
    """The candidates that overlap no base span."""
    taken = sorted((start, end) for start, _, end in taken)
    k = reached = 0
    for m in CANDIDATE.finditer(text):
        token = m[0]
        left = len(token) - len(token.lstrip(BEFORE))
        token = token[left:].rstrip(BEHIND)
        start = m.start() + left
        end = start + len(token)
        if len(token) < LEAST:
            continue
        while k < len(taken) and taken[k][0] < end:
            reached = max(reached, taken[k][1])
            k += 1
        if reached <= start:
            yield start, end, token


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in chunks(batches, "text"):
        yield batch, [text or "" for text in batch.column("text").to_pylist()]


FORMATS = "kind string, shape binary, n long"


def formats(docs: DataFrame) -> DataFrame:
    """How often each format stands in the texts: of credentials by their kind, of the other
    candidates as word or number. Counts combine in the tasks before they are shuffled."""
    schema = arrow(FORMATS)

    def counted(batches):
        for _, texts in _texts(batches):
            seen: Counter[tuple[str, bytes]] = Counter()
            for text in texts:
                spans, values = base_spans(text)
                seen.update((KINDS[kind], shape(value)) for kind, value in values if len(value) <= LONGEST)
                for _, _, token in candidates(text, spans):
                    if len(token) <= LONGEST:
                        form = shape(token)
                        seen[OTHERS[0 in form], form] += 1
            keys = list(seen)
            yield batch_of(schema, kind=[k for k, _ in keys], shape=[s for _, s in keys], n=[seen[k] for k in keys])

    return docs.select("text").mapInArrow(counted, FORMATS).groupBy("kind", "shape").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    automata: dict[str, Automaton]
    thresholds: dict[str, float]

    def score(self, form: bytes) -> tuple[float, str]:
        """The best kind's log-likelihood less that of the other tokens, by character."""
        others = max(self.automata[kind].likelihood(form) for kind in OTHERS if kind in self.automata)
        score, kind = max((a.likelihood(form), kind) for kind, a in self.automata.items() if kind not in OTHERS)
        return (score - others) / (len(form) + 1), kind

    def usable(self) -> bool:
        return bool(self.thresholds) and any(kind in self.automata for kind in OTHERS)


def sampled(counts: DataFrame, most: int) -> list[tuple[str, bytes, int, int]]:
    """A look at the formats, which no fit uses: at most about `most` of each kind, whole, by
    the hash of the format: kind, format, count, and a number from 0 to 3."""
    seen = {kind: n for kind, n in counts.groupBy("kind").count().collect()}
    draw = F.xxhash64(F.lit(11), "shape").cast("double") / float(1 << 63)
    share = F.create_map(*(F.lit(x) for kind in (*KINDS, *OTHERS) for x in (kind, 2.0 * most / max(most, seen.get(kind, 0)) - 1.0)))
    picked = counts.where(draw <= share[F.col("kind")]).orderBy("kind", "shape")
    split = F.pmod(F.xxhash64(F.lit(12), "shape"), F.lit(4))
    return [(kind, bytes(form), n, part) for kind, form, n, part in picked.select("kind", "shape", "n", split).collect()]


def _reached(scores: list[tuple[int, int]], share: float) -> int:
    """The highest step that `share` of the counted scores are not below."""
    total, passed = sum(n for _, n in scores), 0
    for step, n in sorted(scores, reverse=True):
        passed += n
        if passed >= share * total:
            return step
    raise ValueError("no scores")


SCORES = "kind string, step long, n long"


def _scores(held: DataFrame, model: Model) -> dict[str, list[tuple[int, int]]]:
    """How often formats of each kind, or of other tokens, have a score of each step."""
    schema = arrow(SCORES)

    def count(batches):
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for kind, form, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "shape", "n"))):
                seen["other" if kind in OTHERS else kind, math.floor(model.score(form)[0] * STEPS)] += n
            keys = list(seen)
            yield batch_of(schema, kind=[k for k, _ in keys], step=[s for _, s in keys], n=[seen[k] for k in keys])

    out: dict[str, list[tuple[int, int]]] = {}
    for kind, step, n in held.mapInArrow(count, SCORES).groupBy("kind", "step").agg(F.sum("n")).collect():
        out.setdefault(kind, []).append((step, n))
    return out


def fit(docs: DataFrame) -> Model:
    """Automata and thresholds learned from the formats of all documents."""
    counts = formats(docs).persist()
    try:
        split = F.pmod(F.xxhash64(F.lit(12), "shape"), F.lit(4))
        model = Model(learned(counts.where(split != 0), [*KINDS, *OTHERS], CLASSES), {})
        if not any(kind in model.automata for kind in OTHERS) or not any(kind in model.automata for kind in KINDS):
            return model
        held = _scores(counts.where(split == 0), model)
    finally:
        counts.unpersist()
    # above all but a share of the other tokens, and above even for a candidate at all
    spilled = (_reached(held["other"], SPILL) + 1) / STEPS if "other" in held else 0.0
    for kind in KINDS:
        if kind in held and kind in model.automata:
            model.thresholds[kind] = max(math.ulp(0.0), spilled, _reached(held[kind], PASSED) / STEPS)
    return model


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, best_score double"


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: base spans by kind, their digest, all spans, how many the method
    added, and the highest score of a candidate outside the base spans (null without one)."""
    schema = arrow(RESULT)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = sent.value
        usable, known = model.usable(), {}
        for batch, texts in _texts(batches):
            out = {name: [] for name in schema.names}
            for text in texts:
                spans, _ = base_spans(text)
                added, best = [], None
                for start, end, token in candidates(text, spans) if usable else ():
                    form = shape(token)
                    if form not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[form] = model.score(form)
                    score, kind = known[form]
                    best = score if best is None else max(best, score)
                    if score >= model.thresholds.get(kind, float("inf")):
                        added.append((start, KINDS.index(kind), end))
                n = Counter(kind for _, kind, _ in spans)
                values = (n[0], n[1], n[2], hashlib.sha256(listed(spans).encode()).hexdigest(), listed(sorted(spans + added)), len(added), best)
                for name, value in zip(schema.names[1:], values):
                    out[name].append(value)
            yield batch_of(schema, **out | {"doc_id": batch.column("doc_id")})

    return docs.select("doc_id", "text").mapInArrow(scan, RESULT)
