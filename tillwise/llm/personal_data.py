"""Personal data by boosted trees over candidate spans.

Base spans follow fixed rules and always count: email, ip (parts up to 255), card (12 to 19
digits, Luhn) and phone (9 to 15 digits), leftmost and not overlapping within a kind; a
match that fails its check is dropped and the search goes on behind it.

The method adds spans. Generators of high recall propose candidates that may overlap:
anything like an address around "@" or a spelled-out "at", digit groups with separators (as
card, phone and ip), numbers with bracketed dots (as ip), and assigned or random-looking
strings (as secret). Boosted trees score them from their format (lengths, digit groups,
separators, case, entropy) and context (neighbouring characters and words, names of the
kind); checks such as Luhn are not among the inputs. Of overlapping candidates the best one
stays, and none that overlaps a base span.

They learn from the candidates outside the base spans, the only ones that can be added, of
all documents; a quarter of the texts, by hash, is left out for the thresholds, which count
all candidates of these. Tasks sum up what the trees need (`trees.learned`), so that no
examples pass through the driver. Labels are weak. Positive are: the base spans of a document
written in other forms (`respelled`), a secret assigned to a name that says so, and a
candidate of valid format behind a name of its kind ("tel", "mail"). All others are
negative, as are readings of a respelled span as another kind. A kind's threshold is the
lowest that reaches a precision of 0.95 on documents left out of the fit; a kind that never
does adds nothing. The share of positives is that of the base spans, a form standing for
each of them.

All spans are in code points, end exclusive. Null and empty texts have no spans. Texts are
searched whole in time linear in their length. Repeated rows give the same spans each. On
an empty table, or without candidates, only base spans are found. Only examples, histograms
and counts of scores are shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import trees
from tillwise.llm.respelled import respelled
from tillwise.llm.text import arrow, batch_of, chunks, utf8

Span = tuple[int, int]

# The kinds in the order in which they are listed, and their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PRECISION = 0.95
#: Steps of scores in which thresholds are looked for.
STEPS = 1 << 16
NEAR = 24

ADDRESS = re.compile(r"[^\s<>\"',;()\[\]]{1,64}@[^\s<>\"',;()\[\]]{1,64}")
SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?[\[(]at[\])]\s?[\w-]{1,64}(?:(?:\.|\s?[\[(]dot[\])]\s?)[\w-]{1,24})+", re.IGNORECASE)
NUMBER = re.compile(r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
AT_WORD = re.compile(r"(?<![\w.+-])[\w.+-]{1,64} at [\w-]{1,64}(?: dot [\w-]{1,24})+(?![\w-])", re.IGNORECASE)
BRACKETED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(](?:\.|dot)[\])]\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
ASSIGNED = re.compile(r"(?<!\w)(\w{2,40})\s?[=:]\s?[\"']?([^\s\"'=:]{8,})")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
SECRET_NAME = re.compile(r"token|secret|passw|pwd|api_?key|access_?key|credential", re.IGNORECASE)
# Names of a kind that may stand before a span of it.
NAMES = {
    "email": re.compile(r"mail|contact|write to", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|debit", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel\b|mobile|\bcell\b|\bcall\b|\bfax\b|dial", re.IGNORECASE),
    "secret": SECRET_NAME,
}
DIGITS = re.compile(r"[0-9]+")


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, by start, then kind as listed."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return ordered(found)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether an assignment names it a secret) of all proposals."""
    out: dict[tuple[int, int, str], bool] = {}
    if "@" in text:
        out |= {(*m.span(), "email"): False for m in ADDRESS.finditer(text)}
        out |= {(s, e, "email"): False for s, e in emails(text)}
    low = text.lower()
    if "at)" in low or "at]" in low:
        out |= {(*m.span(), "email"): False for m in SPELLED.finditer(text)}
    if " dot " in low:
        out |= {(*m.span(), "email"): False for m in AT_WORD.finditer(text)}
    if any(mark in low for mark in ("[.", "(.", "[dot", "(dot")):
        out |= {(*m.span(), "ip"): False for m in BRACKETED.finditer(text)}
    for m in NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        if n >= 12:
            start = m.start() + (m[0][0] in "+(")
            out[start, m.end(), "card"] = False
        if 7 <= n <= 16:
            out[(*m.span(), "phone")] = False
        if m[0].count(".") >= 3:
            out[m.start() + (m[0][0] in "+("), m.end(), "ip"] = False
    for m in RANDOM.finditer(text):
        if DIGITS.search(m[0]) and not m[0].isdigit():
            out[(*m.span(), "secret")] = False
    for m in ASSIGNED.finditer(text):
        out[(*m.span(2), "secret")] = bool(SECRET_NAME.search(m[1]))
    return [(*key, named) for key, named in out.items()]


def valid(span: str, kind: str) -> bool:
    """Whether a candidate's format is one that its kind can have."""
    groups = DIGITS.findall(span)
    n = sum(map(len, groups))
    if kind == "card":
        return 12 <= n <= 19 and luhn("".join(groups))
    if kind == "ip":
        return len(groups) == 4 and all(int(g) <= 255 for g in groups)
    if kind == "phone":
        return 9 <= n <= 15 and len(groups) > 1
    return kind == "email" and any(c.isalpha() for c in span)


def labelled(text: str) -> Iterator[tuple[str, bool, list[float]]]:
    """kind, weak label and description of the candidates outside the base spans, and of
    those on the base spans written in other forms."""
    base = base_spans(text)
    covered = Covered((s, e) for s, e, _ in base)
    for start, end, kind, named in candidates(text):
        if not covered.meets(start, end):
            told = valid(text[start:end], kind) and bool(NAMES[kind].search(text[max(0, start - NEAR) : start]))
            yield kind, named or told, described(text, start, end, kind)
    if base:
        text, forms = respelled(text, base)
        again = Covered((s, e) for s, e, _ in base_spans(text))
        wanted, places = set(forms), Covered((s, e) for s, e, _ in forms)
        same = {k: Covered((s, e) for s, e, of in forms if of == k) for k in BASE_KINDS}
        for start, end, kind, _ in candidates(text):
            if places.meets(start, end) and not again.meets(start, end):
                positive = (start, end, kind) in wanted
                # another extent of the same kind is neither right nor wrong
                if positive or kind not in same or not same[kind].meets(start, end):
                    yield kind, positive, described(text, start, end, kind)


SEPARATORS = " -.()/+@:=_[]"


def described(text: str, start: int, end: int, kind: str) -> list[float]:
    """The numbers that the trees see of a candidate."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    size, groups = end - start, [len(g) for g in DIGITS.findall(span)]
    counts = {c: span.count(c) for c in set(span)}
    shares = np.array(list(counts.values())) / size
    last, first = before[-1:], after[:1]
    words = before.split()
    return [
        float(KINDS.index(kind)),
        size,
        sum(groups),
        max(groups, default=0),
        min(groups, default=0),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        sum(c.isalpha() for c in span) / size,
        sum(c.isupper() for c in span) / size,
        float(-(shares * np.log2(shares)).sum()),
        *(counts.get(c, 0) for c in SEPARATORS),
        float(span[0] == "+"),
        float(bool(last) and last.isspace()),
        float(bool(last) and last in "\"'=:"),
        float(bool(last) and (last.isalpha() or last in "_-")),
        float(bool(first) and first.isspace()),
        float(bool(first) and first in "\"'"),
        float(bool(first) and first.isalnum()),
        float("=" in before[-4:]),
        float(":" in before[-3:]),
        *(float(bool(name.search(before))) for name in NAMES.values()),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
        len(words[-1]) if words else 0,
        len(after.split()[0]) if after.split() else 0,
    ]


class Covered:
    """Disjoint spans, with a fast test for overlap."""

    def __init__(self, spans: Iterable[Span] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


@dataclass
class Detector:
    """The trees and each kind's threshold."""

    model: trees.Trees
    thresholds: dict[str, float]

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
        """The base spans and all spans of each text."""
        base, proposed, rows = [base_spans(t) for t in texts], [], []
        covered = [Covered((s, e) for s, e, _ in b) for b in base]
        for k, text in enumerate(texts):
            for start, end, kind, _ in candidates(text):
                if self.thresholds[kind] <= 1 and not covered[k].meets(start, end):
                    proposed.append((k, start, end, kind))
                    rows.append(described(text, start, end, kind))
        added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if rows:
            score = self.model.predict(np.array(rows))
            for k in np.lexsort(([p[1] for p in proposed], -score)):
                doc, start, end, kind = proposed[k]
                if score[k] >= self.thresholds[kind] and not covered[doc].meets(start, end):
                    covered[doc].add(start, end)
                    added[doc].append((start, end, kind))
        return [(b, ordered(b + a)) for b, a in zip(base, added)]


EXAMPLE = "left_out boolean, kind string, y int, x binary"
SCORES = "kind string, step long, n long, y long"


def fit(docs: DataFrame, text: str = "text") -> Detector:
    """A detector learned from all documents."""
    split = F.pmod(F.xxhash64(F.lit(3), text), F.lit(4)) == 0
    found = docs.select(split.alias("left_out"), F.col(text).alias("text")).mapInArrow(_examples(arrow(EXAMPLE)), EXAMPLE)
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = trees.learned(found.where("not left_out"), n_trees=40, rate=0.25)
        scores = found.where("left_out").mapInArrow(_scores(model), SCORES).groupBy("kind", "step")
        scores = scores.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toArrow()
    finally:
        found.unpersist()
    kind = np.array(scores.column("kind").to_pylist(), object)
    step, n, y = (scores.column(c).to_numpy() for c in ("step", "n", "y"))
    return Detector(model, {k: threshold(step[kind == k], n[kind == k], y[kind == k]) for k in KINDS})


def threshold(step: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float = PRECISION, least: int = 10) -> float:
    """The lowest score above which the share of positives is the wanted one, from how many
    candidates (n) and positives (y) have a score of each step; 2 if there is none with
    `least` candidates."""
    order = np.argsort(-step, kind="stable")
    above = np.cumsum(n[order])
    good = np.flatnonzero((np.cumsum(y[order]) >= precision * above) & (above >= least))
    return max(float(step[order][good[-1]]) / STEPS, 0.5) if len(good) else 2.0


def suspects(column: pa.Array) -> list[int]:
    """The rows whose text has a digit, an @, a bracket or the word "dot": all others have no
    candidates but assigned words, which need a colon or an equals sign."""
    data, offsets = utf8(column)
    wanted = np.zeros(256, bool)
    wanted[[*range(48, 58), *b"@[(=:"]] = True
    at = np.flatnonzero(wanted[data])
    spoken = pc.fill_null(pc.match_substring(column, " dot ", ignore_case=True), False)
    spoken = np.flatnonzero(spoken.to_numpy(zero_copy_only=False))
    return np.union1d(np.searchsorted(offsets, at, "right") - 1, spoken).tolist()


def _examples(out: pa.Schema):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            some = batch.take(pa.array(suspects(batch.column("text")), pa.int64())).select(["left_out", "text"])
            for left_out, text in zip(*(c.to_pylist() for c in some.columns)):
                rows += [(left_out, kind, int(label), np.array(x, "<f8").tobytes()) for kind, label, x in labelled(text)]
            yield batch_of(out, **dict(zip(out.names, zip(*rows) if rows else ([], [], [], []))))

    return make


def _scores(model: trees.Trees):
    """How many candidates and positives of each kind have a score of each step."""
    out = arrow(SCORES)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                step = np.floor(model.predict(trees.rows_of(batch)) * STEPS).astype(np.int64)
                kind = np.array([KINDS.index(k) for k in batch.column("kind").to_pylist()])
                keys, at = np.unique(kind * (STEPS + 1) + step, return_inverse=True)
                n, y = np.bincount(at), np.bincount(at, batch.column("y").to_numpy()).astype(np.int64)
                yield batch_of(out, kind=[KINDS[k] for k in keys // (STEPS + 1)], step=keys % (STEPS + 1), n=n, y=y)

    return count


def _found(column: pa.Array, detector: Detector) -> Iterator[tuple[int, list, list]]:
    """(row, base spans, all spans) of the rows that may have some."""
    rows = suspects(column)
    texts = column.take(pa.array(rows, pa.int64())).to_pylist()
    for row, (base, spans) in zip(rows, detector.spans(texts)):
        yield row, base, spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


REPORT = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def reported(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, the SHA-256 of the base
    spans, all spans (both as kind:start:end, comma-joined), and how many are added."""
    schema = REPORT.format(id=docs.schema[doc_id].dataType.simpleString())
    out, shared = arrow(schema), docs.sparkSession.sparkContext.broadcast(detector)

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            counts, digest, spans, added = np.zeros((n, len(BASE_KINDS)), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n, np.zeros(n, np.int64)
            for row, base, every in _found(batch.column("text"), shared.value):
                for _, _, kind in base:
                    counts[row, BASE_KINDS.index(kind)] += 1
                digest[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[row], added[row] = joined(every), len(every) - len(base)
            numbers = {f"n_{kind}": counts[:, k] for k, kind in enumerate(BASE_KINDS)}
            yield batch_of(out, doc_id=batch.column("doc_id"), **numbers, base_sha256=digest, spans=spans, n_added=added)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(report, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind, as <kind>."""
    parts, at, covered = [], 0, -1
    for start, end, kind in spans:
        if start >= covered:
            parts += [text[at:start], f"<{kind}>"]
        covered = at = max(covered, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, detector: Detector, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns, the text without its personal data; a column `n_chars` follows
    the text."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    place, counted = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            new = {row: spans for row, _, spans in _found(batch.column(place), shared.value) if spans}
            if new:
                texts = batch.column(place).to_pylist()
                for row, spans in new.items():
                    texts[row] = redact(texts[row], spans)
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if counted is not None:
                    sizes = columns[counted].to_pylist()
                    for row in new:
                        sizes[row] = len(texts[row])
                    columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)
