"""Base spans written in other forms: what a detector of further forms learns from.

A text with an address, number or card that the fixed rules find is written again, with
each of them in a form that the rules don't know. Which form is chosen by a hash of the
span, so that reruns agree.
"""

from __future__ import annotations

import re
import zlib

Found = tuple[int, int, str]

# The marks that stand for "@" and "." in spelled-out addresses, and what
# stands between the parts of a number.
MARKS = [(" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), (" (AT) ", " (DOT) "), ("[at]", ".")]
DOTS = ["[.]", "(.)", "[dot]", " [.] "]
BETWEEN = [".", "/", "  ", "--"]


def respell(span: str, kind: str) -> str | None:
    """Another form of a base span; None where there is none."""
    pick = zlib.crc32(span.encode())
    if kind == "email":
        at, dot = MARKS[pick % len(MARKS)]
        local, domain = span.split("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", DOTS[pick % len(DOTS)])
    digits = re.sub(r"\D", "", span)
    if kind == "card":
        return BETWEEN[pick % len(BETWEEN)].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if len(digits) < 10:
        return span[1:]
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{area} {first} {last}", span[1:]][pick % 5]


def respelled(text: str, base: list[Found]) -> tuple[str, list[Found]]:
    """The text with its base spans in other forms, and where these stand. Spans that
    overlap an earlier one stay as they are."""
    parts, spans, at, size = [], [], 0, 0
    for start, end, kind in base:
        form = respell(text[start:end], kind) if start >= at else None
        if form is None:
            continue
        size += start - at
        parts += [text[at:start], form]
        spans.append((size, size + len(form), kind))
        size, at = size + len(form), end
    return "".join([*parts, text[at:]]), spans
