import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import documents, odd_rows, prose, words  # noqa: F401

from tillwise.llm import recompression as re_
from tillwise.llm.text import Words

N = re_.WINDOW


def brute(rows):
    """(id, words, removed, hash of what is kept) of each row."""
    texts = [(text or "").encode().split() for _, text in rows]
    seen = Counter(tuple(w[k : k + N]) for w in texts for k in range(len(w) - N + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        covered = [False] * len(w)
        for k in range(len(w) - N + 1):
            if seen[tuple(w[k : k + N])] > 1:
                covered[k : k + N] = [True] * N
        kept = [x for x, c in zip(w, covered) if not c]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def repeating(seed, letters):
    """Texts over few words, with runs, periods, copied passages and edits in them."""
    draw, rows = random.Random(seed), []
    passages = [[draw.choice(letters) for _ in range(draw.randint(30, 120))] for _ in range(6)]
    passages += [[draw.choice(letters)] * draw.randint(34, 90), list(letters[:3]) * draw.randint(10, 40), list(letters[:2]) * 18]
    for k in range(40):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += [draw.choice(letters) for _ in range(draw.randint(0, 40))]
            passage = list(draw.choice(passages))
            if draw.random() < 0.4:
                passage[draw.randrange(len(passage))] = "changed"
            text += passage[draw.randint(0, 5) :]
        rows.append((k, (" " if k % 2 else "\n").join(text)))
    return rows


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abc"), (3, "abcdefgh"), (4, [f"w{k}" for k in range(300)])])
def test_exactly_the_repeated_windows_go(documents, seed, letters):
    rows = repeating(seed, letters)
    expected = brute(rows)
    assert sum(n for (_, _, n, _) in expected) > 500
    assert got(re_.deduplicated(documents(rows, extra=True))) == expected


def test_equal_windows_have_equal_keys_at_equal_places():
    rows = [text for _, text in repeating(8, "abcd")] + [prose(300, 1), "x " + prose(300, 1), "a " * 200]
    column = Words.of(pa.array(rows, pa.string()))
    starts = np.concatenate([np.arange(a, b - N + 1) for a, b in zip(column.first[:-1], column.first[1:]) if b - a >= N])
    hashes = column.hashes()
    name, place, level = re_.keys(re_.rounds(hashes, column.first), starts)
    assert (level > 0).any() and ((place >= starts) & (place < starts + N)).all()
    known = {}
    for at, key, where, k in zip(starts.tolist(), name.tolist(), place.tolist(), level.tolist()):
        assert known.setdefault(tuple(hashes[at : at + N].tolist()), (key, where - at, k)) == (key, where - at, k)


def test_prose_ends_in_high_rounds():
    column = Words.of(pa.array([prose(5000, 1)]))
    starts = np.arange(5000 - N + 1)
    _, place, level = re_.keys(re_.rounds(column.hashes(), column.first), starts)
    assert (level == re_.ROUNDS).mean() > 0.8 and len(set(place.tolist())) < 5000 / 5


def test_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (40, prose(60, 1) + " tail"), (41, " ".join(words(34, 8))), (42, " ".join(words(34, 8)))]
    docs = documents(rows, extra=True)
    df = re_.deduplicated(docs)
    assert got(df) == brute(rows)
    texts = {r.doc_id: r.kept_text for r in df.collect()}
    assert texts[40] == "tail" and texts[7] == "" and texts[1] == "" and texts[9] == prose(30_000, 3)
    assert re_.deduplicated(documents([])).count() == 0
