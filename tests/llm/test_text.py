import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm.text import Words, chunks, shingled

TEXT = st.text(alphabet=" \t\n\x0b\x0cabABé漢 \x1f", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6), st.integers(0, 2))
def test_words_are_those_of_each_text(texts, cut):
    column = pa.array(texts, pa.string()).slice(min(cut, len(texts)))
    texts = texts[min(cut, len(texts)) :]
    words = Words.of(column)
    expected = [(t or "").encode().split() for t in texts]
    got = [words.words(a, b) for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == expected
    hashes = words.hashes()
    flat = [w for t in expected for w in t]
    assert len(hashes) == len(flat)
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all(hashes[i] == hashes[flat.index(w)] for i, w in enumerate(flat))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=6))
def test_shingles(texts):
    words = Words.of(pa.array([" ".join(t) for t in texts], pa.string()))
    shingles, owner = shingled(words, words.hashes(), 3)
    expected = [(d, tuple(t[k : k + 3])) for d, t in enumerate(texts) for k in range(max(len(t) - 2, min(len(t), 1)))]
    assert owner.tolist() == [d for d, _ in expected]
    names = {}
    for value, (_, gram) in zip(shingles.tolist(), expected):
        assert names.setdefault(gram, value) == value
    assert len(set(names.values())) == len(names)


def test_chunks_keep_rows_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 3_000_000, None, "y"] + ["z"] * 2000})
    parts = list(chunks([batch], "text"))
    assert sum(p.num_rows for p in parts) == batch.num_rows and parts[0].num_rows == 1
    assert np.concatenate([p.column("text").to_numpy(zero_copy_only=False) for p in parts]).tolist() == batch.column("text").to_pylist()
