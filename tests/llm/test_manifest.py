"""The manifest against a tree built in the plain way."""

import hashlib
import zlib

import pytest
from llm_samples import documents, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from tillwise.llm import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climbed(nodes):
    """The root of some nodes, and each one's siblings on both sides, from the bottom."""
    paths = [[] for _ in nodes]
    level = [(node, [i]) for i, node in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for first in range(0, len(level), 8):
            run = level[first : first + 8]
            for k, (_, under) in enumerate(run):
                for i in under:
                    paths[i].append(("".join(n for n, _ in run[:k]), "".join(n for n, _ in run[k + 1 :])))
            above.append((digest("".join(n for n, _ in run)), [i for _, under in run for i in under]))
        level = above
    return level[0][0], paths


def plain(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        ordered = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((ordered, *climbed([leaf(r, r[1]) for r in ordered])))
    root, above = climbed([subroot for _, subroot, _ in trees]) if trees else (None, [])
    out = []
    for (ordered, subroot, paths), tail in zip(trees, above):
        for row, path in zip(ordered, paths):
            doc_id, text = row[:2]
            if None not in (doc_id, text) and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for left, right in path + tail:
                node = digest(left + node + right)
            proof = digest("".join(left + right for left, right in path + tail))
            out.append((doc_id, leaf(row, row[1]), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def proved(docs):
    return sorted(map(tuple, manifest.proved(docs).collect()), key=str)


def full(rows):
    return [(*r, *[None] * (5 - len(r))) for r in rows]


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = proved(docs)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_runs_that_are_full_or_hold_one(documents, n):
    rows = [(i, f"Text {i}", "en") for i in range(n)] + [(1000, "Lone", "de")] * (n % 2)
    assert proved(documents(rows)) == plain(full(rows))


def test_many_languages(documents):
    rows = [(i, f"Text {i}", f"l{i % 70}" if i % 7 else None, "s", i) for i in range(200)] + [(7, "é", "", "", 0), (8, "Z", "-"), (9, "Z", "=")]
    assert proved(documents(rows)) == plain(full(rows))


def test_odd_rows(documents, odd_rows):
    assert proved(documents(odd_rows, extra=True)) == plain(full(odd_rows))
    assert proved(documents([])) == []


def test_equal_rows_of_one_language(documents):
    rows = [(1, "Same", "en")] * 300 + [(2, "Other", "fr")]
    assert proved(documents(rows, parts=8)) == plain(full(rows))


def test_only_what_is_delivered_otherwise_fails(documents):
    docs = documents([(i, f"Text {i}", "en") for i in range(30)])
    got = manifest.proved(docs, tampered=lambda doc_id, text: F.when(doc_id == 4, "else").otherwise(text))
    assert [r.doc_id for r in got.collect() if not r.verified] == [4]
