import random
from collections import Counter

from llm_samples import documents, odd_rows, prose, words  # noqa: F401
from tillwise.llm import decontamination

ITEM = "item_id long, text string"


def brute(docs, items, similarity=0.8):
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for doc, text in docs:
        w = (text or "").lower().encode().split()
        for item, passage in items:
            p = (passage or "").lower().encode().split()
            if len(p) < 5 or len(w) < 5:
                continue
            size, bag = min(len(p), len(w)), grams(p)
            for at in range(len(w) - size + 1):
                window = grams(w[at : at + size])
                shared = (window & bag).total()
                close = shared / (window.total() + bag.total() - shared)
                if close >= similarity and close > out.get((doc, item), (0,))[0]:
                    out[doc, item] = (close, at, size)
    return out


def planted():
    draw = random.Random(4)
    items = [(i, prose(draw.randint(5, 60), 100 + i)) for i in range(30)] + [(90, "four words are few"), (91, None), (92, "")]
    docs = []
    for k in range(60):
        passage = items[k % 30][1].split()
        for _ in range(k // 12):  # 0 to 4 changed words
            passage[draw.randrange(len(passage))] = "changed"
        around = words(40, 500 + k)
        docs.append((k, " ".join(around[:20] + passage + around[20:])))
    docs += [(60, items[0][1].upper()), (61, " ".join(items[1][1].split()[1:])), (62, items[2][1] + " " + items[2][1])]
    return docs, items


def found(df):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in df.collect()}


def test_every_window_that_resembles_an_item_is_found(spark, documents):
    docs, items = planted()
    expected = {k: (round(c, 9), at, n) for k, (c, at, n) in brute(docs, items).items()}
    assert 15 < len(expected) < 63
    assert found(decontamination.contaminated(documents(docs), spark.createDataFrame(items, ITEM))) == expected


def test_slices_of_the_benchmark(spark, documents, monkeypatch):
    docs, items = planted()
    table = spark.createDataFrame(items, ITEM)
    whole = found(decontamination.contaminated(documents(docs), table))
    monkeypatch.setattr(decontamination, "SLICE_ROWS", 16)
    assert len(list(decontamination.slices(table, "item_id", "text"))) > 2
    assert found(decontamination.contaminated(documents(docs), table)) == whole
    clean = decontamination.clean(documents(docs), table).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in whole}


def test_odd_rows(spark, documents, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[7][1]), (2, None), (None, prose(50, 2))], ITEM)
    docs = documents(odd_rows, extra=True)
    got = sorted((r.doc_id is None, r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(False, 7, 1), (False, 7, 1), (False, 8, 1), (True, None, None)]
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(odd_rows) - 4
    none = spark.createDataFrame([], ITEM)
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.clean(docs, none).count() == len(odd_rows)
    assert decontamination.contaminated(documents([]), items).count() == 0
