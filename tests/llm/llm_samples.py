from __future__ import annotations

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of the input.
CLASHING = ("row", "key", "bucket", "n", "copies", "score", "label", "u", "v", "runs", "place", "size", "node", "component")

VOWELS, OTHERS = "aeiou", "bcdfglmnprstv"


def words(n: int, seed: int, vocabulary: int = 4000) -> list[str]:
    """Pseudo-words; the same seed gives the same words."""
    draw = random.Random(seed)
    known = random.Random(99)
    table = ["".join(known.choice(OTHERS) + known.choice(VOWELS) for _ in range(known.randint(1, 4))) for _ in range(vocabulary)]
    return [draw.choice(table) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """documents([(doc_id, text), ...]) as a table read from files; missing columns are
    null, extra=True adds columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    def build(rows, extra=False, parts=3):
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, DOCUMENT).repartition(parts)
        if extra:
            df = df.withColumns({name: F.lit(7) for name in CLASHING})
        path = str(tmp_path_factory.mktemp("documents") / "documents.parquet")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, short and very long texts, repeated rows, equal texts."""
    return [
        (None, None),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "a b c d"),
        (6, "é ü 漢字 ñ"),
        (7, prose(60, 1)),
        (7, prose(60, 1)),
        (8, prose(60, 1)),
        (None, prose(50, 2)),
        (9, prose(30_000, 3)),
        (10, "x" * 50_000),
        (11, "same " * 500),
    ]
