"""SQL statements of what each query must return, for an independent SQL engine.

Each ``<query>.sql`` is written from the query's meaning over the ``ops_*`` tables
that ``_tables.sql`` derives from the test data.
"""

import re
from pathlib import Path

HERE = Path(__file__).resolve().parent

# The bounds of the test data, which name the columns of the pivoted
# results. A statement cannot be a view with columns that depend on the data;
# tests/test_oracles.py compares them with the data.
YEARS = (1995, 2001)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FIRST_ORDER, LAST_ORDER = (1995, 1), (2001, 8)
FIRST_JOIN, LAST_JOIN = (1995, 1), (2000, 12)


def _months(later: tuple[int, int], earlier: tuple[int, int]) -> int:
    return 12 * (later[0] - earlier[0]) + later[1] - earlier[1]


PERIODS = range(_months(FIRST_ORDER, LAST_JOIN), _months(LAST_ORDER, FIRST_JOIN) + 1)
COLUMNS = {
    "{years}": [str(year) for year in range(YEARS[0], YEARS[1] + 1)],
    "{segments}": SEGMENTS,
    "{periods}": [f"M+{k}" for k in PERIODS],
}


def _uncommented(text: str) -> str:
    """Without the comment lines at its head."""
    return re.sub(r"\A(\s*--.*\n)+", "", text).lstrip()


def load_oracles() -> dict[str, str]:
    tables = (HERE / "_tables.sql").read_text()
    shared = {f"{{{name}}}": _uncommented((HERE / f"_{name}.sql").read_text()).strip() for name in ("alerts", "texts")}
    shared |= {mark: ", ".join(f"'{column}'" for column in columns) for mark, columns in COLUMNS.items()}
    oracles = {}
    for path in sorted(HERE.glob("[!_]*.sql")):
        body = path.read_text()
        for name, text in shared.items():
            body = body.replace(name, text)
        # A query with its own WITH list continues the list of tables.
        body = _uncommented(body)
        if body.upper().startswith("WITH "):
            body = "," + body[len("WITH") :]
        oracles[path.stem] = f"WITH {tables}{body}"
    return oracles
