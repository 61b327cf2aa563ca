"""Options, ad-hoc rows, key rules and schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.operators.selection import Period
from tillwise.sources.schemas import TABLES
from tillwise.sources.store import OpsStore

# The kinds of expression that a condition may consist of, by Spark's names.
ALLOWED = frozenset(
    """Alias AttributeReference Literal
    And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual Between In InSet IsNull IsNotNull
    Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Round BRound Floor Ceil CeilExpressionBuilder
    With CommonExpressionDef CommonExpressionRef CaseWhen If Coalesce Nvl NullIf Greatest Least Cast TryCast
    Like RLike Contains StartsWith EndsWith StringInstr StringLocate Lower Upper Length Substring Left Right Concat ConcatWs
    StringTrim StringTrimLeft StringTrimRight StringReplace RegExpReplace RegExpExtract
    Year Quarter Month WeekOfYear WeekDay DayOfWeek DayOfMonth DayOfYear LastDay DateAdd DateSub DateDiff AddMonths MonthsBetween
    TruncDate DateFormatClass CurrentDate ParseToDate GetTimestamp MakeDate""".split()
)


class ExplorerError(ValueError):
    """A condition that is not valid on the table."""


def explore(
    store: OpsStore,
    table: str,
    condition: str = "",
    limit: int = 500,
    columns: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Rows of one of the five tables that meet a condition written as SQL text.

    Without ``order_by`` any ``limit`` rows may come. A condition consists of ALLOWED kinds
    of expression. A value that it cannot convert or divide by gives null, so the row does
    not meet it: what is wrong with a condition shows here, not when the rows are read.
    """
    if table not in TABLES:
        raise ExplorerError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
    if limit < 1:
        raise ExplorerError(f"limit {limit} is not positive")
    try:
        found = store.read(table)
        if condition.strip():
            with _nulls_for_errors(found.sparkSession):
                found = found.where(F.expr(condition))
            for kind in _kinds(found._jdf.queryExecution().analyzed().condition()):
                if kind not in ALLOWED:
                    raise ExplorerError(f"{kind} is not allowed in a condition")
        if columns:
            found = found.select(*columns)
        if order_by:
            found = found.orderBy(*order_by)
        return found.limit(limit)
    except (AnalysisException, ParseException) as error:
        raise ExplorerError(f"SQL error: {error}") from error


@contextmanager
def _nulls_for_errors(spark: SparkSession) -> Iterator[None]:
    """What is analysed inside gives null where ANSI SQL fails. The settings are the
    session's, and are put back."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _kinds(expression) -> Iterator[str]:
    """The names of the kinds in an analysed expression."""
    yield expression.getClass().getSimpleName()
    children = expression.children()
    for k in range(children.size()):
        yield from _kinds(children.apply(k))


def filter_options(store: OpsStore) -> DataFrame:
    """The values of each filter, sorted, after "All" at position 0."""
    # One pass over the orders leaves the few (state, zone, category) combinations.
    fields = ["state", "zone", "category"]
    combinations = store.orders(*fields).distinct().unpivot([], fields, "field", "value")
    segments = store.customers("segment").distinct().unpivot([], ["segment"], "field", "value")
    options = combinations.unionByName(segments).distinct()
    place = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    listed = options.select("field", place.alias("position"), "value")
    every = (
        options.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(f) for f in [*fields, "segment"]])).alias("field"))
        .select("field", F.lit(0).alias("position"), F.lit("All").alias("value"))
    )
    return listed.unionByName(every).orderBy("field", "position")


def period_bounds(store: OpsStore) -> DataFrame:
    """The first and last order day, the limits of a valid period."""
    return store.orders("order_date").agg(
        F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")
    )


def valid_period(store: OpsStore, period: Period) -> Period:
    """The period, or an error if the store's orders don't cover it. One one-row job."""
    first, last = period_bounds(store).first()
    if first is None:
        raise ValueError("there are no orders")
    return period.within(first, last)


def key_quality(store: OpsStore) -> DataFrame:
    """Violations of each table's key rules: duplicated primary keys (count of key
    values), references to absent rows (count of rows), nulls where none may be.

    Each table is read once. A row gives an entry for its own key and one for each key it
    refers to; entries of one key come together in one shuffle, before which a task's are
    one row, so a key with a third of all references is one row for each task.
    """
    uses = [(t, c, to) for t in TABLES.values() for c, to in t.references.items()]
    needs = [(t, c) for t in TABLES.values() for c in t.required]
    counts = ["owners", *(f"uses{k}" for k in range(len(uses))), *(f"lacks{k}" for k in range(len(needs)))]

    def entry(space, key, **given):
        cells = ", ".join(f"{given.get(name, '0L')} AS {name}" for name in counts)
        return f"struct('{space}' AS space, CAST({key} AS STRING) AS key, {cells})"

    def entries(table):
        lacks = {f"lacks{k}": f"CAST({c} IS NULL AS BIGINT)" for k, (t, c) in enumerate(needs) if t is table}
        kept = [entry(table.name, table.primary_key, owners="1L", **lacks)]
        for k, (t, column, target) in enumerate(uses):
            if t is table:
                kept.append(f"CASE WHEN {column} IS NOT NULL THEN {entry(target, column, **{f'uses{k}': '1L'})} END")
        rows = store.read(table.name, table.primary_key, *table.references, *table.required)
        if len(kept) == 1:
            return rows.selectExpr(f"{kept[0]} AS e").select("e.*")
        return rows.selectExpr(f"inline(filter(array({', '.join(kept)}), e -> e IS NOT NULL))")

    keys = reduce(DataFrame.unionByName, map(entries, TABLES.values())).groupBy("space", "key")
    keys = keys.agg(*[F.sum(name).alias(name) for name in counts])
    found = {(t.name, f"primary key {t.primary_key}"): f"count_if(space = '{t.name}' AND owners > 1)" for t in TABLES.values()}
    for k, (t, column, target) in enumerate(uses):
        found[t.name, f"foreign key {column}"] = f"coalesce(sum(uses{k}) FILTER (WHERE space = '{target}' AND owners = 0), 0L)"
    for k, (t, column) in enumerate(needs):
        found[t.name, f"not null {column}"] = f"coalesce(sum(lacks{k}), 0L)"
    totals = keys.selectExpr(*[f"{sql} AS found{k}" for k, sql in enumerate(found.values())])
    lines = ", ".join(f"'{table}', '{rule}', found{k}" for k, (table, rule) in enumerate(found))
    return totals.selectExpr(f"stack({len(found)}, {lines}) AS (table_name, rule, violations)").orderBy("table_name", "rule")


def schema_catalog(store: OpsStore) -> DataFrame:
    """Each column's declared type and rules, and the nulls and rows found in it. Rows and
    values are counted, which a store can tell from the footers of its files."""
    return reduce(
        DataFrame.unionByName, [_columns_of(store, t) for t in TABLES.values()]
    ).orderBy("table_name", "position")


def declared() -> list[tuple[str, int, str, str, int, int]]:
    """The listing without what is found in the tables: table, position, column, type,
    whether it must not be null, whether it is the key. No job."""
    return [
        (t.name, k, c, kind.simpleString(), int(c in t.required), int(c == t.primary_key))
        for t in TABLES.values()
        for k, (c, kind) in enumerate(t.columns.items())
    ]


def _columns_of(store, table):
    lines = [
        f"{position}, '{column}', '{kind}', {needed}, {key}, total_rows - n_{column}"
        for name, position, column, kind, needed, key in declared()
        if name == table.name
    ]
    return store.counted(table.name).selectExpr(
        f"'{table.name}' AS table_name",
        "total_rows",
        f"stack({len(lines)}, {', '.join(lines)}) AS "
        "(position, column_name, data_type, not_null, primary_key, null_rows)",
    )
