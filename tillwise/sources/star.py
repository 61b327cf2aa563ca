"""The operations tables, derived from a star schema of order lines and events.

Joins happen only for the columns a plan asks for. Attribute joins (place, product)
are left joins on a unique key, so leaving one out never changes the rows. No join
carries a broadcast hint: Spark broadcasts a side when its known size is below
``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges otherwise. AQE splits a
join partition that a hot key has made too large.

Derived columns are SQL text: one expression is one call to the JVM, and only the
wanted ones are selected.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions import rules
from tillwise.operators.selection import Period
from tillwise.sources.store import OpsStore

# --- Fixed values of the mapping --------------------------------------------------

RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
    "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}

TIER_THRESHOLDS = {"Platinum": 500000, "Gold": 200000, "Silver": 80000, "Bronze": 0}
FIRST_DAY = date(1995, 1, 1)
FIRST_EVENT = datetime(2024, 1, 1)
EVENT_SECONDS_PER_DAY = 1080
RETURN_DAYS = (1, 7)

PLACE = {"city", "state", "zone"}
PRODUCT = {"category", "product_name"}

# --- Derived columns --------------------------------------------------------------


def _hundredths(column: str) -> str:
    return f"floor({column} * 100 + 0.5D)"


def _money(hundredths: str) -> str:
    """Whole hundredths as an exact decimal, without going through text."""
    return f"CAST(CAST({hundredths} AS DECIMAL(12,0)) * 0.01BD AS DECIMAL(12,2))"


_PRICE = _hundredths("l_extendedprice")
_GST = f"(({_PRICE} * {_hundredths('l_tax')} + 50) DIV 100)"
_DISCOUNT = f"(({_PRICE} * {_hundredths('l_discount')} + 50) DIV 100)"
_DELIVERY_DAYS = "CAST(2 + (l_orderkey + l_linenumber) % 13 AS INT)"
_STATUS = """CASE WHEN l_returnflag = 'R' THEN 'Returned'
    WHEN o_orderstatus = 'P' THEN 'Processing'
    WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Cancelled'
    WHEN l_linestatus = 'F' THEN 'Delivered'
    ELSE 'Shipped' END"""

HEADER_COLUMNS = {
    "customer_id": "o_custkey",
    "order_date": "CAST(o_orderdate AS DATE)",
    "payment_method": "o_orderpriority",
}
ORDER_COLUMNS = {
    "order_id": "l_orderkey",
    "delivery_date": f"date_add(order_date, {_DELIVERY_DAYS})",
    "amount": _money(_PRICE),
    "gst_amount": _money(_GST),
    "discount": _money(_DISCOUNT),
    "final_amount": _money(f"({_PRICE} + {_GST} - {_DISCOUNT})"),
    "category": "p_type",
    "product_name": "p_name",
    "order_status": _STATUS,
    "delivery_days": _DELIVERY_DAYS,
    "is_returned": "CAST(l_returnflag = 'R' AS INT)",
}
RETURN_COLUMNS = {
    "return_id": "format_string('RET%d-%d', l_orderkey, l_linenumber)",
    "order_id": "l_orderkey",
    "return_date": "date_add(order_date, CAST(1 + l_orderkey % 7 AS INT))",
    "reason": "concat('Reason-', l_partkey % 8)",
    "refund_amount": _money(f"(({_PRICE} * (85 + l_suppkey % 16) + 50) DIV 100)"),
    "refund_status": """CASE WHEN l_partkey % 100 < 70 THEN 'Completed'
        WHEN l_partkey % 100 < 88 THEN 'Pending' ELSE 'Processing' END""",
}

# Whole seconds of event time, from the parts of the time and so in no time zone.
_SECONDS = (
    f"(datediff(CAST(ts AS DATE), DATE'{FIRST_EVENT:%Y-%m-%d}') * 86400L "
    "+ hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
)
# A property that is no whole number is null: such a ticket has no priority and no status.
_K = "try_cast(get_json_object(props, '$.k') AS INT)"
_MIX = "((7 * k + event_id) % 100)"

TICKET_COLUMNS = {
    "ticket_id": "event_id",
    "customer_id": "user_id",
    "agent_id": "event_id % 10",
    "created_date": f"date_add(DATE'{FIRST_DAY}', "
    f"CAST({_SECONDS} DIV {EVENT_SECONDS_PER_DAY} AS INT))",
    "ticket_category": "event_type",
    "priority": """CASE WHEN k < 25 THEN 'Low' WHEN k < 70 THEN 'Medium'
        WHEN k < 90 THEN 'High' WHEN k >= 90 THEN 'Critical' END""",
    "status": f"""CASE WHEN {_MIX} < 68 THEN 'Resolved' WHEN {_MIX} < 80 THEN 'Open'
        WHEN {_MIX} < 90 THEN 'Escalated' WHEN {_MIX} >= 90 THEN 'Pending' END""",
    "csat_score": "CAST(CAST(10 + (event_id * 13) % 41 AS DECIMAL(3,0)) * 0.1BD AS DECIMAL(3,1))",
    "resolution_hours": _money(_hundredths("value")),
    "first_response_h": f"CAST({_money(_hundredths('value'))} * 0.25BD AS DECIMAL(14,4))",
    "is_repeat": "CAST(event_id % 11 < 2 AS INT)",
}
PLACE_COLUMNS = {"city": "concat(state, '-', c_custkey % 5)"}
CUSTOMER_COLUMNS = {
    "customer_id": "c_custkey",
    "full_name": "c_name",
    "segment": "c_mktsegment",
    "join_date": f"date_add(DATE'{FIRST_DAY}', CAST(c_custkey * 37 % 2190 AS INT))",
    "status": """CASE c_custkey % 7 WHEN 0 THEN 'Churned' WHEN 1 THEN 'At-Risk'
        ELSE 'Active' END""",
    "age_group": """CASE c_custkey % 5 WHEN 0 THEN '18-25' WHEN 1 THEN '26-35'
        WHEN 2 THEN '36-45' WHEN 3 THEN '46-60' ELSE '60+' END""",
}
AGENT_COLUMNS = {
    "agent_id": "s_suppkey",
    "agent_name": "s_name",
    "team": "concat('Team-', s_suppkey % 5)",
    "shift": "concat('Shift-', s_suppkey % 3)",
}


def _pick(columns: dict[str, str], wanted) -> list[str]:
    """Select items for the wanted columns; others are taken as they are."""
    return [f"{columns[name]} AS {name}" if name in columns else name for name in wanted]


def _event_time(day: date) -> str:
    """The event time at which a ticket day starts."""
    passed = timedelta(seconds=(day - FIRST_DAY).days * EVENT_SECONDS_PER_DAY)
    return f"TIMESTAMP_NTZ'{FIRST_EVENT + passed}'"


class StarStore(OpsStore):
    """Reads ``<root>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, root: str, tier_thresholds=TIER_THRESHOLDS):
        self.spark, self.root, self.tier_thresholds = spark, root, tier_thresholds
        self._checked: set[str] = set()

    def raw(self, name: str) -> DataFrame:
        """A raw table with the declared types. A declared column that the files lack is
        an error: Spark would fill it with nulls."""
        path = f"{self.root}/{name}.parquet"
        declared = T.StructType.fromDDL(RAW_SCHEMAS[name])
        if name not in self._checked:
            there = {c.lower() for c in self.spark.read.parquet(path).columns}
            missing = [c for c in declared.names if c not in there]
            if missing:
                raise ValueError(f"{path} has no column {', '.join(missing)}")
            self._checked.add(name)
        return self.spark.read.schema(declared).parquet(path)

    def table(self, name, columns, period):
        return getattr(self, f"_{name}")(columns, period)

    # Places: the nation and region of a customer or supplier.

    def states(self) -> DataFrame:
        return self._states(("zone",))

    def _states(self, wanted) -> DataFrame:
        nations = self.raw("nation")
        if "zone" not in wanted:
            return nations.selectExpr("n_nationkey", "n_name AS state")
        zones = self.raw("region")
        return nations.join(zones, F.expr("n_regionkey = r_regionkey"), "left").selectExpr(
            "n_nationkey", "n_name AS state", "r_name AS zone"
        )

    def _located(self, people: DataFrame, nation: str, wanted) -> DataFrame:
        if not PLACE & set(wanted):
            return people
        return people.join(self._states(wanted), F.expr(f"{nation} = n_nationkey"), "left")

    def placed_by_customer(self, df: DataFrame, *wanted: str) -> DataFrame:
        return self._with_place(df, "customer_id", wanted).drop("c_custkey", "c_nationkey", "n_nationkey")

    def _with_place(self, df: DataFrame, customer: str, wanted) -> DataFrame:
        """Add ``customer``'s place. Only the nation's number is joined by customer;
        the names come from the nations afterwards."""
        if not PLACE & set(wanted):
            return df
        homes = self.raw("customer").select("c_custkey", "c_nationkey")
        return self._located(
            df.join(homes, F.expr(f"{customer} = c_custkey"), "left"), "c_nationkey", wanted
        )

    # Facts.

    def _order_lines(self, wanted, period: Period | None) -> DataFrame:
        """Order lines with their header, and with place and product if wanted.

        The header is filtered and given its place first: it has fewer rows than the
        lines, which are then shuffled once.
        """
        header = self._with_place(self.raw("orders"), "o_custkey", wanted)
        header = header.selectExpr(
            "o_orderkey",
            "o_orderstatus",
            *_pick(HEADER_COLUMNS, HEADER_COLUMNS),
            *_pick(PLACE_COLUMNS, sorted(PLACE & set(wanted))),
        )
        if period is not None:
            header = header.where(period.contains("order_date"))
        lines = self.raw("lineitem")
        lines = lines.join(header, F.expr("l_orderkey = o_orderkey"))
        if PRODUCT & set(wanted):
            lines = lines.join(self.raw("part"), F.expr("l_partkey = p_partkey"), "left")
        return lines

    def _orders(self, columns, period):
        return self._order_lines(columns, period).selectExpr(*_pick(ORDER_COLUMNS, columns))

    def _returns(self, columns, period):
        if period is not None:
            # The period also bounds the order date, and that bound reaches the scan.
            first, last = RETURN_DAYS
            ordered = period.shifted(-last, -first)
            lines = self._order_lines(columns, ordered).where(
                f"{RETURN_COLUMNS['return_date']} BETWEEN {period.sql}"
            )
        else:
            lines = self._order_lines(columns, None)
        return lines.where("l_returnflag = 'R'").selectExpr(*_pick(RETURN_COLUMNS, columns))

    def _tickets(self, columns, period):
        events = self.raw("events")
        if period is not None:
            # Days are stretches of event time, so a period is a range of ``ts``.
            start, after = _event_time(period.start), _event_time(period.end + timedelta(days=1))
            events = events.where(f"ts >= {start} AND ts < {after}")
        events = self._with_place(events, "user_id", columns)
        if {"priority", "status"} & set(columns):
            events = events.withColumn("k", F.expr(_K))
        return events.selectExpr(*_pick(TICKET_COLUMNS | PLACE_COLUMNS, columns))

    def days(self, name):
        """From the order headers, or the event times, alone."""
        if name == "orders":
            return self.raw("orders").selectExpr(f"{HEADER_COLUMNS['order_date']} AS day")
        return super().days(name)

    def has_days_exactly(self, name):
        """Each event is a ticket; an order header may be without lines."""
        return name == "tickets"

    # Dimensions.

    def _customers(self, columns, period):
        people = self._located(self.raw("customer"), "c_nationkey", columns)
        if "tier" in columns:
            spend = delivered_spend(self).withColumnRenamed("customer_id", "spender")
            people = people.join(spend, F.expr("c_custkey = spender"), "left").withColumn(
                "tier", rules.tier_of(F.expr("coalesce(spent, 0)"), self.tier_thresholds)
            )
        return people.selectExpr(*_pick(CUSTOMER_COLUMNS | PLACE_COLUMNS, columns))

    def customers_of(self, keys, *columns):
        if "tier" not in columns:
            return super().customers_of(keys, *columns)
        spend = delivered_spend(self, keys)
        people = super().customers_of(keys, *(c for c in columns if c != "tier"))
        return self._with_tier(people.join(spend, "customer_id", "left")).select("customer_id", *columns)

    def customers_with_orders(self, columns, sums, read, counted, period=None):
        """A tier comes from all orders, so one pass over them gives both."""
        if "tier" not in columns:
            return super().customers_with_orders(columns, sums, read, counted, period)
        if period is not None:
            counted = f"{counted} AND order_date BETWEEN {period.sql}"
        needed = ("customer_id", "order_date", "order_status", "final_amount", *read)
        totals = self.orders(*dict.fromkeys(needed)).groupBy("customer_id").agg(
            *[F.expr(f"{sql} FILTER (WHERE {counted})").alias(name) for name, sql in sums.items()],
            F.expr(f"sum(final_amount) FILTER (WHERE {DELIVERED})").alias("delivered"),
        )
        people = self.customers(*dict.fromkeys(("customer_id", *(c for c in columns if c != "tier"))))
        joined = people.join(totals, "customer_id", "left")
        return self._with_tier(joined.withColumnRenamed("delivered", "spent_in_all"), "spent_in_all")

    def _with_tier(self, people: DataFrame, spent: str = "spent") -> DataFrame:
        tier = rules.tier_of(F.expr(f"coalesce({spent}, 0)"), self.tier_thresholds)
        return people.withColumn("tier", tier).drop(spent)

    def _agents(self, columns, period):
        agents = self._located(self.raw("supplier"), "s_nationkey", columns)
        return agents.selectExpr(*_pick(AGENT_COLUMNS, columns))


DELIVERED = "order_status = 'Delivered'"


def delivered_spend(store: OpsStore, keys: DataFrame | None = None) -> DataFrame:
    """Delivered spend of each customer who has any; only of ``keys``, if given."""
    orders = store.orders("customer_id", "final_amount", "order_status")
    if keys is not None:
        orders = orders.join(keys, "customer_id", "left_semi")
    return (
        orders.where(DELIVERED)
        .groupBy("customer_id")
        .agg(F.sum("final_amount").alias("spent"))
    )
