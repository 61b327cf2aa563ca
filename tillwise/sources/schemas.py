"""Columns, types and key rules of the five operations tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
TEXT, LONG, INT, DATE = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, T.DataType]
    primary_key: str
    date: str | None = None
    references: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    # Columns that rows are looked up by, besides the date.
    lookups: tuple[str, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns.items()])


CUSTOMERS = Table(
    "customers",
    {
        "customer_id": LONG,
        "full_name": TEXT,
        "city": TEXT,
        "state": TEXT,
        "zone": TEXT,
        "segment": TEXT,
        "tier": TEXT,
        "join_date": DATE,
        "status": TEXT,
        "age_group": TEXT,
    },
    primary_key="customer_id",
    required=("full_name",),
)

ORDERS = Table(
    "orders",
    {
        "order_id": LONG,
        "customer_id": LONG,
        "order_date": DATE,
        "delivery_date": DATE,
        "amount": MONEY,
        "gst_amount": MONEY,
        "discount": MONEY,
        "final_amount": MONEY,
        "category": TEXT,
        "product_name": TEXT,
        "payment_method": TEXT,
        "order_status": TEXT,
        "city": TEXT,
        "state": TEXT,
        "zone": TEXT,
        "delivery_days": INT,
        "is_returned": INT,
    },
    primary_key="order_id",
    date="order_date",
    references={"customer_id": "customers"},
    lookups=("customer_id", "state"),
)

TICKETS = Table(
    "tickets",
    {
        "ticket_id": LONG,
        "customer_id": LONG,
        "agent_id": LONG,
        "created_date": DATE,
        "ticket_category": TEXT,
        "priority": TEXT,
        "status": TEXT,
        "csat_score": T.DecimalType(3, 1),
        "resolution_hours": T.DecimalType(12, 2),
        "first_response_h": T.DecimalType(14, 4),
        "is_repeat": INT,
        "state": TEXT,
    },
    primary_key="ticket_id",
    date="created_date",
    references={"customer_id": "customers"},
    lookups=("agent_id",),
)

AGENTS = Table(
    "agents",
    {"agent_id": LONG, "agent_name": TEXT, "team": TEXT, "shift": TEXT, "state": TEXT},
    primary_key="agent_id",
    required=("agent_name",),
)

RETURNS = Table(
    "returns",
    {
        "return_id": TEXT,
        "order_id": LONG,
        "customer_id": LONG,
        "return_date": DATE,
        "reason": TEXT,
        "refund_amount": MONEY,
        "refund_status": TEXT,
        "state": TEXT,
    },
    primary_key="return_id",
    date="return_date",
)

TABLES = {t.name: t for t in (CUSTOMERS, ORDERS, TICKETS, AGENTS, RETURNS)}
