"""Declared schemas of the canonical relations, and how a table is checked against one."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "money": T.DecimalType(10, 2)}


def schema(text: str) -> T.StructType:
    """``name type, ...`` of the few types that the relations use."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])


SCHEMAS = {
    "customers": schema("id bigint, name string, email string, city string, created_at timestamp"),
    "orders": schema("id bigint, customer_id bigint, status string, order_ts timestamp, amount money, created_at timestamp"),
    "order_items": schema("id bigint, order_id bigint, product string, quantity int, unit_price money"),
    "events": schema("event_id string, user_id bigint, event_type string, page string, ts timestamp"),
    "cdc_events": schema("source_table string, id bigint, op string, payload string, _version bigint, _deleted boolean, ingested_at timestamp"),
}
STATUSES = ("pending", "paid", "shipped", "delivered", "cancelled")


def differences(df: DataFrame, wanted: T.StructType) -> list[str]:
    """What keeps a table's definition from being the declared one; existence alone is not agreement."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in wanted}
    out = [f"missing {c} {t}" for c, t in want.items() if c not in have]
    out += [f"{c} is {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    return out + [f"extra {c}" for c in have if c not in want]
