"""Points from this repository's own tables. A reader takes an optional box: what its bounds imply for the raw columns is then
tested in the scan, which pushes it down to the files; the box itself is still to be searched in the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions.encoders import Source, categories, computed, days, encode, integers, raw_predicate, scaled_by
from orthobox.plans.box import BoxQuery
from orthobox.schema import EVENTS5, LINEITEM7, ORDERS4, PointSchema

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

LINEITEM_SOURCES: dict[str, Source] = {
    "quantity": scaled_by("l_quantity", 1), "extendedprice": scaled_by("l_extendedprice", 100), "discount": scaled_by("l_discount", 100), "tax": scaled_by("l_tax", 100),
    "shipdate": days("l_shipdate"), "totalprice": scaled_by("o_totalprice", 100), "orderdate": days("o_orderdate"),
}
ORDER_SOURCES: dict[str, Source] = {"custkey": integers("o_custkey"), "totalprice": scaled_by("o_totalprice", 100), "orderdate": days("o_orderdate"), "priority": computed("o_orderpriority", lambda c: F.substring(c, 1, 1).cast("long"))}
EVENT_SOURCES: dict[str, Source] = {"day": days("ts"), "hour": computed("ts", lambda c: F.hour(c).cast("long")), "user_id": integers("user_id"), "value": scaled_by("value", 100), "event_type": categories("event_type", EVENT_TYPES)}


def _encoded(df: DataFrame, schema: PointSchema, sources: dict[str, Source], box: BoxQuery | None, on_overflow: str, pk: Column | None = None) -> DataFrame:
    near = df if box is None else df.where(raw_predicate(schema, sources, box.bounds))
    return encode(near, schema, {a: s.encoded(F.col(s.column)) for a, s in sources.items()}, pk=pk, on_overflow=on_overflow)


def lineitem7(spark: SparkSession, path: str, box: BoxQuery | None = None, on_overflow: str = "trust") -> DataFrame:
    """Line items with their orders' price and date; no primary key, as none is unique."""
    items = spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    orders = spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    return _encoded(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), LINEITEM7, LINEITEM_SOURCES, box, on_overflow)


def orders4(spark: SparkSession, path: str, box: BoxQuery | None = None, on_overflow: str = "trust") -> DataFrame:
    return _encoded(spark.read.parquet(f"{path}/orders.parquet"), ORDERS4, ORDER_SOURCES, box, on_overflow, F.col("o_orderkey"))


def events_points(events: DataFrame, box: BoxQuery | None = None, on_overflow: str = "trust") -> DataFrame:
    """Of rows of the events table, also of a stream's."""
    return _encoded(events, EVENTS5, EVENT_SOURCES, box, on_overflow, F.col("event_id"))


def events5(spark: SparkSession, path: str, box: BoxQuery | None = None, on_overflow: str = "trust") -> DataFrame:
    return events_points(spark.read.parquet(f"{path}/events.parquet"), box, on_overflow)
