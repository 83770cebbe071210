"""The Parquet tables, and the listing model seen in them.

The listing model is mapped onto the star schema: an order is an event at the
venue of its customer, a line item is a candidate reported by a supplier (the
source), a row of `events` is a fetch attempt of the source `user_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Confidence labels in the order in which feeds show them.
CONFIDENCE = ("confirmed", "likely", "unverified", "disputed")


class Tables:
    """Lazy access to the tables below one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def listings(self) -> DataFrame:
        """event_id, venue_id, title, start_time, price, status, confidence; a seventh of the starts is unknown."""
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("venue_id"), F.concat(F.lit("Show "), F.col("o_orderpriority")).alias("title"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("start_time"), F.col("o_totalprice").alias("price"),
            F.when(F.col("o_orderkey") % 11 == 0, "cancelled").when(F.col("o_orderkey") % 13 == 0, "moved").otherwise("scheduled").alias("status"),
            F.when(F.col("o_orderkey") % 17 == 0, "disputed").when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "likely").otherwise("unverified").alias("confidence"),
        )

    def venues(self) -> DataFrame:
        """venue_id, venue_name, city, area, county."""
        return self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
            F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("venue_name"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("area"), F.col("r_name").alias("county"))

    def fetches(self) -> DataFrame:
        """fetch_id, source_id, fetched_at, failed, outcome, cost of each attempt."""
        return self.events.select(
            F.col("event_id").alias("fetch_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"),
            (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("outcome"), F.col("value").alias("cost"),
        )


#: The same views for DuckDB.
LISTINGS_SQL = """
listings as (select o_orderkey as event_id, o_custkey as venue_id, 'Show ' || o_orderpriority as title,
  case when o_orderkey % 7 <> 0 then o_orderdate end as start_time, o_totalprice as price,
  case when o_orderkey % 11 = 0 then 'cancelled' when o_orderkey % 13 = 0 then 'moved' else 'scheduled' end as status,
  case when o_orderkey % 17 = 0 then 'disputed' when o_orderstatus = 'F' then 'confirmed' when o_orderstatus = 'O' then 'likely' else 'unverified' end as confidence
  from orders)"""
VENUES_SQL = """
venues as (select c_custkey as venue_id, c_name as venue_name, n_name as city, c_mktsegment as area, r_name as county
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
FETCHES_SQL = """
fetches as (select event_id as fetch_id, user_id as source_id, ts as fetched_at, event_type = 'error' as failed, event_type as outcome, value as cost from events)"""
