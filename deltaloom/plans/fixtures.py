"""Destinations derived from the driver's tables, in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A destination with every kind of difference: a missing suffix (click), rows that the source
#: lacks (error), a missing partition (purchase), changed and missing rows (view), none (signup),
#: and a partition that the source lacks (legacy).
EVENTS_DST = """
select event_id, ts, user_id, event_type,
       case when event_type = 'view' and event_id % 97 = 5 then value + 1 else value end as value, props
from {events}
where event_type <> 'purchase'
  and not (event_type = 'view' and event_id % 50 = 7)
  and not (event_type = 'click' and event_id > (select 0.9 * max(event_id) from {events}))
union all
select event_id + 1000000000 as event_id, ts, user_id, event_type, value, props
from {events} where event_type = 'error' and event_id < (select 0.05 * max(event_id) from {events})
union all
select event_id + 2000000000 as event_id, ts, user_id, 'legacy' as event_type, value, props
from {events} where event_id < 5
"""

#: Orders without a suffix and with some changed and some missing rows.
ORDERS_DST = """
select o_orderkey, o_custkey,
       case when o_orderkey % 101 = 3 then 'X' else o_orderstatus end as o_orderstatus,
       case when o_orderkey % 211 = 9 then o_totalprice + 0.01 else o_totalprice end as o_totalprice,
       o_orderdate, o_orderpriority
from {orders}
where o_orderkey % 307 <> 11 and o_orderkey <= (select 0.95 * max(o_orderkey) from {orders})
"""

LINES_DST = """
select * from {lineitem} where l_orderkey % 10 <> 3
"""

#: Lines without some orders, with some other quantities and with some lines that the source lacks.
LINES_ALL_DST = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when l_orderkey % 7 = 2 then l_quantity + 100 else l_quantity end as l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
from {lineitem} where l_orderkey % 10 <> 3
union all
select l_orderkey + 1000000000 as l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
from {lineitem} where l_orderkey % 4 = 1
"""

#: The derived orders, and some that the source lacks.
ORDERS_ALL_DST = f"""
select * from ({ORDERS_DST}) d
union all
select o_orderkey + 1000000000 as o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from {{orders}} where o_orderkey % 13 = 5
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: load(spark, sf_dir, name)})


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "events"), derived(spark, sf_dir, EVENTS_DST, "events")


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "orders"), derived(spark, sf_dir, ORDERS_DST, "orders")


def duck(sql: str) -> str:
    """The same SQL over DuckDB's views."""
    return sql.format(events="events", orders="orders", lineitem="lineitem")
