"""Pairs of tables to compare, derived from the given tables by SQL that Spark and DuckDB both run.

Side B is a table with scattered edits. Its conditions on keys place the edits (changed cells, moved keys, rows that are
missing on one side); all rows of the table take part in every comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_B = """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.001 WHEN o_orderkey % 13 = 0 THEN o_totalprice + 5
       WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL '3' SECOND
       WHEN o_orderkey % 19 = 0 THEN o_orderdate + INTERVAL '10' SECOND ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 23 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 101 <> 0
"""

LINEITEM_B = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem}
"""

NULL_KEYS_A = """
SELECT CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM {orders}
"""

NULL_KEYS_B = """
SELECT CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice, o_orderdate,
  o_orderpriority FROM {orders} WHERE o_orderkey % 101 <> 0
"""

PARTLY_NULL_KEYS_A = """
SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM {orders}
"""

PARTLY_NULL_KEYS_B = """
SELECT o_orderkey, CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL '1' DAY ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 8 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM {orders}
"""

CUSTOMER_B = """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN replace(c_name, 'Customer', 'Custumer') ELSE c_name END AS c_name,
  c_nationkey, c_acctbal, c_mktsegment FROM {customer}
"""

EVENTS_B = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '1500' MILLISECOND
                      WHEN event_id % 7 = 0 THEN ts + INTERVAL '1501' MILLISECOND ELSE ts END AS ts,
  user_id, event_type, CASE WHEN event_id % 50 = 0 THEN value + 1 ELSE value END AS value, props
FROM {events}
"""

EVENTS_TWO_TIMES_A = """
SELECT event_id, event_type, ts, ts + INTERVAL '7' SECOND AS done FROM {events}
"""

EVENTS_TWO_TIMES_B = """
SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '20' SECOND ELSE ts END AS ts,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '90' SECOND ELSE ts END AS done FROM {events}
"""

# Nearly all times lie within days, a few thousands of years before and after.
EVENTS_FAR_TIMES_A = """
SELECT event_id, CASE WHEN event_id % 311 = 0 THEN ts + INTERVAL '2900000' DAY
                      WHEN event_id % 313 = 0 THEN ts - INTERVAL '700000' DAY ELSE ts END AS ts,
  ts + INTERVAL '7' SECOND AS done, user_id, event_type, value, props
FROM {events}
"""

EVENTS_FAR_TIMES_B = """
SELECT event_id, CASE WHEN event_id % 622 = 0 THEN ts + INTERVAL '2900000' DAY
                      WHEN event_id % 5 = 0 THEN ts + INTERVAL '20' SECOND ELSE ts END AS ts,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '90' MINUTE ELSE ts END AS done, user_id, event_type, value, props
FROM {events}
"""

DOCUMENTS_B = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(' ', lower(text), ' ')
                    WHEN doc_id % 10 = 1 THEN replace(text, 'e', 'é') ELSE text END AS text, lang, source, n_chars
FROM {documents}
"""

CONVERSATIONS_B = """
SELECT conv_id, turn, upper(role) AS role, CASE WHEN turn % 2 = 0 THEN concat(text, '  ') ELSE text END AS text
FROM {conversations}
"""

RETYPED_ORDERS = """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS BIGINT) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM {orders}
"""

PAGES_B = """
SELECT page_id, concat(url, CASE WHEN page_id % 3 = 0 THEN '?' ELSE '' END) AS url, replace(html, '<p>', '<P>') AS html
FROM {pages}
"""

TABLES = (
    "customer",
    "conversations",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "supplier",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the texts above on the tables of ``sf_dir``."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def duckdb_text(text: str) -> str:
    return text.format(**{name: name for name in TABLES}).strip()
