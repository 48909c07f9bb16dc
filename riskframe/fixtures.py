"""Fraud-shaped views over the generic test tables. The views inject the nulls the raw tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TXN = """
SELECT event_id AS TransactionID,
  timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS TransactionDT,
  value AS TransactionAmt, event_type AS ProductCD, user_id AS card1,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE 100 + (user_id * 7 + CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END) % 40 END AS addr1,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 4 END AS addr2,
  CASE user_id % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.co.uk' WHEN 2 THEN 'Hotmail.com'
                   WHEN 3 THEN 'corp.example' WHEN 4 THEN 'mail.example' ELSE NULL END AS P_emaildomain,
  CASE event_id % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Yahoo.com' WHEN 2 THEN 'hotmail.com'
                    WHEN 3 THEN 'corp.example' ELSE NULL END AS R_emaildomain,
  CAST(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS isFraud
FROM {events}
"""

_IDENTITY = """
SELECT event_id AS TransactionID, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS id_01,
  CASE WHEN event_id % 8 = 0 THEN value END AS id_02,
  CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS DeviceType,
  CASE WHEN event_id % 16 = 0 THEN event_type END AS DeviceInfo
FROM {events} WHERE event_id % 4 = 0
"""

_TXN_ORDERS = """
SELECT o_orderkey AS TransactionID,
  timestampdiff(SECOND, TIMESTAMP_NTZ '1995-01-01 00:00:00', o_orderdate) AS TransactionDT,
  o_totalprice AS TransactionAmt, o_custkey AS card1, c_nationkey AS addr1, n_regionkey AS addr2,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS isFraud
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

_TXN_LINEITEM = """
SELECT l_orderkey * 10 + l_linenumber AS TransactionID,
  timestampdiff(SECOND, TIMESTAMP_NTZ '1995-01-01 00:00:00', l_shipdate) AS TransactionDT,
  l_extendedprice AS TransactionAmt, l_suppkey AS card1, l_returnflag AS addr1, l_linestatus AS addr2
FROM {lineitem}
"""

_SCORED = """
SELECT TransactionID, TransactionDT, TransactionAmt, isFraud AS y,
  CAST((TransactionID * 7919) % 700 + 300 * isFraud AS DOUBLE) / 1000 AS score_a,
  CAST(100 + (TransactionID * 104729) % 500 AS DOUBLE) / 1000 AS score_b,
  CAST((TransactionID * 1299709) % 997 + 200 * isFraud AS DOUBLE) / 10000 AS hdi_width
FROM {txn}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """`events` may be a stream over the same table."""
    return spark.sql(_TXN, events=events if events is not None else table(spark, sf_dir, "events"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_IDENTITY, events=table(spark, sf_dir, "events"))


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "nation")}
    return spark.sql(_TXN_ORDERS, **tables)


def txn_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table as transactions, with two entities of very few values."""
    return spark.sql(_TXN_LINEITEM, lineitem=table(spark, sf_dir, "lineitem"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores with ties and an interval width; `std` is a quarter of the width."""
    df = spark.sql(_SCORED, txn=txn(spark, sf_dir))
    return df.withColumn("std", df["hdi_width"] / 4)
