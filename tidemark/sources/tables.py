"""Parquet tables read with explicit schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


#: Session setting: deal the rows of tables read for row-heavy work (hashing, regular expressions, parsing) to this
#: many tasks. For tables of one row group, which a scan can't split; not set by default, as it costs an exchange.
READ_PARTITIONS = "spark.tidemark.read.partitions"


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One table; timestamps are read as instants so that filters push down unwrapped.

    ``spread`` marks row-heavy work: it follows the session setting READ_PARTITIONS, whatever the table's size.
    """
    table = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(READ_PARTITIONS, None)
    return table.repartition(int(parts)) if spread and parts else table


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.readStream.schema(TABLE_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
