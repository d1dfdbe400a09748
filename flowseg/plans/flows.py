"""A flow-shaped view of the test tables: every order line is one connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseg.functions.tables import spread
from flowseg.specs import FlowSpec, T

# one text for both engines: (column, expression)
COLUMNS = {
    "uid": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "src_ip": "concat('10.0.', o_custkey)",
    "src_port": "CAST(40000 + l_linenumber AS INT)",
    "dst_ip": "concat('10.1.', l_suppkey)",
    "dst_port": "CAST(l_partkey % 1024 AS INT)",
    "proto": "l_returnflag",
    "service": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
    "conn_state": "l_linestatus",
    "duration": "l_discount * 100",
    "orig_bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
    "resp_bytes": "CASE WHEN l_tax = 0 THEN 0 WHEN l_tax > 0.075 THEN NULL"
    " ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "orig_pkts": "CAST(l_quantity AS INT)",
    "orig_ip_bytes": "CAST(floor(l_extendedprice) AS BIGINT) + 40 * CAST(l_quantity AS BIGINT)",
    "label": "CASE WHEN l_discount > 0.045 AND l_quantity > 10 THEN 1 ELSE 0 END",
    "detailed_label": "CASE WHEN NOT (l_discount > 0.045 AND l_quantity > 10) THEN 'Benign'"
    " WHEN l_quantity > 40 THEN 'DDoS' WHEN l_quantity > 25 THEN 'PortScan' ELSE 'C&C' END",
    "prediction": "CASE WHEN l_quantity > 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "clusterId": "CAST(CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE l_suppkey % 7 END AS INT)",
}

VIEW_SQL = "SELECT {} FROM lineitem JOIN orders ON l_orderkey = o_orderkey".format(
    ", ".join(f'{expr} AS "{name}"' for name, expr in COLUMNS.items())
)

FIVE_TUPLE = {"SIP": "src_ip", "SPort": "src_port", "DIP": "dst_ip", "DPort": "dst_port", "Proto": "proto"}

SPEC = FlowSpec(
    name="view",
    path="",
    kind="csv",
    file_glob="*.csv",
    schema=T.StructType(),
    uid="uid",
    noisy=("uid", "src_ip", "src_port", "dst_ip", "dst_port"),
    labels=("label", "detailed_label"),
    five_tuple=FIVE_TUPLE,
    pca_variance=0.95,
    sample_size=1000,
    sample_method="balanced",
    response_bytes="resp_bytes",
    exclude=("prediction", "clusterId"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the test tables are single files of one row group, so one task would do all the work
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*[F.expr(expr).alias(name) for name, expr in COLUMNS.items()])
