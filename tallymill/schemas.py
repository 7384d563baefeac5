"""Explicit schemas of the stored tables and files."""

from pyspark.sql import types as T

RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("suite_id", T.StringType()),
        T.StructField("suite_uid", T.StringType()),
        T.StructField("bench_id", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("failed", T.IntegerType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("system", T.StringType()),
        T.StructField("log_path", T.StringType()),
    ]
)

LINES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("line", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
    ]
)

# The lineitem table of the test data: 11 columns.
LINEITEM = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)

# The lineitem table as TPC-H defines it: 16 columns.
TPCH_LINEITEM = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.DateType()),
        T.StructField("l_commitdate", T.DateType()),
        T.StructField("l_receiptdate", T.DateType()),
        T.StructField("l_shipinstruct", T.StringType()),
        T.StructField("l_shipmode", T.StringType()),
        T.StructField("l_comment", T.StringType()),
    ]
)
