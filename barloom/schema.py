"""Fixed schemas; never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["exchange", "symbol", "market", "settle", "timeframe"]
PRICES = ["open", "high", "low", "close"]
VALUES = [*PRICES, "volume"]

BARS = T.StructType(
    [
        T.StructField("exchange", T.StringType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("market", T.StringType(), False),
        T.StructField("settle", T.StringType(), True),
        T.StructField("timeframe", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        *[T.StructField(c, T.DoubleType(), False) for c in VALUES],
    ]
)
PROVIDER_BARS = T.StructType([T.StructField("timestamp", T.TimestampType(), False), *[T.StructField(c, T.DoubleType(), False) for c in VALUES]])
COVERAGE = T.StructType([*BARS.fields[:5], T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("status", T.StringType(), False)])
DEFINITIONS = T.StructType(
    [
        *BARS.fields[:4],
        T.StructField("active", T.BooleanType(), True),
        T.StructField("timeframes", T.ArrayType(T.StringType()), False),
        T.StructField("tick_size", T.DecimalType(38, 18), True),
        T.StructField("size_increment", T.DecimalType(38, 18), True),
        T.StructField("linear", T.BooleanType(), True),
        T.StructField("inverse", T.BooleanType(), True),
        T.StructField("contract_size", T.StringType(), True),
    ]
)
