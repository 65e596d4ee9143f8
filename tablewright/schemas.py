"""Declared schemas of the tables the library generates or expects."""

from __future__ import annotations

from pyspark.sql import types as T

# The generated fact table. Each drawn column has an inclusive range;
# MARKET_ID counts rows from 0 and IS_DELETED is constant.
FACT_RANGES: dict[str, tuple[int, int] | None] = {
    "PRODUCT_ID": (1, 7),
    "CHANNEL_ID": (1, 7),
    "MARKET_ID": None,
    "CUSTOMER_ID": (100, 100_000),
    "NRX": (100, 1_000),
    "TRX": (100, 1_000),
    "FACTORED_NRX": (100, 1_000),
    "FACTORED_TRX": (100, 1_000),
    "TOTAL_UNITS": (100, 1_000),
    "TOTAL_AMOUNT": (100, 1_000),
    **{f"CUSTOM_METRIC{i}": (100, 1_000) for i in range(1, 11)},
}
FACT_FLAG = "IS_DELETED"
FACT_FLAG_VALUE = "FALSE"
FACT_COLUMNS = [*FACT_RANGES, FACT_FLAG]

# The fact table as read from CSV: whole numbers and a boolean.
FACTS = T.StructType(
    [T.StructField(name, T.LongType()) for name in FACT_RANGES] + [T.StructField(FACT_FLAG, T.BooleanType())]
)

# Columns a volume run reads and writes, in the case it asks for.
VOLUME_COLUMNS = [
    "is_deleted", "PRODUCT_ID", "channel_id", "market_id", "customer_id", "nrx", "trx",
    "factored_nrx", "total_units", "total_amount", *[f"custom_metric{i}" for i in range(1, 11)],
]

# The flower measurements used for classification.
FLOWER_KEY = "iris_external_id"
FLOWER_FEATURES = ["is_deleted", "sepal_length_cm", "sepal_width_cm", "petal_length_cm", "petal_width_cm"]
FLOWER_LABEL = "species"
FLOWERS = T.StructType(
    [T.StructField(FLOWER_KEY, T.StringType()), T.StructField(FLOWER_FEATURES[0], T.BooleanType())]
    + [T.StructField(name, T.DoubleType()) for name in FLOWER_FEATURES[1:]]
    + [T.StructField(FLOWER_LABEL, T.StringType())]
)

# One row per measured write + read; ``run`` tells executions apart.
RUN_STATS = T.StructType(
    [
        T.StructField("run", T.StringType(), False),
        T.StructField("freq", T.IntegerType(), False),
        T.StructField("record_count", T.LongType(), False),
        T.StructField("iteration", T.IntegerType(), False),
        T.StructField("read_s", T.DoubleType(), False),
        T.StructField("write_s", T.DoubleType(), False),
    ]
)
