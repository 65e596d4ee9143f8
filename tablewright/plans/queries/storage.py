"""CSV and object-table scans and sinks, and generated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.keyed import SLOTS, WORD_PRIME, round_constants
from tablewright.operators.checks import load_report
from tablewright.operators.shaping import features_to_double
from tablewright.plans.queries.registry import query, table
from tablewright.schemas import FACT_FLAG, FACT_RANGES
from tablewright.session import scratch_path
from tablewright.sinks.objects import append, append_first
from tablewright.sinks.text import write_csv
from tablewright.sources.facts import facts_for, generate_facts
from tablewright.sources.objects import ObjectTable, read_object, read_rows
from tablewright.sources.text import read_csv, read_csv_for_store, read_csv_split


def scratch_table(spark: SparkSession, name: str) -> ObjectTable:
    return ObjectTable(scratch_path(spark, "objects"), "demo", "volume", name)


@query(
    "csv_infer_roundtrip",
    """
    SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    """,
)
def csv_infer_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "customer"), path, mode="overwrite")
    return read_csv(spark, path)


@query("csv_declared_schema", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_declared_schema(spark: SparkSession, folder: str) -> DataFrame:
    customers, path = table(spark, folder, "customer"), scratch_path(spark, "csv")
    write_csv(customers, path, mode="overwrite")
    return read_csv(spark, path, schema=customers.schema)


@query(
    "csv_string_scan",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_acctbal,
           CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS DOUBLE) AS owes
    FROM customer
    """,
)
def csv_string_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Everything arrives as text; numbers and booleans are cast afterwards."""
    path = scratch_path(spark, "csv")
    customers = table(spark, folder, "customer").withColumn("owes", F.col("c_acctbal") < 0)
    write_csv(customers, path, mode="overwrite")
    text = read_csv(spark, path, infer=False)
    return features_to_double(text, ["c_acctbal", "owes"]).drop("c_name", "c_nationkey")


@query(
    "csv_na_marker",
    """
    SELECT l_returnflag, count(*) AS "rows", count(nullif(l_discount, 0)) AS known,
           round(avg(nullif(l_discount, 0)), 6) AS avg_discount, 'double' AS kind
    FROM lineitem GROUP BY l_returnflag
    """,
)
def csv_na_marker(spark: SparkSession, folder: str) -> DataFrame:
    """A number column with NA in it stays a number column."""
    path = scratch_path(spark, "csv")
    gaps = table(spark, folder, "lineitem").select("l_returnflag", F.nullif("l_discount", F.lit(0.0)).alias("discount"))
    write_csv(gaps, path, mode="overwrite", missing="NA")
    back = read_csv(spark, path, missing="NA")
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("discount").alias("known"),
        F.round(F.avg("discount"), 6).alias("avg_discount"),
        F.lit(back.schema["discount"].dataType.simpleString()).alias("kind"),
    )


@query(
    "csv_store_columns",
    """
    SELECT 'order_external_id,order_id,o_orderkey,o_custkey' AS columns, count(*) AS "rows",
           count(DISTINCT o_orderkey) AS ids, CAST(0 AS BIGINT) AS store_ids,
           CAST(sum(o_custkey) AS BIGINT) AS cust_sum
    FROM orders
    """,
)
def csv_store_columns(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), path)
    df = read_csv_for_store(spark, path, "order", external_id=True, null_id=True)
    per_id = df.groupBy("order_external_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("order_id").alias("given"), F.sum("o_custkey").alias("cust")
    )
    return per_id.agg(
        F.lit(",".join(df.columns)).alias("columns"),
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.sum("given").alias("store_ids"),
        F.sum("cust").alias("cust_sum"),
    )


@query(
    "csv_append_overwrite",
    """
    SELECT c_mktsegment, 2 * count(*) AS appended, count(*) AS replaced FROM customer GROUP BY c_mktsegment
    """,
)
def csv_append_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Appending twice doubles the rows; overwriting what was appended does not."""
    customers = table(spark, folder, "customer")
    grown, replaced = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    for _ in range(2):
        write_csv(customers, grown)
        write_csv(customers, replaced, mode="overwrite")
    sides = []
    for path, here in ((grown, 1), (replaced, 0)):
        segment = read_csv(spark, path, schema=customers.schema).select("c_mktsegment")
        sides.append(segment.select("c_mktsegment", F.lit(here).alias("a"), F.lit(1 - here).alias("r")))
    both = sides[0].unionByName(sides[1])
    return both.groupBy("c_mktsegment").agg(F.sum("a").alias("appended"), F.sum("r").alias("replaced"))


@query(
    "csv_single_part_export",
    """
    SELECT c_mktsegment, c_nationkey, CAST(count(*) AS INTEGER) AS "rows", CAST(1 AS BIGINT) AS parts
    FROM customer GROUP BY c_mktsegment, c_nationkey
    """,
)
def csv_single_part_export(spark: SparkSession, folder: str) -> DataFrame:
    """A small summary of the whole table as one CSV part."""
    path = scratch_path(spark, "csv")
    customers = table(spark, folder, "customer")
    write_csv(customers.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("rows")), path, parts=1)
    back = read_csv(spark, path)
    parts = back.select(F.input_file_name().alias("f")).distinct().count()
    return back.withColumn("parts", F.lit(parts).cast("long"))


@query(
    "csv_text_roundtrip",
    """
    SELECT doc_id, text || ' "' AS text, nullif(lang, 'en') AS lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || source END AS source
    FROM documents
    """,
)
def csv_text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas, blanks, line breaks, empty and missing cells come back as written."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat("text", F.lit(' "')).alias("text"), F.nullif("lang", F.lit("en")).alias("lang"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "source")).alias("source"),
    )
    path = scratch_path(spark, "csv")
    write_csv(docs, path, missing="NA")
    return read_csv(spark, path, schema=docs.schema, missing="NA", multiline=True)


@query(
    "csv_default_roundtrip",
    """
    SELECT doc_id, text, nullif(lang, 'en') AS lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source,
           nullif(n_chars % 7, 3) AS number
    FROM documents
    """,
)
def csv_default_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Without any marker, empty text and NULL come back as what they were."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"),
        F.nullif(F.col("n_chars") % 7, F.lit(3)).alias("number"),
    )
    path = scratch_path(spark, "csv")
    write_csv(docs, path)
    return read_csv(spark, path, schema=docs.schema, multiline=True)


@query(
    "csv_bad_lines",
    """
    WITH t AS (SELECT *, c_custkey % 50 AS k FROM customer)
    SELECT c_nationkey, count(*) AS "rows", CAST(sum(c_custkey) AS BIGINT) AS key_sum, CAST(0 AS BIGINT) AS bad, '' AS "first"
    FROM t WHERE k NOT IN (7, 9, 11) GROUP BY c_nationkey
    UNION ALL
    SELECT NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*),
           min(CASE k WHEN 7 THEN 'x' || c_custkey || ',' || c_nationkey || ',' || c_mktsegment
                      WHEN 9 THEN c_custkey || ',' || c_nationkey || ',' || c_mktsegment || ',more' ELSE CAST(c_custkey AS VARCHAR) END)
    FROM t WHERE k IN (7, 9, 11)
    """,
)
def csv_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a number that is none, a cell too many or too few are set apart and counted."""
    kind, cells = F.col("c_custkey") % 50, F.concat_ws(",", "c_custkey", "c_nationkey", "c_mktsegment")
    line = F.when(kind == 7, F.concat(F.lit("x"), cells)).when(kind == 9, F.concat(cells, F.lit(",more")))
    line = line.when(kind == 11, F.col("c_custkey").cast("string")).otherwise(cells)
    path = scratch_path(spark, "lines")
    table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    declared = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").schema
    scan = read_csv_split(spark, path, declared, header=False)
    none = F.lit(0).cast("long")
    good = scan.good.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("key_sum"))
    bad = scan.bad.agg(F.count(F.lit(1)).alias("bad"), F.min("line").alias("first"))
    return good.select("*", none.alias("bad"), F.lit("").alias("first")).unionByName(
        bad.select(F.lit(None).cast(declared["c_nationkey"].dataType).alias("c_nationkey"), none.alias("rows"), none.alias("key_sum"), "bad", "first")
    )


def fact_sql(ids: str, seed: int, others: str = "") -> str:
    """The fact table in SQL for the relation ``ids`` with ``id``; ``others`` are more of its columns, each with a comma before."""
    *added, high = round_constants(seed)
    prime = WORD_PRIME
    rows = f"SELECT *, (id % {prime} + (id // {prime}) % {prime} * {high}) % {prime} AS s0 FROM ({ids})"
    for n, constant in enumerate(added):
        x = f"((s{n} + {constant}) % {prime})"
        rows = f"SELECT *, {x} * {x} % {prime} * {x} % {prime} AS s{n + 1} FROM ({rows})"
    a, b, c = (f"s{n}" for n in range(len(added) - 2, len(added) + 1))
    cells = []
    for draw, (name, bounds) in enumerate(FACT_RANGES.items(), start=1):
        if bounds is None:
            cells.append(f'CAST(id AS BIGINT) AS "{name}"')
            continue
        low, top = bounds
        drawn = f"{a} + {b} * {draw} + {c} * {draw**2}"
        cells.append(f'CAST({low} + ({drawn}) % {top - low + 1} AS BIGINT) AS "{name}"')
    cells.append(f"'FALSE' AS \"{FACT_FLAG}\"")
    return f"SELECT {', '.join(cells)}{others} FROM ({rows})"


def own_draws_sql(ids: str, seed: int) -> str:
    """The fact table in SQL with a draw for every cell: four draws per digest, in column order."""
    cells, drawn = [], 0
    for name, bounds in FACT_RANGES.items():
        if bounds is None:
            cells.append(f'CAST(id AS BIGINT) AS "{name}"')
            continue
        low, high = bounds
        block, slot = divmod(drawn, SLOTS)
        digits = f"substr(md5(concat(id, ':{block}:', '{seed}')), {8 * slot + 1}, 8)"
        cells.append(f"CAST({low} + CAST('0x' || {digits} AS BIGINT) % {high - low + 1} AS BIGINT) AS \"{name}\"")
        drawn += 1
    cells.append(f"'FALSE' AS \"{FACT_FLAG}\"")
    return f"SELECT {', '.join(cells)} FROM ({ids})"


@query("synthetic_fact", fact_sql("SELECT o_orderkey AS id FROM orders", 11))
def synthetic_fact(spark: SparkSession, folder: str) -> DataFrame:
    return facts_for(table(spark, folder, "orders"), "o_orderkey", seed=11)


@query(
    "synthetic_fact_sized",
    f"""
    SELECT "PRODUCT_ID", count(*) AS "rows", CAST(sum("CUSTOMER_ID") AS BIGINT) AS customer_sum,
           CAST(sum("TOTAL_AMOUNT") AS BIGINT) AS amount, max("MARKET_ID") AS last_market
    FROM ({own_draws_sql("SELECT range AS id FROM range((SELECT count(*) FROM lineitem))", 11)}) GROUP BY "PRODUCT_ID"
    """,
)
def synthetic_fact_sized(spark: SparkSession, folder: str) -> DataFrame:
    """As many generated rows as there are line items."""
    facts = generate_facts(spark, table(spark, folder, "lineitem").count(), seed=11, own_draws=True)
    return facts.groupBy("PRODUCT_ID").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("CUSTOMER_ID").alias("customer_sum"),
        F.sum("TOTAL_AMOUNT").alias("amount"),
        F.max("MARKET_ID").alias("last_market"),
    )


@query(
    "object_append_read",
    """
    SELECT o_orderstatus, count(*) AS "rows", CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 0) GROUP BY o_orderstatus
    """,
)
def object_append_read(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads into one table, each count-checked and key-checked, then a full scan."""
    orders, store = table(spark, folder, "orders"), scratch_table(spark, "orders")
    append(orders, store, "whole", keys=["o_orderkey"], schema=orders.schema)
    append(orders.filter(F.col("o_orderkey") % 2 == 0), store, "even", keys=["o_orderkey"])
    stored = read_object(spark, store, orders.schema)
    return stored.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "object_read_n",
    """
    SELECT count(*) // 2 AS written, count(*) // 4 AS read, count(*) // 4 AS distinct_keys FROM orders
    """,
)
def object_read_n(spark: SparkSession, folder: str) -> DataFrame:
    """Append the first half of the rows, read half of those back, count-checked both ways."""
    orders, store = table(spark, folder, "orders"), scratch_table(spark, "orders")
    n = orders.count()
    sent = append_first(orders, store, n // 2)
    back = read_rows(spark, store, n // 4, orders.schema)
    per_key = back.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(sent.rows).cast("long").alias("written"),
        F.sum("n").alias("read"),
        F.count(F.lit(1)).alias("distinct_keys"),
    )


@query(
    "object_retried_load",
    'SELECT l_returnflag, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY 1',
)
def object_retried_load(spark: SparkSession, folder: str) -> DataFrame:
    """A load sent twice under one name is there once."""
    lines, store = table(spark, folder, "lineitem"), scratch_table(spark, "lines")
    for _ in range(2):
        append(lines, store, "nightly")
    stored = read_object(spark, store, lines.schema)
    return stored.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"))


@query(
    "object_keys_across_loads",
    """
    SELECT o_orderstatus, count(*) AS "rows", CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
           (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 7 = 2) AS refused
    FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderstatus
    """,
)
def object_keys_across_loads(spark: SparkSession, folder: str) -> DataFrame:
    """A load whose keys the table holds is refused as a whole; its own retry and new keys are not."""
    orders, store = table(spark, folder, "orders"), scratch_table(spark, "orders")
    part = F.col("o_orderkey") % 3
    keyed = {"keys": ["o_orderkey"], "whole_table": True}
    append(orders.filter(part == 1), store, "one", **keyed)
    append(orders.filter(part == 1), store, "one", **keyed)
    mixed = orders.filter((part == 2) | (F.col("o_orderkey") % 7 == 2)).filter(part != 0)
    refused = 0
    try:
        append(mixed, store, "two", **keyed)
    except ValueError as error:
        refused = int(str(error).split()[0])
    append(orders.filter(part == 2), store, "two", **keyed)
    stored = read_object(spark, store, orders.schema)
    return stored.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum"), F.lit(refused).cast("long").alias("refused")
    )


@query(
    "load_report",
    """
    WITH k AS (SELECT l_orderkey, nullif(l_linenumber, 7) AS line, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT CAST(sum(n) AS BIGINT) AS "rows",
           CAST(coalesce(sum(n) FILTER (WHERE line IS NULL), 0) AS BIGINT) AS null_keys,
           CAST(coalesce(sum(n - 1) FILTER (WHERE line IS NOT NULL), 0) AS BIGINT) AS duplicate_keys
    FROM k
    """,
)
def line_load_report(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("line"))
    return load_report(lines, ["l_orderkey", "line"])
