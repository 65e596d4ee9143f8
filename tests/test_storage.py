from __future__ import annotations

import gc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.checks import CountMismatch, check_load, check_schema, fingerprint, known_keys, load_report
from tablewright.operators.ranking import first_rows
from tablewright.plans.roundtrip import geometric_series, round_trip, run_volumes, shape_for_store, volume_grid
from tablewright.schemas import FACTS, FLOWERS, RUN_STATS, VOLUME_COLUMNS
from tablewright import session
from tablewright.session import drop_scratch, scratch_path, scratch_root, written
from tablewright.sinks.objects import append, append_first
from tablewright.sinks.stats import grouped_runs, long_form, read_stats, write_stats
from tablewright.sinks.text import write_csv
from tablewright.sources.facts import generate_facts
from tablewright.sources.objects import ObjectTable, read_object, read_rows
from tablewright.sources.text import read_csv, read_csv_for_store, read_csv_split
from tests.conftest import plan, rows


@pytest.fixture
def store(folder):
    return ObjectTable(folder, "group", "app", "thing")


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_csv_types(spark, folder):
    df = spark.createDataFrame([(1, 1.5, False, "x"), (2, None, True, None)], "i int, d double, b boolean, s string")
    write_csv(df, folder + "/t", missing="NA")
    assert kinds(read_csv(spark, folder + "/t", missing="NA")) == {"i": "int", "d": "double", "b": "boolean", "s": "string"}
    assert rows(read_csv(spark, folder + "/t", missing="NA")) == rows(df)
    assert set(kinds(read_csv(spark, folder + "/t", infer=False)).values()) == {"string"}
    assert kinds(read_csv(spark, folder + "/t"))["d"] == "string"
    assert rows(read_csv(spark, folder + "/t", schema=df.schema, missing="NA")) == rows(df)


def test_csv_modes(spark, folder):
    df = spark.range(5)
    for _ in range(2):
        write_csv(df, folder + "/grown")
        write_csv(df, folder + "/replaced", mode="overwrite")
    assert read_csv(spark, folder + "/grown").count() == 10
    assert read_csv(spark, folder + "/replaced").count() == 5


def test_parts_are_what_was_asked_for(spark, folder):
    write_csv(spark.range(100).repartition(4), folder + "/one", parts=1)
    assert len(spark.read.csv(folder + "/one").inputFiles()) == 1


def test_csv_returns_what_was_written(spark, folder):
    texts = [' lead and trail ', '', None, 'say "hi", ok', 'two\nlines', 'back\\slash', '\\"', 'NA ', "'", '"', ',']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    write_csv(df, folder + "/t", missing="NA")
    assert rows(read_csv(spark, folder + "/t", schema=df.schema, missing="NA", multiline=True)) == rows(df)


def test_csv_tells_empty_text_from_missing_without_a_marker(spark, folder):
    df = spark.createDataFrame([(1, "", "x"), (None, None, ""), (3, "a", None), (4, "NULL", '""')], "i int, s string, t string")
    write_csv(df, folder + "/t")
    for back in (read_csv(spark, folder + "/t"), read_csv(spark, folder + "/t", schema=df.schema)):
        assert rows(back) == rows(df) and kinds(back) == kinds(df)
    assert rows(read_csv(spark, folder + "/t", infer=False))[0] == ("1", "", "x")


@pytest.mark.parametrize("text, missing", [("NA", "NA"), ("\x01empty\x01", None)])
def test_text_that_reads_as_a_marker_is_refused(spark, folder, text, missing):
    df = spark.createDataFrame([("fine",), (text,)], "s string")
    with pytest.raises(Exception, match="stands for a missing or empty one"):
        write_csv(df, folder + "/t", missing=missing)


def test_quoted_empty_cells_do_not_make_numbers_text(spark, folder):
    with open(folder + "/t.csv", "w") as out:
        out.write('"a","b"\n"1",""\n"","x"\n')
    df = read_csv(spark, folder + "/t.csv")
    assert kinds(df) == {"a": "int", "b": "string"} and rows(df) == [(1, ""), (None, "x")]


def test_bad_lines_are_set_apart(spark, folder):
    with open(folder + "/t.csv", "w") as out:
        out.write('a,b\n1,x\ny,z\n3\n4,"",5\n,""\n"",q\n6,\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    scan = read_csv_split(spark, folder + "/t.csv", schema)
    assert rows(scan.good) == [(1, "x"), (6, None), (None, "")]
    assert sorted(r.line for r in scan.bad.collect()) == ['"",q', "3", '4,"",5', "y,z"]
    assert {r.file.rsplit("/", 1)[1] for r in scan.bad.collect()} == {"t.csv"}
    marked = read_csv_split(spark, folder + "/t.csv", schema, missing="x")
    assert (1, None) in rows(marked.good) and marked.good.count() + marked.bad.count() == 7


def test_csv_of_other_tools(spark, folder):
    with open(folder + "/t.csv", "w") as out:
        out.write('a,b,c\n1,"say ""hi"", ok",x\n2,"one\ntwo",NA\n')
    df = read_csv(spark, folder + "/t.csv", missing="NA", multiline=True)
    assert rows(df) == [(1, 'say "hi", ok', "x"), (2, "one\ntwo", None)]


def test_loads_of_other_columns(spark, store):
    append(spark.range(2), store)
    wide = spark.range(2, 4).withColumn("extra", F.lit("x"))
    for wrong in (wide, spark.range(2).select(F.col("id").cast("int")), spark.range(2).withColumnRenamed("id", "other")):
        with pytest.raises(ValueError, match="columns differ"):
            append(wrong, store)
    append(wide, store, widen=True)
    assert rows(read_object(spark, store)) == [(0, None), (1, None), (2, "x"), (3, "x")]
    with pytest.raises(ValueError, match="schema"):
        append(spark.range(2), store, schema=wide.schema)


def test_columns_are_checked_against_a_stored_schema(spark, store, monkeypatch):
    append(spark.range(2), store)
    from tablewright.sinks import objects

    def no_scan(*_):
        raise AssertionError("footers of all loads were read")

    monkeypatch.setattr(objects, "read_object", lambda spark, table, schema=None, load=None: read_object(spark, table, schema, load) if schema else no_scan())
    append(spark.range(2), store)
    with pytest.raises(ValueError, match="columns differ"):
        append(spark.range(2).toDF("x"), store)
    append(spark.range(2).withColumn("x", F.lit(1)), store, widen=True)
    append(spark.range(2).withColumn("x", F.lit(1)), store)
    with pytest.raises(ValueError, match="columns differ"):
        append(spark.range(2), store)


def test_keys_of_other_loads_are_refused(spark, store):
    append(spark.range(0, 50_000, 2), store, "even", keys=["id"], whole_table=True)
    append(spark.range(0, 50_000, 2), store, "even", keys=["id"], whole_table=True)
    with pytest.raises(ValueError, match="3 keys are in the table"):
        append(spark.createDataFrame([(i,) for i in (1, 3, 0, 8, 49_998)], "id long"), store, keys=["id"], whole_table=True)
    append(spark.range(1, 50_000, 2), store, "odd", keys=["id"], whole_table=True)
    assert read_object(spark, store).count() == 50_000


def test_keys_meet_the_table_behind_a_filter(spark, folder):
    spark.range(100_000).select("id", F.lit("x").alias("v")).write.parquet(folder + "/t")
    table = spark.read.parquet(folder + "/t")
    load = spark.createDataFrame([(5, None), (-1, "a"), (None, "b"), (99_999, "c")], "id long, v string")
    found = known_keys(table, load, ["id"])
    assert rows(found) == [(5,), (99_999,)]
    text = plan(found)
    scan = text[text.index("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in scan.split("FileScan")[0].split("BroadcastExchange")[0]
    assert rows(known_keys(table, load, ["id", "v"])) == []
    many = known_keys(table, spark.range(100_000, 200_000).withColumn("v", F.lit("x")), ["id", "v"])
    assert many.count() == 0


def test_first_rows_of_a_column_named_like_a_step(spark):
    scan = written(spark.range(50).withColumnRenamed("id", "Exchange"), "test")
    before = first_rows(scan.filter("Exchange >= 0"), 20)
    assert before.count() == 20 and before.inputFiles() == scan.inputFiles()
    assert first_rows(scan.distinct(), 20).count() == 20


def test_a_column_called_load_stays(spark, store):
    append(spark.range(2).withColumn("load", F.lit("mine")), store)
    assert rows(read_object(spark, store)) == [(0, "mine"), (1, "mine")]


def test_fingerprint_sees_moved_gaps(spark):
    one, two = (spark.createDataFrame(r, "a int, b int") for r in ([(None, 1), (2, 3)], [(1, None), (2, 3)]))
    assert fingerprint(one) != fingerprint(two)


def test_store_columns(spark, folder):
    write_csv(generate_facts(spark, 50), folder + "/facts")
    df = read_csv_for_store(spark, folder + "/facts", "sales", null_id=True)
    shaped = shape_for_store(df, ["sales_id", *VOLUME_COLUMNS])
    assert shaped.columns == ["sales_id", *VOLUME_COLUMNS] and shaped.filter("sales_id IS NULL").count() == 50
    assert kinds(shaped)["is_deleted"] == "boolean" and kinds(shaped)["PRODUCT_ID"] == "int"
    ext = read_csv_for_store(spark, folder + "/facts", "product", external_id=True, schema=FACTS)
    assert ext.columns[0] == "product_external_id" and ext.select("product_external_id").distinct().count() == 50
    assert read_csv_for_store(spark, folder + "/facts", "product").columns == FACTS.names


def test_table_names(folder):
    assert ObjectTable("/r/", "g", "a", "t").path == "/r/g/a/t"
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            ObjectTable(folder, "g", "a", bad)


def test_append_then_read(spark, store):
    first = append(spark.range(10), store)
    second = append(spark.range(3), store, "again")
    assert (first.rows, second.rows, second.load) == (10, 3, "again") and first.seconds > 0
    assert read_object(spark, store).columns == ["id"] and read_object(spark, store).count() == 13
    assert rows(read_object(spark, store, load="again")) == [(0,), (1,), (2,)]
    append(spark.range(3), store, "again")
    assert read_object(spark, store).count() == 13


@pytest.mark.parametrize("name", ["1x", "a/b", "a=b", "a b"])
def test_load_names_that_would_not_survive_a_path(spark, store, name):
    with pytest.raises(ValueError):
        append(spark.range(1), store, name)


def test_first_n_rows_only(spark, store):
    big = written(spark.range(100), "test")
    assert append_first(big, store, 42).rows == 42
    with pytest.raises(CountMismatch):
        append_first(big, store, 101)


def test_reading_more_than_there_is(spark, store):
    append(spark.range(10), store)
    assert read_rows(spark, store, 7).count() == 7
    with pytest.raises(CountMismatch, match="expected 11 rows, found 10"):
        read_rows(spark, store, 11)


def test_load_checks(spark, store):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (None, "d"), (2, "e")], "k int, v string")
    assert tuple(load_report(df, ["k"]).first()) == (5, 1, 2)
    assert tuple(load_report(df.limit(0), ["k"]).first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="1 rows without key, 2 rows repeat a key"):
        append(df, store, keys=["k"])
    assert check_load(df, ["v"]) == 5
    check_schema(df, T.StructType([T.StructField("v", T.StringType(), False), T.StructField("k", T.IntegerType())]))
    with pytest.raises(ValueError, match="'k'"):
        check_schema(df, T.StructType([T.StructField("v", T.StringType()), T.StructField("k", T.LongType())]))
    assert FLOWERS.names[0] == "iris_external_id" and len(FLOWERS) == 7


def test_fingerprint_sees_moved_gaps_of_wide_rows(spark):
    """Gaps of more columns than one long has bits for."""
    wide = spark.range(1).select(*[F.lit(1).alias(f"c{n}") for n in range(130)])
    seen = {fingerprint(wide)}
    for n in (0, 61, 62, 63, 123, 124, 129):
        seen.add(fingerprint(wide.withColumn(f"c{n}", F.lit(None).cast("int"))))
    assert len(seen) == 8


def test_fingerprints_ignore_order_and_see_copies(spark):
    df = spark.range(20)
    assert fingerprint(df) == fingerprint(df.repartition(3).orderBy(F.desc("id")))
    assert fingerprint(df) != fingerprint(df.filter("id != 7"))
    pair = spark.createDataFrame([(1,), (1,)], "id long")
    assert fingerprint(pair) != fingerprint(spark.createDataFrame([(2,), (2,)], "id long"))
    assert fingerprint(df.limit(0)).rows == 0


def test_geometric_series(spark):
    assert rows(geometric_series(spark, 3, 2, 4)) == [(1, 3), (2, 6), (3, 12), (4, 24)]
    assert geometric_series(spark, 3, 2, 0).count() == 0
    assert (60, 10 * 2**59) in rows(geometric_series(spark, 10, 2, 60))
    assert rows(geometric_series(spark, 3, -1, 3)) == [(1, 3), (2, -3), (3, 3)] and rows(geometric_series(spark, 4, 1, 2)) == [(1, 4), (2, 4)]
    with pytest.raises(OverflowError):
        geometric_series(spark, 1, 2, 80)


def test_volume_grid(spark):
    assert volume_grid(spark) == [(1, 10, 0)]
    assert volume_grid(spark, 10, 2, 2) == [(1, 10, 0), (1, 20, 0), (2, 10, 0), (2, 10, 1), (2, 20, 0), (2, 20, 1)]


def test_round_trip_is_not_fooled_by_older_rows(spark, store):
    df = written(generate_facts(spark, 200), "test")
    append(df, store)
    trip = round_trip(df, store, 150)
    assert trip.rows == 150 and trip.write_s > 0 and trip.read_s > 0
    assert read_object(spark, store).count() == 350


def test_round_trip_notices_lost_rows(spark, store, monkeypatch):
    df = written(spark.range(100), "test")
    from tablewright.plans import roundtrip

    short = lambda spark, table, schema, load: read_object(spark, table, schema, load).filter("id % 2 = 0")
    monkeypatch.setattr(roundtrip, "read_object", short)
    with pytest.raises(CountMismatch):
        round_trip(df, store, 50)


def test_run_statistics(spark, store, folder):
    stats = run_volumes(written(spark.range(100), "test"), store, [(1, 10, 0), (2, 20, 0), (2, 20, 1)])
    assert stats.schema == RUN_STATS and stats.filter("write_s > 0 AND read_s > 0").count() == 3
    write_stats(stats, folder + "/stats")
    write_stats(stats, folder + "/stats")
    assert read_stats(spark, folder + "/stats").count() == 6
    again = run_volumes(written(spark.range(100), "test"), store, [(1, 10, 0)])
    grouped = grouped_runs(stats.unionByName(again))
    assert sorted((r.freq, r.record_count, [x.iteration for x in r.runs]) for r in grouped.collect()) == [(1, 10, [0]), (1, 10, [0]), (2, 20, [0, 1])]
    long = long_form(stats)
    assert long.columns == ["combination", "type", "time"]
    assert rows(long.groupBy("combination", "type").count()) == [
        ("(1, 10)", "Read", 1), ("(1, 10)", "Write", 1), ("(2, 20)", "Read", 2), ("(2, 20)", "Write", 2),
    ]


def test_scratch_of_this_application_can_be_dropped(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: folder)
    kept = written(spark.range(5), "test")
    other = folder + "/tablewright/another-application/table"
    spark.range(3).write.parquet(other)
    assert kept.count() == 5 and kept.inputFiles()[0].startswith("file://" + folder)
    drop_scratch(spark)
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(scratch_path(spark, "x").rsplit("/", 1)[0])


def test_tables_that_no_frame_reads_are_removed(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: folder)
    table = written(spark.range(5), "test")
    path = Path(table.inputFiles()[0].removeprefix("file:")).parent
    some = table.filter("id > 1").withColumn("other", F.col("id") + 1)
    del table

    def next_table():
        gc.collect()
        spark._jvm.System.gc()
        return written(spark.range(3), "next").count()

    assert next_table() == 3 and path.exists() and some.count() == 3
    assert next_table() == 3 and path.exists() and some.agg(F.sum("other")).first()[0] == 12
    del some
    for _ in range(5):  # Spark lets go of its last job with the next one
        next_table()
    assert not path.exists()


def test_written_frames_reach_python_in_small_batches(spark):
    """A bound that the session set stays; without one Spark's own is back afterwards."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    def seen():
        return written(texts.mapInArrow(sizes, "rows long, bytes long"), "test").agg(F.sum("rows"), F.max("bytes")).first()

    whole, most = seen()
    assert whole == 2000 and most < 2 << 20
    assert spark.conf.get(bound, None) is None
    spark.conf.set(bound, 4 << 20)
    try:
        whole, most = seen()
        assert whole == 2000 and 3 << 20 < most < 5 << 20
        assert spark.conf.get(bound) == str(4 << 20)
    finally:
        spark.conf.unset(bound)


def test_scratch_paths_are_fresh_and_under_the_configured_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or scratch_root(spark) == configured.rstrip("/")


def test_a_cluster_must_name_its_shared_folder():
    """Only a local master may fall back to a folder of its own machine."""
    from types import SimpleNamespace

    def stub(master, configured=None):
        conf = SimpleNamespace(get=lambda name, default: configured or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert scratch_root(stub("cluster", "/shared/folder/")) == "/shared/folder"
    assert scratch_root(stub("local[2]")) == scratch_root(stub("local[2]")) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(stub("cluster"))
