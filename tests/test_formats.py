import datetime
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import compare as comparing
from tallymill.operators.compare import compare, row_differences
from tallymill.sources import tables
from tallymill.sources.text import read_text, write_text


@pytest.fixture(scope="module")
def items(spark, small):
    return tables.read_table(spark, small, "lineitem")


def test_delimited_round_trip(spark, items, path):
    csv = tables.read_delimited(spark, tables.write_delimited(items, path()), schemas.LINEITEM)
    assert csv.schema == schemas.LINEITEM
    assert row_differences(items, csv).count() == 0


def test_delimited_keeps_every_value(spark, path):
    texts = [None, "", " a ", "a|b", 'say "x"', "two\nlines\r\n", "\\n", "\\\\N", "\\N", "\\", "#", "é\t😀"]
    rows = [(i, t, datetime.datetime(2024, 1, 1, 3, 2, 3, 123456), 0.1 + i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, s string, t timestamp_ntz, x double")
    df = df.withColumn("z", F.col("t").cast("timestamp"))
    back = tables.read_delimited(spark, tables.write_delimited(df, path()), df.schema)
    assert row_differences(df, back).count() == 0


def test_delimited_row_that_does_not_fit(spark, path):
    file = path()
    spark.createDataFrame([("1|x",)], "value string").write.text(file)
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_delimited(spark, file, "a int, b int").collect()


@pytest.mark.parametrize("fmt", ["orc", "parquet"])
def test_convert(items, path, fmt):
    copy = tables.convert(items, path(), fmt)
    assert copy.dtypes == items.dtypes
    assert row_differences(items, copy).count() == 0


def test_convert_to_a_missing_format(items, path):
    with pytest.raises(ValueError, match="class path"):
        tables.convert(items, path(), "avro")


def test_result_modes(spark, path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    out = path()
    assert tables.write_result(df, out, partition_by=["k"]).columns == ["n", "k"]
    with pytest.raises(AnalysisException):
        tables.write_result(df, out)
    again = tables.write_result(df.where("n = 1"), out, mode="overwrite")
    assert [tuple(r) for r in again.collect()] == [(1, "a")]


def test_text_round_trip(spark, path):
    texts = ["a", "", "carriage\rreturn", "ünïcode", " spaces "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = read_text(spark, write_text(df, "t", path()))
    assert sorted(r.value for r in back.collect()) == sorted(texts)


def runs(spark, ids, suite="s"):
    rows = [(i, f"{suite}{i % 3}", f"{suite}{i % 3}_1", "b", 0, 1.0 * i, 0) for i in ids]
    return spark.createDataFrame(rows, schemas.RUNS)


def test_append_is_idempotent(spark, path):
    table = path()
    tables.append_rows(runs(spark, range(10)), table, ["run_id"], ["suite_id"])
    tables.append_rows(runs(spark, range(5, 15)), table, ["run_id"], ["suite_id"])
    out = tables.append_rows(runs(spark, range(5, 15)), table, ["run_id"], ["suite_id"])
    assert sorted(r.run_id for r in out.collect()) == list(range(15))
    assert out.columns == schemas.RUNS.fieldNames()


def test_append_drops_repeats_within_the_new_rows(spark, path):
    twice = runs(spark, [1, 2]).unionByName(runs(spark, [2, 3]))
    out = tables.append_rows(twice, path(), ["run_id"])
    assert sorted(r.run_id for r in out.collect()) == [1, 2, 3]


def test_append_by_two_partition_columns(spark, path):
    """The partition belongs to the key: only the same key in the same partition is
    a repeat, whatever else is stored."""
    schema, table = "k int, a int, b string, v int", path()
    tables.append_rows(spark.createDataFrame([(7, 1, "y", 0)], schema), table, ["k"], ["a", "b"])
    fresh = [(7, 1, "x", 5), (7, 1, "y", 9), (7, None, "y", 3), (7, 1, "x", 4)]
    for _ in range(2):
        out = tables.append_rows(spark.createDataFrame(fresh, schema), table, ["k"], ["a", "b"])
        assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(
            [(7, 1, "x", 4), (7, 1, "y", 0), (7, None, "y", 3)], key=str
        )


def test_two_writers_store_a_key_once(spark, path, monkeypatch):
    """Another writer finishes between a writer's look at the table and its commit."""
    table, plain, tries = path(), tables._committed, []

    def beaten(spark_, staged, place):
        tries.append(place)
        if len(tries) == 1:
            tables.append_rows(runs(spark, range(5, 15)), table, ["run_id"], ["suite_id"])
        return plain(spark_, staged, place)

    monkeypatch.setattr(tables, "_committed", beaten)
    out = tables.append_rows(runs(spark, range(10)), table, ["run_id"], ["suite_id"])
    assert sorted(r.run_id for r in out.collect()) == list(range(15))
    assert [t.rpartition("/")[2] for t in tries] == ["_commit=0", "_commit=0", "_commit=1"]
    assert not list(Path(table).glob("_staged*"))
    assert sorted(r.run_id for r in spark.read.parquet(table).collect()) == list(range(15))


def test_threads_that_append_the_same_rows(spark, path):
    table = path()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: tables.append_rows(runs(spark, range(20)), table, ["run_id"]), range(4)))
    assert sorted(r.run_id for r in tables.read_appended(spark, table, schemas.RUNS).collect()) == list(range(20))


def test_what_was_not_committed_is_not_seen(spark, path):
    table = path()
    tables.append_rows(runs(spark, range(3)), table, ["run_id"], ["suite_id"])
    runs(spark, range(9)).write.partitionBy("suite_id").parquet(f"{table}/_staged-of-a-dead-job")
    out = tables.append_rows(runs(spark, [2, 3]), table, ["run_id"], ["suite_id"])
    assert sorted(r.run_id for r in out.collect()) == [0, 1, 2, 3]


def test_a_partition_gets_few_files(spark, path):
    table = path()
    many = runs(spark, range(600)).repartition(60)
    tables.append_rows(many, table, ["run_id"], ["suite_id"])
    files = [f.parent.name for f in Path(table).rglob("*.parquet")]
    assert len(files) == 3 == len(set(files))


def test_append_lists_partitions_in_between_only(spark, path):
    table = path()
    stored = tables.append_rows(runs(spark, range(9)), table, ["run_id"], ["suite_id"])
    within = tables._within(stored, runs(spark, [0, 3]), ["suite_id"])
    plan = within._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(suite_id" in plan and "(suite_id#" in plan


def test_compare_equal(items):
    rows = compare(items, items.repartition(3)).collect()
    assert all(r.same for r in rows)
    by_name = {r.check: r for r in rows}
    assert by_name["rows"].left_value == items.count()
    assert by_name["only_here"].right_value == 0


def test_compare_finds_differences(spark):
    schema = "k int, x double, s string, d date"
    day = datetime.date(2024, 1, 1)
    left = spark.createDataFrame([(1, 1.5, "a", day)] * 3 + [(2, None, None, None)], schema)
    right = spark.createDataFrame([(1, 1.5, "a", day)] * 2 + [(2, None, None, None), (3, 0.1, "b", day)], schema)
    found = {r.k: r.surplus for r in row_differences(left, right).collect()}
    assert found == {1: 1, 3: -1}
    checks = {r.check: (r.left_value, r.right_value, r.same) for r in compare(left, right).collect()}
    assert checks["only_here"] == (1, 1, False)
    assert checks["rows"] == (4, 4, True)
    assert checks["min:k"] == (1, 1, True) and checks["max:k"] == (2, 3, False)
    assert checks["min:x"] == (1.5, 0.1, False)
    assert checks["chars:s"] == (3, 3, True)
    assert checks["non_null:s"] == (3, 3, True)
    assert checks["days:d"] == (19723 * 3, 19723 * 3, True)


def test_only_differing_buckets_are_shuffled(spark, items, monkeypatch):
    """Equal copies are never counted row by row; of unequal ones few buckets are, and
    the counts are exact, nulls, zeros of both signs and repeated rows included."""
    asked = []
    plain = comparing.differing_rows

    def noted(left, right, buckets):
        asked.append(buckets)
        return plain(left, right, buckets)

    monkeypatch.setattr(comparing, "differing_rows", noted)
    assert all(r.same for r in compare(items, items.orderBy("l_extendedprice")).collect()) and asked == []
    rows = [(i % 50, None if i % 7 else 0.0, f"s{i % 9}") for i in range(3_000)] + [(1, 0.0, "z")] * 900
    left = spark.createDataFrame(rows, "k int, x double, s string")
    change = rows[5:] + [rows[0], rows[0], (99, None, "new"), (None, None, None)]
    right = spark.createDataFrame(change, left.schema)
    found = {r.check: r for r in compare(left, right).collect()}["only_here"]
    a, b = Counter(rows), Counter(change)
    assert (found.left_value, found.right_value) == (sum((a - b).values()), sum((b - a).values())) and not found.same
    assert len(asked) == 1 and len(asked[0]) <= 8
    signs = [spark.createDataFrame([(z,)], "x double") for z in (0.0, -0.0)]
    assert all(r.same for r in compare(*signs).collect())


def test_compare_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, s string")
    assert all(r.same for r in compare(empty, empty).collect())

