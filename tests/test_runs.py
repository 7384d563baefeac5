"""Run analytics on a small suite with known runs."""

import pytest
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import runs as ops
from tallymill.operators.report import report
from tallymill.sources.tables import append_rows, explode_paths

TIMES = {"load": 2, "sort": 4, "join": 3}
DAY = 86_400
FIRST = 1_704_067_200  # 2024-01-01


def suite_runs(suite, start, times, failed=0, first_id=0):
    rows = []
    for bench, n in times.items():
        for k in range(n):
            rows.append((first_id + len(rows), suite, f"{suite}_{start}", bench,
                         start + 60 * len(rows), 30.0 * (k + 1), failed))
    return rows


@pytest.fixture(scope="module")
def history(spark):
    """20 nightly runs of one suite; join is new since the tenth."""
    rows = []
    for day in range(20):
        times = TIMES if day >= 10 else {"load": 2, "sort": 4}
        rows += suite_runs("Nightly", FIRST + day * DAY, times, first_id=len(rows))
    rows += suite_runs("Other", FIRST, {"load": 2}, failed=1, first_id=len(rows))
    return spark.createDataFrame(rows, schemas.RUNS)


def test_run_counts(spark):
    runs = spark.createDataFrame(suite_runs("Weekly", FIRST, TIMES), schemas.RUNS)
    uid = f"Weekly_{FIRST}"
    expected = spark.createDataFrame(
        [(uid, "Weekly", b, n) for b, n in TIMES.items()],
        "suite_uid string, suite_id string, bench_id string, times int",
    )
    assert runs.count() == 9
    assert ops.count_violations(runs, expected).count() == 0
    short = ops.count_violations(runs.where("run_id <> 2"), expected).collect()
    assert [(r.bench_id, r.times, r.n) for r in short] == [("sort", 4, 3)]
    gone = ops.count_violations(runs.where("bench_id <> 'load'"), expected).collect()
    assert [(r.bench_id, r.times, r.n) for r in gone] == [("load", 2, 0)]
    extra = ops.count_violations(runs, expected.where("bench_id <> 'join'")).collect()
    assert [(r.bench_id, r.times, r.n) for r in extra] == [("join", 0, 3)]


def test_logs_of_the_suite(spark, path):
    runs = spark.createDataFrame(suite_runs("Weekly", FIRST, TIMES), schemas.RUNS)
    paths = F.create_map(F.lit("engine"), F.lit("p1"), F.lit("store"), F.lit("p2"))
    logs = append_rows(
        explode_paths(runs.withColumn("log_paths", paths)), path(), ["run_id", "system"]
    )
    assert logs.count() == 18
    assert ops.with_logs(runs, logs).count() == 18


def test_failing_suite(spark):
    rows = suite_runs("Weekly", FIRST, {"join": 3}, failed=1)
    grid = ops.with_status(ops.suite_grid(spark.createDataFrame(rows, schemas.RUNS), "Weekly"))
    assert [(r.status, r.run_minutes) for r in grid.collect()] == [("failed", None)] * 3


def test_lookup(history):
    uid = f"Nightly_{FIRST + 3 * DAY}"
    assert ops.runs_of(history, uid, "sort").count() == 4
    assert ops.runs_of(history, uid, "sort", "Nightly").count() == 4
    assert ops.runs_of(history, uid, "sort", "Other").count() == 0


def test_latest(history):
    latest = [r.suite_uid for r in ops.latest_runs(history, "Nightly").collect()]
    assert latest == [f"Nightly_{FIRST + day * DAY}" for day in range(5, 20)]
    assert [r.bench_id for r in ops.benchmarks_of(history, "Nightly").collect()] == sorted(TIMES)
    per_suite = ops.latest_runs_per_suite(history, 3).groupBy("suite_id").count().collect()
    assert {r.suite_id: r["count"] for r in per_suite} == {"Nightly": 3, "Other": 1}


def test_grid_fills_gaps(history):
    grid = ops.with_status(ops.suite_grid(history, "Nightly"))
    rows = grid.collect()
    assert len(rows) == 15 * 6 + 10 * 3 + 5  # five of the shown nights lack join
    gaps = [r for r in rows if r.status == "no data"]
    assert {(r.suite_uid, r.bench_id, r.duration, r.failed) for r in gaps} == {
        (f"Nightly_{FIRST + day * DAY}", "join", 0.0, -1) for day in range(5, 10)
    }
    assert {r.run_minutes for r in gaps} == {None}
    assert {r.run_minutes for r in rows if r.bench_id == "load"} == {0.5, 1.0}


def test_grid_of_one_benchmark_and_of_no_runs(history):
    assert ops.suite_grid(history, "Other").count() == 2
    assert ops.suite_grid(history, "Missing").count() == 0


def test_grid_with_unknown_duration(spark):
    runs = spark.createDataFrame([(1, "s", "s_1", "b", 0, None, 0)], schemas.RUNS)
    assert ops.suite_grid(runs, "s").first().duration == 0.0
    assert ops.with_duration_text(runs).first().took is None


def test_slots(history):
    rows = ops.with_slots(history).where("suite_id = 'Nightly'").collect()
    third = sorted((r.pos, r.width, r.x) for r in rows
                   if r.suite_uid == f"Nightly_{FIRST + 2 * DAY}" and r.bench_id == "sort")
    assert [x for _, _, x in third] == [4.0] * 4
    assert [w for _, w, _ in third] == [0.375] * 4
    assert [p for p, _, _ in third] == pytest.approx([4.25, 4.625, 5.0, 5.375])
    narrow = ops.with_slots(history, step=1.0).where("suite_id = 'Other'").collect()
    assert sorted((r.x, r.width, r.pos) for r in narrow) == [(0.0, 0.5, 0.0), (0.0, 0.5, 0.5)]


def test_labels_and_texts(spark):
    runs = spark.createDataFrame(
        [(1, "a_b", f"a_b_{FIRST + DAY}", "x", FIRST + 3_661, 3_725.9, 0)], schemas.RUNS
    )
    row = ops.with_duration_text(ops.with_label(runs)).first()
    assert (row.label, row.took, row.started) == (
        "02.01.2024", "1 hours, 2 minutes, 5 seconds", "01.01.2024 01:01:01"
    )
    named = ops.with_suite_uid(runs.drop("suite_uid"), "suite_id", F.col("start_time")).first()
    assert named.suite_uid == f"a_b_{FIRST + 3_661}"


def test_last_phase_and_defaults(spark):
    timings = spark.createDataFrame(
        [(1, "Setup", 5, 1.0, 0), (1, "Benchmark", 10, 2.0, 1), (1, "Benchmark", 20, 3.0, 2), (2, "Setup", 7, 4.0, 3)],
        "run int, phase string, start bigint, took double, seq int",
    )
    phases = ops.last_phase(timings, "run", "phase", "start", "took", "seq")
    assert {tuple(r) for r in phases.collect()} == {
        (1, "Setup", 5, 1.0), (1, "Benchmark", 20, 3.0), (2, "Setup", 7, 4.0)
    }
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    main = ops.main_phase_or_zero(runs, phases, "Benchmark")
    assert {tuple(r) for r in main.collect()} == {(1, 20, 3.0), (2, 0, 0.0), (3, 0, 0.0)}


def test_ordered_union(spark):
    schema = "k string, pr int"
    lists = [[("b", 1), ("a", 2)], [("b", 1), ("c", 0)], [("a", 2), ("d", 1)]]
    out = ops.ordered_union([spark.createDataFrame(x, schema) for x in lists], "k", "pr")
    assert {r.k: r.idx for r in out.collect()} == {"c": 0, "b": 1, "d": 2, "a": 3}


def test_report(spark):
    runs = spark.createDataFrame(suite_runs("S", FIRST, {"T": 2}), schemas.RUNS)
    uid = f"S_{FIRST}"
    own = spark.createDataFrame(
        [(uid, 1, "Shutdown", FIRST + 9, 61.0), (uid, 0, "Setup", FIRST, 5.5)],
        "suite_uid string, seq int, phase string, start_time bigint, duration double",
    )
    phases = spark.createDataFrame(
        [(uid, "T", 0, 2, "Shutdown", FIRST + 40, 1.0), (uid, "T", 0, 0, "Setup", FIRST, 2.0),
         (uid, "T", 0, 1, "Benchmark", FIRST + 2, None), (uid, "T", 1, 0, None, None, 3.0)],
        "suite_uid string, bench_id string, run_id bigint, seq int, phase string, start_time bigint, duration double",
    )
    parts = report(runs, phases, own, per_part=3).orderBy("section", "part").collect()
    assert [(r.section, r.part) for r in parts] == [("", -1), ("", 0), ("T", -1), ("T", 0), ("T", 1)]
    whole = "".join(r.report for r in parts)
    assert whole == (
        f"Cluster suite {uid}\n\n"
        "Setup\n01.01.2024 00:00:00\n0 hours, 0 minutes, 5 seconds\n\n"
        "Shutdown\n01.01.2024 00:00:09\n0 hours, 1 minutes, 1 seconds\n\n"
        "T:\n\n"
        "Setup\n01.01.2024 00:00:00\n0 hours, 0 minutes, 2 seconds\n\n"
        "Benchmark\n01.01.2024 00:00:02\nno data\n\n"
        "Shutdown\n01.01.2024 00:00:40\n0 hours, 0 minutes, 1 seconds\n\n"
        "no data\nno data\n0 hours, 0 minutes, 3 seconds\n\n"
    )
    assert "".join(r.report for r in report(runs, phases).orderBy("section", "part").collect()) == (
        whole.split("Setup")[0] + "T:" + whole.split("T:")[1]
    )


def test_times_as_text_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(1, None, FIRST + 3_661), (2, None, -1), (3, None, None)], "run_id int, duration double, start_time bigint")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = {r.run_id: r.started for r in ops.with_duration_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows == {1: "01.01.2024 01:01:01", 2: "31.12.1969 23:59:59", 3: None}
