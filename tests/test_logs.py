import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.operators.logs import failed_flag, flags_from_tree, matches, scan_logs, scan_numbered
from tallymill.sources import logs as log_files
from tallymill.sources.logs import parse_log_path, read_log_lines, scan_log_files

BAD = re.compile("(error|exception)", re.IGNORECASE)


def write_log(folder, uid, bench, attempt, system, name, lines, end="\n"):
    file = Path(folder, "logs", uid, bench, str(attempt), system, name)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("\n".join(lines) + end)
    return file


@pytest.fixture
def tree(tmp_path):
    """One large log, one small one, one empty, one without a last newline."""
    long = [f"line {i} " + ("ERROR" if i % 97 == 0 else "x" * (i % 50)) for i in range(20_000)]
    write_log(tmp_path, "S_1", "Bench", 1, "engine", "engine_coordinator.log", long)
    write_log(tmp_path, "S_1", "Bench", 1, "engine", "engine_worker_3.out", ["ok", "an Exception"])
    write_log(tmp_path, "S_1", "Bench", 2, "store", "store_worker_1.log", [], end="")
    write_log(tmp_path, "S_1", "Other", 1, "store", "store_worker_1.log", ["0 errors"], end="")
    return tmp_path


def brute(tree):
    return {
        (str(f), n, line)
        for f in Path(tree).rglob("*.*")
        for n, line in enumerate(f.read_text().split("\n"))
        if BAD.search(line)
    }


@pytest.mark.parametrize("split", ["134217728", "20000"])
def test_line_numbers_of_split_files(spark, tree, split):
    """The numbers are those of the file, however many tasks read it."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        lines = read_log_lines(spark, str(tree))
        got = {
            (r.path.removeprefix("file:").replace("//", "/"), r.line_no, r.line)
            for r in scan_logs(lines).collect()
        }
        kept = {
            (r.path.removeprefix("file:").replace("//", "/"), r.line_no, r.line)
            for r in read_log_lines(spark, str(tree), matches()).collect()
        }
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == kept == brute(tree)


def test_other_text_is_never_written(spark, tree, monkeypatch):
    """What is stored for numbering holds the matching lines' text only, and a scan
    without numbers stores nothing."""
    stored = []
    plain = log_files.materialize
    monkeypatch.setattr(log_files, "materialize", lambda df, name: stored.append(plain(df, name)) or stored[-1])
    found = read_log_lines(spark, str(tree), matches()).count()
    assert len(stored) == 1 and found == stored[0].where("line is not null").count() == len(brute(tree))
    assert stored[0].count() > 20_000
    assert {(r.path.removeprefix("file:").replace("//", "/"), r.line) for r in scan_logs(scan_log_files(spark, str(tree))).collect()} == {
        (f, line) for f, _, line in brute(tree)
    }
    assert len(stored) == 1


def test_path_keys(spark, tree):
    paths = read_log_lines(spark, str(tree)).select("path").distinct()
    rows = parse_log_path(paths, "path").drop("path").collect()
    assert {tuple(r) for r in rows} == {
        ("S_1", "Bench", 1, "engine", "engine_coordinator.log", "coordinator", "", "log"),
        ("S_1", "Bench", 1, "engine", "engine_worker_3.out", "worker", "3", "out"),
        ("S_1", "Other", 1, "store", "store_worker_1.log", "worker", "1", "log"),
    }
    odd = spark.createDataFrame([("elsewhere/x.txt",), ("results/logs/S_1/B/2/engine",)], "p string")
    rows = {r.p: r for r in parse_log_path(odd, "p").collect()}
    assert rows["elsewhere/x.txt"].attempt is None and rows["elsewhere/x.txt"].system == ""
    assert rows["results/logs/S_1/B/2/engine"].system == "engine"


def test_failed_flag(spark):
    runs = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, 0)], "run_id bigint, failed int")
    lines = spark.createDataFrame(
        [(1, "engine", "fine"), (2, "engine", "an ERROR"), (2, "engine", "again error"),
         (3, "engine", "fine"), (4, "steady", "IOException")],
        "run_id bigint, system string, line string",
    )
    exempt = spark.createDataFrame([("steady",)], "system string")
    out = failed_flag(runs, scan_logs(lines), exempt)
    assert {r.run_id: r.failed for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    none = failed_flag(runs, scan_logs(lines), exempt.where(F.lit(False)))
    assert {r.run_id for r in none.where("failed = 1").collect()} == {2, 3, 4}


def test_flags_from_a_tree(spark, tree):
    """From the files to the runs; runs without logs keep what is stored."""
    rows = [(1, "S_1", "Bench", 1, 0), (2, "S_1", "Bench", 2, 0), (3, "S_1", "Other", 1, 0), (4, "S_2", "B", 1, 1)]
    runs = spark.createDataFrame(rows, "run_id bigint, suite_uid string, bench_id string, attempt int, failed int")
    lines = scan_log_files(spark, str(tree))
    exempt = spark.createDataFrame([("store",)], "system string")
    flags = lambda e: {r.run_id: r.failed for r in flags_from_tree(runs, lines, e).collect()}
    assert flags(exempt) == {1: 1, 2: 0, 3: 0, 4: 1}
    assert flags(exempt.where(F.lit(False))) == {1: 1, 2: 0, 3: 1, 4: 1}


def test_only_matching_text_is_numbered_with_its_line(spark):
    rows = [("f", 10, "x" * 50), ("f", 2**40, "an error"), (None, 5, "ok"), (None, 7, "Exception"), ("f", None, "error 0")]
    df = spark.createDataFrame(rows, "file string, id bigint, line string")
    found = {(r.file, r.line): r.line_no for r in scan_numbered(df, ["file"], "id").collect()}
    assert found == {("f", "error 0"): 0, ("f", "an error"): 2, (None, "Exception"): 1}
