"""The registered queries: operators bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill import schemas
from tallymill.operators import compare as cmp
from tallymill.operators import logs as log_ops
from tallymill.operators import runs as run_ops
from tallymill.operators import wordcount as wc
from tallymill.operators.factorize import factorize, fit_error, with_sides
from tallymill.operators.grep import grep as find_words
from tallymill.operators.report import report
from tallymill.plans import views
from tallymill.sources import generate
from tallymill.sources.logs import parse_log_path, read_log_lines, scan_log_files
from tallymill.sources.scratch import materialize, scratch_path
from tallymill.sources.tables import (
    append_rows,
    convert,
    explode_paths,
    read_delimited,
    read_table,
    write_delimited,
    write_result,
)
from tallymill.sources.text import (
    read_text,
    read_words,
    stream_table,
    stream_text,
    write_text,
    write_words,
)
from tallymill.streaming.drive import drain_with_restarts
from tallymill.streaming.files import stream_copy
from tallymill.streaming.grep import stream_grep
from tallymill.streaming.wordcount import (
    stream_count_windows,
    stream_time_windows,
    stream_word_count,
)

Query = Callable[[SparkSession, str], DataFrame]

TIME_ZONE = "spark.sql.session.timeZone"

# Fixed parameters of the workloads.
GREP_WORDS = ["these", "are", "test", "words"]
WINDOW_SIZE = 100
SUITE = "suite1"
SUITE_UID = "suite1_1704067200"
BENCH = "click"
EXEMPT = "system3"
RUNS_WANTED = 13
MAIN_PHASE = "click-3"
# Root mean square error that ten iterations must stay below, for ratings with a
# variance of 4.
FIT_BOUND = 2.5
# What one batch of a stream reads at most, about.
BATCH_BYTES = 8 << 30
# How late events may come, by event time, behind the newest of earlier batches.
EVENT_DELAY = "1 hour"
# Batches of the restarted search, at least; the fault comes in the last. Its files
# hold so much text, about.
RESTART_BATCHES = 4
FILE_BYTES = 64 << 20

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; plan with UTC as session time zone."""

    @wraps(fn)
    def bound(spark: SparkSession, d: str) -> DataFrame:
        zone = spark.conf.get(TIME_ZONE)
        spark.conf.set(TIME_ZONE, "UTC")
        try:
            return fn(spark, d)
        finally:
            spark.conf.set(TIME_ZONE, zone)

    QUERIES[fn.__name__] = bound
    return bound


# --- generators, sources and sinks ---------------------------------------


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The words of the documents, stored once like a dictionary file."""
    return materialize(views.vocabulary(spark, d), "dictionary")


def _word_lines(spark: SparkSession, d: str) -> DataFrame:
    """One generated line per document."""
    n = read_table(spark, d, "documents").count()
    return generate.gen_word_lines(spark, _dictionary(spark, d), num_lines=n)


@query
def gen_text(spark, d):
    texts = read_table(spark, d, "documents")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    made = generate.gen_text(spark, _dictionary(spark, d), size)
    return read_text(spark, write_text(made, "value", scratch_path(spark, "text")))


@query
def gen_wc_lines(spark, d):
    return _word_lines(spark, d)


@query
def dictionary_normalize(spark, d):
    entries = views.dictionary_entries(spark, d)
    path = write_words(entries, "entry", scratch_path(spark, "dictionary-latin1"))
    return wc.normalize_words(read_words(spark, path, escaped=True), "entry")


@query
def gen_ratings(spark, d):
    users = read_table(spark, d, "customer").count()
    items = read_table(spark, d, "part").count()
    return generate.gen_ratings(spark, users, items, 20, 4, 40, 50)


@query
def gen_lineitem(spark, d):
    scale = read_table(spark, d, "orders").count() / 1_500_000
    made = generate.gen_lineitem(spark, scale)
    path = write_delimited(made, scratch_path(spark, "lineitem-csv"))
    return read_delimited(spark, path, schemas.TPCH_LINEITEM)


@query
def text_source(spark, d):
    return read_text(spark, write_text(views.lines(spark, d), "line", scratch_path(spark, "lines")))


@query
def text_stream_source(spark, d):
    path = write_text(views.lines(spark, d), "line", scratch_path(spark, "text-in"))
    return stream_copy(
        stream_text(spark, path, BATCH_BYTES),
        scratch_path(spark, "text-out"),
        scratch_path(spark, "text-checkpoint"),
    )


def _lineitem_csv(spark: SparkSession, d: str) -> str:
    return write_delimited(views.lineitem(spark, d), scratch_path(spark, "lineitem-csv"))


@query
def lineitem_csv_source(spark, d):
    return read_delimited(spark, _lineitem_csv(spark, d), schemas.LINEITEM)


@query
def result_sink(spark, d):
    counts = wc.word_count(views.documents(spark, d), "text")
    return write_result(counts, scratch_path(spark, "result"))


@query
def runs_append(spark, d):
    runs = views.results(spark, d)
    path = scratch_path(spark, "runs")
    append_rows(runs.where("run_id % 3 <> 0"), path, ["run_id"], ["suite_id"])
    return append_rows(runs.where("run_id % 3 <> 1"), path, ["run_id"], ["suite_id"])


@query
def logs_append(spark, d):
    per_run = views.logs(spark, d).select(
        "run_id",
        F.create_map(
            F.lit("coordinator"),
            F.concat_ws("/", "log_path", F.lit("coordinator")),
            "system",
            "log_path",
        ).alias("log_paths"),
    )
    path = scratch_path(spark, "logs")
    suites = views.runs(spark, d).select("run_id", "suite_uid")
    logs = explode_paths(per_run).join(suites, "run_id")
    return append_rows(logs, path, ["run_id", "system"], ["suite_uid"]).drop("suite_uid")


@query
def log_path_fields(spark, d):
    worker = F.concat(F.lit("_worker_"), (F.col("run_id") % 10).cast("string"), F.lit(".log"))
    file = F.concat("system", F.when(F.col("run_id") % 2 == 0, worker).otherwise("_coordinator.out"))
    paths = views.logs(spark, d).select("run_id", F.concat_ws("/", "log_path", file).alias("path"))
    return parse_log_path(paths, "path").drop("path")


# --- workloads ------------------------------------------------------------


@query
def wordcount(spark, d):
    return wc.word_count(views.documents(spark, d), "text")


@query
def wordcount_file(spark, d):
    path = write_text(_word_lines(spark, d), "line", scratch_path(spark, "word-lines"))
    return wc.word_count(read_text(spark, path), "value")


@query
def wordcount_composed(spark, d):
    return (
        views.documents(spark, d).transform(wc.tokenize("text")).transform(wc.count_by("word"))
    )


@query
def wordcount_implicit_combine(spark, d):
    return wc.tokenize("text")(views.documents(spark, d)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def wordcount_explicit_combine(spark, d):
    return wc.word_count_combined(views.documents(spark, d), "text")


def _document_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read_table(spark, d, "documents").select("doc_id", "text").schema
    return stream_table(spark, d, "documents", schema, BATCH_BYTES)


@query
def wordcount_streaming(spark, d):
    return stream_word_count(
        _document_stream(spark, d),
        "text",
        scratch_path(spark, "totals"),
        scratch_path(spark, "totals-checkpoint"),
    )


@query
def wordcount_count_window(spark, d):
    return wc.count_windows(views.events(spark, d), "event_type", WINDOW_SIZE)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read_table(spark, d, "events").select("event_id", "ts", "event_type").schema
    stream = stream_table(spark, d, "events", schema, BATCH_BYTES)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def wordcount_count_window_stream(spark, d):
    return stream_count_windows(
        _event_stream(spark, d),
        "event_type",
        scratch_path(spark, "windows"),
        scratch_path(spark, "windows-checkpoint"),
        WINDOW_SIZE,
    )


def _naive_start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def wordcount_time_window_stream(spark, d):
    windows = stream_time_windows(
        _event_stream(spark, d),
        "ts",
        "event_type",
        scratch_path(spark, "hours"),
        scratch_path(spark, "hours-checkpoint"),
        delay=EVENT_DELAY,
    )
    return _naive_start(windows)


@query
def wordcount_time_window_batch(spark, d):
    return _naive_start(wc.time_window_count(views.events(spark, d), "ts", "event_type"))


@query
def grep(spark, d):
    return find_words(views.lines(spark, d), "line", GREP_WORDS)


@query
def grep_restart(spark, d):
    """The documents, cut into files of bounded size by ``doc_id``, come a quarter of
    them at a time. The first attempt dies at the file that comes last; the second goes
    on there, and must leave what the batches before have stored as it is."""
    folder = scratch_path(spark, "grep-in")
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cut = docs.repartitionByRange(max(RESTART_BATCHES, -(-size // FILE_BYTES)), "doc_id", F.xxhash64("text"))
    cut.write.parquet(f"{folder}/documents.parquet")
    files = read_table(spark, folder, "documents").select(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_size"
    ).distinct()
    last, stored_bytes = files.agg(F.max(F.struct("*")).alias("x"), F.sum("file_size")).select(
        "x.file_path", "sum(file_size)"
    ).first()
    batch = max(1, min(BATCH_BYTES, (stored_bytes or 0) // RESTART_BATCHES))
    stream = stream_table(spark, folder, "documents", docs.schema, batch)
    dying = F.when(F.col("_metadata.file_path") == last, F.raise_error("worker lost")).otherwise(F.lit(True))
    sink, checkpoint = scratch_path(spark, "grep-out"), scratch_path(spark, "grep-checkpoint")
    found = spark.read.schema("word string, doc_id bigint, pos int, line string")
    stored: list[set[str]] = []

    def attempt(i: int):
        if i:  # what the sink lists is what was committed
            stored.append(set(found.parquet(sink).inputFiles()))
        rows = stream if i else stream.where(dying.cast("boolean"))
        return stream_grep(rows.selectExpr(*views.LINE_COLUMNS), "line", GREP_WORDS, sink, checkpoint)

    failures = drain_with_restarts(attempt)
    out = found.parquet(sink)
    if failures != (last is not None):
        raise RuntimeError(f"{failures} failures where one was injected")
    if stored and not (stored[0] and stored[0] <= set(out.inputFiles())):
        raise RuntimeError("the batches before the fault were not kept")
    return out


@query
def als_factors(spark, d):
    """Ratings generated for as many users and items as there are customers and
    parts, stored under their parameters; both factor tables are stored as well."""
    users = read_table(spark, d, "customer").count()
    items = read_table(spark, d, "part").count()
    sizes = (users, items, 20, 4, 40, 50)
    name = "ratings-" + "-".join(map(str, sizes))
    ratings = write_result(generate.gen_ratings(spark, *sizes), scratch_path(spark, name))
    left, right = (
        write_result(side, scratch_path(spark, f"{name}-{kind}"))
        for kind, side in zip(("users", "items"), factorize(ratings, seed=1))
    )
    rmse = fit_error(ratings, left, right).first()[0]
    return with_sides(left, right).select(
        "side", "id", F.size("features").alias("rank"), F.lit(rmse < FIT_BOUND).alias("fits")
    )


@query
def lineitem_prepare(spark, d):
    table = read_delimited(spark, _lineitem_csv(spark, d), schemas.LINEITEM)
    return convert(table, scratch_path(spark, "lineitem-orc"), "orc")


@query
def lineitem_compare(spark, d):
    csv = read_delimited(spark, _lineitem_csv(spark, d), schemas.LINEITEM)
    binary = convert(csv, scratch_path(spark, "lineitem-orc"), "orc")
    return cmp.compare(binary, csv)


# --- run analytics --------------------------------------------------------


@query
def runs_lookup(spark, d):
    return run_ops.runs_of(views.results(spark, d), SUITE_UID, BENCH)


@query
def runs_count_check(spark, d):
    """Of each suite run a benchmark is wanted that never ran, and one that ran is
    not wanted."""
    runs = views.results(spark, d)
    keys = ["suite_uid", "suite_id", "bench_id"]
    never = runs.select("suite_uid", "suite_id", F.lit("idle").alias("bench_id"))
    wanted = runs.where("bench_id <> 'view'").select(*keys).union(never).distinct()
    return run_ops.count_violations(runs, wanted.withColumn("times", F.lit(RUNS_WANTED)))


@query
def bench_ids_distinct(spark, d):
    return run_ops.benchmarks_of(views.results(spark, d), SUITE)


@query
def latest_suite_runs(spark, d):
    return run_ops.latest_runs(views.results(spark, d), SUITE)


@query
def latest_suite_runs_per_suite(spark, d):
    return run_ops.latest_runs_per_suite(views.results(spark, d))


@query
def suite_bench_grid(spark, d):
    return run_ops.suite_grid(views.grid_runs(spark, d), SUITE)


@query
def run_status(spark, d):
    return run_ops.with_status(run_ops.suite_grid(views.grid_runs(spark, d), SUITE))


@query
def run_slots(spark, d):
    runs = views.results(spark, d).select("suite_id", "suite_uid", "bench_id", "run_id")
    return run_ops.with_slots(runs)


@query
def suite_run_labels(spark, d):
    return run_ops.with_label(views.results(spark, d).select("suite_uid").distinct())


@query
def run_duration_text(spark, d):
    return run_ops.with_duration_text(
        views.results(spark, d).select("run_id", "duration", "start_time")
    ).select("run_id", "took", "started")


@query
def suite_uid(spark, d):
    named = views.events(spark, d).select(
        "event_id",
        F.concat(F.lit("suite"), (F.col("user_id") % 5).cast("string")).alias("suite_id"),
        "ts",
    )
    return run_ops.with_suite_uid(named, "suite_id", F.unix_timestamp("ts")).drop("ts")


@query
def phase_durations(spark, d):
    timings = views.events(spark, d).withColumn("start", F.unix_timestamp("ts"))
    return run_ops.last_phase(timings, "user_id", "event_type", "start", "value", "event_id")


@query
def run_defaults(spark, d):
    """Phases are so many that most runs lack the main one."""
    phase = F.concat_ws("-", "event_type", (F.col("event_id") % 29).cast("string"))
    every = views.events(spark, d).withColumns({"start": F.unix_timestamp("ts"), "phase": phase})
    phases = run_ops.last_phase(every, "user_id", "phase", "start", "value", "event_id")
    return run_ops.main_phase_or_zero(
        every.select(F.col("user_id").alias("run")).distinct(), phases, MAIN_PHASE
    )


@query
def run_logs_join(spark, d):
    runs = views.results(spark, d).select("run_id", "suite_uid", "bench_id", "failed")
    return run_ops.with_logs(runs, views.logs(spark, d))


@query
def log_error_scan(spark, d):
    text = views.log_text(spark, d)
    return log_ops.scan_numbered(text, ["suite_uid", "system"], "run_id")


@query
def log_file_scan(spark, d):
    """Log files of each system, cut at every 2**20 run ids, written and scanned."""
    path = scratch_path(spark, "log-files")
    text = views.log_text(spark, d).withColumn("piece", F.shiftright("run_id", 20))
    (
        text.repartition("system", "piece")
        .sortWithinPartitions("system", "piece", "run_id")
        .select("system", "piece", F.col("line").alias("value"))
        .write.partitionBy("system", "piece")
        .text(path)
    )
    hits = read_log_lines(spark, path, log_ops.matches())
    return hits.select(
        F.regexp_extract("path", "system=([^/]+)/", 1).alias("system"),
        F.regexp_extract("path", "piece=([^/]+)/", 1).cast("bigint").alias("piece"),
        "line_no",
        "line",
    )


@query
def run_failed_flag(spark, d):
    text = views.log_text(spark, d)
    exempt = spark.createDataFrame([(EXEMPT,)], "system string")
    runs = views.results(spark, d).select("run_id", "failed")
    return log_ops.failed_flag(runs, log_ops.scan_logs(text), exempt)


@query
def log_tree_flags(spark, d):
    """A log tree with all parts of a path, read, scanned and joined to its runs."""
    path = scratch_path(spark, "log-tree")
    keys = ["suite_uid", "bench_id", "attempt", "system"]
    text = views.tree_text(spark, d).withColumnRenamed("line", "value")
    (
        text.repartition(*keys)
        .sortWithinPartitions(*keys, "run_id")
        .select(*keys, "value")
        .write.partitionBy(*keys)
        .text(f"{path}/logs")
    )
    exempt = spark.createDataFrame([(EXEMPT,)], "system string")
    return log_ops.flags_from_tree(views.tree_runs(spark, d), scan_log_files(spark, path), exempt)


@query
def suite_report(spark, d):
    timings = views.suite_timings(spark, d)
    phases = run_ops.last_phase(
        timings, "suite_uid", "bench_id", "start_time", "duration", "run_id"
    )
    own = phases.select(
        F.col("run").alias("suite_uid"), F.col("phase").alias("seq"), "phase", "start_time", "duration"
    )
    return report(views.results(spark, d), views.run_phases(spark, d), own, per_part=100)


@query
def systems_union(spark, d):
    nations = read_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("pr")
    )
    listed = [
        read_table(spark, d, name).select(F.col(col).alias("k")).join(nations, "k")
        for name, col in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))
    ]
    return run_ops.ordered_union([*listed, nations], "k", "pr")
