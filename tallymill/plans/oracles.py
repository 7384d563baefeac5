"""The same queries as SQL for DuckDB, over the same parquet tables."""

from __future__ import annotations

WORDS = r"""
  select unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) as word from documents
"""

WORD_COUNT = f"select word, count(*) as n from ({WORDS}) where word <> '' group by 1"

LINES = """lines as (
  select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as pos,
         unnest(string_split(text, chr(10))) as line from documents)"""

GREP = f"""with {LINES}
select w as word, doc_id, pos, line from lines
join (select unnest(['these','are','test','words']) as w) on contains(line, w)"""

RUNS = """runs as (
  select event_id as run_id,
         concat('suite', user_id % 5) as suite_id,
         concat('suite', user_id % 5, '_',
                cast(cast(epoch(date_trunc('day', ts)) as bigint) as varchar)) as suite_uid,
         event_type as bench_id,
         cast(floor(epoch(ts)) as bigint) as start_time,
         value as duration,
         case when value > 100 then 1 else 0 end as failed,
         concat('system', user_id % 7) as system,
         concat(event_type, ' ', props) as line
  from events)"""

LOGS = f"""{RUNS},
logs as (select run_id, system,
  concat('results/logs/', suite_uid, '/', bench_id, '/1/', system) as log_path from runs)"""

COUNT_WINDOWS = """
select word, w, count(*) as n from (
  select event_type as word, cast(floor((row_number() over
    (partition by event_type order by event_id) - 1) / 100) as bigint) as w
  from events) group by 1, 2 having count(*) = 100"""

HOURS = """select time_bucket(interval 1 hour, ts) as window_start,
  event_type as word, count(*) as n from events group by 1, 2"""

GRID = f"""with {RUNS},
g as (select * replace (concat(bench_id, '-', run_id % 37) as bench_id) from runs
      where suite_id = 'suite1'),
u as (select distinct suite_uid from g order by suite_uid desc limit 15),
b as (select distinct bench_id from g),
grid as (select u.suite_uid, b.bench_id, g.run_id, coalesce(g.duration, 0e0) as duration,
      coalesce(g.failed, -1) as failed
  from u cross join b
  left join g on g.suite_uid = u.suite_uid and g.bench_id = b.bench_id)"""

# a value for (row, item, salt): linear mix, then the fifth power modulo 2**31 - 1
P = "2147483647"


def _mixed(row: str, item: str, salt: str) -> str:
    return (
        f"((({row} & {P}) * 48271 + ({row} >> 31) * 69621 + {item} * 16807"
        f" + (cast({salt} as bigint) * 271828183) % {P}) % {P})"
    )


def _fifth(x: str) -> str:
    return f"((({x} * {x} % {P}) * ({x} * {x} % {P}) % {P}) * {x} % {P})"


def _draw(row: str, item: str, salt: str) -> str:
    return f"list_transform([{_mixed(row, item, salt)}], lambda x: {_fifth('x')})[1]"


def _normal(row: str, item: str, salt: int) -> str:
    drawn = f"list_transform(range({salt}, {salt + 12}), lambda s: {_mixed(row, item, 's')})"
    return f"(list_sum(list_transform({drawn}, lambda x: {_fifth('x')}))::double / {P}e0 - 6e0)"


VOCABULARY = f"""vocabulary as (
  select word, row_number() over (order by word) - 1 as idx, count(*) over () as size,
         sum(strlen(word)) over () as chars
  from (select distinct word from ({WORDS}) where word <> ''))"""


def _gen_lines(lines: str, words: int) -> str:
    """(id, line); ``lines`` is an SQL expression for their number."""
    return f"""{VOCABULARY},
picks as (
  select id, j, {_draw('id', 'j', '0')} % (select count(*) from vocabulary) as idx
  from (select id, unnest(range({words})) as j
        from (select unnest(range(cast({lines} as bigint))) as id))),
word_lines as (
  select id, string_agg(word, ' ' order by j) as line
  from picks join vocabulary using (idx) group by id)"""


DOC_LINES = _gen_lines("(select count(*) from documents)", 15)

TEXT_LINES = _gen_lines(
    """(select (select sum(strlen(text)) from documents) * max(size) // (20 * (max(chars) + max(size)))
     from vocabulary)""",
    20,
)

LINEITEM = "select * from lineitem"


def _profile() -> str:
    checks = [("rows", "count(*)")]
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        checks += [(f"non_null:{c}", f"count({c})"), (f"min:{c}", f"min({c})"),
                   (f"max:{c}", f"max({c})")]
    for c in ("l_returnflag", "l_linestatus"):
        checks += [(f"non_null:{c}", f"count({c})"), (f"chars:{c}", f"sum(length({c}))")]
    c = "l_shipdate"
    checks += [(f"non_null:{c}", f"count({c})"),
               (f"days:{c}", f"sum(date_diff('day', date '1970-01-01', cast({c} as date)))")]
    rows = [
        f"""select '{name}' as "check", cast({agg} as double) + 0e0 as left_value,
        cast({agg} as double) + 0e0 as right_value, true as same from lineitem"""
        for name, agg in checks
    ]
    rows.append("select 'only_here', 0e0, 0e0, true")
    return " union all ".join(rows)


def _lineitem_rows() -> str:
    def d(salt: int, row: str = "id") -> str:
        return _draw(row, "0", str(salt))

    def pick(values: list[str], salt: int) -> str:
        listed = ", ".join(f"'{v}'" for v in values)
        return f"[{listed}][{d(salt)} % {len(values)} + 1]"

    comment = ", ' ', ".join(
        pick(v, 12 + i)
        for i, v in enumerate(
            [
                ["quickly", "slowly", "carefully", "furiously", "blithely", "evenly", "daringly"],
                ["final", "regular", "special", "bold", "ironic", "pending", "express", "silent"],
                ["packages", "requests", "accounts", "deposits", "theodolites", "ideas", "foxes"],
            ]
        )
    )
    return f"""with sizes as (
  select count(*) / 1500000e0 as sf from orders),
n as (select cast(round(6000000 * sf) as bigint) as n_lines,
  greatest(1, cast(round(200000 * sf) as bigint)) as n_parts,
  greatest(4, cast(round(10000 * sf) as bigint)) as n_supp from sizes),
ids as (select unnest(range((select n_lines from n))) as id),
keyed as (
  select id, n_supp, (id >> 2) + 1 as l_orderkey, {d(1)} % n_parts + 1 as l_partkey,
    cast(id % 4 + 1 as int) as l_linenumber, {d(2)} % 50 + 1 as quantity,
    date '1992-01-01' + cast({d(0, '(id >> 2)')} % 2406 as int) as ordered,
    cast({d(3)} % 121 + 1 as int) as to_ship, cast({d(4)} % 61 + 30 as int) as to_commit,
    cast({d(5)} % 30 + 1 as int) as to_receipt
  from ids cross join n)
select l_orderkey, l_partkey,
  (l_partkey + {d(6)} % 4 * (n_supp // 4 + (l_partkey - 1) // n_supp)) % n_supp + 1 as l_suppkey,
  l_linenumber, cast(quantity as double) as l_quantity,
  cast(quantity * (90000 + (l_partkey // 10) % 20001 + 100 * (l_partkey % 1000)) as double) / 100e0
    as l_extendedprice,
  cast({d(7)} % 11 as double) / 100e0 as l_discount,
  cast({d(8)} % 9 as double) / 100e0 as l_tax,
  case when ordered + to_ship + to_receipt > date '1995-06-17' then 'N'
    else ['R', 'A'][{d(9)} % 2 + 1] end as l_returnflag,
  case when ordered + to_ship > date '1995-06-17' then 'O' else 'F' end as l_linestatus,
  ordered + to_ship as l_shipdate, ordered + to_commit as l_commitdate,
  ordered + to_ship + to_receipt as l_receiptdate,
  {pick(["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"], 10)} as l_shipinstruct,
  {pick(["REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB"], 11)} as l_shipmode,
  concat({comment}) as l_comment
from keyed"""


RATINGS = f"""with n as (
  select (select count(*) from customer) as n_users, (select count(*) from part) as n_items),
tries as (  -- 64 steps spread over the columns, each raised to the next coprime
  select distinct (select min(s) from range(base, base + 1000) t(s) where gcd(s, n_items) = 1) as step,
    min(i) over (partition by (select min(s) from range(base, base + 1000) t(s)
                               where gcd(s, n_items) = 1)) as i
  from (select i, n_items, greatest(1, n_items * (2 * i + 1) // 128) as base
        from n cross join (select unnest(range(64)) as i))),
steps as (select list(step order by i) as steps from tries),
sized as (
  select id, n_items,
    cast(least(greatest(floor(40e0 + sqrt(50e0) * {_normal('id', '0', 0)} + 0.5e0), 0), n_items)
      as bigint) as entries,
    {_draw('id', '0', '12')} % n_items as start,
    steps[{_draw('id', '0', '13')} % len(steps) + 1] as step
  from n cross join steps cross join (
    select unnest(range((select n_users from n))) as id)),
cells as (select id, n_items, start, step, unnest(range(entries)) as j from sized)
select cast(id as int) as "user", cast((start + step * j) % n_items as int) as item,
  cast(20e0 + sqrt(4e0) * {_normal('id', 'j', 14)} as float) as rating
from cells"""

TOOK = """concat(cast(cast(floor(duration/3600) as bigint) as varchar), ' hours, ',
  cast(cast(floor(duration/60) as bigint) % 60 as varchar), ' minutes, ',
  cast(cast(floor(duration) as bigint) % 60 as varchar), ' seconds')"""
STARTED = "strftime(make_timestamp(start_time*1000000), '%d.%m.%Y %H:%M:%S')"

ORACLES: dict[str, str] = {
    "gen_text": f"with {TEXT_LINES} select line as value from word_lines",
    "gen_wc_lines": f"with {DOC_LINES} select id, line from word_lines",
    "dictionary_normalize": f"""select distinct split_part(concat(word, '/', length(word)), '/', 1)
        as word from ({WORDS}) where word <> ''""",
    "gen_ratings": RATINGS,
    "gen_lineitem": _lineitem_rows(),
    "text_source": f"with {LINES} select line as value from lines",
    "text_stream_source": f"with {LINES} select line as value from lines",
    "lineitem_csv_source": LINEITEM,
    "result_sink": WORD_COUNT,
    "runs_append": f"""with {RUNS} select run_id, suite_id, suite_uid, bench_id, start_time,
        duration, failed from runs""",
    "logs_append": f"""with {LOGS} select run_id, system, log_path from logs
        union all select run_id, 'coordinator', concat(log_path, '/coordinator') from logs""",
    "log_path_fields": f"""with {LOGS},
        files as (select run_id, concat(log_path, '/', system, case when run_id % 2 = 0
          then concat('_worker_', run_id % 10, '.log') else '_coordinator.out' end) as path
          from logs)
        select run_id, split_part(path, '/', 3) as suite_uid, split_part(path, '/', 4) as bench_id,
          cast(split_part(path, '/', 5) as int) as attempt, split_part(path, '/', 6) as system,
          split_part(path, '/', 7) as file,
          case when run_id % 2 = 0 then 'worker' else 'coordinator' end as role,
          case when run_id % 2 = 0 then cast(run_id % 10 as varchar) else '' end as worker,
          split_part(path, '.', -1) as stream
        from files""",
    "wordcount": WORD_COUNT,
    "wordcount_file": f"""with {DOC_LINES} select word, count(*) as n from (
        select unnest(string_split(line, ' ')) as word from word_lines) group by 1""",
    "wordcount_composed": WORD_COUNT,
    "wordcount_implicit_combine": WORD_COUNT,
    "wordcount_explicit_combine": WORD_COUNT,
    "wordcount_streaming": WORD_COUNT,
    "wordcount_count_window": COUNT_WINDOWS,
    "wordcount_count_window_stream": COUNT_WINDOWS,
    "wordcount_time_window_stream": HOURS,
    "wordcount_time_window_batch": HOURS,
    "grep": GREP,
    "grep_restart": GREP,
    "als_factors": f"""with r as ({RATINGS})
        select distinct 'user' as side, "user" as id, 15 as "rank", true as fits from r
        union all select distinct 'item', item, 15, true from r""",
    "lineitem_prepare": LINEITEM,
    "lineitem_compare": _profile(),
    "runs_lookup": f"""with {RUNS} select run_id, duration, failed from runs
        where suite_uid = 'suite1_1704067200' and bench_id = 'click'""",
    "runs_count_check": f"""with {RUNS},
        found as (select suite_uid, suite_id, bench_id, count(*) as n from runs group by all),
        wanted as (select suite_uid, suite_id, bench_id from found where bench_id <> 'view'
          union select suite_uid, suite_id, 'idle' from found)
        select suite_uid, suite_id, bench_id,
          cast(case when wanted.bench_id is null then 0 else 13 end as bigint) as times,
          coalesce(n, 0) as n
        from found full join wanted using (suite_uid, suite_id, bench_id)
        where coalesce(n, 0) <> case when wanted.bench_id is null then 0 else 13 end""",
    "bench_ids_distinct": f"""with {RUNS} select distinct bench_id from runs
        where suite_id = 'suite1' order by bench_id""",
    "latest_suite_runs": f"""with {RUNS} select suite_uid from (
          select distinct suite_uid from runs where suite_id = 'suite1'
          order by suite_uid desc limit 15) order by suite_uid""",
    "latest_suite_runs_per_suite": f"""with {RUNS} select suite_id, suite_uid from (
          select suite_id, suite_uid, row_number() over (partition by suite_id
            order by suite_uid desc) as newest
          from (select distinct suite_id, suite_uid from runs)) where newest <= 15""",
    "suite_bench_grid": f"{GRID} select * from grid",
    "run_status": f"""{GRID} select *, case when failed = -1 then 'no data'
          when failed = 1 then 'failed' else 'ok' end as status,
          case when failed = 0 then duration / 60 end as run_minutes from grid""",
    "run_slots": f"""with {RUNS},
        laid as (select suite_id, suite_uid, bench_id, run_id,
          cast(2 * (dense_rank() over (partition by suite_id order by suite_uid) - 1) as double) as x,
          1.5e0 / count(*) over (partition by suite_uid, bench_id) as width,
          row_number() over (partition by suite_uid, bench_id order by run_id) - 1 as slot
        from runs)
        select suite_id, suite_uid, bench_id, run_id, x, width, x + 0.25e0 + slot * width as pos
        from laid""",
    "suite_run_labels": f"""with {RUNS} select distinct suite_uid, strftime(make_timestamp(
          cast(split_part(suite_uid, '_', -1) as bigint) * 1000000), '%d.%m.%Y') as label
        from runs""",
    "run_duration_text": f"with {RUNS} select run_id, {TOOK} as took, {STARTED} as started from runs",
    "suite_uid": """select event_id, concat('suite', user_id % 5) as suite_id,
          concat('suite', user_id % 5, '_', cast(floor(epoch(ts)) as bigint)) as suite_uid
        from events""",
    "phase_durations": """select user_id as run, event_type as phase,
          arg_max(cast(floor(epoch(ts)) as bigint), event_id) as start_time,
          arg_max(value, event_id) as duration from events group by 1, 2""",
    "run_defaults": """with main as (
          select user_id, arg_max(cast(floor(epoch(ts)) as bigint), event_id) as start_time,
            arg_max(value, event_id) as duration
          from events where event_type = 'click' and event_id % 29 = 3 group by 1)
        select u.user_id as run, coalesce(start_time, 0) as start_time,
          coalesce(duration, 0e0) as duration
        from (select distinct user_id from events) u left join main on main.user_id = u.user_id""",
    "run_logs_join": f"""with {LOGS} select runs.run_id, suite_uid, bench_id, failed, logs.system,
          log_path from runs join logs on runs.run_id = logs.run_id""",
    "log_error_scan": f"""with {RUNS}, log_lines as (
          select run_id, suite_uid, system, line, row_number() over (
            partition by suite_uid, system order by run_id) - 1 as line_no from runs)
        select * from log_lines where regexp_matches(line, '(?i)(error|exception)')""",
    "log_file_scan": f"""with {RUNS}, log_lines as (
          select system, run_id >> 20 as piece, line, row_number() over (
            partition by system, run_id >> 20 order by run_id) - 1 as line_no from runs)
        select * from log_lines where regexp_matches(line, '(?i)(error|exception)')""",
    "run_failed_flag": f"""with {RUNS}
        select r.run_id, greatest(r.failed, coalesce(x.hit, 0)) as failed
        from runs r left join (
          select run_id, max(case when regexp_matches(line, '(?i)(error|exception)')
            then 1 else 0 end) as hit
          from runs where system <> 'system3' group by 1) x on r.run_id = x.run_id""",
    "log_tree_flags": f"""with {RUNS}
        select min(run_id) as run_id, greatest(min(failed), max(case when system <> 'system3'
          and regexp_matches(line, '(?i)(error|exception)') then 1 else 0 end)) as failed
        from runs group by suite_id, date_trunc('month', make_timestamp(start_time * 1000000)), bench_id""",
    "suite_report": f"""with {RUNS},
        timed as (
          select suite_uid, bench_id as section, run_id, 0 as seq, 'Setup' as phase,
            start_time - 60 as start_time, floor(floor(duration) / 10) as duration from runs
          union all select suite_uid, bench_id, run_id, 1, 'Benchmark', start_time, duration from runs
          union all select suite_uid, bench_id, run_id, 2, 'Shutdown',
            start_time + cast(floor(duration) as bigint), floor(floor(duration) / 20) from runs),
        numbered as (select *, (row_number() over (partition by suite_uid, section
            order by run_id, seq) - 1) // 100 as part from timed),
        entries as (select suite_uid, section, part, run_id, seq,
            concat(phase, chr(10), {STARTED}, chr(10), {TOOK}, chr(10), chr(10)) as entry from numbered),
        last as (select suite_uid, bench_id, arg_max(start_time, run_id) as start_time,
            arg_max(duration, run_id) as duration from runs group by 1, 2),
        phases as (select suite_uid, bench_id,
            concat(bench_id, chr(10), {STARTED}, chr(10), {TOOK}, chr(10), chr(10)) as entry
          from last)
        select distinct suite_uid, '' as section, -1 as part,
            concat('Cluster suite ', suite_uid, chr(10), chr(10)) as report from runs
        union all
        select distinct suite_uid, bench_id, -1, concat(bench_id, ':', chr(10), chr(10)) from runs
        union all
        select suite_uid, '', 0, string_agg(entry, '' order by bench_id)
        from phases group by suite_uid
        union all
        select suite_uid, section, part, string_agg(entry, '' order by run_id, seq)
        from entries group by suite_uid, section, part""",
    "systems_union": """select k, row_number() over (order by pr, k) - 1 as idx from (
          select c_nationkey as k, n_regionkey as pr from customer
            join nation on c_nationkey = n_nationkey
          union select s_nationkey, n_regionkey from supplier
            join nation on s_nationkey = n_nationkey
          union select n_nationkey, n_regionkey from nation)""",
}
