"""The whole pipeline against plain Python, stage by stage."""

import sys
import threading
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
from test_decontaminate import contamination  # noqa: E402
from test_packing import _check  # noqa: E402
from tallymill.llm.oracles import ORACLES  # noqa: E402
from tallymill.sources.scratch import handed_out  # noqa: E402
from tallymill.sources.tables import read_table  # noqa: E402


def test_stages_like_brute_force(spark, small, path):
    con = oracle.connect(small)
    rows = con.execute("select doc_id, text from documents").fetchall()
    good = {r[0] for r in con.execute(f"select doc_id from ({ORACLES['op1_quality_rules']}) where kept").fetchall()}
    docs = {i: t for i, t in rows if i in good}
    items = dict(con.execute("select item_id, text from benchmark").fetchall())

    def without_repeats(docs):
        out = {}
        for i, (_, _, _, _, repeats) in brute.line_classes(docs).items():
            left = "\n".join(x for n, x in enumerate(docs[i].split("\n")) if n not in repeats)
            if left.split() or not repeats:
                out[i] = left
        return out

    wanted = [docs]
    wanted.append(without_repeats(wanted[-1]))
    near = brute.near_components(wanted[-1])
    wanted.append({i: t for i, t in wanted[-1].items() if near[i][1] == i})
    hit = contamination(wanted[-1], items)
    wanted.append({i: t for i, t in wanted[-1].items() if not hit[i][3]})

    table = read_table(spark, small, "documents")
    columns = table.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        at = path("stage")
        stage(spark, table, small).write.parquet(at)
        table = spark.read.parquet(at)
        assert table.columns == columns, name
        assert {r.doc_id: r.text for r in table.collect()} == want, name
    pieces = corpus_pipeline.run(spark, small).collect()
    _check(pieces, wanted[-1], lambda p: zlib.crc32(p.ids))


def test_results_of_stages_do_not_delete_each_other(spark, small):
    docs = read_table(spark, small, "documents")
    held = [(stage(spark, docs, small), stage(spark, docs, small)) for _, stage in corpus_pipeline.STAGES]
    counts = [(a.count(), b.count()) for a, b in held]
    assert all(a == b > 0 for a, b in counts)
    again = held[1][0].select("doc_id").distinct().count()  # also what is derived later
    assert again <= counts[1][0] and held[2][1].count() == counts[2][1]


def test_runs_in_one_session_stay_apart(spark, small):
    """A second run, and one in another thread, change nothing; each leaves one path."""
    before, out = set(handed_out()), {}

    def work(name):
        out[name] = corpus_pipeline.run(spark, small)

    other = threading.Thread(target=work, args=(0,))
    other.start()
    work(1)
    other.join()
    found = [sorted(map(str, df.select("doc_id", "start", "length").collect())) for df in out.values()]
    assert len(found) == 2 and found[0] == found[1] != []
    assert len(set(handed_out()) - before) == 2


TEXT = " ".join(f"the word{i} and a thing{i} of it" for i in range(40))


def test_nulls_repeats_and_more_columns(spark, small, path):
    """Rows without an id or a text, repeated rows, and columns named like the stages' own."""
    rows = [(1, TEXT, "en", "s", 5, 1), (1, TEXT, "en", "s", 5, 1), (None, TEXT + " end", None, None, None, 2),
            (2, None, "en", "s", 0, 3), (3, "", "en", "s", 0, 4), (4, "x " * 100_000, "en", "s", 9, 5),
            (5, " ".join(f"that is item{i} of part{i} with" for i in range(60)), "en", None, 1, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, sig bigint, fp int")
    table = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = path("stage")
        stage(spark, table, small).write.parquet(at)
        table = spark.read.parquet(at)
        assert table.columns == df.columns, name
    kept = [(r.doc_id, r.fp) for r in table.collect()]
    assert (5, 6) in kept and {i for i, _ in kept} <= {1, None, 5} and (1, 1) in kept
    assert corpus_pipeline.STAGES[-1][1](spark, table, small).count() > 0


def test_empty_table(spark, small, path):
    table = read_table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = path("stage")
        stage(spark, table, small).write.parquet(at)
        table = spark.read.parquet(at)
        assert table.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, small).count() == 0
