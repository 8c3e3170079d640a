"""Operators with an SQL form: small odd tables against the registered SQL in DuckDB."""

from __future__ import annotations

import re

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import chat_format, line_dedup, secret_scan, warc

LINE = "A line that is long enough to be judged as a key, surely"
KEY = "AKIA" + "Z9" * 8
TEXTS = [
    None,
    "",
    "\n",
    f"{LINE}\nshort\n{LINE}\n",
    f"  {LINE.upper()}\t\n\x0b",
    f"{LINE}\n\n" + "é" * 39,
    "é" * 40,
    f" {LINE}",
    f"password: 'hunter22' and Token=abc secret = \"a.b-c_d\" ſecret: notakeyword {KEY}x AKIASHORT",
    f"API_KEY={KEY} {'0123456789abcdef' * 2} apikey:short",
    "ü" * 5 + " token=" + "A1b2C3d4E5f6G7h8I9j0K" + " then A1b2C3d4E5f6G7h8I9j0K alone",
    "see Zx9Yw8Vu7Ts6Rq5Po4Nm3 and again Zx9Yw8Vu7Ts6Rq5Po4Nm3",
    "example tokens Qq1Ww2Ee3Rr4Tt5Yy6Uu7 are copied",
    "word " * 60_000 + "secret:" + "f" * 30,
    "a" * 120_000,
    " ü ".join(f"token={k}abcdef {'%032x' % (k * 0x9E3779B97F4A7C15F39CC0605CEDC835)} Zx9Yw8Vu7Ts6Rq5Po4{k}" + (f"+{KEY}" if k % 3 else "") for k in range(200)),
]


def documents():
    rows = [(k, t, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, f"{LINE}\nbody {k}\nQq1Ww2Ee3Rr4Tt5Yy6Uu7", f"s{k}") for k in range(6)]
    rows += [(300 + k, "an example of one owner: Rr9Tt8Yy7Uu6Ii5Oo4Pp3Ww2 in many places", "s1") for k in range(12)]
    rows += [(400 + k, "a value of one owner: Vv9Bb8Nn7Mm6Kk5Jj4Hh3Gg2 in some places", "s1") for k in range(9)] + [(400, "Vv9Bb8Nn7Mm6Kk5Jj4Hh3Gg2", "s1")]
    rows += [(101, f"{LINE}\nother row", "s1"), (None, f"{LINE}\nnull id", None), (None, "x", None), rows[3], rows[3]]
    return rows


CONVERSATIONS = [
    (1, 0, "user", "hi <|im_end|> \\ there"), (1, 1, "assistant", "</s>[INST]\n<|im_sep|>x"), (2, 1, "assistant", "late"), (2, 0, "user", "early"), (2, 0, "user", "early"),
    (3, 0, None, None), (4, 0, "system", ""), (4, 1, "user", "a\\"), (4, 2, "assistant", "b<"), (4, 3, "user", "c" * 100_000), (None, None, "user", "q"), (None, 2, "assistant", "\\\\<s>"),
    (5, 0, "as<s>sistant\n", "odd role"), (6, 0, "user", "<<SYS>>"), (6, 1, "assistant", "<|endoftext|>"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    for name, rows, schema in (
        ("documents", documents(), "doc_id long, text string, source string"),
        ("conversations", CONVERSATIONS, "conv_id long, turn long, role string, text string"),
        ("pages", [(3, "u", "a"), (1, "u", "b"), (2, "v", "a"), (4, None, None), (5, "w", ""), (6, "ü", "ü")], "page_id long, url string, html string"),
    ):
        df = spark.createDataFrame(rows, schema)
        pq.write_table(df.toArrow(), f"{path}/{name}.parquet")
        (path / "none").mkdir(exist_ok=True)
        pq.write_table(df.limit(0).toArrow(), f"{path}/none/{name}.parquet")
    return path


def same(spark, folder, module):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = module.query(spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({module.SQL})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)


@pytest.mark.parametrize("module", [secret_scan, line_dedup, chat_format, warc], ids=lambda m: m.__name__.split(".")[-1])
def test_odd_rows_and_empty_tables(spark, folder, module):
    assert same(spark, folder, module) > 2
    assert same(spark, folder / "none", module) == (1 if module is chat_format else 0)


def test_widely_copied_values_are_left_out(spark, folder):
    rows = {r.doc_id: r.spans for r in secret_scan.query(spark, str(folder)).collect()}
    assert rows[11].count("value:") == 2 and "value" not in rows[12]


def test_line_dedup_keeps_columns_and_rewrites(spark):
    docs = spark.createDataFrame([(k, f"{LINE}\nbody {k}", "x", k) for k in range(5)], "doc_id long, text string, dropped string, n_lines long")
    rows = {r.doc_id: r for r in line_dedup.dedup(docs).select("doc_id", "text", "dropped").collect()}
    assert [rows[k].text for k in range(5)] == [f"body {k}" for k in range(4)] + [f"{LINE}\nbody 4"]
    assert rows[0].dropped == "x"


def line_batch(spark, b):
    return spark.createDataFrame([(100 - 10 * b - d, bytes([k])) for d in range(3) for k in range(b + 2)], "doc_id long, key binary")


@pytest.mark.parametrize("buckets", [None, 3])
def test_runs_are_levelled_and_outlive_a_session(spark, buckets):
    state = line_dedup.LineRuns(spark, fanout=2, buckets=buckets)
    for b in range(3):
        state.add(line_batch(spark, b))
        assert all(len(level) < 2 for level in state.levels)
        for level in state.levels:
            for run in level:
                spark.sql(f"DROP TABLE {run}")  # a later session's catalog does not have it
        state = line_dedup.LineRuns.open(spark, state.folder)
    assert (state.version, state.floor) == (3, 78)
    got = {bytes(r.key)[0]: (r.n_docs, r.owner) for r in state.merged().collect()}
    assert got == {0: (9, 100), 1: (9, 100), 2: (6, 90), 3: (3, 80)}
    with pytest.raises(ValueError, match="falling order"):
        state.add(line_batch(spark, 2))


def test_runs_are_read_in_their_order(spark):
    state = line_dedup.LineRuns(spark, fanout=3)
    for b in range(2):
        state.add(line_batch(spark, b))
    first, second = state.runs()
    with line_dedup.ordered_scans(spark):
        for rows, joins in ((state.disowned(first), 2), (state.merged(), 1)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == joins
            assert not re.search(r"Exchange|\bSort ", plan), plan
    assert {bytes(r.key)[0]: r.owner for r in state.disowned(first).collect()} == {0: None, 1: None}
    assert first.where("owner = 100").count() == 2


def test_segments_and_machine(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat_format.format_conversations(rows).collect()}
    assert [got[k].valid for k in (1, 2, 3, 4, 5, 6)] == [True, False, False, False, False, True]
    assert (got[2].first_bad_turn, got[3].first_bad_turn, got[4].first_bad_turn) == (1, 0, None)
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    t = chat_format.Template()
    for r in got.values():
        for s in r.segments[1::3]:
            assert not any(c in s.text for c in t.all_controls())


def test_many_repositories_of_one_owner_make_an_example(spark):
    rows = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    spans = {r["repository"]: [s["copied"] for s in r["spans"] if s["rank"] == 3] for r in secret_scan.scan(rows).where("repository between 300 and 499").collect()}
    assert all(not spans[300 + k] for k in range(12))
    assert all(spans[400 + k] == [False] for k in range(9))


def test_offsets_of_many_matches(spark):
    """20,000 matches in one text: their starts as Python finds them (adding up all earlier lengths for each takes minutes)."""
    text = " ü ".join(f"{'%064x' % (k * 0x9E3779B97F4A7C15F39CC0605CEDC835)}" for k in range(20_000))
    rows = secret_scan.candidates(spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string"), "doc_id", "source")
    got = rows.selectExpr("transform(found, s -> struct(s.start, s.end)) spans").first().spans
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
