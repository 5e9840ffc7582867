"""The registered queries against their SQL on the smallest tables, sources and streams."""

import duckdb
import pytest

import __spark_entry__ as entry
from lumenprose.plans import catalog
from lumenprose.sources import files
from lumenprose.streaming import checks

DATA = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["det_safety_start", "det_safety_reason", "det_contractions"])
def test_keys_beyond_a_step(spark, tmp_path, name):
    """Ids of the SQL repeat from a million keys on: number * STEP + key. Each sentence stays a document of its own."""
    spark.createDataFrame([(5,), (catalog.STEP + 5,), (2 * catalog.STEP + 5,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_corpus_rules_on_prose(spark, tmp_path):
    """Prose with findings of each rule, accents, cases that aren't findings, null and empty texts."""
    docs = [(1, "She's here; they don’t go. He has gone and it is turning."), (2, "We must have moved it. This is going to stop. Été: hé, her man."), (3, None), (4, ""), (5, "I had already seen this; this shows more. They are being good.")]
    turns = [(1, 0, "You can't. We're reading him/her."), (1, 1, "It's not; was always failing. Theory, sheet, thistle is.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["corpus_rules"]).fetchall()
    assert {r for _, r, _ in want} == {"8.1", "4.2", "3.2", "GR-7", "GR-4"}
    assert sorted(map(tuple, entry.queries()["corpus_rules"](spark, str(tmp_path)).select("doc_id", "rule", "n").collect())) == sorted(want)


def test_corpus_rules_between_markup(spark, tmp_path):
    """The SQL reads texts as they are written: marks between words part them, and code, entities and tables count."""
    docs = [(1, "to this*** was so; this was."), (2, "`this is` x\n\n```\nyou can't;\n```"), (3, "# She has gone\n\n| he | it is turning |\n|---|---|"), (4, ";;"), (5, "a &amp; b <i title=';'>her</i>"), (6, "this\u00a0is")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["corpus_rules"]).fetchall()
    assert sorted(map(tuple, entry.queries()["corpus_rules"](spark, str(tmp_path)).select("doc_id", "rule", "n").collect())) == sorted(want)


def test_folder_source(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfOne\r\nTwo")
    (tmp_path / "b.txt").write_bytes("Zwölf".encode("utf-16"))
    (tmp_path / "c.rst").write_bytes(b"caf\xe9 \x93x\x94")
    (tmp_path / "d.py").write_bytes(b"no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "e.md").write_bytes(b"no")
    got = {r.name: r.text for r in files.folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "One\nTwo", "b.txt": "Zwölf", "c.rst": "café “x”"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "We can't go."), (2, "Read it.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    checks.check_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    assert {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 0.0, 2: 100.0}
