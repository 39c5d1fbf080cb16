"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from quire.plans import catalog, evaluation

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    expected = con.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got, want = plain(df.collect(), df.columns), plain(expected.fetchall(), expected.columns)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []
    assert want or name in ("neighbor_pages", "conflicts_payslips"), "an empty result shows nothing"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_greedy_query_takes_both_sides_from_one_table(spark):
    rows = contract.queries()["eval_payslips_greedy"](spark, SF).collect()
    assert rows and len({(r["case_id"], r["competence"], r["taken"]) for r in rows}) == len(rows)


def test_letters_flags_are_of_every_word(spark, tmp_path):
    """Null, empty, blank and long texts; words of one to three letters, the last ones included."""
    cases = {None: None, "": "", " \n ": "", "ab é1 abc": "001", "07:00 abc\tx\n\nçãoé 12a": "01010", "ab " * 20_000 + "abc": "0" * 20_000 + "1"}
    rows = [(k, k % 5, text) for k, text in enumerate(cases)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = contract.queries()["letters_flags"](spark, str(tmp_path))
    assert {r["conv_id"]: r["word_flags"] for r in got.collect()} == dict(enumerate(cases.values()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.sql(contract.oracle_sql()["letters_flags"])
    assert plain(got.collect(), got.columns) == plain(expected.fetchall(), expected.columns)


def test_letters_flags_differ_within_texts(spark):
    flags = [r["word_flags"] for r in contract.queries()["letters_flags"](spark, SF).collect()]
    assert any("0" in x for x in flags) and any("1" in x for x in flags)


def test_a_stream_lists_the_truth_files_of_one_folder(spark, con, monkeypatch):
    """A driver keeps the names of all files that a stream finds, so no stream may find all."""
    stream, paths = evaluation.stream_evaluation.truth_stream, []
    monkeypatch.setattr(evaluation, "FOLDER_CASES", 4, raising=False)
    monkeypatch.setattr(evaluation.stream_evaluation, "truth_stream", lambda spark, path, *a: paths.append(path) or stream(spark, path, *a))
    df = contract.queries()["truth_files_scored"](spark, SF)
    expected = con.sql(contract.oracle_sql()["truth_files_scored"])
    assert plain(df.collect(), df.columns) == plain(expected.fetchall(), expected.columns)
    found = [len(glob.glob(f"{p.removeprefix('file:')}/*.json")) for p in set(paths)]
    assert sum(found) == df.count() and 1 < len(found) and max(found) <= df.count() / 2
