"""Every core query against DuckDB on the same tables."""

import glob
import os

import pytest

from traceguard.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(names, values):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr([round(v[i], 9) if isinstance(v[i], float) else v[i] for i in at]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tool_policy_reads_every_event(spark, tmp_path):
    rows = [(5, 1, "click"), (3, 1, "drop"), (4, 1, "erase"), (9, 2, "erase"), (8, 2, "view"), (14, 3, "drop"), (13, 4, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.violations for r in catalog.QUERIES["tool_policy"](spark, str(tmp_path)).collect()}
    assert got == {1: " drop|ERASE", 2: " erase"}


def test_prompt_extract_keeps_the_tail_of_a_long_text(spark, tmp_path):
    text = "x" * 1_000_030 + "end"
    spark.createDataFrame([(3, 1, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = catalog.QUERIES["prompt_extract"](spark, str(tmp_path)).collect()
    assert row.prompt == f"{text[:20]} {text[20:]}"


@pytest.mark.parametrize("name", ["gate_replies", "response_gate_check"])
def test_gates_read_a_long_response_to_its_end(spark, tmp_path, name):
    import duckdb

    path = f"{tmp_path}/documents.parquet"
    duckdb.sql(f"COPY (SELECT 29 + k AS doc_id, repeat('many words ', 11000) AS text FROM range(29) t(k)) TO '{path}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_slow_columns_are_computed_once_and_after_the_deal(spark):
    import re

    for name, slow in (("secrets_normalized", r"\bArrowEvalPython\b"), ("secrets_named", r"sk-ant-\[a"), ("secrets_entropy", r"regexp_extract_all"), ("pii_custom_keys", r"sk-ant-\[a")):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        slow_at = [i for i, line in enumerate(plan) if re.search(slow, line)]
        (dealt,) = (i for i, line in enumerate(plan) if "Repartition" in line)
        assert len(slow_at) == 1 and slow_at[0] < dealt, name
