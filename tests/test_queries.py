"""Every query of the engine against its DuckDB oracle on the smallest tables."""

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaweave.operators import leapers
from deltaweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = duck.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize(("name", "joins"), [("rel_from_leapjoin", 3), ("leap_extend_anti", 2)])
def test_query_in_cells(spark, duck, monkeypatch, capsys, name, joins):
    """As on relations that aren't small: the same rows, and no exchange between the joins of proposed values."""
    monkeypatch.setattr(leapers, "_SMALL", 0)
    monkeypatch.setattr(leapers, "_SHARES", 2)
    capsys.readouterr()
    catalogue.queries()[name](spark, FOLDER).explain()
    plan = [line for line in capsys.readouterr().out.splitlines() if "Join" in line or "Exchange" in line]
    first = next(k for k, line in enumerate(plan) if "Join" in line)
    assert all("ShuffledHashJoin" in line for line in plan[first : first + joins])
    test_query(spark, duck, name)


def test_whole_tables(spark, tmp_path):
    """Whole tables of more than a few ids, against brute force."""
    spark.range(300).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in catalogue.queries()["same_generation_all"](spark, str(tmp_path)).select("a", "b").collect()]
    assert sorted(got) == [(a, b) for a in range(1, 300) for b in range(1, 300) if a.bit_length() == b.bit_length()]
    rng = random.Random(2)
    users = [rng.randrange(40) for _ in range(700)]
    rows = [(i, u, datetime(2024, 1, 1 + i // 100, 0, 0, i % 60), "view") for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    order = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    e = {(a, b) for a, b in zip(order, order[1:]) if a != b}
    two = {(a, b, c) for a, b in e for x, c in e if x == b}
    want = {
        "leap_extend_anti_all": {(a, b, c) for a, b, c in two if (a, c) not in e},
        "leap_value_all": {(a, c) for a, _, c in two if a < c},
        "leap_seven_all": {(a, b, c) for a, b, c in two if a < b < c and (a, c) in e and not (c % 2 == 0 and (c, a) in e) and (b, a) in e and (a + 1, b) not in e},
    }
    for name, rows in want.items():
        df = catalogue.queries()[name](spark, str(tmp_path))
        assert max(r[0] for r in rows) >= 20 and sorted(tuple(r) for r in df.select(sorted(df.columns)).collect()) == sorted(rows)


def test_stats_trace(spark):
    rows = catalogue.queries()["stats_trace"](spark, FOLDER).orderBy("round").collect()
    assert rows[0]["stable"] == 0 and rows[-1]["recent"] == 0
    assert all(a["stable"] + a["recent"] == b["stable"] for a, b in zip(rows, rows[1:]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1345
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
