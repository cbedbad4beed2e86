"""Every registered query of the engine against its SQL, or for its shape where SQL can't express it."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from scriptorium import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, sf_dir, sql, name):
    found = plans.QUERIES[name](spark, sf_dir)
    cursor = sql.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    expected = Counter(tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in order) for r in found.collect()) == expected and expected


@pytest.mark.parametrize("name", ["spans_merged", "spans_gaps", "spans_subtracted"])
def test_spans_of_broken_quantities(spark, tmp_path, name):
    """SQL rounds a quantity where it casts it, and a half to the even number: spans end there, touch or stay apart by that."""
    con = duckdb.connect()
    con.execute("create table lineitem as select i as l_orderkey, 7 * i + 2 * k as l_partkey, (i + k) / 4 as l_quantity from range(60) a(i), range(3) b(k)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    cursor = con.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = Counter(cursor.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()) == expected and expected


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
