import duckdb
import pytest

import __spark_entry__
from tamis.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r)) for r in rows)


#: One query of each family; the rest of the numbered algorithms are held by the contract tests.
NAMES = [n for n in queries.ORACLE_SQL if not n.startswith(("alg", "semi_join_alg")) or n.startswith(("alg0000", "alg0030", "alg0036", "alg2776"))]


@pytest.mark.parametrize("name", NAMES)
def test_sql_gives_the_same(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got.select(*sorted(got.columns)).collect()) == norm(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in sorted(got.columns))} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == set()


def test_closed_windows(spark, small):
    days = spark.read.parquet(f"{small}/events.parquet").selectExpr("count(distinct date(ts))").first()[0]
    assert queries.QUERIES["stream_windows"](spark, small).select("day").distinct().count() == days - 1


def test_blocked_probe_has_no_second_shuffle(spark, small):
    plan = queries.QUERIES["bloom_false_positives_block32"](spark, small)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in physical and "Python" not in physical


def test_entry_without_the_training_data_part(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) == set(queries.ORACLE_SQL)


def test_entry_hides_no_other_error(monkeypatch):
    import builtins

    plain = builtins.__import__

    def broken(name, *args, **more):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("no numpy", name="numpy")
        return plain(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_keys_of_hashes_are_planned_in_steps(spark, small):
    plan = queries.QUERIES["cqf_build_invertible"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


@pytest.mark.parametrize(("starts", "repeats"), [((0, queries.AWAY), 1), ((1600,), 100)], ids=["absent keys that are there", "repeated keys"])
def test_rates_are_of_keys_not_added(spark, tmp_path, starts, repeats):
    keys = [k for start in starts for k in range(start, start + 200)]
    orders = spark.createDataFrame([(k, "1-URGENT") for k in keys * repeats], "o_orderkey long, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    n = len(keys) * repeats
    assert queries.QUERIES["alg1056_homogribbon64_5"](spark, str(tmp_path)).collect() == [(n, n, True)]
