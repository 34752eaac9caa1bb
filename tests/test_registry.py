"""Every registered query against the SQL beside it, on the smallest tables."""

import math

import duckdb
import pytest

from skyquarry.plans import registry, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def same(df, relation):
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    ours = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(views.TEMPLATES))
def test_derived_table(spark, duck, name):
    same(getattr(views.Catalogue(spark, SF), name), duck.sql(views.oracle(f"SELECT * FROM {name}")))


def test_every_query_but_the_layout_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"l03_labels"}


def test_plans_push_down_and_avoid_products(spark):
    def plan(name):
        return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "CartesianProduct" not in plan("g09_band_join") and "NestedLoop" not in plan("g09_band_join")
    assert "TakeOrderedAndProject" in plan("t04_ranked_search")
    assert "PushedFilters: [" in plan("a01_article") and "doc_id" in plan("a01_article")
    assert "ReadSchema: struct<doc_id:bigint>" in plan("a02_articles_page")


def test_a_goal_that_can_be_reached_counts_no_jumps(spark, monkeypatch):
    line = [(1, 0.0, 0.0, 0.0), (7, 9.0, 0.0, 0.0), (42, 18.0, 0.0, 0.0)]

    def answer(rows):
        systems = spark.createDataFrame(rows, "address long, x double, y double, z double")
        monkeypatch.setattr(registry, "Catalogue", lambda *_: type("Made", (), {"systems": systems}))
        ours = [tuple(r) for r in registry.QUERIES["r01_unreachable"](spark, "").collect()]
        con = duckdb.connect()
        con.sql("CREATE TABLE systems (address BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)")
        con.executemany("INSERT INTO systems VALUES (?, ?, ?, ?)", rows)
        final = registry.ORACLE["r01_unreachable"].rpartition(" SELECT ")[2]
        assert ours == con.sql(registry._CLOSURE + "SELECT " + final).fetchall()
        return ours

    assert answer(line) == [(42, 0)] and answer(line[::2]) == []


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows[0].distance == 0 and [r.distance for r in rows] == sorted(r.distance for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
