"""Every registered query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from veridra.plans import queries as star

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def shown(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(star.ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    found = star.QUERIES[name](spark, SF)
    result = sql.execute(star.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    places = [names.index(c) for c in order]
    assert shown(found.select(*order).collect()) == shown([r[i] for i in places] for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(star.QUERIES) - set(star.ORACLE_SQL)))
def test_runs(spark, name):
    assert star.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters_follow_their_leader(spark):
    from veridra.functions.fuzzy import weighted_ratio

    for row in star.leader_cluster_fuzzy(spark, SF).collect():
        assert row["name"] == row["leader"] or weighted_ratio(row["name"], row["leader"]) >= 85
