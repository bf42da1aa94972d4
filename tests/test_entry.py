"""The entry module's contract."""

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_run_on_the_smallest_tables(spark):
    """Every query has columns of its own and as many rows as its SQL, where it has some."""
    import os

    import duckdb

    from docloom.plans import catalog

    sf, sql, con = "/root/testdata/sf0.001", catalog.oracle_sql(), duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    for name, query in catalog.queries().items():
        out = query(spark, sf)
        assert len(set(out.columns)) == len(out.columns) > 0, name
        n = out.count()
        if name in sql:
            found = con.execute(sql[name])
            assert sorted(c[0] for c in found.description) == sorted(out.columns), name
            assert len(found.fetchall()) == n, name
