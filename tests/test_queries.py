"""Some of the registered queries against their SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["dfvs_min_size", "fvs_min_size_ic", "scc_labels", "kcore", "rwse_v3", "kernel_u2_preserves_opt", "score_pivot", "combined_pareto", "features_v2_dir", "greedy_dfvs", "gcn_layer", "candidate_pick"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_every_query_is_callable_and_sql_has_a_query():
    import __spark_entry__ as entry

    q = entry.queries()
    assert all(callable(f) for f in q.values())
    assert set(entry.oracle_sql()) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["ma_dfvs_valid", "kma_fvs_valid", "consensus_commit"])
def test_heuristic_queries_run_with_the_defaults(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from coppice.operators import solvers

    real, given = solvers.solve, []
    monkeypatch.setattr(solvers, "solve", lambda *a, **options: given.append(set(options)) or real(*a, **options))
    entry.queries()[name](spark, SF)
    assert given and not set().union(*given) & {"generations", "population", "patience"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_forced_vertices_are_counted_by_the_kernel(spark, duck, monkeypatch):
    import __spark_entry__ as entry
    from coppice.operators import kernels

    real, edges = kernels.confluent_kernel, []
    monkeypatch.setattr(kernels, "confluent_kernel", lambda e, *a, **k: edges.append(e.count()) or real(e, *a, **k))
    got = entry.queries()["kernel_forced_count"](spark, SF).collect()
    assert edges == [duck.execute("SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)").fetchone()[0]]
    assert [tuple(x) for x in got] == duck.execute(entry.oracle_sql()["kernel_forced_count"]).fetchall()
