"""Every query against its DuckDB SQL at the smallest scale, and the shape of its plan."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from amendry import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    def value(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        return x if isinstance(x, str) else repr(round(float(x), 6) + 0.0)

    return sorted(map(str, frame[sorted(frame.columns)].map(value).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_oracle(spark, oracle, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(oracle.execute(catalog.ORACLE_SQL[name]).df())


#: Jobs of several steps run when the query is built; the plan of the last step says little about them.
STEPS = {"fork_points", "merged_branches", "merged_section_pairs", "mainline", "greedy_pick"}
NATIVE = sorted(n for n in catalog.ORACLE_SQL if n not in STEPS | {"edit_hunks", "fit_optimality"})


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "part", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fits_see_whole_vectors_and_lengths(spark, monkeypatch):
    """9 d + 9 and 4 d + 5 features of 64 numbers, lengths as they are, and the operator's own number of steps."""
    seen = []
    monkeypatch.setattr(catalog.models, "lopo", lambda df, kind="pairwise", **options: seen.append((df, options)))
    catalog.lopo_pairwise(spark, SF)
    catalog.lopo_bt(spark, SF)
    assert [x[1] for x in seen] == [{}, {}]
    rows = seen[0][0].collect()
    assert {len(r.features) for r in rows} == {585} and any(r.features[-5:-2] != [0.0, 0.0, 0.0] for r in rows)
    assert {len(v) for r in seen[1][0].collect() for v in (r.better, r.worse)} == {261}


def test_encoded_texts_are_whole_and_of_both_columns(spark):
    rows = catalog.encoded_texts(spark, SF).collect()
    e = catalog.view(spark, SF, "examples")
    assert {r["size"] for r in rows} == {256}
    assert len(rows) == e.select("source_text").union(e.select("edited_text")).distinct().count()
