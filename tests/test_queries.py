import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from citeline.plans import context_plans, registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") else v
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SMALL).toPandas()
    wanted = duck.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)


def test_entry(spark):
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sources", [["src1", "Energy", None], ["src1", ""]])
def test_a_question_without_a_name_has_every_source(spark, tmp_path, sources):
    spark.createDataFrame([(0, "about energy"), (1, "names src"), (4, "names nobody"), (8, None), (12, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, s) for i, s in enumerate(sources * 2)], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["scope_by_source"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert plain(found) == plain(con.sql(registry.ORACLES["scope_by_source"]).df())
    if "" not in sources:
        assert {x for i, x in found.values.tolist() if i == 4} == set(sources)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_documents_do_not_move_for_few_found_rows(spark, monkeypatch):
    """Texts meet the found rows where they lie, and once: the calls and checks of answers read no document again, and no index is built for them."""
    chunks = context_plans.ranked_chunks(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" in chunks and "BroadcastHashJoin" in chunks and "Exchange hashpartitioning" not in chunks
    monkeypatch.setattr(context_plans.P, "stored_index", None)
    assert "documents.parquet" not in registry.QUERIES["answered_turns"](spark, SMALL)._jdf.queryExecution().toString()
