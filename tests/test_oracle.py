"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from folioflow.plans.oracle import SQL
from folioflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    out = [[None if x is None or x is pd.NA or x != x else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in r] for r in frame[sorted(frame.columns)].values.tolist()]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "part", "events", "documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


SOME = [n for n in SQL if n not in ("three_way_compare", "weighted_fusion", "hybrid_search", "eval_by_category", "rag_context_md", "relevance_tiers", "overfetch_rerank", "eval_metrics", "rag_context_xml", "stream_index", "index_update", "rrf_fusion", "hybrid_fallback", "grid_search", "search_chunk_ranks")]  # search_chunks holds the same ranking


@pytest.mark.parametrize("name", [*SOME, "weighted_fusion", "rag_context_xml", "grid_search", "stream_index"])
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).limit(1).count() == 1
