import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["kg_typecheck_verdicts", "kg_closure_cyclic", "kg_transitive_reduction", "kg_retype", "kg_majority", "kg_lca_metrics", "kg_fact_verdicts", "kg_csc_places", "kg_wu_palmer", "kg_robustness", "kg_rewire_candidates", "kg_io_predictions", "kg_io_mapping"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted(repr([flat(r[c]) for c in cols]) for r in got.collect())
    b = sorted(repr([flat(r[i]) for i in at]) for r in want.fetchall())
    assert a == b
