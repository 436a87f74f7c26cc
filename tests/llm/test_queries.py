import duckdb
import pytest

from tradewind.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = [tuple(row[rel.columns.index(c)] for c in columns) for row in rel.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
