"""Every registered query of the library against its oracle at the smallest scale."""

import duckdb
import pytest

from veilspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders events documents".split()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    mine = catalog.queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    assert normal(mine.columns, mine.collect()) == normal(columns, result.fetchall())


def test_all_rules_run_on_whole_documents(spark):
    out = catalog.queries()["detect_all_rules"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
