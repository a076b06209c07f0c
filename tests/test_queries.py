"""Every registered query of the core against its SQL, at the smallest scale."""

import duckdb
import pytest

from docquarry import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def value(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(map(value, r)) for r in found.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_audit_of_every_document(spark, tmp_path):
    texts = ["w " * 8193, "w " * 701, "w " * 650, "w " * 600, " \n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = queries.over_limit_audit(spark, str(tmp_path)).collect()
    assert r.asDict() == {"structured_over_model": 1, "over_budget": 3, "over_model": 1, "blank": 2, "verdict": "FAILED"}


def test_all_registered():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"chunk_pack"}
