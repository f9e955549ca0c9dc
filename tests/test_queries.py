"""Every query of the catalog: against DuckDB where it has SQL, else that it runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from causalloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def canonical(df):
    cols = sorted(df.columns)
    text = df[cols].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return text.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        want = db.execute(catalog.ORACLE_SQL[name]).df()
        assert canonical(got).equals(canonical(want))
    else:
        assert len(got.columns)


def test_whole_vectors_roll(spark, sf_dir):
    sizes = {r.vec_id: len(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = catalog.QUERIES["zero_pad_roll"](spark, sf_dir).collect()
    assert len(got) == 3 * len(sizes)
    for r in got:
        parts = r.rolled.split(",")
        assert len(parts) == sizes[r.vec_id]
        assert any(float(x) for x in parts) == (abs(r.k) < len(parts))


@pytest.mark.parametrize("name", ["kshape_assign", "centroid_lag", "gap_statistic"])
def test_all_ks(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).select("service", "k").distinct().collect()
    services = {r.service for r in rows}
    assert services and {tuple(r) for r in rows} == {(s, k) for s in services for k in range(2, 7)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
