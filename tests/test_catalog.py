"""Every query with an oracle gives DuckDB's rows; the others run."""

import duckdb
import pytest

from casefile.plans import catalog, catalog_images, catalog_media, catalog_state  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        return float(v) if not isinstance(v, (str, bool, type(None), list)) and hasattr(v, "__float__") else v

    return sorted((tuple(str(one(r[c])) for c in columns) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
