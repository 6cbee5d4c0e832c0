"""Every registered query with a SQL twin gives its rows; the others run with a stable schema."""

import pytest

from vellum.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, duck, compare, name):
    compare(registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    assert frame.count() > 0 and len(frame.columns) > 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["main_direction", "pca_box"])
def test_axes_without_covariance_equal_sql(spark, tmp_path, compare, name):
    """Mirrored tiles: their exact covariance is 0, and full ones have no greatest variance."""
    import duckdb
    import numpy as np

    rng = np.random.default_rng(7)
    tiles = rng.choice([-1.0, 1.0], (400, 8, 8))
    tiles[::2, :, 4:] = tiles[::2, :, 3::-1]
    tiles[1::4, 4:] = tiles[1::4, 3::-1]
    tiles[::50] = 1
    rows = [(i, t.reshape(-1).tolist(), 0) for i, t in enumerate(tiles)] + [(400, None, 0), (401, [-1.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    compare(registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name]).df())
