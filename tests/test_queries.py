"""Every query with SQL against DuckDB, the rest for a stable schema."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracefield import plans


WITHOUT_SQL = {
    "assigned_pairs", "bootstrap_interval", "generated_discs", "greedy_links", "linked_sets", "principal_axis", "segment_distances", "verified_clusters",
}


SIZES = "[12, 18, 29, 23]"
VALUES = "[0.0, 11.52, 0.0, 0.0, 50.91]"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 5)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    if name not in plans.ORACLES:
        # these have tests of their own against plain versions
        assert name in WITHOUT_SQL and got.count() > 0
        return
    expected = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.toPandas()) == rows(expected)


@pytest.mark.parametrize(
    "name, table, keep",
    [
        ("disc_face_traces", "part", "SELECT unnest([15440, 100769, 101643, 7])::BIGINT AS p_partkey, unnest({sizes})::INT AS p_size, 'Brand#11' AS p_brand"),
        ("three_point_normals", "events", "SELECT unnest([21488, 28999, 52979, 63606, 5])::BIGINT AS event_id, 'a' AS event_type, 7::BIGINT AS user_id, unnest({values})::DOUBLE AS value"),
    ],
)
def test_corners_ties_and_lines_without_length(spark, tmp_path, name, table, keep):
    con = duckdb.connect()
    keep = keep.replace("{sizes}", SIZES).replace("{values}", VALUES)
    con.execute(f"COPY ({keep}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    assert rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(plans.ORACLES[name]).df())


def test_sweep_does_not_multiply_pairs_by_settings(spark, sf_dir):
    plan = plans.QUERIES["parameter_sweep"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_corpus_subpackage():
    import pathlib

    import tracefield

    top = pathlib.Path(tracefield.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "llm" not in path.read_text()


@pytest.mark.parametrize("name", ["adaptive_gate_pairs", "bayes_factor_candidates", "range_overlap_join"])
def test_pairs_are_made_on_all_partitions(spark, sf_dir, name):
    """Not in the one task that reads a small file of discs."""
    got = plans.QUERIES[name](spark, sf_dir)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(
    "name, table, keep",
    [
        # chords that only touch a corner, by the last digit of a sine
        ("disc_face_traces", "part", "SELECT unnest([538643, 209421, 7])::BIGINT AS p_partkey, unnest([37, 27, 9])::INT AS p_size, 'Brand#11' AS p_brand"),
        # a quality next to the middle of two rounded ones
        ("three_point_normals", "events", "SELECT unnest([347, 555, 5])::BIGINT AS event_id, 'a' AS event_type, 7::BIGINT AS user_id, 160.0::DOUBLE AS value"),
    ],
)
def test_last_digits_of_sines_and_of_rounding(spark, tmp_path, name, table, keep):
    con = duckdb.connect()
    con.execute(f"COPY ({keep}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got, sql = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(plans.ORACLES[name]).df()
    columns = sorted(sql.columns)
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, sql[columns].values.tolist()))


def test_pairs_of_one_range_follow_each_other(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 920 * i + 7 AS p_partkey, 'Brand#11' AS p_brand, 9::INT AS p_size FROM range(40) q(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS s_suppkey FROM range(2000) q(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in plans.QUERIES["range_overlap_join"](spark, str(tmp_path)).select("disc_id", "s_suppkey").collect()]
    assert sorted(got) == sorted(con.execute(plans.ORACLES["range_overlap_join"]).fetchall())
    changes = sum(a[1] != b[1] for a, b in zip(got, got[1:]))
    assert changes < len(got) / 30
