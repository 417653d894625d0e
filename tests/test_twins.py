"""Queries against their SQL twins on small tables of uncommon shape."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from cytofleet.operators import cells as D
from cytofleet.plans import catalogue


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query returns the rows of its twin over the given vectors."""

    def run(name: str, ids: list[int], vectors: np.ndarray) -> bool:
        rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

    return run


def test_copies_never_take_the_id_of_a_field(agrees):
    """Fields 0 and 1000: a copy of the first must not mix with the second."""
    ids = [*range(64), *range(64_000, 64_064)]
    assert agrees("A5_content_hash", ids, np.random.default_rng(0).normal(size=(128, 64)))


def test_cells_without_a_nucleus_have_no_nuclear_values(agrees):
    """One row of tiles: its cells have no nucleus."""
    assert agrees("D14_nuclear_morphometry", list(range(8)), np.random.default_rng(1).normal(size=(8, 64)))


def test_orientation_of_symmetric_regions_does_not_depend_on_the_place(spark):
    shapes = ([(0, 0), (0, 1), (1, 0), (1, 1)], [(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)])
    rows = [(100 * s + k, 1, y + 7 * k, x + 11 * k + s) for s, shape in enumerate(shapes) for k in range(60) for y, x in shape]
    got = D.moments(spark.createDataFrame(rows, "field_id long, cell_id int, y int, x int")).collect()
    assert {(r["orientation"], r["eccentricity"]) for r in got} == {(-math.pi / 4, 0.0)}
