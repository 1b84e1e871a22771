"""Round 3: validLib that leaves few rows or none, and many neighbours of long series."""

import numpy as np
import pytest

from phasefold import queries
from phasefold.functions import kernels
from phasefold.operators.projection import simplex, smap
from phasefold.plans import sweeps

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, tmp_path, name, far):
    """Rows of a query and its SQL over 60 hours, of which only those in `far` have a mean outside 48 to 52."""
    db = duckdb.connect()
    value = f"CASE WHEN h IN ({', '.join(map(str, far)) or 'NULL'}) THEN 60 + h % 7 ELSE 50 + sin(h) END"
    db.execute(f"COPY (SELECT timestamp '2024-01-01' + to_hours(h) AS ts, {value} AS value FROM (SELECT unnest(range(60)) AS h)) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = queries.queries()[name](spark, str(tmp_path)).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    rows = lambda f: sorted(map(str, f[["i", "obs", "pred", "var"]].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize("far,known", [((), 0), ((9,), 30), ((9, 17, 23), 30), ((40,), 0)])
def test_valid_library_of_few_rows(spark, tmp_path, far, known):
    """The library is the first half; a valid row of the second half is none of it."""
    got = same_as_sql(spark, tmp_path, "simplex_valid_library", far)
    assert len(got) == 31 and got.pred.count() == known


@pytest.mark.parametrize("far,known", [((), 0), ((9,), 0), ((25,), 0), ((9, 25), 42), ((9, 25, 33, 50), 42)])
def test_valid_overlap_of_few_rows(spark, tmp_path, far, known):
    """All valid rows of the first 36 but the farthest, or the row itself: one alone is left out of each."""
    got = same_as_sql(spark, tmp_path, "simplex_valid_overlap", far)
    assert len(got) == 43 and got.pred.count() == known


@pytest.fixture(scope="module")
def wave(spark):
    return spark.createDataFrame([(i, float(np.sin(i * i)), float(np.cos(i))) for i in range(60)], "t long, x double, y double")


def test_no_valid_row_in_sweeps(wave):
    span = {"lib": "1 30", "pred": "31 60", "validLib": "x > 2"}
    found = smap(wave, "x", "y", **span, E=2, theta=1)
    assert found["predictions"].count() == 31 and found["predictions"].where("Predictions IS NOT NULL").count() == 0
    got = sweeps.predict_nonlinear(wave, "x", "y", [0, 2], **span, E=2).collect()
    assert sorted((r.theta, r.rho) for r in got) == [(0.0, None), (2.0, None)]
    got = simplex(wave, "x", "y", "1 30", "29 30", E=2, generateSteps=3, validLib="x > 2")
    assert got.count() == 3 and got.where("Predictions IS NOT NULL").count() == 0


@pytest.mark.parametrize("pred", ["31 60", "20 60"])
def test_no_valid_row_in_dimensions(wave, pred):
    got = sweeps.embed_dimension(wave, "x", "y", 3, "1 30", pred, validLib="x > 2").collect()
    assert sorted((r.E, r.rho) for r in got) == [(1, None), (2, None), (3, None)]


def test_neighbours_are_held_by_blocks(monkeypatch):
    rng, asked = np.random.default_rng(0), []
    x = rng.standard_normal(300)
    spec = {"lib": [1, 200], "pred": [150, 300], "E": 2, "Tp": 1, "tau": -1}
    p = kernels.problem([x], x, spec, x > -1)
    want = kernels.simplex(p, p.pred)
    find = kernels.neighbours
    monkeypatch.setattr(kernels, "CELLS", 5000)
    monkeypatch.setattr(kernels, "neighbours", lambda p, q: asked.append(len(q) * min(p.k, len(p.lib))) or find(p, q))
    got = kernels.simplex(p, p.pred)
    assert max(asked) <= 5000 and sum(asked) == len(p.pred) * len(p.lib)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))
