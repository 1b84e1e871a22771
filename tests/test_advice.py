"""Whole jobs where an earlier round left rows out."""

import pytest

from phasefold import queries as q

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.fixture(scope="module")
def hours(db):
    return db.sql("SELECT count(DISTINCT date_trunc('hour', ts)) FROM events").fetchall()[0][0]


def whole(db, a, b):
    """rho with all hours as library, by the SQL of the operators."""
    return db.sql(f"SELECT {q.RHO} FROM ({q.sql_simplex(q.FILLED, [a], b, q.ALL, q.ALL, 2, 0)})").fetchall()[0][0]


def test_ccm_takes_all_hours(spark, db, hours):
    assert hours > 300
    got = q.queries()["ccm_whole_library"](spark, SF).collect()
    assert [(r.LibSize, r.fwd, r.rev) for r in got] == [(hours, whole(db, "g0", "g1"), whole(db, "g1", "g0"))]
    sizes = {r.LibSize for r in q.queries()["ccm_library_sizes"](spark, SF).collect()}
    assert max(sizes) == hours and len(sizes) == 5
    assert {r.LibSize for r in q.queries()["ccm_statistics"](spark, SF).collect()} == {hours * 17 // 100, hours // 2}


def test_ccm_matrix_takes_all_hours(spark, db):
    got = {(r.column, r.target): r.rho for r in q.queries()["ccm_matrix_whole"](spark, SF).collect()}
    assert len(got) == 20
    for a, b in (("g0", "g1"), ("g3", "g2"), ("g4", "g0")):
        assert got[a, b] == whole(db, a, b)
    direct = q.matrices.ccm_matrix(q.filled(spark, SF), 2, sample=5, time="t").collect()
    assert {(r.column, r.target, r.rho) for r in q.queries()["ccm_matrix"](spark, SF).collect()} == {(r.column, r.target, r.rho) for r in direct}


def same_users(spark, folder):
    got = {(r.user_id, r.i): (r.obs, r.pred) for r in q.queries()["simplex_panel"](spark, str(folder)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = {(u, i): (o, p) for u, i, o, p in c.sql(q.USERS).fetchall()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        for a, b in zip(got[k], v):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=2e-6)), k
    return got


def test_panel_takes_all_events(spark):
    got = same_users(spark, SF)
    assert max(i for _, i in got) > 41


def test_panel_keeps_short_users(spark, tmp_path):
    import random

    rng = random.Random(1)
    counts = {1: 90, 2: 39, 3: 5, 4: 4, 5: 2, 6: 1}
    rows = [(u, 1000 * u + k, rng.uniform(0, 100)) for u, n in counts.items() for k in range(n)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").toPandas().to_parquet(tmp_path / "events.parquet")
    got = same_users(spark, tmp_path)
    assert {u for u, _ in got} == set(counts)
    assert all(p is None for (u, _), (_, p) in got.items() if u > 3) and got[2, 39][1] is not None


def test_solvers_choose_by_the_data():
    import numpy as np

    from phasefold.functions import solvers

    rng = np.random.default_rng(2)
    X = rng.standard_normal((300, 6))
    true = np.array([2.0, -1.5, 1.0, 0, 0, 0])
    c, i = solvers.solver("OrthogonalMatchingPursuitCV")(X, X @ true + 3 + 0.1 * rng.standard_normal(300))
    assert np.abs(c - true).max() < 0.05 and abs(i - 3) < 0.05
    # mostly noise: the whole path fits it, cross-validation and the criterion shrink
    X = rng.standard_normal((60, 20))
    true = np.r_[1.0, np.zeros(19)]
    y = X @ true + rng.standard_normal(60)
    whole = np.abs(solvers.linear(X, y)[0] - true).sum()
    for name in ("LassoLarsCV", "LarsCV", "LassoLarsIC"):
        c, _ = solvers.solver(name)(X, y)
        assert np.abs(c - true).sum() < 0.7 * whole and c[0] > 0.4, name
    # a point of the path between knots is the lasso's solution for that penalty of standardised columns
    Z = (X - X.mean(0)) / X.std(0)
    c, _ = solvers.solver("LassoLarsCV")(Z, y)
    corr = Z.T @ (y - y.mean() - Z @ c) / len(y)
    most = np.abs(corr).max()
    assert np.allclose(corr[c != 0], most * np.sign(c[c != 0]), atol=1e-8)
    flat = np.column_stack([np.ones(30), np.arange(30.0)])
    for name in solvers.NAMED:
        if name.endswith(("CV", "IC")):
            for n in (0, 1, 2, 3, 30):
                c, i = solvers.solver(name)(flat[:n], flat[:n, 1])
                assert not n or np.isfinite(c).all() and np.isfinite(i) and c[0] == 0, (name, n)
