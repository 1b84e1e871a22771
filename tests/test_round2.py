"""Finders, wide matrices, libraries of valid rows, generated combinations, results as objects."""

import itertools

import numpy as np
import pytest

from phasefold import api
from phasefold.functions import kernels
from phasefold.operators.ccm import CCMResult
from phasefold.operators.multiview import combinations_from
from phasefold.operators.projection import simplex
from phasefold.plans import matrices


@pytest.mark.parametrize(("n", "E", "radius", "k", "digits"), [(400, 3, 0, 4, 6), (1000, 2, 12, 5, 6), (300, 1, 150, 6, 6), (200, 2, 0, 300, 6), (500, 2, 3, 3, 1)])
def test_kdtree_equals_all_pairs(n, E, radius, k, digits):
    """The same rows, ties included, as rounded values have many."""
    x = np.round(np.random.default_rng(n).standard_normal(n), digits)
    x[::50] = np.nan
    found = []
    for finder in (None, kernels.tree_finder):
        p = kernels.problem([x], x, {"lib": [1, n], "pred": [1, n], "E": E, "tau": -1, "Tp": 1, "knn": k, "radius": radius})
        p.finder = finder
        found.append((*kernels.neighbours(p), p.short))
    assert np.array_equal(found[0][0], found[1][0]) and np.array_equal(found[0][1], found[1][1]) and found[0][2] == found[1][2]


def series(spark, n=300, columns=1):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal((n, columns)), 0) * 0.1
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.sin(x))], ["t", *(f"x{k}" for k in range(columns))])


def test_finders_of_simplex(spark):
    df = series(spark)
    rows = lambda how: [(r._i, r.Predictions) for r in simplex(df, "x0", "x0", "1 200", "150 300", E=2, neighbor_algorithm=how).orderBy("_i").collect()]

    def own(X, pred, lib, k, radius):
        d = np.sqrt(kernels.masked(kernels.distances(X, pred, lib), pred, lib, radius))
        at = np.argsort(d, 1, kind="stable")[:, :k]
        return lib[at], np.take_along_axis(d, at, 1)

    assert rows("arrays") == rows("kdtree") == rows(own)
    with pytest.raises(ValueError, match="no neighbor_algorithm"):
        rows("balltree")
    with pytest.raises(ValueError, match="validLib"):
        simplex(df, "x0", "x0", "1 200", "150 300", E=2, neighbor_algorithm="join", validLib="x0 > 0")


def test_combinations_from_any_place():
    for n, size in ((6, 3), (5, 5), (7, 1)):
        every = list(itertools.combinations(range(n), size))
        for first in range(len(every)):
            assert list(combinations_from(list(range(n)), size, first, len(every))) == every[first:]


def test_matrix_blocks(spark, monkeypatch):
    """Targets in blocks of three give what single pairs give; neighbours are searched once a block."""
    monkeypatch.setattr(matrices, "TARGETS", 3)
    df = series(spark, 120, 7)
    got = {(r.column, r.target): r.rho for r in matrices.cross_map_matrix(df, 2, lib="1 60", pred="61 120").collect()}
    assert len(got) == 49 and all(got[f"x{k}", f"x{k}"] is None for k in range(7))
    for a, b in (("x0", "x6"), ("x5", "x1")):
        one = api.ComputeError(simplex(df, a, b, "1 60", "61 120", E=2)).first()
        assert got[a, b] == pytest.approx(one.rho, abs=1e-6)
    found = {(r.column, r.target): r.rho for r in matrices.ccm_matrix(df, 2, libSizes="20 80", sample=3, seed=4).collect()}
    assert len(found) == 42
    direct = api.CCM(df, "x2", "x4", "20 80", 3, E=2, seed=4).where("LibSize = 80").first()
    assert found["x2", "x4"] == pytest.approx(direct["x2:x4"], abs=1e-6)


def test_valid_rows_in_matrices(spark):
    df = series(spark, 200, 2)
    for valid in ("x0 > 0", "true"):
        got = {r.column: (r.E, r.rho) for r in matrices.embed_dim_columns(df, maxE=3, lib="1 100", pred="101 200", validLib=valid).collect()}
        E, rho = got["x1"]
        one = api.ComputeError(simplex(df, "x1", "x1", "1 100", "101 200", E=E, validLib=valid)).first().rho
        assert rho == pytest.approx(one, abs=1e-6)
    a = matrices.ccm_matrix(df, 2, libSizes="20 60", sample=2, validLib="x0 > 0").where("column = 'x0'").first()
    b = api.CCM(df, "x0", "x1", "20 60", 2, E=2, seed=0, validLib="x0 > 0").where("LibSize = 60").first()
    assert a.error is None and a.rho == pytest.approx(b["x0:x1"], abs=1e-6)


def test_wide_table(spark):
    """2,000 columns: values are gathered column by column."""
    rng = np.random.default_rng(0)
    rows = np.round(rng.standard_normal((30, 2000)), 3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "t int, v array<double>").selectExpr("t", *(f"v[{k}] AS c{k}" for k in range(2000)))
    got = matrices.embed_dim_columns(df, maxE=2, lib="1 15", pred="16 30")
    assert got.count() == 2000


def test_ccm_result(spark):
    got = api.CCM(series(spark, 100, 2), "x0", "x1", "20 60", 2, E=2, seed=1, returnObject=True)
    assert isinstance(got, CCMResult) and got.LibMeans.count() == 2 and got.PredictStats.count() == 8
