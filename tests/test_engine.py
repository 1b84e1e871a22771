"""Operators against plain numpy, and what must not depend on plans, partitions or row order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold import api
from phasefold.functions import indices, kernels, solvers
from phasefold.operators import surrogate
from phasefold.operators.projection import simplex
from phasefold.plans import matrices
from phasefold.sources import io
from phasefold.streaming.forecast import forecast_stream

rng = np.random.default_rng(11)


@pytest.fixture(scope="module")
def lorenz(spark):
    return io.sample(spark, "lorenz", 400).cache()


@pytest.fixture(scope="module")
def frame(lorenz):
    return lorenz.orderBy("t").toPandas()


def naive_simplex(x, y, lib, pred, E, tau, Tp, k, radius=0):
    """Loops only; x is one column."""
    n = len(x)
    state = lambda i: [x[i + tau * j] if 0 <= i + tau * j < n else np.nan for j in range(E)]
    shift = abs(tau) * (E - 1)
    lo, hi = (lib[0] - 1 + shift, lib[1] - 1) if tau < 0 else (lib[0] - 1, lib[1] - 1 - shift)
    lo, hi = (lo + abs(Tp) - 1, hi) if Tp < 0 else (lo, hi - Tp)
    out = {}
    for p in range(pred[0] - 1, pred[1]):
        a = state(p)
        if np.isnan(a).any():
            continue
        near = sorted((float(np.sqrt(sum((u - v) ** 2 for u, v in zip(a, state(q))))), q) for q in range(lo, hi + 1) if 0 <= q + Tp < n and abs(p - q) > radius and not np.isnan(state(q)).any())[:k]
        w = [np.exp(-d / max(near[0][0], 1e-6)) for d, _ in near]
        v = [y[q + Tp] for _, q in near]
        mu = sum(a * b for a, b in zip(w, v)) / sum(w)
        out[p + Tp] = (mu, sum(a * (b - mu) ** 2 for a, b in zip(w, v)) / sum(w))
    return out


CASES = [
    dict(E=3, tau=-1, Tp=1),
    dict(E=2, tau=-2, Tp=3),
    dict(E=3, tau=2, Tp=1),
    dict(E=3, tau=-1, Tp=-2),
    dict(E=1, tau=-1, Tp=0),
    dict(E=2, tau=-1, Tp=1, radius=15),
    dict(E=2, tau=-1, Tp=1, k=9),
]


@pytest.mark.parametrize("case", CASES, ids=str)
@pytest.mark.parametrize("spans", [((1, 150), (151, 220)), ((1, 200), (100, 260))], ids=str)
def test_simplex(lorenz, frame, case, spans):
    c = {"radius": 0, "k": case["E"] + 1} | case
    lib, pred = spans
    want = naive_simplex(frame.V1.to_numpy(), frame.V2.to_numpy(), lib, pred, c["E"], c["tau"], c["Tp"], c["k"], c["radius"])
    got = api.Simplex(lorenz, "V1", "V2", list(lib), list(pred), E=c["E"], tau=c["tau"], Tp=c["Tp"], knn=case.get("k", 0), exclusionRadius=c["radius"]).toPandas()
    have = {r.row: (r.Predictions, r.Pred_Variance) for r in got.rename(columns={"_i": "row"}).itertuples() if r.Predictions == r.Predictions}
    assert have.keys() == want.keys()
    assert np.allclose([have[i] for i in want], list(want.values()), atol=1e-9)


def test_alignment(lorenz, frame):
    got = api.Simplex(lorenz, "V1", "V1", "1 100", "381 400", E=2, Tp=5).orderBy("_i").toPandas()
    assert got["_i"].tolist() == list(range(380, 405))
    assert got["Time"].tolist() == list(range(381, 406))
    assert got["Observations"].isna().sum() == 5 and got["Predictions"].isna().tolist() == [True] * 5 + [False] * 20
    back = api.Simplex(lorenz, "V1", "V1", "50 150", "1 10", E=1, Tp=-3).orderBy("_i").toPandas()
    assert back["_i"].tolist() == list(range(-3, 10)) and back["Time"].tolist()[:2] == [-2, -1]
    assert back["Predictions"].isna().tolist() == [False] * 10 + [True] * 3


def test_times(spark):
    days = pd.date_range("2001-01-06", periods=60, freq="7D")
    for t in (days, days.strftime("%Y-%m-%d"), days.date):
        df = spark.createDataFrame(pd.DataFrame({"d": t, "x": rng.standard_normal(60)}))
        got = api.Simplex(df, "x", "x", "1 40", "41 60", E=2, Tp=2).orderBy("_i").toPandas()
        assert str(got["Time"].iloc[-1])[:10] == str(days[-1] + pd.Timedelta(days=14))[:10]


def test_plans_agree(lorenz):
    opts = dict(columns="V1", target="V3", lib="1 200", pred="150 260", E=3, Tp=2, tau=-2)
    key = ["segment", "_i"]
    a = simplex(lorenz, **opts).orderBy(key).toPandas()
    shuffled = lorenz.orderBy(F.rand(3)).repartition(7)
    for other in (simplex(shuffled, **opts), simplex(lorenz, neighbor_algorithm="join", **opts), simplex(lorenz.coalesce(1), **opts)):
        b = other.orderBy(key).toPandas()
        assert np.allclose(a[["Observations", "Predictions", "Pred_Variance"]], b[["Observations", "Predictions", "Pred_Variance"]], equal_nan=True)


def test_blocks_of_long_series(spark):
    df = io.sample(spark, "logistic", 3200)
    opts = dict(columns="x", target="y", lib="1 1500", pred="1400 1700 2900 3200", E=2, Tp=2)
    a, b = (simplex(df, n=n, **opts).orderBy("segment", "_i").toPandas() for n in (None, 3200))
    assert a.equals(b)


def test_panel(spark, frame):
    long = pd.concat([pd.DataFrame({"k": v, "t": frame.t, "x": frame[v]}) for v in ("V1", "V2", "V3")])
    got = api.Simplex(spark.createDataFrame(long), "x", "x", "1 100", "101 150", E=2, series="k").toPandas()
    for v in ("V1", "V2", "V3"):
        one = api.Simplex(spark.createDataFrame(frame[["t", v]]), v, v, "1 100", "101 150", E=2).orderBy("_i").toPandas()
        assert np.allclose(got[got.k == v].sort_values("_i").Predictions, one.Predictions, equal_nan=True)


def test_missing(spark, frame):
    x, y = frame.V1.to_numpy().copy(), frame.V2.to_numpy().copy()
    x[[50, 51, 120]] = np.nan
    y[[70, 130]] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"t": frame.t, "x": x, "y": y}))
    got = api.Simplex(df, "x", "y", "1 150", "100 200", E=2).orderBy("_i").toPandas().set_index("_i")
    assert np.isnan(got.Predictions[[121, 122]]).all() and len(got) == 102
    want = naive_simplex(x, y, (1, 150), (100, 200), 2, -1, 1, 3)
    for i, (mu, _) in want.items():
        assert (np.isnan(mu) and np.isnan(got.Predictions[i])) or mu == pytest.approx(got.Predictions[i])


def naive_smap(X, y, lib, p, Tp, theta):
    """The row itself is left out, or if it is no library row, the farthest."""
    d = np.sqrt(((X[lib] - X[p]) ** 2).sum(1))
    keep = np.array([q != p for q in lib])
    lib, d = np.array(lib)[keep], d[keep]
    if keep.all():
        o = np.argsort(d, kind="stable")[:-1]
        lib, d = lib[o], d[o]
    w = np.exp(-theta * d / d.mean())
    A = w[:, None] * np.column_stack([np.ones(len(lib)), X[lib]])
    c, _, _, s = np.linalg.lstsq(A, w * y[lib + Tp], rcond=None)
    return c[0] + c[1:] @ X[p], c, s


@pytest.mark.parametrize("theta", [0, 2.5])
@pytest.mark.parametrize("pred", [(101, 140), (60, 110)], ids=str)
def test_smap(lorenz, frame, theta, pred):
    E, x = 3, frame.V1.to_numpy()
    X = kernels.embed([x], E, -1)
    lib = np.arange(2, 99)
    got = api.SMap(lorenz, "V1", "V1", "1 100", list(pred), E=E, theta=theta)
    mu, coef, sing = (got[k].where("_i > 0").orderBy("_i").toPandas() for k in ("predictions", "coefficients", "singularValues"))
    assert list(coef.columns)[3:] == ["C0", "∂V1/∂V1(t-0)", "∂V1/∂V1(t-1)", "∂V1/∂V1(t-2)"]
    for p in range(pred[0] - 1, pred[1]):
        m, c, s = naive_smap(X, x, lib, p, 1, theta)
        at = mu.index[mu["_i"] == p + 1][0]
        assert mu.Predictions[at] == pytest.approx(m, abs=1e-8)
        assert np.allclose(coef.iloc[at, 3:].astype(float), c, atol=1e-7) and np.allclose(sing.iloc[at, 3:].astype(float), s)


def test_smap_rank_deficient(spark):
    """A noiseless circle in four lags has rank 2: the least-norm solution predicts it."""
    got = api.SMap(io.sample(spark, "circle", 200), "x", "x", "1 100", "110 160", E=4, theta=3)["predictions"].dropna().toPandas()
    assert np.abs(got.Observations - got.Predictions).max() < 1e-8


def test_solvers():
    X = rng.standard_normal((200, 4))
    true = np.array([1.0, -2.0, 0.0, 0.5])
    y = X @ true + 3 + 0.01 * rng.standard_normal(200)
    for name in solvers.NAMED:
        options = {"Lasso": 0.001, "ElasticNet": 0.001, "LassoLars": 0.0}.get(name)
        fit = solvers.NAMED[name](options) if options is not None else solvers.solver(name)
        if name == "OrthogonalMatchingPursuit":
            fit = solvers.orthogonal_matching_pursuit(3)
        c, i = fit(X, y)
        loose = 2.5 if name == "OrthogonalMatchingPursuitCV" else 0.1
        assert np.abs(c - true).max() < loose and abs(i - 3) < 0.3, name
    with pytest.raises(ValueError):
        solvers.solver("Nothing")


def test_ccm(lorenz, frame):
    got = api.CCM(lorenz, "V1", "V2", [30, 200], 6, E=3, seed=5).orderBy("LibSize").toPandas()
    x, y = frame.V1.to_numpy(), frame.V2.to_numpy()
    X = kernels.embed([x], 3, -1)
    draws, want = np.random.default_rng(5), []
    pred = np.arange(2, 400)
    for size in (30, 200):
        rho = []
        for _ in range(6):
            lib = pred[draws.choice(len(pred), size=size, replace=False)]
            mu = []
            for p in pred:
                d = np.sqrt(((X[lib] - X[p]) ** 2).sum(1))
                d[lib == p] = np.inf
                o = np.argsort(d)[:4]
                w = np.exp(-d[o] / max(d[o[0]], 1e-6))
                mu.append((w * y[lib[o]]).sum() / w.sum())
            rho.append(round(np.corrcoef(mu, y[pred])[0, 1], 5))
        want.append(np.mean(rho))
    assert np.allclose(got["V1:V2"], want, atol=1e-6)
    assert got["V1:V2"].is_monotonic_increasing
    both = api.CCM(lorenz, "V1", "V2", "30 60 30", 2, E=3, seed=5, includeData=True)
    assert both["LibMeans"].count() == 2 and both["PredictStats"].count() == 8


def test_causal_direction(spark):
    """x drives y, so y's states tell x better than x's tell y."""
    got = api.CCM(io.sample(spark, "logistic", 600), "x", "y", [500], 4, E=2, seed=1).first()
    assert got["y:x"] > got["x:y"] and got["y:x"] > 0.8


def test_nonlinearity(spark):
    got = api.PredictNonlinear(io.sample(spark, "tent", 500), "x", "x", lib="1 250", pred="251 490", E=2).toPandas().sort_values("theta")
    assert len(got) == 15 and got.rho.iloc[-5:].max() > got.rho.iloc[0] + 0.1


def test_sweeps_equal_single_calls(lorenz):
    rho = api.EmbedDimension(lorenz, "V1", "V1", 5, "1 200", "201 380", Tp=3, tau=-2, exclusionRadius=8).orderBy("E").toPandas()
    for e, want in zip(rho.E, rho.rho):
        one = api.ComputeError(api.Simplex(lorenz, "V1", "V1", "1 200", "201 380", E=int(e), Tp=3, tau=-2, exclusionRadius=8), digits=None).first()
        assert want == pytest.approx(one.rho, abs=1e-9)
    rho = api.PredictInterval(lorenz, "V1", "V1", 4, "1 200", "201 380", E=3).orderBy("Tp").toPandas()
    assert rho.rho.is_monotonic_decreasing and len(rho) == 4


def test_multiview(lorenz):
    got = api.Multiview(lorenz, "V1 V2 V3", "V1", "1 150", "151 250", D=2, E=2, trainLib=True)
    view = got["View"].orderBy("rank").toPandas()
    assert len(view) == 3  # the root of 15
    views, mean = got["Views"].toPandas(), got["Predictions"].orderBy("_i").toPandas()
    assert np.allclose(views.groupby("_i").Predictions.mean(), mean.Predictions, equal_nan=True)
    without = api.Multiview(lorenz, "V1 V2 V3", "V1", "1 150", "151 250", D=2, excludeTarget=True)["View"].toPandas()
    assert not any("V1" in c for cs in without.Columns for c in cs)
    with pytest.warns(UserWarning):
        assert api.Multiview(lorenz, "V1 V2", "V1", "1 150", "151 250", D=9, multiview=7)["View"].count() == 1


def test_surrogates(spark, frame):
    for n in (200, 201):
        x = frame.V1.to_numpy()[:n]
        z = surrogate.ebisuzaki(x, np.random.default_rng(1))
        a, b = np.abs(np.fft.rfft(x))[1:-1], np.abs(np.fft.rfft(z))[1:-1]
        assert len(z) == n and z.std() == pytest.approx(x.std()) and np.allclose(b / a, (b / a)[0])
    df = spark.createDataFrame(frame[["t", "V1"]])
    got = api.SurrogateData(df, "V1", "random_shuffle", 3).toPandas()
    assert list(got.columns) == ["_i", "Time", "V1_1", "V1_2", "V1_3"]
    assert np.allclose(sorted(got.V1_2), sorted(frame.V1), atol=1e-8) and not np.allclose(got.V1_1, got.V1_2)
    again = api.SurrogateData(df, "V1", "random_shuffle", 3).toPandas()
    assert got.sort_values("_i").equals(again.sort_values("_i").set_index(got.sort_values("_i").index))
    season = surrogate.smooth_season(np.sin(np.arange(300) / 20) + 0.05 * rng.standard_normal(300), 0.8)
    assert np.abs(season - np.sin(np.arange(300) / 20)).max() < 0.2


def test_generation(lorenz, frame):
    got = api.Simplex(lorenz, "V1", "V1", "1 300", "1 2", E=3, generateSteps=30, generateConcat=True).orderBy("_i", "Observations").toPandas()
    assert len(got) == 430
    end = api.Simplex(lorenz, "V1", "V1", "1 400", "1 2", E=3, generateSteps=5).orderBy("_i").toPandas()
    assert end["_i"].tolist() == list(range(400, 405)) and end.Predictions.notna().all()
    x = frame.V1.to_numpy()
    for r in end.itertuples():
        want = naive_simplex(np.append(x, np.nan), np.append(x, np.nan), (1, 400), (len(x), len(x)), 3, -1, 1, 4)[len(x)][0]
        assert r.Predictions == pytest.approx(want)
        x = np.append(x, want)
    smap = api.SMap(lorenz, "V1", "V1", "1 400", "1 2", E=3, theta=4, generateSteps=5)["predictions"].toPandas()
    assert smap.Predictions.notna().all()


def test_fan_outs(lorenz):
    best = api.EmbedDim_Columns(lorenz, maxE=4, lib="1 150", pred="151 250").toPandas().set_index("column")
    assert sorted(best.index) == [f"V{k}" for k in range(1, 6)] and best.E.between(1, 4).all()
    m = api.CrossMap_Matrix(lorenz, 2, lib="1 150", pred="151 250").toPandas()
    one = api.ComputeError(api.Simplex(lorenz, "V2", "V4", "1 150", "151 250", E=2), digits=None).first()
    assert m[(m.column == "V2") & (m.target == "V4")].rho.iloc[0] == pytest.approx(one.rho)
    assert m[m.column == m.target].rho.isna().all() and len(m) == 25
    c = api.CCM_Matrix(lorenz, [2, 2, 3, 2, 2], sample=3, expConverge=True, includeCCM=True).toPandas()
    assert len(c) == 20 and c.error.isna().all() and c.rho.notna().all()
    bad = api.CCM_Matrix(lorenz, 90, sample=3).toPandas()
    assert bad.rho.isna().all() and bad.error.notna().all()


def test_converge():
    x = np.linspace(0.1, 0.9, 9)
    y0, b, a = matrices.converge(x, 0.2 + 0.5 * (1 - np.exp(-4 * x)))
    assert (y0, b, a) == pytest.approx((0.2, 0.5, 4), abs=1e-3)


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 7)) for i in range(60)], "t long, x double, y double")
    got = api.ComputeError(api.Simplex(df, "x", "y", "1 30", "31 60", E=2)).first()
    assert got.n_pairs == 29 and got.RMSE is not None
    assert api.ComputeError(api.Simplex(df, "y", "x", "1 30", "31 60", E=2)).first().rho is None


def test_names_with_spaces_and_dots(spark, frame):
    df = spark.createDataFrame(frame.rename(columns={"V1": "Var 1", "V2": "a.b"}))
    got = api.Simplex(df, ["Var 1"], ["a.b"], [1, 100], [101, 150], E=2).count()
    assert got == 51 and api.Embed(df, 2, -1, ["Var 1", "a.b"]).columns == ["Var 1(t-0)", "a.b(t-0)", "Var 1(t-1)", "a.b(t-1)"]


@pytest.mark.parametrize(
    "change",
    [{"columns": ""}, {"columns": "nope"}, {"target": ""}, {"lib": ""}, {"lib": "1 100 7"}, {"lib": "100 1"}, {"lib": "0 100"}, {"pred": "0 100"}, {"pred": "150 101"}, {"E": 0}, {"tau": 0}, {"lib": "1 5", "E": 6}, {"pred": "101 500", "n": 400}, {"neighbor_algorithm": "magic"}],
    ids=str,
)
def test_refusals(lorenz, change):
    with pytest.raises(ValueError):
        api.Simplex(lorenz, **{"columns": "V1", "target": "V1", "lib": "1 100", "pred": "101 200", "E": 2} | change)


def test_other_refusals(lorenz):
    for call in (
        lambda: api.SMap(lorenz, "V1 V2", "V1", "1 100", "101 200", E=2),
        lambda: api.CCM(lorenz, "V1", "V2", "", 5, E=2),
        lambda: api.CCM(lorenz, "V1", "V2", [50], 0, E=2),
        lambda: api.CCM(lorenz, "V1", "V2", [3], 5, E=2),
        lambda: api.CCM(lorenz, "V1", "V2", [500], 5, E=2, n=400),
        lambda: api.Embed(lorenz, 0, -1, "V1"),
        lambda: api.Embed(lorenz, 2, 0, "V1"),
        lambda: api.Multiview(lorenz, "", "V1"),
        lambda: api.SurrogateData(lorenz, "V1", "none"),
        lambda: api.SurrogateData(lorenz),
        lambda: api.CrossMap_Matrix(lorenz, [1, 2]),
        lambda: indices.pairs([1], "lib"),
    ):
        with pytest.raises(ValueError):
            call()


def test_stream(spark, lorenz, tmp_path):
    rows = lorenz.select("t", "V1")
    history = rows.where("t <= 300")
    for k in range(2):
        rows.where(f"t > {300 + 20 * k} AND t <= {320 + 20 * k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = forecast_stream(stream, history, "V1", str(tmp_path / "out"), E=3, trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/forecasts").orderBy("Time").toPandas()
    want = api.Simplex(rows.where("t <= 340"), "V1", "V1", "1 300", "300 340", E=3).where("Predictions IS NOT NULL").orderBy("_i").toPandas()
    assert set(range(301, 341)) <= set(got.Time)
    both = got.drop_duplicates("Time").merge(want, on="Time", suffixes=("", "_w"))
    assert np.allclose(both.Predictions, both.Predictions_w)


def test_io(spark, lorenz, tmp_path):
    io.register_samples(spark)
    assert spark.table("circle").count() == 1000
    io.write(lorenz, f"{tmp_path}/x.csv")
    assert io.read_csv(spark, f"{tmp_path}/x.csv").count() == 400
    io.write(lorenz, f"{tmp_path}/x.parquet", by=None)
    assert io.read_parquet(spark, f"{tmp_path}/x.parquet").count() == 400
    io.write(lorenz, f"{tmp_path}/x.feather")
    assert io.read_feather(spark, f"{tmp_path}/x.feather").count() == 400


def test_examples_and_cli(spark, lorenz, tmp_path):
    from phasefold import cli
    from phasefold.examples import examples

    assert all(df.count() > 0 for df in examples(spark).values())
    io.write(lorenz, f"{tmp_path}/in.parquet")
    cli.main(["EmbedDimension", "--input", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/out.csv", "columns=V1", "target=V1", "maxE=3", "lib=1 100", "pred=[101, 200]"], spark)
    assert io.read_csv(spark, f"{tmp_path}/out.csv").count() == 3
    with pytest.raises(ValueError):
        api.MakeBlock()


def test_generated_maps(lorenz):
    got = api.SMap(lorenz, "V1", "V1", "1 400", "1 2", E=2, theta=1, generateSteps=3, generateConcat=True)
    coef = got["coefficients"].orderBy("_i").toPandas()
    assert len(coef) == 403 and coef["C0"].notna().sum() == 3 and list(coef.columns)[-1] == "∂V1/∂V1(t-1)"
