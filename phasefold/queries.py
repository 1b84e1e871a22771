"""Registered queries over the given tables, and the SQL that gives the same rows.

Series: hours (mean event value), panel (the same by event type), days (order totals),
users (one short series per user). Values are rounded where they are made, so that both
engines start from equal numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metrics import compute_error
from .operators.ccm import ccm
from .operators.embed import embed
from .operators.multiview import multiview
from .operators.projection import neighbours, request, simplex, simplex_whole, smap
from .operators.surrogate import surrogate_data
from .plans import matrices, sweeps
from .sources import io

# ---------------------------------------------------------------- series


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").cast("double").alias("n"))


HOURS = "SELECT row_number() OVER (ORDER BY t) - 1 AS i, t, v, n FROM (SELECT date_trunc('hour', ts) AS t, round(avg(value), 6) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1)"


def panel(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("t"))
    return e.agg(*(F.round(F.avg(F.when(F.pmod("user_id", F.lit(5)) == k, F.col("value"))), 6).alias(f"g{k}") for k in range(5)))


PANEL = "SELECT row_number() OVER (ORDER BY t) - 1 AS i, * FROM (SELECT date_trunc('hour', ts) AS t, {} FROM events GROUP BY 1)".format(
    ", ".join(f"round(avg(value) FILTER (WHERE user_id % 5 = {k}), 6) AS g{k}" for k in range(5))
)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """The panel without missing values."""
    return panel(spark, sf).select("t", *(F.coalesce(f"g{k}", F.lit(50.0)).alias(f"g{k}") for k in range(5)))


FILLED = f"SELECT i, t, {', '.join(f'coalesce(g{k}, 50.0::DOUBLE) AS g{k}' for k in range(5))} FROM ({PANEL})"


def days(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("t")).agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("v"))


DAYS = "SELECT row_number() OVER (ORDER BY t) - 1 AS i, t, v FROM (SELECT o_orderdate::DATE AS t, round(sum(o_totalprice) / 1000, 3) AS v FROM orders GROUP BY 1)"


def users(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id", "event_id", F.round("value", 6).alias("v"))


# ---------------------------------------------------------------- rows


class Part(tuple):
    """Rows as percentages (from, to, from, to ...) of a series' length, so that they go on with it."""

    def of(self, n: int) -> str:
        return " ".join(f"{n * a // 100 + 1} {n * b // 100}" for a, b in zip(self[::2], self[1::2]))

    def sql(self) -> list[tuple[str, str]]:
        """First and last row, from 1, of a series s."""
        return [tuple(f"((SELECT count(*) FROM s) * {x} // 100 + {k})" for x, k in ((a, 1), (b, 0))) for a, b in zip(self[::2], self[1::2])]


#: the first half teaches, the second half is forecast
LIB, PRED, ALL = Part((0, 50)), Part((50, 100)), Part((0, 100))


def rows(df: DataFrame, lib: Part = LIB, pred: Part = PRED) -> dict[str, str]:
    n = df.count()
    return {"lib": lib.of(n), "pred": pred.of(n)}


# ---------------------------------------------------------------- SQL of the operators


def sql_simplex(series: str, cols: list[str], target: str, lib, pred, E: int = 1, Tp: int = 1, tau: int = -1, knn: int = 0, radius: int = 0, embedded: bool = False, valid: str = "TRUE", drop_last: bool = False, rows: str = "", digits: int = 6) -> str:
    """i, obs, pred, var over the aligned rows; rows "knn" stops at the neighbours."""
    E = len(cols) if embedded else E
    shift = 0 if embedded else abs(tau) * (E - 1)
    learn = []
    for at, (first, last) in enumerate(lib.sql()):
        first += f" + {shift * (tau < 0) + (abs(Tp) - 1 if Tp < 0 and not embedded else 0)}"
        last += f" - {shift * (tau > 0) + (Tp if Tp >= 0 and at == len(lib) // 2 - 1 else 0)}"
        learn.append(f"i BETWEEN {first} - 1 AND {last} - 1")
    coords = cols if embedded else [f"{'lag' if tau < 0 else 'lead'}({c}, {abs(tau) * j}) OVER (ORDER BY i)" for j in range(E) for c in cols]
    have = " AND ".join(f"e{j} IS NOT NULL" for j in range(len(coords)))
    d = " + ".join(f"(p.e{j} - l.e{j}) * (p.e{j} - l.e{j})" for j in range(len(coords)))
    ask = " OR ".join(f"i BETWEEN {a} - 1 AND {b} - 1" for a, b in pred.sql())
    k = f"(SELECT count(*) FROM lib) - {int(drop_last)}" if valid != "TRUE" else str(knn or E + 1)
    edges = [(f"greatest({a} - 1, {shift * (tau < 0)})", f"least({b}, (SELECT count(*) FROM s) - {shift * (tau > 0)}) - 1") for a, b in pred.sql()]
    spine = " UNION ALL ".join(f"SELECT unnest(generate_series({a} + {min(Tp, 0)}, {b} + {max(Tp, 0)})) AS i, {a} AS lo, {b} AS hi" for a, b in edges)
    base = f"""s AS ({series}), e AS (SELECT *, {', '.join(f'{c} AS e{j}' for j, c in enumerate(coords))} FROM s),
lib AS (SELECT * FROM e WHERE ({' OR '.join(learn)}) AND {have} AND i + {Tp} BETWEEN 0 AND (SELECT max(i) FROM s) AND ({valid})),
prd AS (SELECT * FROM e WHERE ({ask}) AND {have}),
pairs AS (SELECT p.i AS p, l.i AS l, sqrt({d}) AS d FROM prd p JOIN lib l ON abs(p.i - l.i) > {radius}),
knn AS (SELECT p, l, d, row_number() OVER (PARTITION BY p ORDER BY d, l) AS rk FROM pairs QUALIFY rk <= {k})"""
    if rows == "knn":
        return f"WITH {base} SELECT p, rk, l, round(d, 6) AS d FROM knn"
    return f"""WITH {base},
w AS (SELECT p, exp(-d / greatest(min(d) OVER (PARTITION BY p), 1e-6)) AS w, s.{target} AS v FROM knn LEFT JOIN s ON s.i = l + {Tp}),
m AS (SELECT p, CASE WHEN count(v) = count(*) THEN sum(w * v) / sum(w) END AS mu FROM w GROUP BY p),
r AS (SELECT w.p, any_value(mu) AS mu, sum(w * (v - mu) * (v - mu)) / sum(w) AS var FROM w JOIN m ON w.p = m.p GROUP BY w.p),
spine AS ({spine})
SELECT spine.i::BIGINT AS i, round(s.{target}, 6) AS obs, round(r.mu, {digits}) AS pred, round(CASE WHEN r.mu IS NOT NULL THEN r.var END, {digits}) AS var
FROM spine LEFT JOIN s ON s.i = spine.i LEFT JOIN r ON r.p = spine.i - {Tp} AND r.p BETWEEN lo AND hi"""


RHO = "round(CASE WHEN count(obs + pred) >= 5 THEN covar_pop(obs, pred) / nullif(stddev_pop(CASE WHEN pred IS NOT NULL THEN obs END) * stddev_pop(CASE WHEN obs IS NOT NULL THEN pred END), 0) END, 4)"


def sql_smap1(series: str, col: str, target: str, lib, pred, theta: float, Tp: int = 1, rows: str = "pred") -> str:
    """S-Map with one coordinate in closed form: least squares with squared weights; lib and pred do not overlap, so the farthest row is left out."""
    ((a, b),), ((c, d),) = lib.sql(), pred.sql()
    return f"""WITH s AS ({series}), lib AS (SELECT i, {col} AS x FROM s WHERE i BETWEEN {a} - 1 AND {b} - {1 + Tp} AND {col} IS NOT NULL),
prd AS (SELECT i AS p, {col} AS px FROM s WHERE i BETWEEN {c} - 1 AND {d} - 1 AND {col} IS NOT NULL),
q AS (SELECT p, px, l.i AS l, x, abs(px - x) AS d FROM prd, lib l QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, l.i) <= (SELECT count(*) - 1 FROM lib)),
w AS (SELECT p, px, x, s.{target} AS v, exp(-{float(theta)}::DOUBLE * d / avg(d) OVER (PARTITION BY p)) AS w FROM q JOIN s ON s.i = l + {Tp}),
f AS (SELECT p, px, sum(w * w) AS s0, sum(w * w * x) / sum(w * w) AS mx, sum(w * w * v) / sum(w * w) AS mv FROM w GROUP BY p, px),
g AS (SELECT f.p, f.px, mx, mv, sum(w * w * (x - mx) * (v - mv)) / sum(w * w * (x - mx) * (x - mx)) AS slope FROM w JOIN f ON w.p = f.p GROUP BY ALL)
""" + (
        f"SELECT p + {Tp} AS i, round(s.{target}, 6) AS obs, round(mv + slope * (px - mx), 5) AS pred FROM g LEFT JOIN s ON s.i = p + {Tp}"
        if rows == "pred"
        else f"SELECT p + {Tp} AS i, round(mv - slope * mx, 4) AS c0, round(slope, 4) AS c1 FROM g"
    )


def sql_smap2(series: str, col: str, theta: float) -> str:
    """S-Map of a column from itself and its lag, one step ahead, in closed form: the normal equations of two centred coordinates."""
    ((a, b),), ((c, d),) = LIB.sql(), PRED.sql()
    return f"""WITH s AS ({series}), e AS (SELECT i, {col} AS x, lag({col}) OVER (ORDER BY i) AS z FROM s),
lib AS (SELECT * FROM e WHERE i BETWEEN {a} AND {b} - 2 AND x IS NOT NULL AND z IS NOT NULL),
prd AS (SELECT i AS p, x AS px, z AS pz FROM e WHERE i BETWEEN {c} - 1 AND {d} - 1 AND x IS NOT NULL AND z IS NOT NULL),
q AS (SELECT p, px, pz, l.i AS l, x, z, sqrt((px - x) * (px - x) + (pz - z) * (pz - z)) AS d FROM prd, lib l QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, l.i) <= (SELECT count(*) - 1 FROM lib)),
w AS (SELECT p, px, pz, x, z, s.{col} AS v, exp(-2 * {float(theta)}::DOUBLE * d / avg(d) OVER (PARTITION BY p)) AS w FROM q JOIN s ON s.i = l + 1),
f AS (SELECT p, px, pz, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * v) / sum(w) AS mv FROM w GROUP BY p, px, pz),
g AS (SELECT f.p, f.px, f.pz, mx, mz, mv, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (x - mx) * (z - mz)) AS xz, sum(w * (z - mz) * (z - mz)) AS zz, sum(w * (x - mx) * (v - mv)) AS xv, sum(w * (z - mz) * (v - mv)) AS zv FROM w JOIN f ON w.p = f.p GROUP BY ALL),
h AS (SELECT *, (zz * xv - xz * zv) / (xx * zz - xz * xz) AS sx, (xx * zv - xz * xv) / (xx * zz - xz * xz) AS sz FROM g)
SELECT p + 1 AS i, round(s.{col}, 6) AS obs, round(mv + sx * (px - mx) + sz * (pz - mz), 5) AS pred FROM h LEFT JOIN s ON s.i = p + 1"""


# ---------------------------------------------------------------- shaping


def table(df: DataFrame, digits: int = 6) -> DataFrame:
    """i, obs, pred, var of a projection."""
    return df.select(F.col("_i").alias("i"), F.round("Observations", 6).alias("obs"), F.round("Predictions", digits).alias("pred"), F.round("Pred_Variance", digits).alias("var"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- embedding and neighbours


def _embed_sql(series: str, cols: list[str], E: int, tau: int, both: bool = False) -> str:
    way = lambda t: "lag" if t < 0 else "lead"
    one = lambda t, j, c: f"""{way(t)}({c}, {abs(t) * j}) OVER (ORDER BY i) AS "{c}_{'m' if t < 0 else 'p'}{abs(t) * j}\""""
    out = [one(tau, j, c) for j in range(E) for c in cols]
    out += [one(-tau, j, c) for j in range(1, E) for c in cols] if both else []
    return f"SELECT epoch(t)::BIGINT AS t, {', '.join(out)} FROM ({series})"


def plain(df: DataFrame) -> DataFrame:
    """x(t-1) as x_m1, x(t+1) as x_p1, and times as seconds."""
    df = df.withColumn("t", F.unix_timestamp("t")) if "t" in df.columns else df
    return df.toDF(*(c.replace("(t-", "_m").replace("(t+", "_p").replace(")", "") for c in df.columns))


register("embed_lags", lambda s, d: plain(embed(hours(s, d), 3, -1, "v", True)), _embed_sql(HOURS, ["v"], 3, -1))
register("embed_leads", lambda s, d: plain(embed(hours(s, d), 3, 2, "v", True)), _embed_sql(HOURS, ["v"], 3, 2))
register("embed_columns", lambda s, d: plain(embed(panel(s, d), 2, -2, "g0 g1", True)), _embed_sql(PANEL, ["g0", "g1"], 2, -2))
register("embed_both_ways", lambda s, d: plain(embed(hours(s, d), 3, -1, "v", True, plusminus=True)), _embed_sql(HOURS, ["v"], 3, -1, True))


def _panel_embed(s, d):
    return plain(embed(users(s, d), 3, -1, "v", True, time="event_id", series="user_id"))


register("embed_panel", _panel_embed, 'SELECT user_id, event_id, v AS v_m0, lag(v, 1) OVER w AS v_m1, lag(v, 2) OVER w AS v_m2 FROM (SELECT user_id, event_id, round(value, 6) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)')
register(
    "nearest_neighbors",
    lambda s, d: neighbours(request(h := hours(s, d), "v", "v", **rows(h), E=3)).withColumn("d", F.round("d", 6)),
    sql_simplex(HOURS, ["v"], "v", LIB, PRED, 3, rows="knn"),
)

# ---------------------------------------------------------------- simplex


def simplex_case(name: str, source: tuple, cols: str, target: str, lib: Part = LIB, pred: Part = PRED, validLib: str | None = None, drop_last: bool = False, digits: int = 6, **opts) -> None:
    make, sql = source
    mapped = {"exclusionRadius": "radius"}
    o = {mapped.get(k, k): v for k, v in opts.items() if k != "neighbor_algorithm"}
    text = sql_simplex(sql, cols.split(), target, lib, pred, valid=validLib or "TRUE", drop_last=drop_last, digits=digits, **o)
    register(name, lambda s, d: table(simplex(x := make(s, d), cols, target, **rows(x, lib, pred), validLib=validLib, time="t", **opts), digits), text)


H, P, FP, D = (hours, HOURS), (panel, PANEL), (filled, FILLED), (days, DAYS)
OVER = {"lib": Part((0, 60)), "pred": Part((30, 100))}
simplex_case("simplex_basic", H, "v", "v", E=3)
simplex_case("simplex_cross", H, "v", "n", E=2)
simplex_case("simplex_tp_negative", H, "v", "v", E=3, Tp=-2)
simplex_case("simplex_tp_zero", H, "v", "n", E=3, Tp=0)
simplex_case("simplex_tp_long", H, "v", "v", E=2, Tp=7)
simplex_case("simplex_tau_forward", H, "v", "v", E=3, tau=2)
simplex_case("simplex_disjoint", H, "v", "v", Part((0, 20, 25, 50)), Part((20, 25, 50, 100)), E=3, tau=-2)
simplex_case("simplex_radius", H, "v", "v", **OVER, E=3, exclusionRadius=12)
simplex_case("simplex_leave_one_out", H, "v", "v", ALL, ALL, E=2)
simplex_case("simplex_many_neighbors", H, "v", "v", E=2, knn=25)
simplex_case("simplex_embedded", FP, "g0 g1 g2", "g3", embedded=True)
simplex_case("simplex_two_columns", FP, "g0 g1", "g0", E=2)
simplex_case("simplex_missing", P, "g0", "g1", E=2)
simplex_case("simplex_valid_library", H, "v", "v", validLib="v > 52 OR v < 48", E=2)
simplex_case("simplex_valid_overlap", H, "v", "v", **OVER, validLib="v > 52 OR v < 48", drop_last=True, E=2)
simplex_case("simplex_join_plan", H, "v", "v", E=3, neighbor_algorithm="join")
simplex_case("simplex_join_radius", H, "v", "v", **OVER, E=2, exclusionRadius=5, neighbor_algorithm="join")


def _simplex_daily(s, d):
    """One long series, cut into blocks of its prediction rows as its length is known."""
    n = (x := days(s, d)).count()
    return table(simplex(x, "v", "v", ALL.of(n), ALL.of(n), time="t", E=3, n=n), 2)


register("simplex_daily", _simplex_daily, sql_simplex(DAYS, ["v"], "v", ALL, ALL, 3, digits=2))


def _simplex_users(s, d):
    """One forecast series per user over all its events; users with too few have null predictions."""
    got = simplex_whole(users(s, d), "v", "v", E=2, time="event_id", series="user_id")
    return got.select("user_id", F.col("_i").alias("i"), F.round("Observations", 6).alias("obs"), F.round("Predictions", 6).alias("pred"))


#: library and predictions are all events of a user, but for each one itself
USERS = """WITH s AS (SELECT user_id, round(value, 6) AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(round(value, 6)) OVER w AS e1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
pairs AS (SELECT p.user_id, p.i AS p, l.i AS l, sqrt((p.v - l.v) * (p.v - l.v) + (p.e1 - l.e1) * (p.e1 - l.e1)) AS d FROM s p JOIN s l USING (user_id) WHERE p.n >= 5 AND p.i >= 1 AND l.i BETWEEN 1 AND l.n - 2 AND p.i <> l.i),
knn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY d, l) <= 3),
w AS (SELECT knn.user_id, p, exp(-d / greatest(min(d) OVER (PARTITION BY knn.user_id, p), 1e-6)) AS w, s.v FROM knn JOIN s ON s.user_id = knn.user_id AND s.i = l + 1),
m AS (SELECT user_id, p, sum(w * v) / sum(w) AS mu FROM w GROUP BY ALL),
spine AS (SELECT user_id, unnest(generate_series(CASE WHEN max(n) > 1 THEN 1 ELSE 0 END, max(n))) AS i FROM s GROUP BY user_id)
SELECT spine.user_id, spine.i::BIGINT AS i, round(s.v, 6) AS obs, round(mu, 6) AS pred FROM spine LEFT JOIN s ON s.user_id = spine.user_id AND s.i = spine.i LEFT JOIN m ON m.user_id = spine.user_id AND m.p = spine.i - 1"""
register("simplex_panel", _simplex_users, USERS)


# ---------------------------------------------------------------- errors and sweeps


def _errors(s, d):
    got = simplex(h := hours(s, d), "v", "v", **rows(h), E=3, time="t")
    return compute_error(got, digits=4)


register("compute_error", _errors, f"""SELECT {RHO} AS rho, round(max(obs - pred), 4) AS "MAE", round(avg(abs(obs - pred)), 4) AS mean_abs_err, round(sum(abs(obs - pred)), 4) AS "CAE", round(sqrt(avg((obs - pred) * (obs - pred))), 4) AS "RMSE", count(obs + pred) AS n_pairs
FROM ({sql_simplex(HOURS, ["v"], "v", LIB, PRED, 3)})""")
register(
    "embed_dimension",
    lambda s, d: rounded(sweeps.embed_dimension(h := hours(s, d), "v", "v", 6, **rows(h), time="t"), rho=4),
    " UNION ALL ".join(f"SELECT {e}::BIGINT AS \"E\", {RHO} AS rho FROM ({sql_simplex(HOURS, ['v'], 'v', LIB, PRED, e)})" for e in range(1, 7)),
)
register(
    "embed_dimension_radius",
    lambda s, d: rounded(sweeps.embed_dimension(h := hours(s, d), "v", "n", 5, **rows(h, ALL, ALL), Tp=3, tau=-2, exclusionRadius=10, time="t"), rho=4),
    " UNION ALL ".join(f"SELECT {e}::BIGINT AS \"E\", {RHO} AS rho FROM ({sql_simplex(HOURS, ['v'], 'n', ALL, ALL, e, 3, -2, 0, 10)})" for e in range(1, 6)),
)
register(
    "predict_interval",
    lambda s, d: rounded(sweeps.predict_interval(h := hours(s, d), "v", "v", 6, **rows(h), E=2, time="t"), rho=4),
    " UNION ALL ".join(f"SELECT {t}::BIGINT AS \"Tp\", {RHO} AS rho FROM ({sql_simplex(HOURS, ['v'], 'v', LIB, PRED, 2, t)})" for t in range(1, 7)),
)
THETAS = (0.0, 0.5, 1.0, 3.0)
register(
    "predict_nonlinear",
    lambda s, d: rounded(sweeps.predict_nonlinear(h := hours(s, d), "v", "v", THETAS, **rows(h), E=1, time="t"), rho=4),
    " UNION ALL ".join(f"SELECT {t}::DOUBLE AS theta, {RHO} AS rho FROM ({sql_smap1(HOURS, 'v', 'v', LIB, PRED, t)})" for t in THETAS),
)

# ---------------------------------------------------------------- S-Map


def _smap_rows(df: DataFrame) -> DataFrame:
    return df.where("Predictions IS NOT NULL").select(F.col("_i").alias("i"), F.round("Observations", 6).alias("obs"), F.round("Predictions", 5).alias("pred"))


for _t in (0.0, 3.0):
    register(
        f"smap_theta{int(_t)}",
        lambda s, d, t=_t: _smap_rows(smap(h := hours(s, d), "v", "v", **rows(h), E=1, theta=t, time="t")["predictions"]),
        sql_smap1(HOURS, "v", "v", LIB, PRED, _t),
    )
register(
    "smap_coefficients",
    lambda s, d: smap(h := hours(s, d), "v", "n", **rows(h), E=1, theta=2, time="t")["coefficients"].where("C0 IS NOT NULL").select((F.col("_i")).alias("i"), F.round("C0", 4).alias("c0"), F.round("∂n/∂v(t-0)", 4).alias("c1")),
    sql_smap1(HOURS, "v", "n", LIB, PRED, 2.0, rows="coef"),
)
register("smap_two_lags", lambda s, d: _smap_rows(smap(h := hours(s, d), "v", "v", **rows(h), E=2, theta=2, time="t")["predictions"]), sql_smap2(HOURS, "v", 2.0))
register("smap_dimensions", lambda s, d: _smap_rows(smap(h := hours(s, d), "v", "v", **rows(h, ALL, ALL), E=4, theta=3, time="t")["predictions"]))
register("smap_singular_values", lambda s, d: smap(h := hours(s, d), "v", "v", **rows(h), E=3, theta=1, time="t")["singularValues"].drop("segment"))
register("smap_solver_ridge", lambda s, d: _smap_rows(smap(h := hours(s, d), "v", "v", **rows(h), E=3, theta=2, solver="Ridge", time="t")["predictions"]))
register(
    "smap_per_tp",
    lambda s, d: sweeps.smap_tp(h := hours(s, d), [1, 2, 4], "v", "v", E=1, theta=1, **rows(h), time="t").where("Predictions IS NOT NULL").select("Tp", F.col("_i").alias("i"), F.round("Predictions", 5).alias("pred")),
    " UNION ALL ".join(f"SELECT {t}::BIGINT AS \"Tp\", i, pred FROM ({sql_smap1(HOURS, 'v', 'v', LIB, PRED, 1.0, t)})" for t in (1, 2, 4)),
)
register(
    "smap_per_theta",
    lambda s, d: sweeps.smap_theta(h := hours(s, d), [0.5, 2.0, 4.0], "v", "v", E=1, **rows(h), time="t").where("Predictions IS NOT NULL").select("theta", F.col("_i").alias("i"), F.round("Predictions", 5).alias("pred")),
    " UNION ALL ".join(f"SELECT {t}::DOUBLE AS theta, i, pred FROM ({sql_smap1(HOURS, 'v', 'v', LIB, PRED, t)})" for t in (0.5, 2.0, 4.0)),
)

# ---------------------------------------------------------------- cross mapping


def _shares(df: DataFrame, *percent: int) -> list[int]:
    """Library sizes as percentages of the series' length."""
    n = df.count()
    return sorted({max(5, n * p // 100) for p in percent})


def _ccm_full(s, d):
    """With the whole series as library every sample is the same."""
    df = filled(s, d)
    return rounded(ccm(df, "g0", "g1", _shares(df, 100), 3, E=2, seed=7, time="t").withColumnsRenamed({"g0:g1": "fwd", "g1:g0": "rev"}), fwd=4, rev=4)


def _ccm_sizes(s, d):
    df = filled(s, d)
    return ccm(df, "g0", "g1", _shares(df, 5, 25, 50, 75, 100), 20, E=3, seed=7, time="t").withColumnsRenamed({"g0:g1": "fwd", "g1:g0": "rev"})


def _ccm_statistics(s, d):
    df = filled(s, d)
    return ccm(df, "g0", "g1", _shares(df, 17, 50), 5, E=2, seed=7, includeData=True, time="t")["PredictStats"]


def _ccm_matrix_whole(s, d):
    df = filled(s, d)
    return rounded(matrices.ccm_matrix(df, 2, libSizes=_shares(df, 100), sample=2, time="t").select("column", "target", "rho"), rho=4)


register("ccm_whole_library", _ccm_full, f"""SELECT (SELECT count(*) FROM ({FILLED})) AS "LibSize", (SELECT {RHO} FROM ({sql_simplex(FILLED, ['g0'], 'g1', ALL, ALL, 2, 0)})) AS fwd, (SELECT {RHO} FROM ({sql_simplex(FILLED, ['g1'], 'g0', ALL, ALL, 2, 0)})) AS rev""")
register("ccm_library_sizes", _ccm_sizes)
register("ccm_statistics", _ccm_statistics)
register("ccm_matrix", lambda s, d: matrices.ccm_matrix(filled(s, d), 2, sample=5, expConverge=True, time="t"))
register(
    "ccm_matrix_whole",
    _ccm_matrix_whole,
    " UNION ALL ".join(f"SELECT 'g{a}' AS \"column\", 'g{b}' AS target, {RHO} AS rho FROM ({sql_simplex(FILLED, [f'g{a}'], f'g{b}', ALL, ALL, 2, 0)})" for a in range(5) for b in range(5) if a != b),
)


def _pairs_sql(jobs: list[tuple[str, str, int]], value: str = "rho") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"column\", '{b}' AS target, {RHO} AS {value} FROM ({sql_simplex(FILLED, [a], b, LIB, PRED, e)})" for a, b, e in jobs)


register("cross_map_errors", lambda s, d: rounded(matrices.cross_map_columns(x := filled(s, d), "g0", Evec=[1, 2, 3, 2, 1], **rows(x), time="t", returnError=True).select("column", "target", "rho"), rho=4), _pairs_sql([(f"g{k}", "g0", e) for k, e in enumerate([1, 2, 3, 2, 1])]))
register(
    "cross_map_columns",
    lambda s, d: matrices.cross_map_columns(x := filled(s, d), "g0", E=2, **rows(x), time="t").select("column", F.col("_i").alias("i"), F.round("Predictions", 6).alias("pred")),
    " UNION ALL ".join(f"SELECT 'g{k}' AS \"column\", i, pred FROM ({sql_simplex(FILLED, [f'g{k}'], 'g0', LIB, PRED, 2)}) WHERE pred IS NOT NULL" for k in range(5)),
)
register(
    "cross_map_column_list",
    lambda s, d: matrices.cross_map_column_list(x := filled(s, d), ["g0", "g1 g2", "g2 g3 g4"], "g0", **rows(x), embedded=True, time="t").select("columns", F.col("_i").alias("i"), F.round("Predictions", 6).alias("pred")),
    " UNION ALL ".join(f"SELECT '{c}' AS columns, i, pred FROM ({sql_simplex(FILLED, c.split(), 'g0', LIB, PRED, embedded=True)})" for c in ("g0", "g1 g2", "g2 g3 g4")),
)
_ALL = [(f"g{a}", f"g{b}", 2) for a in range(5) for b in range(5) if a != b]
_NONE = " UNION ALL " + " UNION ALL ".join(f"SELECT 'g{k}' AS \"column\", 'g{k}' AS target, NULL::DOUBLE AS rho" for k in range(5))
register("cross_map_matrix", lambda s, d: rounded(matrices.cross_map_matrix(x := filled(s, d), 2, **rows(x), time="t"), rho=4), _pairs_sql(_ALL) + _NONE)
register(
    "cross_map_matrix_wide",
    lambda s, d: rounded(matrices.cross_map_matrix(x := filled(s, d), 2, **rows(x), time="t", returnValue="matrix"), **{f"g{k}": 4 for k in range(5)}),
    'SELECT "column", ' + ", ".join(f"max(rho) FILTER (WHERE target = 'g{k}') AS g{k}" for k in range(5)) + f' FROM ({_pairs_sql(_ALL)}{_NONE}) GROUP BY "column"',
)
_DIMS = " UNION ALL ".join(f"SELECT 'g{k}' AS \"column\", 'g{k}' AS target, {e}::BIGINT AS \"E\", {RHO} AS rho FROM ({sql_simplex(FILLED, [f'g{k}'], f'g{k}', LIB, PRED, e)})" for k in range(5) for e in range(1, 5))
register(
    "embed_dim_columns",
    lambda s, d: rounded(matrices.embed_dim_columns(x := filled(s, d), maxE=4, **rows(x), time="t"), rho=4),
    f'SELECT "column", target, "E", rho FROM ({_DIMS}) QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY rho DESC, "E") = 1',
)
register(
    "embed_dim_first_max",
    lambda s, d: rounded(matrices.embed_dim_columns(x := filled(s, d), maxE=4, **rows(x), time="t", firstMax=True, minE=2), rho=4),
    f"""WITH r AS ({_DIMS}), h AS (SELECT *, rho > lag(rho) OVER w AND rho > lead(rho) OVER w AS hit FROM r WINDOW w AS (PARTITION BY "column" ORDER BY "E")),
b AS (SELECT "column", greatest(coalesce(min("E") FILTER (WHERE hit), max("E")), 2) AS best FROM h GROUP BY "column")
SELECT r."column", target, "E", rho FROM r JOIN b ON r."column" = b."column" AND r."E" = b.best""",
)

# ---------------------------------------------------------------- ensembles, surrogates, generation


def _multi(s, d):
    return multiview(x := filled(s, d), "g0 g1 g2", "g0", **rows(x), D=2, E=1, trainLib=False, multiview=2, time="t")


_V = list(combinations(["g0", "g1", "g2"], 2))
_VIEWS = [sql_simplex(FILLED, list(v), "g0", LIB, PRED, embedded=True, digits=12) for v in _V]
_RANK = " UNION ALL ".join(f"SELECT {k} AS id, '{v[0]}(t-0) {v[1]}(t-0)' AS columns, corr(obs, pred) AS r, {RHO} AS rho FROM ({_VIEWS[k]})" for k, v in enumerate(_V))
register("multiview_views", lambda s, d: _multi(s, d)["View"].select(F.concat_ws(" ", "Columns").alias("columns"), F.round("rho", 4).alias("rho")), f"SELECT columns, rho FROM ({_RANK}) ORDER BY r DESC LIMIT 2")
register(
    "multiview_predictions",
    lambda s, d: _multi(s, d)["Predictions"].select(F.col("_i").alias("i"), F.round("Predictions", 4).alias("pred")),
    f"""WITH best AS (SELECT id FROM ({_RANK}) ORDER BY r DESC LIMIT 2), a AS ({' UNION ALL '.join(f'SELECT {k} AS id, i, pred FROM ({q})' for k, q in enumerate(_VIEWS))})
SELECT i, round(CASE WHEN count(pred) = count(*) THEN avg(pred) END, 4) AS pred FROM a JOIN best USING (id) GROUP BY i""",
)
_L = f"SELECT *, {', '.join(f'lag(g{k}) OVER (ORDER BY i) AS h{k}' for k in range(3))} FROM ({FILLED})"
_LAGS = {f"{c}{k}": f"g{k}(t-{j})" for j, c in enumerate("gh") for k in range(3)}
_IN, _OUT = ([(v, sql_simplex(_L, list(v), "g0", LIB, rows, embedded=True, digits=12)) for v in combinations(_LAGS, 3)] for rows in (LIB, PRED))
register(
    "multiview_lags",
    lambda s, d: multiview(x := filled(s, d), "g0 g1 g2", "g0", **rows(x), D=3, E=2, time="t")["View"].select("rank", F.round("rho", 4).alias("rho"), F.concat_ws(" ", "Columns").alias("columns")),
    "WITH ranked AS ("
    + " UNION ALL ".join(f"SELECT {k} AS id, corr(obs, pred) AS r FROM ({q})" for k, (_, q) in enumerate(_IN))
    + "), best AS (SELECT id, row_number() OVER (ORDER BY r DESC, id) AS rank FROM ranked QUALIFY rank <= 4), views AS ("
    + " UNION ALL ".join(f"SELECT {k} AS id, '{' '.join(map(_LAGS.get, v))}' AS columns, {RHO} AS rho FROM ({q})" for k, (v, q) in enumerate(_OUT))
    + ") SELECT rank::BIGINT AS rank, rho, columns FROM best JOIN views USING (id)",
)
for _m in ("random_shuffle", "ebisuzaki", "seasonal"):
    register(f"surrogate_{_m}", lambda s, d, m=_m: surrogate_data(hours(s, d), "v", m, 4, seed=3, time="t"))
register(
    "surrogate_shuffle_values",
    lambda s, d: surrogate_data(hours(s, d), "v", "random_shuffle", 3, seed=3, digits=6, time="t", long=True).groupBy("surrogate").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("most")),
    f"SELECT k::BIGINT AS surrogate, count(*) AS n, round(sum(v), 3) AS total, max(v) AS most FROM ({HOURS}), (SELECT unnest([1, 2, 3]) AS k) GROUP BY k",
)
register("generate_simplex", lambda s, d: simplex(h := hours(s, d), "v", "v", ALL.of(h.count()), "1 2", E=3, generateSteps=20, time="t").drop("segment"))
register("generate_smap", lambda s, d: smap(h := hours(s, d), "v", "v", ALL.of(h.count()), "1 2", E=2, theta=2, generateSteps=10, time="t")["predictions"].drop("segment"))
register("sample_tent_sweep", lambda s, d: sweeps.predict_nonlinear(io.sample(s, "tent", 400), "x", "x", (0.0, 1.0, 4.0), "1 200", "201 400", E=2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
