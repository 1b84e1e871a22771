"""Nearest neighbours and simplex projection as a relational plan.

A theta join of prediction rows with the library, a top-k window (which Spark limits
before its shuffle), an equi-join for the targets at +Tp, and grouped weighted sums. One
shuffle on the prediction row serves window and aggregate. It is the plan to choose for
composing with SQL; the kernels of projection.py do the same for many series at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indices
from ..functions.indices import names
from ..sources.series import as_double, clean, indexed, quoted, typed_time
from .embed import lag_columns

#: a library of at most so many rows is sent to all tasks; a larger one is joined by shuffled blocks
MOST_BROADCAST = 200_000


def within(c: Column, rows: list[tuple[int, int]]) -> Column:
    """Whether a 0-based row lies in one of the (first, last) spans."""
    out = F.lit(False)
    for a, b in rows:
        out = out | c.between(a, b)
    return out


def spans(rows) -> list[tuple[int, int]]:
    """Sorted rows as (first, last) of consecutive ones."""
    out: list[list[int]] = []
    for r in rows.tolist():
        if out and r == out[-1][1] + 1:
            out[-1][1] = r
        else:
            out.append([r, r])
    return [(a, b) for a, b in out]


def state(df: DataFrame, columns: list[str], target: str, E: int, tau: int, embedded: bool, time: str) -> DataFrame:
    """_i, time (as a double), y, emb (array; null where a coordinate is missing) of a single series."""
    base = indexed(df, time)
    lags = [clean(quoted(c)) for c in columns] if embedded else lag_columns(columns, E, tau, F.col("_i"), [])
    named = [c.alias(f"e{j}") for j, c in enumerate(lags)]
    rows = base.select("_i", as_double(base, time)[0].alias("time"), clean(quoted(target)).alias("y"), *named)
    whole = F.lit(True)
    for j in range(len(named)):
        whole = whole & F.col(f"e{j}").isNotNull()
    return rows.select("_i", "time", "y", F.when(whole, F.array(*(F.col(f"e{j}") for j in range(len(named))))).alias("emb"))


def nearest(state_rows: DataFrame, lib: Column, pred: Column, k: int, radius: int = 0, dims: int = 1, n: int | None = None) -> DataFrame:
    """p, l, rk, d: each prediction row's k nearest library rows, by (distance, row); n: rows of the series, if known."""
    left = state_rows.where(pred & F.col("emb").isNotNull()).select(F.col("_i").alias("p"), F.col("emb").alias("pe"))
    right = state_rows.where(lib & F.col("emb").isNotNull()).select(F.col("_i").alias("l"), F.col("emb").alias("le"))
    parallel = int(state_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(parallel, "p")  # the numbering window leaves one partition
    if n is not None and n <= MOST_BROADCAST:
        right = F.broadcast(right)
    total = F.lit(0.0)
    for j in range(dims):
        d = F.col("pe")[j] - F.col("le")[j]
        total = total + d * d
    pairs = left.join(right, F.abs(F.col("p") - F.col("l")) > F.lit(max(radius, 0)))
    w = Window.partitionBy("p").orderBy("d", "l")
    return pairs.select("p", "l", F.sqrt(total).alias("d")).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def project(near: DataFrame, state_rows: DataFrame, Tp: int) -> DataFrame:
    """p, prediction, variance by simplex weights; null if any neighbour's target is."""
    values = state_rows.select((F.col("_i") - Tp).alias("l"), F.col("y").alias("v"))
    got = near.join(values, "l")
    close = F.min("d").over(Window.partitionBy("p"))
    got = got.withColumn("w", F.exp(-F.col("d") / F.greatest(close, F.lit(1e-6))))
    terms = F.collect_list(F.struct("w", "v"))
    got = got.groupBy("p").agg(F.when(F.count("v") == F.count("*"), terms).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"])
    mean = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"] * x["v"]) / total
    got = got.select("p", "x", total.alias("t"), mean.alias("prediction"))
    spread = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"] * (x["v"] - F.col("prediction")) * (x["v"] - F.col("prediction")))
    return got.select("p", "prediction", (spread / F.col("t")).alias("variance"))


def align(projected: DataFrame, state_rows: DataFrame, segments: list[tuple[int, int]], Tp: int, kind, n: int) -> DataFrame:
    """segment, _i, Time, Observations, Predictions, Pred_Variance over each segment and |Tp| rows more; times beyond the series go on with its first step."""
    spark = state_rows.sparkSession
    parts = spark.createDataFrame([(s, a + min(Tp, 0), b + max(Tp, 0), a, b) for s, (a, b) in enumerate(segments)], "segment int, lo long, hi long, a long, b long")
    spine = parts.select("segment", F.explode(F.sequence("lo", "hi")).alias("_i"), "a", "b").withColumn("src", F.when((F.col("_i") - Tp).between(F.col("a"), F.col("b")), F.col("_i") - Tp))
    out = spine.join(state_rows.select("_i", "time", "y"), "_i", "left").join(projected, F.col("src") == F.col("p"), "left")
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("time")))
    # one row: where the series starts, ends and how it steps
    edge = state_rows.where(F.col("_i").isin(0, 1, n - 1)).agg(at(0).alias("t_first"), at(n - 1).alias("t_last"), F.coalesce(at(1) - at(0), F.lit(1.0)).alias("t_step"))
    out = out.crossJoin(F.broadcast(edge))
    beyond = F.when(F.col("_i") < 0, F.col("t_first") + F.col("_i") * F.col("t_step")).when(F.col("_i") >= n, F.col("t_last") + (F.col("_i") - n + 1) * F.col("t_step"))
    return out.select("segment", "_i", typed_time(F.coalesce(beyond, "time"), kind).alias("Time"), F.col("y").alias("Observations"), F.col("prediction").alias("Predictions"), F.col("variance").alias("Pred_Variance"))


def simplex_join(df: DataFrame, columns, target: str, lib, pred, E: int, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, time: str | None = None, n: int | None = None) -> DataFrame:
    """Simplex projection of a single series in Spark's own operators (see the module)."""
    cols = names(columns)
    E = len(cols) if embedded else E
    at = time or df.columns[0]
    lib, pred = indices.numbers(lib), indices.numbers(pred)
    n = df.count() if n is None else n
    indices.check(lib, pred, E, tau, Tp, embedded, n)
    rows = state(df, cols, target, E, tau, embedded, at)
    learn = indices.library(lib, E, tau, Tp, embedded)
    learn = learn[(learn >= 0) & (learn < n) & (learn + Tp >= 0) & (learn + Tp < n)]
    ask = [(a - 1, b - 1) for a, b in indices.pairs(pred, "pred")]
    near = nearest(rows, within(F.col("_i"), spans(learn)), within(F.col("_i"), ask), knn or E + 1, exclusionRadius, E if embedded else E * len(cols), n)
    parts = [(int(s[0]), int(s[-1])) for s in indices.segments(pred, E, tau, embedded, n) if len(s)]
    return align(project(near, rows, Tp), rows, parts, Tp, df.schema[at].dataType, n)
