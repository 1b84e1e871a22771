"""Extension: forecasts over a stream of rows against a fixed library.

Each micro-batch is embedded with the last rows that came before it, kept as a table of
bounded size; its rows are projected on the library, and results are appended. Work per
batch does not grow with what has been seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import simplex
from ..sources.series import indexed, quoted


def forecast_batch(history: DataFrame, batch: DataFrame, column: str, E: int, Tp: int = 1, tau: int = -1, time: str | None = None, library_rows: int | None = None) -> DataFrame:
    """Time, Observations, Predictions of the batch's rows; the library is the history's first rows."""
    at = time or history.columns[0]
    n, m = history.count(), batch.count()
    if not m:
        return batch.select(quoted(at).alias("Time"), F.col(column).alias("Observations"), F.lit(None).cast("double").alias("Predictions")).limit(0)
    both = history.select(quoted(at), quoted(column)).unionByName(batch.select(quoted(at), quoted(column)))
    got = simplex(both, column, column, [1, library_rows or n], [max(1, n - Tp), n + m], E=E, Tp=Tp, tau=tau, time=at)
    return got.where((F.col("_i") >= n) & F.col("Predictions").isNotNull()).select("Time", "Observations", "Predictions")


def forecast_stream(stream: DataFrame, history: DataFrame, column: str, path: str, E: int, Tp: int = 1, tau: int = -1, time: str | None = None, checkpoint: str | None = None, trigger: dict | None = None):
    """Start a query that writes forecasts of a stream's rows to path/forecasts.

    path/tail holds, for each batch, the last streamed rows that later ones are embedded
    with. A batch that is run again overwrites its own folders, so results are written once.
    """
    spark, n, at = stream.sparkSession, history.count(), time or history.columns[0]
    keep, columns = abs(tau) * (E - 1) + abs(Tp) + 1, history.columns
    kinds = T.StructType([*history.schema.fields, T.StructField("batch", T.LongType())])
    history.write.mode("overwrite").parquet(f"{path}/library")
    library = spark.read.parquet(f"{path}/library")
    history.limit(0).write.mode("overwrite").parquet(f"{path}/tail/batch=-1")

    def on_batch(batch: DataFrame, number: int) -> None:
        tails = spark.read.schema(kinds).parquet(f"{path}/tail").where(F.col("batch") < number)
        last = tails.agg(F.max("batch")).first()[0]
        # rows of the tail follow the library at once, or hold all lags of the rows that are forecast
        tail = tails.where(F.col("batch") == F.lit(last)).drop("batch")
        rows = batch.select(*columns)
        got = forecast_batch(library.unionByName(tail), rows, column, E, Tp, tau, time, n)
        got.write.mode("overwrite").parquet(f"{path}/forecasts/batch={number}")
        tail.unionByName(rows).orderBy(quoted(at).desc()).limit(keep).write.mode("overwrite").parquet(f"{path}/tail/batch={number}")

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    return (w.trigger(**trigger) if trigger else w).start()


__all__ = ["forecast_batch", "forecast_stream", "indexed"]
