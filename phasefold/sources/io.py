"""Reading and writing tables, and samples made here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line; a schema saves the pass that infers one."""
    reader = spark.read.option("header", True).option("nanValue", "nan").option("nullValue", "")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A Feather file of one machine; larger tables belong in Parquet."""
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV or one Feather file (for small results), by the kind or the path's ending."""
    kind = next((k for k in ("csv", "parquet", "feather") if path.endswith("." + k)), kind)
    if kind == "feather":
        import pyarrow.feather as feather

        feather.write_feather(df.toArrow(), path)
        return
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def sample(spark: SparkSession, name: str, n: int = 1000) -> DataFrame:
    """One of the samples: circle, tent, logistic, lorenz; all computed, none stored."""
    rng = np.random.default_rng(7)
    t = np.arange(1, n + 1)
    if name == "circle":
        cols = {"x": np.cos(2 * np.pi * t / 50), "y": np.sin(2 * np.pi * t / 50)}
    elif name == "tent":
        x = np.empty(n)
        x[0] = 0.37
        for i in range(1, n):
            x[i] = min(x[i - 1], 1 - x[i - 1]) * 1.97 + 1e-4 * rng.standard_normal()
        cols = {"x": x}
    elif name == "logistic":
        x, y = np.empty(n), np.empty(n)
        x[0], y[0] = 0.4, 0.2
        for i in range(1, n):
            x[i] = x[i - 1] * (3.8 - 3.8 * x[i - 1])
            y[i] = y[i - 1] * (3.5 - 3.5 * y[i - 1] - 0.1 * x[i - 1])
        cols = {"x": x, "y": y}
    elif name == "lorenz":
        v, out = 8 + 0.01 * np.arange(5), np.empty((n, 5))
        f = lambda z: (np.roll(z, -1) - np.roll(z, 2)) * np.roll(z, 1) - z + 8
        for i in range(n + 500):
            k1 = f(v)
            k2 = f(v + 0.025 * k1)
            k3 = f(v + 0.025 * k2)
            v = v + 0.05 / 6 * (k1 + 2 * k2 + 2 * k3 + f(v + 0.05 * k3))
            if i >= 500:
                out[i - 500] = v
        cols = {f"V{i + 1}": out[:, i] for i in range(5)}
    else:
        raise ValueError(f"no sample {name}")
    rows = list(zip(t.tolist(), *(c.tolist() for c in cols.values())))
    return spark.createDataFrame(rows, ", ".join(["t long", *(f"{c} double" for c in cols)]))


SAMPLES = ("circle", "tent", "logistic", "lorenz")


def register_samples(spark: SparkSession) -> None:
    """The samples as temporary views."""
    for name in SAMPLES:
        sample(spark, name).createOrReplaceTempView(name)
