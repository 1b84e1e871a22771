"""Canonical calls on the samples: python -m phasefold.examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import api
from .sources.io import sample


def examples(spark: SparkSession) -> dict[str, DataFrame]:
    """One result per operator."""
    tent, pair, lorenz, circle = (sample(spark, n, 500) for n in ("tent", "logistic", "lorenz", "circle"))
    return {
        "embedding dimension": api.EmbedDimension(tent, "x", "x", 6, "1 100", "201 490"),
        "forecast interval": api.PredictInterval(tent, "x", "x", 6, "1 100", "201 490", E=2),
        "nonlinearity": api.PredictNonlinear(tent, "x", "x", (0, 1, 2, 4, 8), "1 100", "201 490", E=2),
        "simplex, lags": api.Simplex(lorenz, "V1", "V1", "1 300", "301 490", E=5),
        "simplex, state given": api.Simplex(lorenz, "V1 V2 V3", "V1", "1 300", "301 490", embedded=True),
        "S-Map": api.SMap(circle, "x", "x", "1 100", "110 190", E=4, theta=4)["predictions"],
        "multiview": api.Multiview(lorenz, "V1 V2 V3", "V1", "1 300", "301 490", D=3, E=3, trainLib=False)["View"],
        "cross mapping": api.CCM(pair, "x", "y", [20, 100, 400], 20, E=2, seed=1),
    }


def main() -> None:
    spark = SparkSession.builder.appName("examples").getOrCreate()
    for name, df in examples(spark).items():
        print(name)
        df.show(8)


if __name__ == "__main__":
    main()
