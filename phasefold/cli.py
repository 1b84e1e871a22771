"""Any operator from the command line:

    python -m phasefold.cli CrossMap_Matrix --input panel.csv --output rho.parquet E=2 lib="1 300" pred="301 450"

Arguments are Python literals, or text as it stands.
"""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import DataFrame, SparkSession

from . import api
from .sources import io


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def read(spark: SparkSession, path: str) -> DataFrame:
    return io.read_csv(spark, path) if path.endswith(".csv") else io.read_feather(spark, path) if path.endswith(".feather") else io.read_parquet(spark, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("operator", choices=[n for n in api.__all__ if n != "MakeBlock"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", help="a .csv, .parquet or .feather path; shown without it")
    p.add_argument("options", nargs="*", metavar="name=value")
    o = p.parse_intermixed_args(args)
    spark = spark or SparkSession.builder.appName(o.operator).getOrCreate()
    got = getattr(api, o.operator)(read(spark, o.input), **{k: value(v) for k, v in (x.split("=", 1) for x in o.options)})
    for name, df in got.items() if isinstance(got, dict) else [("", got)]:
        if not o.output:
            df.show(20)
        else:
            stem, dot, kind = o.output.rpartition(".")
            io.write(df, f"{stem}-{name}{dot}{kind}" if name else o.output)


if __name__ == "__main__":
    main()
