"""Kernels over series x parameter grid: the one way in which numpy code is distributed.

The grid is a list of parameter dictionaries; its rows are crossed with the packed
series (the grid is made on the driver and broadcast) and spread by series and grid row,
so that a panel, a sweep and the blocks of one long series all become tasks of even size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import Packed, quoted

#: kernel(series, spec) -> columns of equal length by name
Kernel = Callable[["Series", dict], dict[str, list | np.ndarray]]


class Series:
    """One packed series in a task."""

    def __init__(self, columns: list[str], arrays: dict[str, np.ndarray], t: np.ndarray, valid: np.ndarray | None):
        self.t, self.valid, self._at = t, valid, {c: arrays[f"c{i}"] for i, c in enumerate(columns)}

    def __getitem__(self, name: str) -> np.ndarray:
        return self._at[name]


def _array(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(float)


def run(packed: Packed, grid: list[dict], kernel: Kernel, schema: str) -> DataFrame:
    """Series keys, g (the grid row's number) and the kernel's columns; schema is that of the kernel's columns."""
    spark, keys, columns, has_valid = packed.df.sparkSession, packed.keys, packed.columns, packed.valid
    cells = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(grid)], "g int, spec string")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = packed.df.crossJoin(F.broadcast(cells))
    if len(grid) > 1:
        both = both.repartition(min(len(grid), parallel) if not keys else parallel, *map(quoted, keys), F.col("g"))
    kinds = {f.name: f.dataType for f in packed.df.schema if f.name in keys}
    key_schema = "".join(f"`{k}` {kinds[k].simpleString()}, " for k in keys)
    out_names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                arrays = {f"c{i}": _array(at[f"c{i}"][r]) for i in range(len(columns))}
                valid = at["valid"][r].values.to_numpy(zero_copy_only=False).astype(bool) if has_valid else None
                s = Series(columns, arrays, _array(at["t"][r]), valid)
                got = kernel(s, json.loads(at["spec"][r].as_py()))
                n = len(next(iter(got.values())))
                types = types or _types(schema)
                cols = [pa.array([at[k][r].as_py()] * n, b.schema.field(k).type) for k in keys]
                cols.append(pa.array(np.full(n, at["g"][r].as_py(), np.int32)))
                cols += [_column(got[c], types[c]) for c in out_names]
                yield pa.RecordBatch.from_arrays(cols, [*keys, "g", *out_names])

    return both.mapInArrow(each, f"{key_schema}g int, {schema}")


def _types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    return {n: kinds[k] for n, k in (x.strip().split(" ") for x in schema.split(","))}


def _column(values, kind: pa.DataType) -> pa.Array:
    """Values of a type, NaN being null."""
    if kind == pa.float64():
        v = np.asarray(values, float)
        return pa.array(v, kind, mask=np.isnan(v))
    if pa.types.is_list(kind):
        return pa.array([[None if x != x else float(x) for x in v] for v in values], kind)
    return pa.array(values, kind)
