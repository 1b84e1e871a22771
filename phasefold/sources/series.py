"""Series of a DataFrame in packed form: one row per series, columns as arrays in time order.

A packed series is what one task works on; panels of many series spread over tasks by
series, parameter grids and blocks of prediction rows by what they repeat. Packing is
one shuffle on the series key with only the columns that an operator needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.indices import names


@dataclass
class Packed:
    """df: series key columns, n, t (double), one array<double> per column, optionally valid (array<boolean>)."""

    df: DataFrame
    keys: list[str]
    columns: list[str]
    time_type: T.DataType
    valid: bool

    def time(self, c: Column) -> Column:
        """A time in packed form as the series' own type."""
        return typed_time(c, self.time_type)


def typed_time(c: Column, kind: T.DataType) -> Column:
    """A time as a double (see as_double) as the type it has in its table; text becomes a timestamp."""
    if isinstance(kind, (T.TimestampType, T.StringType)):
        return F.timestamp_micros(F.round(c * 1e6).cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(F.round(c * 1e6).cast("long")).cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit("1970-01-01").cast("date"), F.round(c / 86400).cast("int"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.round(c).cast("long")
    return c.cast("double")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean(c: Column) -> Column:
    """A double in which NaN is null, so that aggregates skip missing values alike."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def time_column(df: DataFrame, time: str | None, noTime: bool, series: list[str]) -> str | None:
    """The time column: the one named, or the first that is no series key; None without time."""
    if noTime:
        return time
    return time or next(c for c in df.columns if c not in series)


def as_double(df: DataFrame, time: str | None) -> tuple[Column, T.DataType]:
    if time is None:
        return F.lit(None).cast("double"), T.DoubleType()
    kind = df.schema[time].dataType
    c = quoted(time)
    if isinstance(kind, T.StringType):
        return F.unix_micros(F.to_timestamp(c)) / F.lit(1e6), kind
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6), kind
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")) * F.lit(86400.0), kind
    if isinstance(kind, T.NumericType):
        return c.cast("double"), kind
    raise ValueError(f"{time}: {kind.simpleString()} is no time")


def pack(df: DataFrame, columns, time: str | None = None, noTime: bool = False, series=None, validLib: Column | str | None = None) -> Packed:
    """Pack the named columns; rows are ordered by time (noTime: by `time` if named, else as read)."""
    keys, wanted = names(series), list(dict.fromkeys(columns))
    missing = [c for c in [*keys, *wanted, *([time] if time else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    at = time_column(df, time, noTime, keys)
    t, kind = as_double(df, at)
    order = quoted(at) if at else F.monotonically_increasing_id()
    valid = F.expr(validLib) if isinstance(validLib, str) else validLib
    fields = [order.alias("o"), t.alias("t"), *(clean(quoted(c)).alias(f"c{i}") for i, c in enumerate(wanted))]
    if valid is not None:
        fields.append(F.coalesce(valid, F.lit(False)).alias("valid"))
    rows = df.select(*map(quoted, keys), F.struct(*fields).alias("r"))
    got = rows.groupBy(*map(quoted, keys)).agg(F.array_sort(F.collect_list("r")).alias("r")).where(F.size("r") > 0)
    n = F.size("r")
    times = F.transform("r", lambda x: x["t"]) if not noTime else F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("double"))
    out = [*map(quoted, keys), n.alias("n"), times.alias("t"), *(F.col("r")[f"c{i}"].alias(f"c{i}") for i in range(len(wanted)))]
    if valid is not None:
        out.append(F.col("r")["valid"].alias("valid"))
    return Packed(got.select(*out), keys, wanted, T.LongType() if noTime else kind, valid is not None)


def indexed(df: DataFrame, time: str, series=None) -> DataFrame:
    """df with _i, each row's 0-based place in its series."""
    keys = names(series)
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(time))
    return df.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))


def column_rows(df: DataFrame, columns, time: str | None = None, noTime: bool = False) -> DataFrame:
    """(name, v): one row per column of a single series, its values in time order; many-column plans join these by name.

    Values are unpivoted before they are gathered, so that a task holds one column at a time.
    """
    wanted = list(dict.fromkeys(columns))
    if missing := [c for c in [*wanted, *([time] if time else [])] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    at = time_column(df, time, noTime, [])
    order = quoted(at) if at else F.monotonically_increasing_id()
    values = F.posexplode(F.array(*(clean(quoted(c)) for c in wanted))).alias("k", "v")
    long = df.select(order.alias("o"), values).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("r"))
    name = F.element_at(F.array(*map(F.lit, wanted)), F.col("k") + 1)
    return long.select(name.alias("name"), F.transform("r", lambda x: x["v"]).alias("v"))
