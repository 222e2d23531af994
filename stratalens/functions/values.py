"""Typed values in one column, missing values, and their export to JSON."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of value in canonical order, with the field that holds them in a typed value.
KINDS = ("boolean", "integer", "float", "string", "date", "naive_datetime", "aware_datetime", "timedelta")
FIELDS = dict(zip(KINDS, "bifsdntu"))
_SQL = {"b": "boolean", "i": "bigint", "f": "double", "s": "string", "d": "date", "n": "timestamp_ntz", "t": "timestamp", "u": "interval day to second"}
VALUE_TYPE = "struct<absent:boolean," + ",".join(f"{k}:{t}" for k, t in _SQL.items()) + ">"


def kind_of(t: T.DataType) -> str | None:
    """The kind of a column's values, or None for types that are not analysed (nested, binary, decimal)."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    by_type = {T.DateType: "date", T.TimestampNTZType: "naive_datetime", T.TimestampType: "aware_datetime", T.DayTimeIntervalType: "timedelta"}
    return by_type.get(type(t))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sentinel_key(value):
    """Declared missing values match by what they export to, and numbers by value; booleans are no numbers."""
    out = json_value(value)
    return ("number", out) if isinstance(out, (int, float)) and not isinstance(out, bool) else (type(out).__name__, out)


def normalised(column: Column, t: T.DataType, sentinels=()) -> Column:
    """The column with NaN and declared missing values turned into null, and -0.0 into 0.0."""
    kind = kind_of(t)
    if kind == "float":
        column = F.when(~F.isnan(column), column + F.lit(0.0)).cast(t)
    for s in sentinels:
        key, value = sentinel_key(s)
        if key == "number" and kind in ("integer", "float"):
            if kind == "integer" and float(value) != int(value) if math.isfinite(value) else kind == "integer":
                continue
            hit = column == F.lit(int(value) if kind == "integer" else float(value))
        elif key == "bool" and kind == "boolean":
            hit = column == F.lit(value)
        elif key == "str" and kind == "string":
            hit = column == F.lit(value)
        elif key == "str" and kind in ("date", "naive_datetime", "aware_datetime"):
            hit = column == F.lit(value).cast(t)
        else:
            continue
        column = F.when(~F.coalesce(hit, F.lit(False)), column)
    return column


def typed(column: Column, kind: str, kinds=KINDS) -> Column:
    """Any analysed value as one struct type, ordered as its kind is, missing last; with fields for the given kinds only."""
    own, fields = FIELDS[kind], {FIELDS[k] for k in kinds}
    return F.struct(column.isNull().alias("absent"), *((column if k == own else F.lit(None)).cast(t).alias(k) for k, t in _SQL.items() if k in fields))


def widened(value: Column, kinds) -> Column:
    """A typed value with fields for the given kinds as one with all fields."""
    fields = {FIELDS[k] for k in kinds}
    return F.struct(value["absent"].alias("absent"), *((value[k] if k in fields else F.lit(None)).cast(t).alias(k) for k, t in _SQL.items()))


def display(value: Column) -> Column:
    """A typed value as text, null for missing."""
    return F.coalesce(*(value[k].cast("string") for k in _SQL))


def plain(value):
    """A collected typed value as a Python value."""
    if value is None or not hasattr(value, "asDict"):
        return value
    d = value.asDict()
    return next((d[k] for k in _SQL if d.get(k) is not None), None)


def json_value(value):
    """A Python value as JSON can hold it."""
    if hasattr(value, "asDict"):
        value = plain(value)
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0 if math.isfinite(value) else ("inf" if value > 0 else "-inf")
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return str(value)
    raise TypeError(f"unsupported value type {type(value).__name__}")


def melt(frame: DataFrame, kinds: dict[str, str], columns: list[str], keep: list[str] = (), labels: list[str] | None = None, narrow=None) -> DataFrame:
    """One row per row and column: kept columns, feature (the column's name or label), and value (its typed value).

    With `narrow`, a collection of kinds, values have fields for those kinds only, which makes rows to be shuffled a good deal smaller.
    """
    fields = KINDS if narrow is None else [k for k in KINDS if k in narrow]
    cells = [F.struct(F.lit(n).alias("feature"), typed(quoted(c), kinds[c], fields).alias("value")) for c, n in zip(columns, labels or columns)]
    inner = ",".join(f"{FIELDS[k]}:{_SQL[FIELDS[k]]}" for k in fields)
    empty = F.expr(f"cast(array() as array<struct<feature:string,value:struct<absent:boolean{',' if inner else ''}{inner}>>>)")
    rows = frame.select(*map(quoted, keep), F.explode(F.array(*cells) if cells else empty).alias("_cell"))
    return rows.select(*map(quoted, keep), F.col("_cell")["feature"].alias("feature"), F.col("_cell")["value"].alias("value"))
