"""Two versions of the same nested rows compared leaf by leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-9
_LEAVES = "array<struct<path: string, number: double, said: string>>"


def leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """The leaves of a value as (path, number or null, text or null): fields by name, elements by place, entries of a map by key. A null, or an empty container, is a leaf of its own."""
    one = lambda number, said: F.array(F.struct(path.alias("path"), number.cast("double").alias("number"), said.cast("string").alias("said"))).cast(_LEAVES)
    none = F.lit(None)
    if isinstance(kind, T.StructType):
        inner = F.flatten(F.array(*(leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields))) if kind.fields else one(none, F.lit("{}"))
    elif isinstance(kind, T.ArrayType):
        each = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        inner = F.when(F.size(value) == 0, one(none, F.lit("[]"))).otherwise(each)
    elif isinstance(kind, T.MapType):
        each = F.flatten(F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]")))))
        inner = F.when(F.size(value) == 0, one(none, F.lit("{}"))).otherwise(each)
    elif isinstance(kind, T.NumericType):
        return one(value, none)
    else:
        return one(none, value)
    return F.when(value.isNull(), one(none, none)).otherwise(inner)


def differences(left: DataFrame, right: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, path, left_number, left_said, right_number, right_said) of the leaves that are in one version alone, of another kind, or differ: numbers by more than tolerance, all else at all. key is unique in each."""

    def flat(df: DataFrame, side: str) -> DataFrame:
        fields = [f for f in df.schema.fields if f.name != key]
        every = F.flatten(F.array(*(leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in fields)))
        x = df.select(F.col(key), F.explode(every).alias("leaf"))
        return x.select(key, "leaf.path", F.col("leaf.number").alias(f"{side}_number"), F.col("leaf.said").alias(f"{side}_said"), F.lit(True).alias(side))

    x = flat(left, "left").join(flat(right, "right"), [key, "path"], "full")
    a, b = F.col("left_number"), F.col("right_number")
    same = F.col("left").isNotNull() & F.col("right").isNotNull() & F.when(a.isNotNull() & b.isNotNull(), (F.abs(a - b) <= tolerance) | (a == b)).otherwise(a.isNull() & b.isNull() & F.col("left_said").eqNullSafe(F.col("right_said")))
    return x.where(~F.coalesce(same, F.lit(False))).select(key, "path", "left_number", "left_said", "right_number", "right_said")
