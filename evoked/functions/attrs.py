"""Attributes of events and recordings: three types and null, told apart from missing keys.

Two encodings. Dynamic: a map from key to a struct with a field for each kind of value (``ATTR``); a null struct is None,
an absent key is missing. Typed: a column for each key, with an optional boolean column ``<key>__present``; scans of
Parquet tables then prune and push down as usual.
"""

from __future__ import annotations

import math
import numbers
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTR = "struct<l:bigint,d:double,s:string,b:boolean>"


class EventsError(ValueError):
    """A query or an event that does not make sense."""


def kind_of(value) -> str | None:
    """numeric, text, bool, or None for null. Booleans are no numbers; NaN is null."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return "bool"
    if isinstance(value, numbers.Number) and not isinstance(value, complex):
        return "numeric"
    if isinstance(value, str):
        return "text"
    raise TypeError(f"attributes cannot hold {type(value).__name__}")


def encode(value) -> dict | None:
    kind = kind_of(value)
    if kind is None:
        return None
    own = {"l": None, "d": None, "s": None, "b": None}
    if kind == "numeric":
        whole = isinstance(value, numbers.Integral)
        own["l" if whole else "d"] = int(value) if whole else float(value)
    else:
        own["b" if kind == "bool" else "s"] = value
    return own


def decode(row):
    return None if row is None else next((v for v in (row["l"], row["d"], row["s"], row["b"]) if v is not None), None)


def pack(value: Column, dtype: str) -> Column:
    """The struct of a typed column; null for null."""
    whole, real = dtype in ("tinyint", "smallint", "int", "bigint"), dtype in ("float", "double") or dtype.startswith("decimal")
    part = lambda own, t: (value if own else F.lit(None)).cast(t)
    return F.when(value.isNotNull(), F.struct(part(whole, "bigint").alias("l"), part(real, "double").alias("d"), part(dtype == "string", "string").alias("s"), part(dtype == "boolean", "boolean").alias("b")))


def kind_of_type(dtype: str) -> str | None:
    return {"string": "text", "boolean": "bool", "void": None}.get(dtype, "numeric")


def agree(types: dict, others: dict) -> dict:
    """Both sets of types; a key that holds values of two types is an error."""
    known = dict(types)
    for key, kind in others.items():
        if kind and known.get(key) and known[key] != kind:
            raise TypeError(f"{key!r} holds {known[key]} values, not {kind}")
        known[key] = known.get(key) or kind
    return known


class Registry(dict):
    """Types by key, fixed by the first value that is not null."""

    def learn(self, key: str, value) -> None:
        kind = kind_of(value)
        known = self.get(key)
        if kind and known and kind != known:
            raise TypeError(f"{key!r} holds {known} values, not {kind}")
        self[key] = known or kind


@dataclass(frozen=True)
class MapAttrs:
    """Dynamic encoding in the map column ``column``."""

    types: dict = field(default_factory=dict)
    column: str = "attrs"

    def kind(self, key: str) -> str | None:
        return self.types.get(key)

    def value(self, key: str) -> Column:
        at = F.try_element_at(F.col(self.column), F.lit(key))
        if self.kind(key) == "text":
            return at["s"]
        if self.kind(key) == "bool":
            return at["b"]
        return F.coalesce(at["d"], at["l"].cast("double"))

    def present(self, key: str) -> Column:
        return F.coalesce(F.map_contains_key(F.col(self.column), key), F.lit(False))

    def put(self, df: DataFrame, key: str, value: Column, dtype: str, hit: Column) -> tuple[DataFrame, MapAttrs]:
        """``df`` and its attributes with ``value``, a column of type ``dtype``, under ``key`` where ``hit``."""
        rest = F.map_filter(self.column, lambda k, _: k != key)
        own = F.map_concat(rest, F.create_map(F.lit(key), pack(value, dtype)))
        return df.withColumn(self.column, F.when(hit, own).otherwise(F.col(self.column))), replace(self, types=agree(self.types, {key: kind_of_type(dtype)}))

    def without(self, df: DataFrame, key: str, hit: Column) -> DataFrame:
        """``df`` without ``key`` where ``hit``; a row that has no such key is an error."""
        gone = F.when(self.present(key), F.map_filter(self.column, lambda k, _: k != key)).otherwise(F.raise_error(F.lit(f"no attribute {key}")).cast(df.schema[self.column].dataType))
        return df.withColumn(self.column, F.when(hit, gone).otherwise(F.col(self.column)))

    def take(self, df: DataFrame, other: MapAttrs | ColumnAttrs, keep) -> tuple[DataFrame, MapAttrs]:
        """The columns ``keep`` of ``df`` and its attributes, which ``other`` describes, in this encoding."""
        after = replace(self, types=agree(self.types, other.types))
        if isinstance(other, MapAttrs):
            return df.select(*keep, F.col(other.column).alias(self.column)), after
        dtypes = dict(df.dtypes)
        cells = [F.struct(F.lit(k).alias("key"), pack(other.value(k), dtypes[other.prefix + k]).alias("value"), other.present(k).alias("there")) for k in other.types]
        if not cells:
            return df.select(*keep, F.map_filter(F.create_map(F.lit(""), pack(F.lit(None), "void")), lambda k, _: F.lit(False)).alias(self.column)), after
        there = F.transform(F.filter(F.array(*cells), lambda c: c["there"]), lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))
        return df.select(*keep, F.map_from_entries(there).alias(self.column)), after

    def columns(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class ColumnAttrs:
    """Typed encoding: keys are columns with the prefix ``prefix``."""

    types: dict
    prefix: str = ""
    optional: frozenset = frozenset()

    @staticmethod
    def of(df: DataFrame, keys, prefix: str = "") -> ColumnAttrs:
        types = dict(df.dtypes)
        optional = frozenset(k for k in keys if f"{prefix}{k}__present" in types)
        return ColumnAttrs({k: kind_of_type(types[prefix + k]) for k in keys}, prefix, optional)

    def kind(self, key: str) -> str | None:
        return self.types.get(key)

    def value(self, key: str) -> Column:
        return F.col(self.prefix + key) if key in self.types else F.lit(None)

    def present(self, key: str) -> Column:
        if key in self.optional:
            return F.col(f"{self.prefix}{key}__present")
        return F.lit(key in self.types)

    def put(self, df: DataFrame, key: str, value: Column, dtype: str, hit: Column) -> tuple[DataFrame, ColumnAttrs]:
        """``df`` and its attributes with ``value``, a column of type ``dtype``, under ``key`` where ``hit``."""
        types = agree(self.types, {key: kind_of_type(dtype)})
        # A key that never held a value takes the type of this one.
        old = F.col(self.prefix + key) if self.types.get(key) else F.lit(None)
        stored = "double" if dtype == "void" and not self.types.get(key) else dtype
        df = df.withColumns({self.prefix + key: F.when(hit, value if dtype == stored else value.cast(stored)).otherwise(old), f"{self.prefix}{key}__present": F.when(hit, F.lit(True)).otherwise(self.present(key))})
        return df, replace(self, types=types, optional=self.optional | {key})

    def without(self, df: DataFrame, key: str, hit: Column) -> DataFrame:
        """``df`` without ``key`` where ``hit``; a row that has no such key is an error. The key is optional from then on."""
        missing = F.raise_error(F.lit(f"no attribute {key}"))
        if key not in self.types:
            return df.withColumn("recspan_id", F.when(hit, missing.cast("bigint")).otherwise(F.col("recspan_id")))
        gone = F.when(self.present(key), F.lit(False)).otherwise(missing.cast("boolean"))
        return df.withColumns({self.prefix + key: F.when(~hit, F.col(self.prefix + key)), f"{self.prefix}{key}__present": F.when(hit, gone).otherwise(self.present(key))})

    def take(self, df: DataFrame, other: MapAttrs | ColumnAttrs, keep) -> tuple[DataFrame, ColumnAttrs]:
        """The columns ``keep`` of ``df`` and its attributes, which ``other`` describes, in this encoding."""
        types, out = agree(self.types, other.types), []
        stored = {None: "double", "numeric": "double", "text": "string", "bool": "boolean"}
        for k, kind in types.items():
            known = k in other.types and other.types[k]
            value = other.value(k) if known else F.lit(None).cast(stored[kind])
            out.append(value.alias(self.prefix + k))
            out.append((other.present(k) if k in other.types else F.lit(False)).alias(f"{self.prefix}{k}__present"))
        return df.select(*keep, *out), replace(self, types=types, optional=frozenset(types))

    def columns(self) -> list[str]:
        return [c for k in self.types for c in ([self.prefix + k] + ([f"{self.prefix}{k}__present"] if k in self.optional else []))]
