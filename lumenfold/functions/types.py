"""Struct types for functions that are defined before a session exists."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType())}


def struct_of(fields: str) -> T.StructType:
    """The type of `name type, name type, ...`, of the types above."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (x.split() for x in fields.split(", "))])
