"""Column, table and property names (SCA5 to SCA7, D5d)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER_RUN = re.compile(r"[A-Z]+")


def clean_name(name: str, prefix: str) -> str:
    """A result column name without spaces and without ``prefix``."""
    return name.replace(" ", "").replace(prefix, "")


def clean_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[clean_name(c, prefix) for c in df.columns])


def camel_case(name: str) -> str:
    """``OrderID`` to ``orderId``, ``WebsiteURL`` to ``websiteUrl``, ``URLValue`` to ``urlValue``."""
    run = _UPPER_RUN.match(name)
    if run:
        end = run.end()
        if 1 < end < len(name):
            end -= 1
        name = name[:end].lower() + name[end:]
    for upper, lower in (("ID", "Id"), ("URL", "Url")):
        if name.endswith(upper):
            return name[: -len(upper)] + lower
    return name


def renamed_type(dtype: T.DataType, rename: Callable[[str], str]) -> T.DataType:
    """The type with every struct field renamed, however deep."""
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(rename(f.name), renamed_type(f.dataType, rename), f.nullable, f.metadata) for f in dtype.fields]
        )
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(renamed_type(dtype.elementType, rename), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, renamed_type(dtype.valueType, rename), dtype.valueContainsNull)
    return dtype


def rename_deep(df: DataFrame, rename: Callable[[str], str] = camel_case) -> DataFrame:
    """Rename columns and nested fields. Nested renames are casts by position: no data moves."""
    out = []
    for f in df.schema.fields:
        target = renamed_type(f.dataType, rename)
        c = F.col(f"`{f.name}`")
        out.append((c if target == f.dataType else c.cast(target)).alias(rename(f.name)))
    return df.select(*out)


def ordinal_columns(df: DataFrame) -> DataFrame:
    """``ordinal__name`` for every column, so that equal names can be told apart."""
    return df.toDF(*[f"{i}__{c}" for i, c in enumerate(df.columns)])


def singular(name: Column) -> Column:
    """Singular form of a table name: ``ies`` to ``y``, final ``s`` dropped, ``ss`` kept."""
    n = F.length(name)
    return (
        F.when(name.endswith("ies") & (n > 3), F.concat(name.substr(F.lit(1), n - 3), F.lit("y")))
        .when(name.endswith("s") & ~name.endswith("ss") & (n > 1), name.substr(F.lit(1), n - 1))
        .otherwise(name)
    )
