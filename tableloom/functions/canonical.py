"""One canonical form per value, so that results of different stores compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.names import camel_case

# Fixed output form of timestamps.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

_JSON = {"ignoreNullFields": "false"}


def canonical_number(column: Column, digits: int = 3) -> Column:
    """A number with exactly ``digits`` decimals, half up; null if it has no such form."""
    return column.try_cast(f"decimal(38,{digits})")


def canonical_time(column: Column, zone: str | None = None) -> Column:
    """Timestamp or date text; a date is its start of day.

    ``zone`` reads wall-clock values as local time of that zone and writes
    UTC; by default they are taken as they are.
    """
    if zone:
        column = F.to_utc_timestamp(column.cast("timestamp"), zone)
    return F.date_format(column.cast("timestamp"), ISO_MILLIS)


def canonical_value(
    column: Column,
    dtype: T.DataType,
    sort_arrays: bool = False,
    rename: Callable[[str], str] = camel_case,
    drop: frozenset[str] = frozenset(),
    texts: bool = False,
) -> Column:
    """The canonical form of a value of the given type, however deep.

    ``texts`` writes numbers as text, which keeps values without a decimal
    form (not a number, infinite, beyond 32 digits) apart from null.
    """
    if isinstance(dtype, T.StructType):
        fields = sorted(((rename(f.name), f) for f in dtype.fields if f.name not in drop), key=lambda p: p[0])
        parts = [
            canonical_value(column[f.name], f.dataType, sort_arrays, rename, drop, texts).alias(name) for name, f in fields
        ]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(column, lambda x: canonical_value(x, dtype.elementType, sort_arrays, rename, drop, texts))
        return F.sort_array(items) if sort_arrays else items
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(column),
            lambda e: F.struct(
                e["key"].alias("key"),
                canonical_value(e["value"], dtype.valueType, sort_arrays, rename, drop, texts).alias("value"),
            ),
        )
        return F.sort_array(entries)
    if isinstance(dtype, (T.DecimalType, T.DoubleType, T.FloatType)):
        number = canonical_number(column)
        return F.coalesce(number.cast("string"), column.cast("string")) if texts else number
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return canonical_time(column)
    if isinstance(dtype, T.BinaryType):
        return F.base64(column)
    return column


def canonical_struct(
    df: DataFrame, sort_arrays: bool = False, drop: tuple[str, ...] = (), rename=camel_case, texts: bool = False
) -> Column:
    """All columns as one canonical struct: names in camel case, keys sorted, nulls kept, ``drop`` left out."""
    dropped = frozenset(drop)
    fields = sorted(((rename(f.name), f) for f in df.schema.fields if f.name not in dropped), key=lambda p: p[0])
    return F.struct(
        *[
            canonical_value(F.col(f"`{f.name}`"), f.dataType, sort_arrays, rename, dropped, texts).alias(name)
            for name, f in fields
        ]
    )


def canonical_json(
    df: DataFrame, sort_arrays: bool = False, drop: tuple[str, ...] = (), rename=camel_case, texts: bool = False
) -> Column:
    """The canonical row as JSON text."""
    return F.to_json(canonical_struct(df, sort_arrays, drop, rename, texts), _JSON)


def json_text(column: Column) -> Column:
    return F.to_json(column, _JSON)


# --- hashing --------------------------------------------------------------

# Numbers below this size are hashed as thousandths in 64 bits.
_EXACT = 9e9


def _hash_parts(column: Column, dtype: T.DataType, path: str, rename, drop, kinds: list[str]) -> list[Column]:
    """Scalar columns that together identify the canonical value; ``kinds`` collects name and kind of each."""
    if isinstance(dtype, T.StructType):
        parts = [column.isNull()]
        kinds.append(f"{path}:struct")
        for f in sorted(dtype.fields, key=lambda f: rename(f.name)):
            if f.name not in drop:
                parts += _hash_parts(column[f.name], f.dataType, f"{path}.{rename(f.name)}", rename, drop, kinds)
        return parts
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        kinds.append(f"{path}:list")
        return [json_text(canonical_value(column, dtype, True, rename, drop, texts=True))]
    if isinstance(dtype, (T.DecimalType, T.DoubleType, T.FloatType)):
        kinds.append(f"{path}:number")
        small = F.abs(column) < F.lit(_EXACT)
        small_value = F.when(small, column)
        exact = (canonical_number(small_value) * 1000).cast("bigint")
        if isinstance(dtype, T.DecimalType):
            thousandths = exact
        else:
            # Plain arithmetic, except next to a tie, where the decimal form decides.
            size = F.abs(small_value.cast("double")) * 1000
            tie = F.abs(size - F.floor(size) - 0.5) < 0.01
            whole = F.floor(size + 0.5).cast("bigint")
            thousandths = F.when(tie, exact).when(column < 0, -whole).otherwise(whole)
        text = F.coalesce(canonical_number(column).cast("string"), column.cast("string"))
        return [thousandths, F.when(~small, text)]
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        kinds.append(f"{path}:time")
        return [F.unix_millis(column.cast("timestamp"))]
    if isinstance(dtype, T.IntegralType):
        kinds.append(f"{path}:integer")
        return [column.cast("bigint")]
    kinds.append(f"{path}:{dtype.simpleString()}")
    return [column]


def _parts(df: DataFrame, drop: tuple[str, ...], rename) -> tuple[list[Column], str]:
    dropped = frozenset(drop)
    kinds: list[str] = []
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: rename(f.name)):
        if f.name not in dropped:
            parts += _hash_parts(F.col(f"`{f.name}`"), f.dataType, rename(f.name), rename, dropped, kinds)
    return parts, "|".join(kinds)


def _hash(parts: list[Column], kinds: str) -> list[Column]:
    # The hash function passes over nulls, so their positions go in as bits.
    nulls = []
    for start in range(0, len(parts), 62):
        bits = [F.when(p.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, p in enumerate(parts[start : start + 62])]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        nulls.append(total)
    return [F.xxhash64(F.lit(seed), F.lit(kinds), *nulls, *parts).alias(f"h{seed}") for seed in (0, 1)]


def row_hash(df: DataFrame, drop: tuple[str, ...] = (), rename=camel_case) -> Column:
    """128 bits that identify the canonical row, as a struct of two hashes.

    Names and kinds of the columns are part of it. Plain values are hashed as
    64-bit numbers and text in generated code; only nested lists are written
    out as canonical JSON, sorted.
    """
    return F.struct(*_hash(*_parts(df, drop, rename)))


def row_hashes(df: DataFrame, drop: tuple[str, ...] = (), rename=camel_case) -> DataFrame:
    """The two hashes ``h0, h1`` of every row; each value is brought into hash form once."""
    parts, kinds = _parts(df, drop, rename)
    staged = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return staged.select(*_hash([F.col(f"p{i}") for i in range(len(parts))], kinds))
