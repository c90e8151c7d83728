"""Scalar column expressions, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Patterns and type names the results depend on.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+?[0-9]{10,15}$"
DEFAULT_COUNTRY_CODE = "60"
TYPE_NAMES = {
    "integer": "int",
    "int": "int",
    "long": "bigint",
    "double": "double",
    "float": "float",
    "string": "string",
    "date": "date",
    "timestamp": "timestamp",
    "boolean": "boolean",
}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    """Names of the columns whose type is one of ``kinds``, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def as_list(value: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """``"a, b"``, ``["a", "b"]`` and ``None`` as a list of names."""
    if value is None:
        return []
    if isinstance(value, str):
        return [part.strip() for part in value.split(",") if part.strip()]
    return list(value)


def safe_cast(column: Column, type_name: str) -> Column:
    """Cast that gives NULL for a bad value."""
    target = TYPE_NAMES.get(type_name.lower())
    if target is None:
        raise ValueError(f"unknown type {type_name!r}; use one of {sorted(TYPE_NAMES)}")
    return column.try_cast(target)


def exact(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_number(column: Column) -> Column:
    """The value as double, with NaN read as missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell counts as missing: NULL, or NaN in a floating column."""
    column = exact(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def phone_digits(column: Column) -> Column:
    """Digits and plus signs only."""
    return F.regexp_replace(column, "[^0-9+]", "")


def e164(column: Column, country_code: str = DEFAULT_COUNTRY_CODE) -> Column:
    """``+<digits>``; a ten-digit number loses its first digit and gains the country code."""
    digits = F.regexp_replace(column, r"\D", "")
    national = F.concat(F.lit(f"+{country_code}"), F.substring(digits, 2, 9))
    return (
        F.when(F.length(digits) == 10, national)
        .when(F.length(digits) > 0, F.concat(F.lit("+"), digits))
        .otherwise(column)
    )


def md5_of(columns: list[str], null_safe: bool = True, separator: str = "||") -> Column:
    """MD5 of the joined cells.

    With ``null_safe`` every cell is led by its length and NULL is a marker without one, so that different rows have
    different texts whatever the cells hold; without it cells are joined as they are and NULL is left out.
    """
    cells = [exact(c).cast("string") for c in columns]
    if null_safe:
        cells = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("\\N")) for c in cells]
    return F.md5(F.concat_ws(separator, *cells))


def row_spread(df: DataFrame) -> Column:
    """A hash of all cells, for spreading and ordering rows; columns with maps are hashed as JSON."""

    def cell(f: T.StructField) -> Column:
        column = exact(f.name)
        return F.to_json(F.struct(column)) if "map<" in f.dataType.simpleString() else column

    return F.xxhash64(*[cell(f) for f in df.schema.fields])


def sha256_of(columns: list[str]) -> Column:
    """SHA-256 of the JSON object of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*[exact(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def epoch_seconds(column: Column) -> Column:
    """Seconds since 1970 as double, with the fraction kept."""
    return column.cast("timestamp").cast("double")
