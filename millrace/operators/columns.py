"""Projections, filters and column-wise operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions.scalars import (
    COMPLEX,
    DEFAULT_COUNTRY_CODE,
    columns_of,
    e164,
    exact,
    md5_of,
    phone_digits,
    safe_cast,
    sha256_of,
)

COMPARISONS = {
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "!=": lambda c, v: c != v,
}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def filter_expr(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(F.expr(condition))


def filter_triples(df: DataFrame, filters: Sequence[Mapping[str, object]]) -> DataFrame:
    """``[{column, operator, value}]`` joined by AND."""
    terms = [COMPARISONS[f["operator"]](F.col(f["column"]), f["value"]) for f in filters]
    return df.filter(reduce(lambda a, b: a & b, terms)) if terms else df


def filter_equals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return filter_triples(df, [{"column": c, "operator": "=", "value": v} for c, v in values.items()])


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where any listed column contains the text, ignoring case."""
    hits = [F.lower(F.col(c).cast("string")).contains(text.lower()) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def cast_types(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Casts by name; columns not in the table are skipped, bad values become NULL."""
    return df.withColumns({c: safe_cast(F.col(c), t) for c, t in mapping.items() if c in df.columns})


def cast_by_rules(df: DataFrame, rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Per-column rules ``{type, default, lower, trim}``, for columns that exist."""
    out = {}
    for name, rule in rules.items():
        if name not in df.columns:
            continue
        value = F.col(name)
        if rule.get("trim"):
            value = F.trim(value)
        if rule.get("lower"):
            value = F.lower(value)
        if "type" in rule:
            value = safe_cast(value, rule["type"])
        if "default" in rule:
            value = F.coalesce(value, F.lit(rule["default"]))
        out[name] = value
    return df.withColumns(out) if out else df


# Casts the change stream applies by table name.
CDC_CAST_RULES = {
    "transaction": {
        "amount": {"type": "double", "default": 0.0},
        "transaction_date": {"type": "timestamp"},
    },
    "user": {"email": {"lower": True, "trim": True}, "created_at": {"type": "timestamp"}},
}


def cdc_type_cast(df: DataFrame, table_name: str) -> DataFrame:
    """The casts whose key word occurs in the table name."""
    for word, rules in CDC_CAST_RULES.items():
        if word in table_name.lower():
            df = cast_by_rules(df, rules)
    return df


def normalize(df: DataFrame, config: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """``{column: {type: lowercase|uppercase|titlecase|trim|phone_format|round, decimals, trim}}``."""
    kinds = {
        "lowercase": F.lower,
        "uppercase": F.upper,
        "titlecase": F.initcap,
        "trim": F.trim,
        "phone_format": phone_digits,
    }
    out = {}
    for name, rule in config.items():
        if name not in df.columns:
            continue
        kind = rule["type"]
        if kind == "round":
            value = F.round(F.col(name), int(rule.get("decimals", 2)))
        elif kind in kinds:
            value = kinds[kind](F.col(name))
        else:
            raise ValueError(f"unknown normalisation {kind!r}")
        out[name] = F.trim(value) if rule.get("trim") else value
    return df.withColumns(out) if out else df


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column in one projection."""
    strings = columns_of(df, T.StringType)
    return df.withColumns({c: F.trim(exact(c)) for c in strings}) if strings else df


def standardize(df: DataFrame, fill_zero: bool = True, parse_dates: bool = True) -> DataFrame:
    """Trim strings, NULL → 0 in int and double columns, columns named date/time → timestamp."""
    out = {}
    for f in df.schema.fields:
        value = exact(f.name)
        if isinstance(f.dataType, T.StringType):
            value = F.trim(value)
            if parse_dates and re.search("date|time", f.name.lower()):
                value = value.try_cast("timestamp")
        elif fill_zero and isinstance(f.dataType, (T.IntegerType, T.DoubleType)):
            value = F.coalesce(value, F.lit(0).cast(f.dataType))
        out[f.name] = value
    return df.select(*[v.alias(n) for n, v in out.items()])


def standardize_typed(
    df: DataFrame,
    dates: Sequence[str] = (),
    phones: Sequence[str] = (),
    emails: Sequence[str] = (),
    currencies: Sequence[str] = (),
    country_code: str = DEFAULT_COUNTRY_CODE,
) -> DataFrame:
    """Dates as ``YYYY-MM-DD``, phones as E.164, emails lower and trimmed, money with two decimals."""
    out = {}
    out |= {c: F.date_format(F.col(c).try_cast("timestamp"), "yyyy-MM-dd") for c in dates if c in df.columns}
    out |= {c: e164(F.col(c).cast("string"), country_code) for c in phones if c in df.columns}
    out |= {c: F.trim(F.lower(F.col(c))) for c in emails if c in df.columns}
    out |= {c: F.round(F.col(c).try_cast("double"), 2).try_cast("decimal(10,2)") for c in currencies if c in df.columns}
    return df.withColumns(out) if out else df


def add_silver_metadata(
    df: DataFrame, source: str, entity: str, job_id: str, now: Column, null_safe: bool = True
) -> DataFrame:
    """Source, entity, time, job and the MD5 record hash over the data columns."""
    data = [c for c in df.columns if not c.startswith("_")]
    return df.withColumns(
        {
            "_source_system": F.lit(source),
            "_entity_name": F.lit(entity),
            "_ingestion_timestamp": now,
            "_job_id": F.lit(job_id),
            "_record_hash": md5_of(data, null_safe),
        }
    )


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, name: str = "_row_hash") -> DataFrame:
    """SHA-256 over the sorted-key JSON of the columns."""
    return df.withColumn(name, sha256_of(list(columns or df.columns)))


# Technical columns that stay when a table is promoted.
ESSENTIAL_TECHNICAL = ["_bronze_ingested_at", "_silver_processed_at", "_silver_quality_passed"]


def to_gold(df: DataFrame, score: float, now: Column, keep: Sequence[str] = tuple(ESSENTIAL_TECHNICAL)) -> DataFrame:
    """Drop ``_bronze_*`` and ``_silver_*`` except the essential ones, add Gold metadata."""
    technical = [c for c in df.columns if c.startswith(("_bronze_", "_silver_")) and c not in keep]
    return df.drop(*technical).withColumns({"_gold_processed_at": now, "_quality_score": F.lit(float(score))})


def flatten(df: DataFrame, sep: str = "_", max_depth: int = 3) -> DataFrame:
    """Structs become ``a_b`` columns down to ``max_depth`` levels; arrays, maps and deeper structs JSON."""

    def leaves(column: Column, name: str, kind: T.DataType, depth: int) -> list[Column]:
        if isinstance(kind, T.StructType) and depth < max_depth:
            return [
                leaf
                for f in kind.fields
                for leaf in leaves(column.getField(f.name), f"{name}{sep}{f.name}", f.dataType, depth + 1)
            ]
        if isinstance(kind, COMPLEX):
            return [F.to_json(column).alias(name)]
        return [column.alias(name)]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(exact(f.name), f.name, f.dataType, 0)])


def flatten_json(df: DataFrame, keys: Mapping[str, Sequence[str]], keep: bool = True) -> DataFrame:
    """JSON string columns → ``<column>_<key>`` string columns."""
    out = {f"{c}_{k}": F.get_json_object(c, f"$.{k}") for c, ks in keys.items() for k in ks}
    wide = df.withColumns(out)
    return wide if keep else wide.drop(*keys)


def sanitize(df: DataFrame) -> DataFrame:
    """Struct, array and map columns → JSON text; decimals → double."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, COMPLEX):
            out[f.name] = F.to_json(exact(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out[f.name] = exact(f.name).cast("double")
    return df.withColumns(out) if out else df


def apply_sql(df: DataFrame, sql: str, view: str = "input") -> DataFrame:
    """Run a SELECT over the table under the name ``view``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(sql)


# Statements an ad-hoc query may not contain.
FORBIDDEN_WORDS = ["insert", "update", "delete", "drop", "create", "alter", "truncate", "grant", "revoke", "merge"]


def check_select(sql: str) -> str:
    """The statement without its final semicolon, if it is one SELECT; otherwise an error."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", text)
    if not re.match(r"(?is)(select|with)\b", bare):
        raise ValueError("only SELECT statements are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    word = re.search(r"(?i)\b(" + "|".join(FORBIDDEN_WORDS) + r")\b", bare)
    if word:
        raise ValueError(f"{word.group(1).upper()} is not allowed")
    return text


def run_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame | str], limit: int | None = None) -> DataFrame:
    """An ad-hoc SELECT over named tables (frames or Parquet paths); a row limit, if given, is part of the plan."""
    text = check_select(sql)
    for name, table in tables.items():
        frame = spark.read.parquet(table) if isinstance(table, str) else table
        frame.createOrReplaceTempView(name)
    result = spark.sql(text)
    return result if limit is None else result.limit(limit)


def query_template(name: str, table: str, column: str = "*", order: str = "created_at", rows: int = 100) -> str:
    """SQL text of a stock check, for ``run_query``; the preview shows the first ``rows`` by ``order``."""
    templates = {
        "basic_preview": f"SELECT * FROM {table} ORDER BY {order} LIMIT {rows}",
        "row_count": f"SELECT COUNT(*) AS total_rows FROM {table}",
        "check_nulls": (
            f"SELECT COUNT(*) AS total_rows, COUNT(CASE WHEN {column} IS NULL THEN 1 END) AS null_count FROM {table}"
        ),
        "check_duplicates": (
            f"SELECT {column}, COUNT(*) AS duplicate_count FROM {table} GROUP BY {column} HAVING COUNT(*) > 1"
        ),
        "date_range": (
            f"SELECT MIN({order}) AS earliest_date, MAX({order}) AS latest_date, COUNT(*) AS total_records FROM {table}"
        ),
        "value_distribution": (
            f"SELECT {column}, COUNT(*) AS count FROM {table} GROUP BY {column} ORDER BY count DESC, {column}"
        ),
        "statistics": (
            f"SELECT COUNT(*) AS row_count, AVG({column}) AS avg_value, MIN({column}) AS min_value,"
            f" MAX({column}) AS max_value FROM {table}"
        ),
    }
    if name not in templates:
        raise ValueError(f"unknown template {name!r}; use one of {sorted(templates)}")
    return templates[name]


def mask_columns(df: DataFrame, methods: Mapping[str, str], key: Column | None = None) -> DataFrame:
    """hash (SHA-256), partial (last four characters stay), redact, or encrypt (AES with ``key``)."""
    out = {}
    for name, method in methods.items():
        text = F.col(name).cast("string")
        if method == "hash":
            out[name] = F.sha2(text, 256)
        elif method == "partial":
            hidden = F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0)))
            out[name] = F.concat(hidden, F.right(text, F.lit(4)))
        elif method == "redact":
            out[name] = F.when(text.isNotNull(), F.lit("[REDACTED]"))
        elif method == "encrypt":
            if key is None:
                raise ValueError("encrypt needs a key")
            out[name] = F.base64(F.aes_encrypt(text, key))
        else:
            raise ValueError(f"unknown masking method {method!r}")
    return df.withColumns(out)
