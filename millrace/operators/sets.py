"""Unions, schema comparison, schema versions and DDL events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions.scalars import exact


def union_tables(df: DataFrame, others: Sequence[DataFrame], by: str = "position") -> DataFrame:
    """Append tables, duplicates kept; by position, or by name with missing columns as NULL."""
    if by == "position":
        return reduce(lambda a, b: a.unionAll(b), others, df)
    if by == "name":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, df)
    raise ValueError("by must be 'position' or 'name'")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def column_listing(df: DataFrame, table: str) -> DataFrame:
    """The schema of a table as rows (table_name, column_name, data_type)."""
    rows = [(table, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string")


def schema_diff(old: DataFrame, new: DataFrame, allow_breaking: bool = False) -> DataFrame:
    """Added, removed and changed columns per table of two column listings; order does not matter.

    Compatible means that columns were only added, unless breaking changes are allowed.
    """
    before = old.select("table_name", "column_name", F.col("data_type").alias("old_type"))
    after = new.select("table_name", "column_name", F.col("data_type").alias("new_type"))
    joined = before.join(after, ["table_name", "column_name"], "full_outer")
    added = F.col("old_type").isNull()
    removed = F.col("new_type").isNull()
    changed = F.col("old_type") != F.col("new_type")

    def names(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("column_name"))))

    diff = joined.groupBy("table_name").agg(
        names(added).alias("added"), names(removed).alias("removed"), names(changed).alias("changed")
    )
    breaking = (F.size("removed") > 0) | (F.size("changed") > 0)
    diff = diff.withColumn("is_compatible", F.lit(allow_breaking) | ~breaking)
    summary = F.concat_ws(
        "; ",
        *[
            F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, ", ")))
            for c in ("added", "removed", "changed")
        ],
    )
    return diff.withColumn("summary", F.when(summary == "", F.lit("no changes")).otherwise(summary))


def schema_hash(listing: DataFrame) -> DataFrame:
    """One row per table: MD5 over its sorted ``column:type`` pairs, and the number of columns."""
    pair = F.concat_ws(":", "column_name", "data_type")
    return listing.groupBy("table_name").agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(pair)), "|")).alias("schema_hash"),
        F.count("*").alias("column_count"),
    )


CATALOG_SCHEMA = (
    "table_name string, schema_hash string, column_count bigint, version int, row_count bigint,"
    " tags array<string>, registered_at timestamp"
)


def register(
    catalog: DataFrame, listing: DataFrame, row_counts: DataFrame, now: Column, tags: Sequence[str] = ()
) -> DataFrame:
    """Catalogue rows to append: the version goes up by one only when the schema hash changes."""
    newest = Window.partitionBy("table_name").orderBy(F.col("version").desc(), F.col("registered_at").desc())
    current = (
        catalog.withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .select("table_name", F.col("schema_hash").alias("_old_hash"), F.col("version").alias("_old_version"))
    )
    entries = schema_hash(listing).join(row_counts.select("table_name", "row_count"), "table_name", "left")
    changed = ~F.col("schema_hash").eqNullSafe(F.col("_old_hash"))
    version = F.coalesce(F.col("_old_version"), F.lit(0)) + F.when(changed, 1).otherwise(0)
    return entries.join(current, "table_name", "left").select(
        "table_name",
        "schema_hash",
        "column_count",
        version.cast("int").alias("version"),
        "row_count",
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
        now.alias("registered_at"),
    )


def search_catalog(catalog: DataFrame, text: str | None = None, tag: str | None = None) -> DataFrame:
    """Catalogue rows whose table name contains the text and whose tags hold the tag."""
    if text:
        catalog = catalog.filter(F.lower("table_name").contains(text.lower()))
    return catalog.filter(F.array_contains("tags", tag)) if tag else catalog


def align(df: DataFrame, target: T.StructType, allow_new: bool = True) -> DataFrame:
    """Additive evolution to a target schema: missing columns as typed NULLs, type changes refused.

    Columns the target does not know are kept at the end, or refused with ``allow_new=False``.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    clashes = [f.name for f in target.fields if f.name in have and have[f.name] != f.dataType]
    if clashes:
        raise ValueError(f"breaking type change in {clashes}")
    known = {f.name for f in target.fields}
    extra = [c for c in df.columns if c not in known]
    if extra and not allow_new:
        raise ValueError(f"columns not in the target schema: {extra}")
    aligned = [exact(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]
    return df.select(*aligned, *[exact(c) for c in extra])


# DDL patterns and the change they stand for; the first match wins.
DDL_KINDS = [
    ("table_created", "CREATE TABLE"),
    ("column_added", "ALTER TABLE(?s).*ADD COLUMN"),
    ("column_renamed", "ALTER TABLE(?s).*RENAME COLUMN"),
    ("column_modified", "ALTER TABLE(?s).*MODIFY COLUMN"),
    ("column_dropped", "DROP COLUMN"),
]


def classify_ddl(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON schema-change events → time, database, table, change type, DDL; else the listed fields."""
    payload = "$.payload"
    text = F.coalesce(F.get_json_object(value, f"{payload}.ddl"), F.lit(""))
    change = F.lit(None).cast("string")
    for name, pattern in reversed(DDL_KINDS):
        change = F.when(F.col("ddl").rlike(pattern), F.lit(name)).otherwise(change)
    fields = F.from_json(F.get_json_object(value, "$.schema.fields"), "array<struct<field:string>>")
    return (
        df.withColumn("event_ms", F.get_json_object(value, f"{payload}.ts_ms").try_cast("bigint"))
        .withColumn("database", F.get_json_object(value, f"{payload}.databaseName"))
        .withColumn("table", F.get_json_object(value, f"{payload}.tableName"))
        .withColumn("ddl", F.when(F.col("database").isNotNull(), text))
        .withColumn("change_type", change)
        .withColumn("fields", F.when(F.col("database").isNull(), F.transform(fields, lambda f: f["field"])))
        .withColumn("field_count", F.when(F.col("fields").isNotNull(), F.size("fields")))
        .filter(F.col("database").isNotNull() | F.col("fields").isNotNull())
    )
