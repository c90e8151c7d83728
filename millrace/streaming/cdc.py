"""Change messages: parsing, operation codes, envelopes, and merging into a keyed table.

Everything here works on batch and streaming frames alike, except ``apply_changes``, which runs per batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.sources.versions import Version, VersionedTable

# Operation names of the different capture tools.
OPERATION_CODES = {
    "c": ["c", "create", "insert"],
    "r": ["r", "read", "snapshot"],
    "u": ["u", "update", "replace"],
    "d": ["d", "delete"],
}


def normalize_op(op: Column) -> Column:
    """Any spelling of an operation as c, r, u or d; unknown → NULL."""
    name, out = F.lower(F.trim(op)), F.lit(None).cast("string")
    for code, names in OPERATION_CODES.items():
        out = F.when(name.isin(names), F.lit(code)).otherwise(out)
    return out


def parse_cdc(df: DataFrame, value: str = "value") -> DataFrame:
    """Flat change messages → operation, source time (ms), database, table and the whole record."""
    pick = lambda key: F.get_json_object(F.col(value).cast("string"), f"$.{key}")
    extra = [c for c in ("topic", "partition", "offset", "timestamp") if c in df.columns]
    return df.select(
        pick("__op").alias("operation"),
        pick("__source_ts_ms").try_cast("bigint").alias("source_ts_ms"),
        pick("__source_db").alias("source_db"),
        pick("__source_table").alias("source_table"),
        F.col(value).cast("string").alias("record"),
        *extra,
    )


def unwrap_cdc(df: DataFrame, schema: T.StructType, value: str = "value", now: Column | None = None) -> DataFrame:
    """``{op, before, after}`` messages → rows: c/r/u give ``after``, d gives ``before`` marked deleted.

    Messages with another operation are dropped.
    """
    envelope = T.StructType(
        [T.StructField("op", T.StringType()), T.StructField("before", schema), T.StructField("after", schema)]
    )
    others = [c for c in df.columns if c != value]
    parsed = df.select(*others, F.from_json(F.col(value).cast("string"), envelope).alias("_m"))
    coded = parsed.withColumn("_op", normalize_op(F.col("_m.op"))).filter(F.col("_op").isNotNull())
    deleted = F.col("_op") == "d"
    row = F.when(deleted, F.col("_m.before")).otherwise(F.col("_m.after"))
    moment = F.current_timestamp() if now is None else now
    return coded.select(
        *others,
        *[row.getField(f.name).alias(f.name) for f in schema.fields],
        F.col("_op").alias("_cdc_operation"),
        deleted.alias("_deleted"),
        F.when(deleted, moment).alias("_deleted_at"),
    )


# Keys that may become columns, unless the caller says otherwise: each is a column of the plan.
MAX_KEYS = 2000


def record_keys(df: DataFrame, record: str = "record", max_keys: int = MAX_KEYS) -> list[str]:
    """The union of the top-level keys of all records, technical keys (``__…``) left out. Batch only.

    More than ``max_keys`` are refused; ``record_map`` is the way beyond.
    """
    keys = df.select(F.explode(F.json_object_keys(record)).alias("k")).filter(~F.col("k").startswith("__"))
    found = [r["k"] for r in keys.distinct().orderBy("k").limit(max_keys + 1).collect()]
    if len(found) > max_keys:
        raise ValueError(f"records have more than {max_keys} different keys; give a schema or use record_map")
    return found


def record_map(df: DataFrame, record: str = "record") -> DataFrame:
    """Parsed messages with the record as one map of texts, for any number of keys; technical keys are left out."""
    fields = F.from_json(record, "map<string,string>")
    return df.withColumn("fields", F.map_filter(fields, lambda k, v: ~k.startswith("__"))).drop(record)


def expand_record(
    df: DataFrame, schema: T.StructType | None = None, record: str = "record", max_keys: int = MAX_KEYS
) -> DataFrame:
    """Parsed messages → business columns plus ``_cdc_operation``, ``_cdc_timestamp`` and ``_kafka_offset``.

    With a schema the values are typed; without one they are text and the columns are all keys that occur.
    """
    meta = [F.col("operation").alias("_cdc_operation"), F.timestamp_millis("source_ts_ms").alias("_cdc_timestamp")]
    if "offset" in df.columns:
        meta.append(F.col("offset").alias("_kafka_offset"))
    if schema is not None:
        fields = [f for f in schema.fields if not f.name.startswith("__")]
        wide = df.withColumn("_r", F.from_json(record, T.StructType(fields)))
        return wide.select(*[F.col("_r").getField(f.name).alias(f.name) for f in fields], *meta)
    return df.select(*[F.get_json_object(record, f"$['{k}']").alias(k) for k in record_keys(df, record, max_keys)], *meta)


ENVELOPE_SCHEMA = T.StructType(
    [
        *[
            T.StructField(n, T.StringType())
            for n in ("source", "bucket", "prefix", "file_key", "file_type", "batch_id")
        ],
        T.StructField("batch_number", T.LongType()),
        T.StructField("total_batches", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("extracted_at", "watermark_from", "watermark_to")],
        T.StructField("record_count", T.LongType()),
        T.StructField("records", T.ArrayType(T.StringType())),
    ]
)


def explode_envelope(df: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """Batch messages → one row per record with its index, typed times and date partitions."""
    parsed = df.select(F.from_json(F.col(value).cast("string"), ENVELOPE_SCHEMA).alias("e")).select("e.*")
    times = {c: F.col(c).try_cast("timestamp") for c in ("extracted_at", "watermark_from", "watermark_to")}
    head = [c for c in parsed.columns if c not in ("records", "record_count")]
    rows = parsed.withColumns(times).select(*head, F.posexplode("records").alias("record_id", "raw_document"))
    return rows.withColumns(
        {
            "ingested_at": F.current_timestamp() if now is None else now,
            "year": F.year("extracted_at"),
            "month": F.month("extracted_at"),
            "day": F.dayofmonth("extracted_at"),
        }
    )


OP = "_cdc_operation"


def coded(changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = OP) -> DataFrame:
    """Changes as (keys, code, order struct, image struct of the other columns); unknown operations dropped."""
    data = [c for c in changes.columns if c not in keys and c != op]
    return changes.select(
        *keys,
        normalize_op(F.col(op)).alias("_code"),
        F.struct(*[F.col(c) for c in order]).alias("_at"),
        F.struct(*[F.col(c) for c in data]).alias("_image"),
    ).filter("_code IS NOT NULL")


def newer_than(changes: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Coded changes that are newer than the target row of their key, or have none."""
    version = target.select(*keys, F.struct(*[F.col(c) for c in order]).alias("_version"))
    joined = changes.join(version, list(keys), "left")
    return joined.filter(F.col("_version").isNull() | (F.col("_at") > F.col("_version"))).drop("_version")


def net_upsert(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of every key: a plain aggregate, so very busy keys shrink before the shuffle."""
    return changes.groupBy(*keys).agg(
        F.max_by("_image", "_at").alias("_new"), (F.max_by("_code", "_at") == "d").alias("_deleted")
    )


def net_snapshot(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the changes of a key amount to when c needs a missing row and u an existing one.

    Only changes after the last delete matter. If the row was missing then, the first c or r creates it and the
    last u or r after that gives its value; if it was there, the last u or r does.
    """
    deletes = changes.filter("_code = 'd'").groupBy(*keys).agg(F.max("_at").alias("_deleted_at"))
    live = changes.join(deletes, list(keys), "left").filter(
        F.col("_deleted_at").isNull() | (F.col("_at") >= F.col("_deleted_at"))
    )
    inserted = F.when(F.col("_code").isin("c", "r"), F.col("_at"))
    updated = F.when(F.col("_code").isin("u", "r"), F.col("_at"))
    net = live.groupBy(*keys).agg(
        F.min_by("_image", inserted).alias("_created"),
        F.min(inserted).alias("_created_at"),
        F.max_by("_image", updated).alias("_update"),
        F.max(updated).alias("_update_at"),
        F.bool_or(F.col("_deleted_at").isNotNull()).alias("_deleted"),
    )
    later = F.coalesce(F.col("_update_at") > F.col("_created_at"), F.lit(False))
    fresh = F.when(F.col("_created_at").isNotNull(), F.when(later, F.col("_update")).otherwise(F.col("_created")))
    return net.select(*keys, "_deleted", F.col("_update"), fresh.alias("_fresh"))


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    policy: str = "snapshot",
    op: str = OP,
) -> DataFrame:
    """The target table after the changes, which may hold many changes per key.

    * ``snapshot``: d deletes; u and r change an existing row; c and r create a missing one. A c for an existing
      row and a u for a missing one have no effect.
    * ``upsert``: d deletes, everything else changes or creates the row.

    The result equals applying the changes one by one in order. When the target has the order columns, changes
    that are not newer than their target row are ignored. Both sides of the join hold one row per key.
    """
    keys = list(keys)
    data = [c for c in target.columns if c not in keys]
    todo = coded(changes, keys, order, op)
    if set(order) <= set(data):
        todo = newer_than(todo, target, keys, order)
    old = target.select(*keys, F.struct(*data).alias("_old"))
    exists = F.col("_old").isNotNull()
    if policy == "upsert":
        net = net_upsert(todo, keys)
        touched = F.col("_deleted").isNotNull()
        kept = F.when(touched, ~F.col("_deleted")).otherwise(exists)
        new = F.when(touched, F.col("_new"))
    elif policy == "snapshot":
        net = net_snapshot(todo, keys)
        in_place = exists & ~F.coalesce(F.col("_deleted"), F.lit(False))
        kept = in_place | F.col("_fresh").isNotNull()
        new = F.when(in_place, F.col("_update")).otherwise(F.col("_fresh"))
    else:
        raise ValueError("policy must be 'snapshot' or 'upsert'")
    names = net.schema["_new" if policy == "upsert" else "_fresh"].dataType.fieldNames()
    joined = old.join(net, keys, "full_outer").filter(kept).withColumn("_row", new)
    cells = []
    for c in data:
        before = F.col("_old").getField(c)
        if c in names:
            after = F.col("_row").getField(c).cast(target.schema[c].dataType)
            cells.append(F.when(F.col("_row").isNotNull(), after).otherwise(before).alias(c))
        else:
            cells.append(before.alias(c))
    return joined.select(*keys, *cells)


def merge_into(
    table: VersionedTable, changes: DataFrame, order: Sequence[str], policy: str = "snapshot", op: str = OP, writer: str | None = None, batch: int | None = None
) -> Version:
    """``apply_changes`` to a stored table: only files that may hold a changed key are read and replaced.

    The table must exist and hold one row per key. Ranges and filters of its files, which were stored when they were
    written, say which files these are; new keys go into the files that are written for them. With ``writer`` and
    ``batch`` the changes are applied once, however often they are handed in.
    """
    if not table.version().schema.fields:
        raise ValueError("the table has no columns yet; add its first rows")

    def merged(old: DataFrame) -> DataFrame:
        return apply_changes(old, changes, table.keys, order, policy, op)

    return table.rewrite(changes.select(*table.keys).distinct(), merged, writer, batch)


def merge_sql(target: str, source: str, keys: Sequence[str], columns: Sequence[str], op: str = OP) -> str:
    """MERGE text for catalogues that support it; ``source`` holds one row per key."""
    on = " AND ".join(f"t.{k} <=> s.{k}" for k in keys)
    sets = ", ".join(f"t.{c} = s.{c}" for c in columns if c not in keys)
    names, values = ", ".join(columns), ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {target} t USING {source} s ON {on} "
        f"WHEN MATCHED AND s.{op} = 'd' THEN DELETE "
        f"WHEN MATCHED AND s.{op} IN ('u', 'r') THEN UPDATE SET {sets} "
        f"WHEN NOT MATCHED AND s.{op} IN ('c', 'r') THEN INSERT ({names}) VALUES ({values})"
    )


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between two tables, for comparing a merge with its replay."""
    other = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*[c for c in b.columns if c not in keys]).alias("_b"))
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    mine = a.select(*keys, F.struct(*[c for c in a.columns if c not in keys]).alias("_a"))
    return mine.join(other, match, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
