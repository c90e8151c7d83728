"""Joins, lookups, key checks and content de-duplication.

No broadcast hints: Spark broadcasts a side when its size is known to be under the threshold, and adaptive
execution switches at run time or splits skewed partitions of the streamed side. Lookup sides are reduced to
one row per key first, so a hot key on the other side is the only skew left, and that one can be split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.scalars import as_list, exact, row_spread
from millrace.operators.windows import first_per_key

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer", "full": "full_outer", "full_outer": "full_outer"}


def join_tables(
    df: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", salt: int | None = None
) -> DataFrame:
    """Equi-join on shared column names; each key appears once in the result.

    Adaptive execution splits skewed partitions by itself. ``salt=n`` spreads hot keys of the left side over
    ``n`` tasks in the plan already, for inner and left joins.
    """
    kind = HOW[how.lower().removeprefix("join_")]
    return df.join(right, as_list(on), kind) if salt is None else salted_join(df, right, as_list(on), kind, salt)


HOT_ROWS = 5_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``min_rows`` rows: never more than rows / min_rows of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select(*keys)


def salted_join(
    df: DataFrame, right: DataFrame, keys: Sequence[str], how: str, salt: int, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Join in which rows of hot left keys are spread over ``salt`` groups and their right rows repeated there.

    Only hot keys are repeated; everything else is joined as usual. The list of hot keys is broadcast, which
    is safe because of the bound in ``hot_keys``.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted")
    hot = F.broadcast(hot_keys(df, keys, min_rows).withColumn("_hot", F.lit(True)))
    place = F.pmod(row_spread(df), F.lit(salt))
    left = df.join(hot, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), place.cast("int")).otherwise(F.lit(0)))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.drop("_hot").join(other, [*keys, "_salt"], how).drop("_salt")


def join_ci(df: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys compared in lower case; only the left columns come back, once per match."""
    keys = as_list(on)
    slim = right.select(*[F.lower(F.col(k).cast("string")).alias(f"_r_{k}") for k in keys])
    match = reduce(lambda a, b: a & b, [F.lower(F.col(k).cast("string")) == F.col(f"_r_{k}") for k in keys])
    return df.join(slim, match, HOW[how.lower()]).select(*df.columns)


def join_multi(
    tables: Mapping[str, DataFrame],
    conditions: Sequence[Mapping[str, str]],
    select: Sequence[str],
    now: Column | None = None,
) -> DataFrame:
    """Tables by alias, joined in the order of ``[{left, right, type}]``, then a list of SQL expressions.

    The first alias of the first condition starts; the alias of each right column is joined next.
    """
    start = conditions[0]["left"].split(".")[0]
    result = tables[start].alias(start)
    for c in conditions:
        alias = c["right"].split(".")[0]
        how = HOW[c.get("type", "inner").lower()]
        result = result.join(tables[alias].alias(alias), F.col(c["left"]) == F.col(c["right"]), how)
    result = result.selectExpr(*select)
    return result if now is None else result.withColumn("_gold_created_at", now)


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str | Sequence[str],
    columns: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Add columns of a lookup table; every left row stays once, the first lookup row per key wins."""
    keys = as_list(key)
    order = [F.col(c) for c in (order_by or columns)]
    return df.join(first_per_key(table.select(*{*keys, *columns, *order_by}), keys, order).select(*keys, *columns), keys, "left")


def attach_blobs(
    meta: DataFrame, blobs: DataFrame, link: str, order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Metadata rows with the first blob of the same checksum."""
    return lookup(meta, blobs, link, columns, order_by)


def with_rules(log: DataFrame, rules: DataFrame, how: str = "left") -> DataFrame:
    """Log or quarantine rows with the rule's name and category."""
    names = rules.select("rule_id", "rule_name", "category").dropDuplicates(["rule_id"])
    return log.join(names, "rule_id", HOW[how])


def fk_violations(df: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows whose key is not in the parent; a NULL in the key passes. ``keys`` maps child to parent column."""
    slim = parent.select(*[F.col(p).alias(f"_p_{p}") for p in keys.values()])
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{p}") for c, p in keys.items()])
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    return df.filter(present).join(slim, match, "left_anti")


def fk_valid(df: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows whose key is in the parent."""
    slim = parent.select(*[F.col(p).alias(f"_p_{p}") for p in keys.values()])
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{p}") for c, p in keys.items()])
    return df.join(slim, match, "left_semi")


def new_only(files: DataFrame, assets: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Files whose key is not yet among the assets."""
    keys = as_list(key)
    return files.join(assets.select(*keys), keys, "left_anti")


def content_dedup(
    df: DataFrame, content_col: str, order_by: Sequence[str], existing: DataFrame | None = None
) -> DataFrame:
    """The first row per SHA-256 of the content, without contents known from earlier runs.

    ``existing`` has a ``content_hash`` column. Copies are dropped map-side before the shuffle, and the check
    against earlier runs reuses that shuffle.
    """
    hashed = df.withColumn("content_hash", F.sha2(F.col(content_col).cast("binary"), 256))
    kept = first_per_key(hashed, ["content_hash"], [F.col(c) for c in order_by])
    return kept if existing is None else kept.join(existing.select("content_hash"), "content_hash", "left_anti")


def content_dedup_counts(df: DataFrame, content_col: str, existing: DataFrame | None = None) -> DataFrame:
    """One row: rows seen, contents kept, copies inside the run, rows known from earlier runs."""
    groups = df.groupBy(F.sha2(F.col(content_col).cast("binary"), 256).alias("content_hash")).agg(F.count("*").alias("n"))
    if existing is not None:
        known = existing.select("content_hash").distinct().withColumn("_known", F.lit(True))
        groups = groups.join(known, "content_hash", "left")
    else:
        groups = groups.withColumn("_known", F.lit(None).cast("boolean"))
    fresh = F.col("_known").isNull()
    return groups.agg(
        F.sum("n").alias("rows_seen"),
        F.count_if(fresh).alias("kept"),
        F.coalesce(F.sum(F.when(fresh, F.col("n") - 1)), F.lit(0)).alias("copies_in_run"),
        F.coalesce(F.sum(F.when(~fresh, F.col("n"))), F.lit(0)).alias("known_before"),
    )


def identical_columns(df: DataFrame) -> DataFrame:
    """Pairs of same-typed columns that are equal in every row, NULLs included. One scan."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = [(a, b) for a, b in combinations(df.columns, 2) if kinds[a] == kinds[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string")
    entries = [
        F.struct(
            F.lit(a).alias("column1"),
            F.lit(b).alias("column2"),
            F.bool_and(exact(a).eqNullSafe(exact(b))).alias("same"),
        )
        for a, b in pairs
    ]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p")).filter("same").drop("same")
