"""Streaming jobs: Bronze table streams, per-table routing, and the Silver change stream.

The sinks write versioned tables (``millrace.sources.versions``): files first, then one list of what counts. The Silver stream
merges each micro-batch into one table with a row per key, the others append. Each table remembers the last batch of a
stream, so a batch that is replayed after a failure leaves the same rows. ``write_batch`` is the plain alternative, a
folder for each micro-batch that a replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.scalars import EMAIL_PATTERN
from millrace.functions.stats import one_row
from millrace.operators.columns import cdc_type_cast, trim_strings
from millrace.operators.windows import latest_changes
from millrace.sources.versions import VersionedTable

# Columns that must not be NULL, by word in the table name; trigger.
CRITICAL_COLUMNS = {
    "users": ["user_id", "email"],
    "transactions": ["transaction_id", "amount", "transaction_date"],
    "orders": ["order_id", "customer_id", "order_date"],
    "products": ["product_id", "name", "price"],
}
TRIGGER = "30 seconds"
DAY = "silver_day"


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, pattern: str = "*.parquet"
) -> DataFrame:
    """A Parquet table as a stream of its files; ``max_files`` bounds a trigger."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start(
    df: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str,
    available_now: bool = False,
    every: str = TRIGGER,
) -> StreamingQuery:
    """Run ``process`` per micro-batch, either on a timer or once over all available data."""
    writer = df.writeStream.queryName(name).foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Overwrite the folder of this micro-batch; partitions are gathered first and large ones split."""
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def route_batch(path: str, errors: str) -> Callable[[DataFrame, int], None]:
    """A sink that files parsed changes by database and table, and unusable messages as errors.

    Both are versioned tables (``versions.read``). One write serves all tables of the batch; the batch is kept in memory for
    the two writes only, and small files are gathered now and then.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        known = F.col("source_table").isNotNull() & F.col("operation").isNotNull()
        writer, spark = stream_id(batch, "routing"), batch.sparkSession
        batch = batch.persist()
        try:
            routed = VersionedTable(spark, path, partition_by=["source_db", "source_table"])
            routed.add(batch.filter(known), writer, batch_id)
            reason = F.when(F.col("source_table").isNull(), "no source table").otherwise("no operation")
            unusable = VersionedTable(spark, errors)
            unusable.add(batch.filter(~known).withColumn("error", reason), writer, batch_id)
            tidy(routed)
            tidy(unusable)
        finally:
            batch.unpersist()

    return process


@dataclass(frozen=True)
class SilverStream:
    """One table of the Silver stream."""

    source: str
    table: str
    silver: str
    quarantine: str
    key: str | Sequence[str] = "_cdc_key"
    order: Sequence[str] = ("_cdc_timestamp", "_cdc_lsn")
    critical: Sequence[str] | None = None
    checks: Mapping[str, str] = field(default_factory=dict)
    catalog: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    @property
    def required(self) -> list[str]:
        if self.critical is not None:
            return list(self.critical)
        return next((c for word, c in CRITICAL_COLUMNS.items() if word in self.table.lower()), [])


def quality_flags(df: DataFrame, required: Sequence[str], checks: Mapping[str, str] | None = None) -> dict[str, Column]:
    """``_dq_*`` columns, true where the row fails; extra checks are SQL conditions that must hold."""
    flags = {f"_dq_null_{c}": F.col(c).isNull() for c in required if c in df.columns}
    if "email" in df.columns:
        flags["_dq_invalid_email"] = ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))
    if "amount" in df.columns:
        flags["_dq_negative_amount"] = F.coalesce(F.col("amount") < 0, F.lit(False))
    for name, condition in (checks or {}).items():
        flags[f"_dq_{name}"] = ~F.coalesce(F.expr(condition), F.lit(True))
    return flags


def check_batch(batch: DataFrame, cfg: SilverStream) -> tuple[DataFrame, list[str]]:
    """Trim, cast, keep the newest change per key, and add the ``_dq_*`` columns; also returns their names."""
    df = cdc_type_cast(trim_strings(batch), cfg.table)
    if set([*cfg.keys, *cfg.order]) <= set(df.columns):
        df = latest_changes(df, cfg.keys, cfg.order)
    flags = quality_flags(df, cfg.required, cfg.checks)
    return (df.withColumns(flags) if flags else df), list(flags)


def split_batch(checked: DataFrame, flags: Sequence[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """The clean rows with the score of the batch, and the failing rows with their flags."""
    failed = reduce(lambda a, b: a | b, [F.col(c) for c in flags], F.lit(False))
    score = one_row(checked, total=F.count("*"), clean=F.count_if(~failed))
    clean = checked.filter(~failed).drop(*flags)
    clean = clean.withColumns(
        {
            "silver_processed_at": now,
            "silver_quality_score": F.try_divide(score["clean"] * F.lit(100.0), score["total"]),
            "silver_validation_status": F.lit("passed"),
        }
    )
    return clean, checked.filter(failed).withColumn("_quarantine_timestamp", now)


def clean_batch(batch: DataFrame, cfg: SilverStream, now: Column) -> tuple[DataFrame, DataFrame]:
    """The clean and the failing rows of one batch."""
    return split_batch(*check_batch(batch, cfg), now)


def silver_table(spark: SparkSession, cfg: SilverStream, columns: Sequence[str]) -> VersionedTable:
    """The Silver table; it has keys if the rows have all key and order columns."""
    keyed = set([*cfg.keys, *cfg.order]) <= set(columns)
    return VersionedTable(spark, cfg.silver, cfg.keys if keyed else (), [DAY])


def merge_batch(clean: DataFrame, cfg: SilverStream, moment: Column, writer: str | None = None, batch: int | None = None) -> None:
    """Merge the clean rows of a batch into the Silver table: one row per key, the newest by ``cfg.order``.

    The table is partitioned by the day on which a key first arrived, so a key stays in its partition. Only files that may
    hold a key of the batch are read and replaced, and readers see the new files and the old ones' end at once. An older
    change than the stored one is ignored, and a batch that is already there changes nothing. Without key or order columns
    there is nothing to merge by, and the rows are added as they are. With a catalogue table whole days are replaced,
    because the catalogue knows one folder for each day.
    """
    spark = clean.sparkSession
    rows = clean.withColumn(DAY, F.to_date(moment))
    table = silver_table(spark, cfg, clean.columns)

    def merged(old: DataFrame | None) -> DataFrame:
        both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        if not table.keys:
            return both
        image = F.struct(*[F.col(c) for c in both.columns if c != DAY])
        newest = both.groupBy(*table.keys).agg(F.max_by(image, F.struct(*cfg.order)).alias("_row"), F.min(DAY).alias(DAY))
        return newest.select("_row.*", DAY)

    if table.keys or cfg.catalog:
        table.rewrite(rows.select(*table.keys, DAY), merged, writer, batch, whole_parts=cfg.catalog is not None)
    else:
        table.add(rows, writer, batch)
    if cfg.catalog:
        ensure_table(spark, cfg.catalog, clean.schema, cfg.silver)
        point_partitions(spark, cfg.catalog, table)
    else:
        tidy(table)


def point_partitions(spark: SparkSession, name: str, table: VersionedTable) -> None:
    """Let each day of the catalogue table read the folder that holds its live files.

    Days change one after the other; readers that need one state of all days read the table's path (``versions.read``).
    """
    folders = {f.part[0]: f"{table.path}/{f.path.rsplit('/', 1)[0]}" for f in table.version().files}
    shown = spark.sql(f"SHOW PARTITIONS {name}").collect()  # a row for each day
    known = {r[0].split("=", 1)[1] for r in shown}
    for day, folder in sorted(folders.items()):
        spec = f"PARTITION ({DAY} = DATE '{day}')"
        if day in known:
            spark.sql(f"ALTER TABLE {name} {spec} SET LOCATION '{folder}'")
        else:
            spark.sql(f"ALTER TABLE {name} ADD {spec} LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


# Small files of one partition above which a sink gathers them.
MAX_SMALL_FILES = 32


def tidy(table: VersionedTable, most: int = MAX_SMALL_FILES) -> None:
    """Gather the small files of a table once there are more than ``most`` in a partition."""
    if table.small_files(table.version()) > most:
        table.compact()


def stream_id(batch: DataFrame, fallback: str) -> str:
    """The id of the running stream, which its checkpoint keeps; ``fallback`` outside of one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or fallback


def silver_sink(cfg: SilverStream, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """The micro-batch function of the Silver stream; the checked rows are kept for score and both writes.

    Silver and quarantine tables remember the last batch of each stream, so a batch that comes again, after a crash between
    the two writes too, adds what is missing and nothing twice.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        moment = F.current_timestamp() if now is None else now
        writer = stream_id(batch, "silver")
        checked, flags = check_batch(batch, cfg)
        checked = checked.persist()
        try:
            clean, failed = split_batch(checked, flags, moment)
            merge_batch(clean, cfg, moment, writer, batch_id)
            quarantine = VersionedTable(batch.sparkSession, cfg.quarantine)
            quarantine.add(failed.withColumn("_quarantine_batch_id", F.lit(batch_id)), writer, batch_id)
            tidy(quarantine)
        finally:
            checked.unpersist()

    return process


def start_silver_stream(
    bronze: DataFrame,
    cfg: SilverStream,
    checkpoint: str,
    available_now: bool = False,
    now: Column | None = None,
) -> StreamingQuery:
    """Bronze change stream → Silver and quarantine."""
    return start(bronze, silver_sink(cfg, now), checkpoint, f"silver_{cfg.source}_{cfg.table}", available_now)


SILVER_COLUMNS = [
    T.StructField("silver_processed_at", T.TimestampType()),
    T.StructField("silver_quality_score", T.DoubleType()),
    T.StructField("silver_validation_status", T.StringType()),
]


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str) -> None:
    """Create the Silver table if it is missing: data and metadata columns, partitioned by day."""
    known = {f.name for f in schema.fields}
    fields = [*schema.fields, *[f for f in SILVER_COLUMNS if f.name not in known], T.StructField(DAY, T.DateType())]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet PARTITIONED BY (silver_day) LOCATION '{path}'")


def stream_metrics(df: DataFrame, now: Column) -> DataFrame:
    """One row: total rows, mean quality, rows of the last hour, last update."""
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    return df.agg(
        F.count("*").alias("total_rows"),
        F.round(F.avg("silver_quality_score"), 2).alias("avg_quality_score"),
        F.count_if(F.col("silver_processed_at") >= now - hour).alias("recent_rows_1h"),
        F.max("silver_processed_at").alias("last_updated"),
    )


def drop_late_duplicates(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Option for streams with redelivery: one row per key within the allowed delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
