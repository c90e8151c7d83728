"""Queries over change data capture, streaming jobs, step lists and Bronze to Silver."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from millrace.functions.scalars import md5_of
from millrace.operators.rules import rule
from millrace.plans import presets, silver as plan, steps
from millrace.queries.registry import Tables, query
from millrace.session import fresh_path
from millrace.sources import layout, tables, versions
from millrace.streaming import cdc, monitor, silver

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def operation(kind: str = "event_type"):
    k = F.col(kind)
    return F.when(k == "signup", "c").when(k == "view", "r").when(k == "error", "d").otherwise("u")


OPERATION = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END"


def flat_messages(t: Tables):
    body = F.struct(
        F.col("user_id").alias("id"),
        F.col("value"),
        operation().alias("__op"),
        (F.col("event_id") * 1000).alias("__source_ts_ms"),
        F.lit("shop").alias("__source_db"),
        F.concat(F.lit("table_"), (F.col("user_id") % 4).cast("string")).alias("__source_table"),
    )
    return t.events.select(F.to_json(body).alias("value"), F.col("event_id").alias("offset"))


@query(
    "parse_cdc_flat",
    f"SELECT {OPERATION} AS operation, event_id * 1000 AS source_ts_ms, 'shop' AS source_db, 'table_' || (user_id % 4) AS source_table, event_id AS \"offset\" FROM events",
)
def parse_cdc_flat(t: Tables):
    return cdc.parse_cdc(flat_messages(t)).drop("record")


@query(
    "cdc_columns",
    f"SELECT CAST(user_id AS VARCHAR) AS id, value, {OPERATION} AS _cdc_operation, event_id AS _kafka_offset, epoch_ms(event_id * 1000) AS _cdc_timestamp FROM events",
)
def cdc_columns(t: Tables):
    wide = cdc.expand_record(cdc.parse_cdc(flat_messages(t)))
    return wide.withColumns({"value": F.col("value").cast("double"), "_cdc_timestamp": F.col("_cdc_timestamp").cast("timestamp_ntz")})


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())])


@query(
    "parse_cdc_envelope",
    f"""SELECT event_id, user_id AS id, value, {OPERATION} AS _cdc_operation, event_type = 'error' AS _deleted, CASE WHEN event_type = 'error' THEN TIMESTAMP '{NOW}' END AS _deleted_at
    FROM events WHERE event_type <> 'click'""",
)
def parse_cdc_envelope(t: Tables):
    kind = F.col("event_type")
    row = F.struct(F.col("user_id").alias("id"), "value")
    body = F.struct(
        F.when(kind == "click", "x").otherwise(operation()).alias("op"),
        F.when(kind == "error", row).alias("before"),
        F.when(kind != "error", row).alias("after"),
    )
    return cdc.unwrap_cdc(t.events.select("event_id", F.to_json(body).alias("value")), ROW, now=now())


@query(
    "normalize_ops",
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'u' WHEN 'error' THEN 'd' WHEN 'click' THEN 'r' END AS code FROM events",
)
def normalize_ops(t: Tables):
    k = F.col("event_type")
    word = F.when(k == "signup", "INSERT").when(k == "view", "replace").when(k == "error", " Delete").when(k == "click", "r").otherwise("truncate")
    return t.events.select("event_id", cdc.normalize_op(word).alias("code"))


@query(
    "explode_envelope",
    """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
    SELECT o_orderstatus AS file_key, (rn - 1) // 64 + 1 AS batch_number, CAST((rn - 1) % 64 AS INTEGER) AS record_id,
    '{"o_orderstatus":"' || o_orderstatus || '","o_orderkey":' || o_orderkey || '}' AS raw_document, 2024 AS year, 1 AS month, 15 AS day FROM r""",
)
def explode_envelope(t: Tables):
    packed = layout.to_envelopes(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 64)
    message = F.struct(
        F.col("o_orderstatus").alias("file_key"), "batch_number", "total_batches", "record_count", "records",
        F.lit("2024-01-15 08:00:00").alias("extracted_at"),
    )
    rows = cdc.explode_envelope(packed.select(F.to_json(message).alias("value")))
    return rows.select("file_key", "batch_number", "record_id", "raw_document", "year", "month", "day")


CHANGES = f"SELECT CASE WHEN value > 50 THEN user_id ELSE -user_id - 1 END AS o_orderkey, value AS o_totalprice, event_type AS o_orderstatus, event_id AS lsn, {OPERATION} AS op FROM events"


def order_changes(t: Tables):
    key = F.when(F.col("value") > 50, F.col("user_id")).otherwise(-F.col("user_id") - 1)
    return t.events.select(
        key.alias("o_orderkey"),
        F.col("value").alias("o_totalprice"),
        F.col("event_type").alias("o_orderstatus"),
        F.col("event_id").alias("lsn"),
        operation().alias("_cdc_operation"),
    )


@query(
    "cdc_merge",
    f"""WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders), c AS ({CHANGES}),
    d AS (SELECT o_orderkey, max(lsn) AS del FROM c WHERE op = 'd' GROUP BY 1),
    l AS (SELECT c.*, del FROM c LEFT JOIN d USING (o_orderkey) WHERE del IS NULL OR lsn >= del),
    n AS (SELECT o_orderkey AS k, bool_or(del IS NOT NULL) AS deleted, min(lsn) FILTER (op IN ('c', 'r')) AS ins, max(lsn) FILTER (op IN ('u', 'r')) AS upd FROM l GROUP BY 1),
    j AS (SELECT *, o_orderkey IS NOT NULL AND NOT coalesce(deleted, false) AS in_place FROM t FULL JOIN n ON o_orderkey = k),
    w AS (SELECT *, CASE WHEN in_place THEN upd WHEN ins IS NOT NULL THEN greatest(ins, coalesce(upd, ins)) END AS win FROM j WHERE in_place OR ins IS NOT NULL)
    SELECT coalesce(w.o_orderkey, k) AS o_orderkey, CASE WHEN win IS NULL THEN w.o_totalprice ELSE c.o_totalprice END AS o_totalprice,
    CASE WHEN win IS NULL THEN w.o_orderstatus ELSE c.o_orderstatus END AS o_orderstatus, o_custkey FROM w LEFT JOIN c ON c.lsn = win""",
)
def cdc_merge(t: Tables):
    target = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    return cdc.apply_changes(target, order_changes(t), ["o_orderkey"], ["lsn"], "snapshot")


@query(
    "cdc_merge_upsert",
    f"""WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders), n AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, op FROM ({CHANGES}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC) = 1)
    SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN o_totalprice ELSE price END AS o_totalprice, CASE WHEN k IS NULL THEN o_orderstatus ELSE status END AS o_orderstatus
    FROM t FULL JOIN n ON o_orderkey = k WHERE op IS NULL OR op <> 'd'""",
)
def cdc_merge_upsert(t: Tables):
    target = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return cdc.apply_changes(target, order_changes(t), ["o_orderkey"], ["lsn"], "upsert")


NARROW = "o_orderkey BETWEEN 100 AND 160"


@query(
    "cdc_merge_files",
    f"""WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders), c AS (SELECT * FROM ({CHANGES}) WHERE {NARROW}),
    d AS (SELECT o_orderkey, max(lsn) AS del FROM c WHERE op = 'd' GROUP BY 1),
    l AS (SELECT c.*, del FROM c LEFT JOIN d USING (o_orderkey) WHERE del IS NULL OR lsn >= del),
    n AS (SELECT o_orderkey AS k, bool_or(del IS NOT NULL) AS deleted, min(lsn) FILTER (op IN ('c', 'r')) AS ins, max(lsn) FILTER (op IN ('u', 'r')) AS upd FROM l GROUP BY 1),
    j AS (SELECT *, o_orderkey IS NOT NULL AND NOT coalesce(deleted, false) AS in_place FROM t FULL JOIN n ON o_orderkey = k),
    w AS (SELECT *, CASE WHEN in_place THEN upd WHEN ins IS NOT NULL THEN greatest(ins, coalesce(upd, ins)) END AS win FROM j WHERE in_place OR ins IS NOT NULL)
    SELECT coalesce(w.o_orderkey, k) AS o_orderkey, CASE WHEN win IS NULL THEN w.o_totalprice ELSE c.o_totalprice END AS o_totalprice,
    CASE WHEN win IS NULL THEN w.o_orderstatus ELSE c.o_orderstatus END AS o_orderstatus, o_custkey FROM w LEFT JOIN c ON c.lsn = win""",
)
def cdc_merge_files(t: Tables):
    """All orders in a stored table, then the changes of a narrow range of keys."""
    target = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    rows = target.count()
    table = versions.VersionedTable(t.spark, fresh_path(t.spark, "merged"), ["o_orderkey"], file_rows=min(versions.FILE_ROWS, max(1, rows // 16)))
    table.add(target, rows=rows)
    cdc.merge_into(table, order_changes(t).filter(NARROW), ["lsn"])
    return table.read()


def _events_stream(t: Tables):
    return silver.stream_table(t.spark, t.dir, t.events.schema, pattern="events.parquet")


@query("table_stream_source", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def table_stream_source(t: Tables):
    out = fresh_path(t.spark, "stream")
    run = silver.start(
        _events_stream(t), lambda df, i: silver.write_batch(df, out, i), fresh_path(t.spark, "chk"), "bronze_events", True
    )
    run.awaitTermination()
    rows = t.spark.read.parquet(out)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("route_tables", "SELECT 'shop' AS source_db, 'table_' || (user_id % 4) AS source_table, count(*) AS n, max(event_id) AS last_offset FROM events GROUP BY 1, 2")
def route_tables(t: Tables):
    out, errors = fresh_path(t.spark, "routed"), fresh_path(t.spark, "errors")
    stream = _events_stream(t)
    body = F.struct(
        F.col("value"), operation().alias("__op"), F.lit("shop").alias("__source_db"),
        F.concat(F.lit("table_"), (F.col("user_id") % 4).cast("string")).alias("__source_table"),
    )
    messages = stream.select(F.to_json(body).alias("value"), F.col("event_id").alias("offset"))
    run = silver.start(cdc.parse_cdc(messages), silver.route_batch(out, errors), fresh_path(t.spark, "chk"), "routing", True)
    run.awaitTermination()
    rows = versions.read(t.spark, out)
    return rows.groupBy("source_db", "source_table").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


BATCHES = 3
# The newest change of each key in each batch; what of it is clean is merged.
SILVERED = f"""SELECT * FROM (SELECT event_id % {BATCHES} AS batch, user_id AS _cdc_key, event_id AS _cdc_lsn, ts AS _cdc_timestamp, event_type, CASE WHEN event_type = 'error' THEN -value ELSE value END AS amount FROM events)
 QUALIFY row_number() OVER (PARTITION BY batch, _cdc_key ORDER BY _cdc_timestamp DESC, _cdc_lsn DESC) = 1"""


def _silver_run(t: Tables):
    source, checkpoint = fresh_path(t.spark, "events"), fresh_path(t.spark, "chk")
    cfg = silver.SilverStream("shop", "transactions", fresh_path(t.spark, "silver"), fresh_path(t.spark, "quarantine"))
    runs = []
    for part in range(BATCHES):  # each run finds the files of one more part and takes them as one batch
        t.events.filter(F.col("event_id") % BATCHES == part).write.mode("append").parquet(source)
        runs.append(_silver_batch(t, source, checkpoint, cfg))
    return cfg, runs


def _silver_batch(t: Tables, source: str, checkpoint: str, cfg: silver.SilverStream):
    stream = silver.stream_table(t.spark, source, t.events.schema).select(
        F.col("user_id").alias("_cdc_key"),
        F.col("event_id").alias("_cdc_lsn"),
        F.col("ts").alias("_cdc_timestamp"),
        F.concat(F.col("event_type"), F.lit(" ")).alias("event_type"),
        F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).cast("string").alias("amount"),
    )
    run = silver.start_silver_stream(stream, cfg, checkpoint, available_now=True, now=now())
    run.awaitTermination()
    return run


@query(
    "silver_stream",
    f"""WITH s AS ({SILVERED}), q AS (SELECT batch, count(*) FILTER (amount >= 0) * 100.0::DOUBLE / count(*) AS score FROM s GROUP BY 1)
    SELECT _cdc_key, _cdc_lsn, event_type, amount, round(score, 6) AS silver_quality_score, 'passed' AS silver_validation_status, TIMESTAMP '{NOW}' AS silver_processed_at
    FROM s JOIN q USING (batch) WHERE amount >= 0 QUALIFY row_number() OVER (PARTITION BY _cdc_key ORDER BY _cdc_timestamp DESC, _cdc_lsn DESC) = 1""",
)
def silver_stream(t: Tables):
    cfg, _ = _silver_run(t)
    df = versions.read(t.spark, cfg.silver).withColumn("silver_quality_score", F.round("silver_quality_score", 6))
    return df.select("_cdc_key", "_cdc_lsn", "event_type", "amount", "silver_quality_score", "silver_validation_status", "silver_processed_at")


@query("stream_quarantine", f"SELECT _cdc_key, _cdc_lsn, amount, true AS _dq_negative_amount, CAST(batch AS INTEGER) AS _quarantine_batch_id, TIMESTAMP '{NOW}' AS _quarantine_timestamp FROM ({SILVERED}) WHERE amount < 0")
def stream_quarantine(t: Tables):
    cfg, _ = _silver_run(t)
    df = versions.read(t.spark, cfg.quarantine)
    return df.select("_cdc_key", "_cdc_lsn", "amount", "_dq_negative_amount", "_quarantine_batch_id", "_quarantine_timestamp")


@query(
    "stream_table_init",
    "SELECT s_suppkey, s_name, DATE '2024-02-01' AS silver_day, 100.0::DOUBLE AS silver_quality_score FROM supplier",
)
def stream_table_init(t: Tables):
    path = fresh_path(t.spark, "init")
    name = "silver_supplier_" + path.rsplit("-", 1)[-1]
    cfg = silver.SilverStream("shop", "suppliers", path, fresh_path(t.spark, "quarantine"), "s_suppkey", ["s_version"], catalog=name)
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp")
    for version in range(2):  # both versions of each row end up as one
        batch = t.supplier.select("s_suppkey", "s_name", F.lit(version).alias("s_version"))
        silver.silver_sink(cfg, moment)(batch, version)
    return t.spark.table(name).select("s_suppkey", "s_name", "silver_day", "silver_quality_score")


@query(
    "stream_metrics",
    "SELECT count(*) AS total_rows, round(avg(value), 2) AS avg_quality_score, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR) AS recent_rows_1h, max(ts) AS last_updated FROM events",
)
def stream_metrics(t: Tables):
    df = t.events.select(F.col("value").alias("silver_quality_score"), F.col("ts").alias("silver_processed_at"))
    return silver.stream_metrics(df, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("stream_monitor", "SELECT 'silver_shop_transactions' AS query, count(*) AS input_rows FROM events")
def stream_monitor(t: Tables):
    _, runs = _silver_run(t)
    rows = monitor.recent_progress(t.spark, runs)
    return rows.groupBy("query").agg(F.sum("input_rows").alias("input_rows"))


# ---------------------------------------------------------------- step lists and Bronze to Silver


@query(
    "step_chain",
    """SELECT o_orderpriority, count(*) AS count FROM (SELECT * FROM orders JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) USING (o_custkey)
    WHERE sqrt(o_totalprice) > 300 AND c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def step_chain(t: Tables):
    return steps.run_steps(
        t.orders,
        [
            {"operation": "join_inner", "params": {"right": "customer", "on": "o_custkey"}},
            {"operation": "sqrt_transform", "params": {"columns": "o_totalprice"}},
            {"operation": "filter", "params": {"condition": "o_totalprice > 300 AND c_mktsegment = 'BUILDING'"}},
            {"operation": "round_values", "params": {"columns": "o_totalprice"}, "enabled": False},
            {"operation": "drop_duplicates", "params": {"columns": "o_orderkey"}},
            {"operation": "group_count", "params": {"group_by": "o_orderpriority"}},
        ],
        {"customer": t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")},
    )


@query(
    "step_chain_metrics",
    "SELECT count(*) AS input_rows, count(*) FILTER (o_orderstatus <> 'P') AS output_rows, 7 AS output_columns, 2 AS steps_run FROM orders",
)
def step_chain_metrics(t: Tables):
    chain = [
        {"operation": "filter", "params": {"condition": "o_orderstatus <> 'P'"}},
        {"operation": "normalize", "params": {"columns": "o_totalprice"}},
    ]
    return steps.step_metrics(t.orders, steps.run_steps(t.orders, chain), chain)


@query(
    "cleaning_plan_transactions",
    """WITH x AS (SELECT * FROM (SELECT event_id AS transaction_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 20 = 3 THEN -value ELSE value END AS amount, 'USD' AS currency FROM events)
      WHERE amount IS NOT NULL AND amount >= 0)
    SELECT transaction_id, round(amount, 2) AS amount, currency FROM x""",
)
def cleaning_plan_transactions(t: Tables):
    e = F.col("event_id")
    amount = F.when(e % 20 == 3, -F.col("value")).when(e % 10 != 0, F.col("value"))
    df = t.events.select(e.alias("transaction_id"), amount.alias("amount"), F.lit(" usd ").alias("currency"), "ts")
    return presets.run_plan(df.unionAll(df), "transaction_data_cleaning", ["ts"]).valid.select("transaction_id", "amount", "currency")


@query(
    "cleaning_plan_users",
    """SELECT lower(replace(c_name, '#', '.')) || '@mail.example.com' AS email, 'Ann Lee' AS name, '+60123456789' AS phone, max(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 20 <> 0 GROUP BY 1""",
)
def cleaning_plan_users(t: Tables):
    local = F.regexp_replace("c_name", "#", ".")
    email = F.when(F.col("c_custkey") % 20 == 0, local).otherwise(F.concat(local, F.lit("@Mail.example.com")))
    df = t.customer.select("c_custkey", email.alias("email"), F.lit("ann LEE").alias("name"), F.lit("+60 12-345 6789").alias("phone"))
    return presets.run_plan(df, "user_data_cleaning", ["c_custkey"]).valid.select("email", "name", "phone", "c_custkey")


def _silver_job(t: Tables) -> plan.SilverJob:
    bronze = fresh_path(t.spark, "bronze")
    copies = t.orders.unionAll(t.orders.filter("o_orderstatus = 'F'"))
    tables.write_files(copies, bronze)
    return plan.SilverJob(
        source=bronze,
        target=fresh_path(t.spark, "silver"),
        quarantine=fresh_path(t.spark, "quarantine"),
        job_id="job-1",
        source_system="erp",
        entity="orders",
        rules=[
            rule("not_null", "o_custkey"),
            rule("range", "o_totalprice", action="quarantine", max=400_000),
            rule("enum", "o_orderpriority", action="warn", severity="warning", values=["1-URGENT"]),
        ],
        sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, lower(o_orderpriority) AS o_orderpriority FROM input",
        watermark_col="o_orderdate",
        mode="incremental",
        watermark_value=F.lit("1996-01-01").cast("timestamp_ntz"),
    )


@query(
    "silver_batch",
    """SELECT DISTINCT o_orderkey, o_totalprice, lower(o_orderpriority) AS o_orderpriority, 'orders' AS _entity_name, 'job-1' AS _job_id,
    md5(o_orderkey || '||' || o_orderstatus || '||' || lower(o_orderpriority)) AS check_hash FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_totalprice <= 400000""",
)
def silver_batch(t: Tables):
    job = _silver_job(t)
    plan.bronze_to_silver(t.spark, job, now())
    df = t.spark.read.parquet(job.target)
    df = df.withColumn("check_hash", md5_of(["o_orderkey", "o_orderstatus", "o_orderpriority"], null_safe=False))
    return df.select("o_orderkey", "o_totalprice", "o_orderpriority", "_entity_name", "_job_id", "check_hash")


@query(
    "silver_batch_report",
    """SELECT 'job-1' AS job_id, 'orders' AS entity, count(*) FILTER (o_totalprice <= 400000) AS silver_rows,
    CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) FILTER (o_totalprice > 400000), 0) AS BIGINT) AS quarantined_rows, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS watermark
    FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'""",
)
def silver_batch_report(t: Tables):
    return plan.bronze_to_silver(t.spark, _silver_job(t), now())
