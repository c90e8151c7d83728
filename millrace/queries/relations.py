"""Queries over joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.stats import distinct_counts
from millrace.operators import aggregates, joins, sets, windows
from millrace.queries.registry import Tables, query

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------- joins

SEGMENT = "SELECT c_custkey AS custkey, c_mktsegment FROM customer"
# The orders of every seventh customer name one that does not exist, so both sides have rows without a partner.
PRICED = "SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS custkey, o_orderkey FROM orders"


def _sides(t: Tables):
    customer = F.when(F.col("o_custkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    left = t.orders.select(customer.alias("custkey"), "o_orderkey")
    right = t.customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return left, right


def _join(kind: str, sql_kind: str):
    @query(
        f"join_{kind}",
        f"SELECT custkey, o_orderkey, c_mktsegment FROM ({PRICED}) {sql_kind} JOIN ({SEGMENT}) USING (custkey)",
    )
    def run(t: Tables):
        left, right = _sides(t)
        return joins.join_tables(left, right, "custkey", f"join_{kind}")


for _kind, _sql in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}.items():
    _join(_kind, _sql)


@query("join_salted", f"SELECT custkey, o_orderkey, c_mktsegment FROM ({PRICED}) LEFT JOIN ({SEGMENT}) USING (custkey)")
def join_salted(t: Tables):
    return joins.salted_join(*_sides(t), ["custkey"], "left", salt=8, min_rows=10)


@query(
    "join_case_insensitive",
    """SELECT c_custkey, nation FROM (SELECT c_custkey, lower('Nation_' || c_nationkey) AS nation FROM customer) c
    JOIN (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 0) n ON lower(c.nation) = lower(n.n_name)""",
)
def join_case_insensitive(t: Tables):
    left = t.customer.select("c_custkey", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("nation"))
    names = t.nation.unionAll(t.nation.filter("n_regionkey = 0"))
    return joins.join_ci(left, names.select(F.col("n_name").alias("nation")), "nation")


@query(
    "join_multi",
    """SELECT c.c_mktsegment, o.o_orderkey, l.l_linenumber, l.l_extendedprice * (1 - l.l_discount) AS revenue
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
)
def join_multi(t: Tables):
    return joins.join_multi(
        {"c": t.customer, "o": t.orders, "l": t.lineitem},
        [
            {"left": "c.c_custkey", "right": "o.o_custkey", "type": "inner"},
            {"left": "o.o_orderkey", "right": "l.l_orderkey", "type": "left"},
        ],
        ["c.c_mktsegment", "o.o_orderkey", "l.l_linenumber", "l.l_extendedprice * (1 - l.l_discount) AS revenue"],
    )


@query("lookup_enrich", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_enrich(t: Tables):
    table = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    doubled = table.unionAll(table)
    return joins.lookup(t.orders.select("o_orderkey", "o_custkey"), doubled, "o_custkey", ["c_name", "c_mktsegment"])


@query(
    "attach_blobs",
    """WITH b AS (SELECT md5(text) AS checksum, min(doc_id) AS blob_id FROM documents GROUP BY 1)
    SELECT l.doc_id, l.quality, md5(d.text) AS checksum, b.blob_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id LEFT JOIN b ON md5(d.text) = b.checksum""",
)
def attach_blobs(t: Tables):
    sums = t.documents.select("doc_id", F.md5("text").alias("checksum"))
    meta = t.labels.select("doc_id", "quality").join(sums, "doc_id")
    blobs = sums.withColumnRenamed("doc_id", "blob_id")
    return joins.attach_blobs(meta, blobs, "checksum", ["blob_id"], ["blob_id"])


RULES_SQL = "SELECT p_brand AS rule_id, 'rule ' || p_brand AS rule_name, min(p_type) AS category FROM part GROUP BY 1"


def rules_table(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("rule_id")).agg(
        F.concat(F.lit("rule "), F.first("p_brand")).alias("rule_name"), F.min("p_type").alias("category")
    )


@query(
    "join_log_rules",
    f"SELECT rule_id, event_id, rule_name, category FROM (SELECT event_id, 'Brand#' || (user_id % 40) AS rule_id FROM events) LEFT JOIN ({RULES_SQL}) USING (rule_id)",
)
def join_log_rules(t: Tables):
    log = t.events.select("event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 40).cast("string")).alias("rule_id"))
    return joins.with_rules(log, rules_table(t))


@query(
    "semi_anti_fk",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'orphan' AS side FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'found' FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)""",
)
def semi_anti_fk(t: Tables):
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    parent = t.part.filter("p_size <= 25")
    keys = {"l_partkey": "p_partkey"}
    orphans = joins.fk_violations(child, parent, keys).withColumn("side", F.lit("orphan"))
    return orphans.unionAll(joins.fk_valid(child, parent, keys).withColumn("side", F.lit("found")))


@query("already_processed", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def already_processed(t: Tables):
    return joins.new_only(t.documents.select("doc_id", "source", "n_chars"), t.labels, "doc_id")


KNOWN = "SELECT DISTINCT sha256(text) AS content_hash FROM documents JOIN labels USING (doc_id) WHERE quality = 0"


def known_hashes(t: Tables):
    return (
        t.documents.join(t.labels.filter("quality = 0"), "doc_id", "left_semi")
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
        .distinct()
    )


@query(
    "content_dedup",
    f"SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN ({KNOWN}) GROUP BY 2",
)
def content_dedup(t: Tables):
    df = joins.content_dedup(t.documents.select("doc_id", "text"), "text", ["doc_id"], known_hashes(t))
    return df.select("doc_id", "content_hash")


@query(
    "content_dedup_counts",
    f"""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1), k AS ({KNOWN})
    SELECT CAST(sum(n) AS BIGINT) AS rows_seen, count(*) FILTER (content_hash IS NULL) AS kept,
    CAST(coalesce(sum(n - 1) FILTER (content_hash IS NULL), 0) AS BIGINT) AS copies_in_run,
    CAST(coalesce(sum(n) FILTER (content_hash IS NOT NULL), 0) AS BIGINT) AS known_before FROM g LEFT JOIN k ON h = content_hash""",
)
def content_dedup_counts(t: Tables):
    return joins.content_dedup_counts(t.documents, "text", known_hashes(t))


@query(
    "dup_columns",
    """SELECT 'o_orderkey' AS column1, 'copy_key' AS column2 WHERE (SELECT bool_and(o_orderkey = o_orderkey) FROM orders)
    UNION ALL SELECT 'o_orderkey', 'o_custkey' WHERE (SELECT bool_and(o_orderkey = o_custkey) FROM orders)
    UNION ALL SELECT 'copy_key', 'o_custkey' WHERE (SELECT bool_and(o_orderkey = o_custkey) FROM orders)""",
)
def dup_columns(t: Tables):
    return joins.identical_columns(t.orders.select("o_orderkey", F.col("o_orderkey").alias("copy_key"), "o_custkey", "o_orderstatus"))


# ---------------------------------------------------------------- aggregations


@query(
    "aggregate",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, count(*) AS n_lines, round(avg(l_discount), 6) AS avg_disc,
    max(l_quantity) AS max_l_quantity, min(l_shipdate) AS min_l_shipdate, count(DISTINCT l_orderkey) AS orders, TIMESTAMP '{NOW}' AS _gold_created_at
    FROM lineitem WHERE l_quantity >= 5 AND l_returnflag <> 'N' GROUP BY 1, 2""",
)
def aggregate(t: Tables):
    df = aggregates.aggregate(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        [
            {"column": "l_extendedprice", "function": "sum"},
            {"column": "*", "function": "count", "alias": "n_lines"},
            {"column": "l_discount", "function": "avg", "alias": "avg_disc"},
            {"column": "l_quantity", "function": "max"},
            {"column": "l_shipdate", "function": "min"},
            {"column": "l_orderkey", "function": "count_distinct", "alias": "orders"},
        ],
        [
            {"column": "l_quantity", "operator": ">=", "value": 5},
            {"column": "l_returnflag", "operator": "!=", "value": "N"},
        ],
        now(),
    )
    return df.withColumns({"sum_l_extendedprice": F.round("sum_l_extendedprice", 2), "avg_disc": F.round("avg_disc", 6)})


@query(
    "rfm_segments",
    f"""WITH r AS (SELECT o_custkey, max(o_orderdate) AS last_purchase_date, count(*) AS purchase_frequency, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders GROUP BY 1)
    SELECT o_custkey, last_purchase_date, purchase_frequency, round(s, 2) AS total_spent, round(a, 4) AS avg_order_value,
    CAST(DATE '2002-01-01' - CAST(last_purchase_date AS DATE) AS INTEGER) AS days_since_last_purchase,
    CASE WHEN s > 1000 AND purchase_frequency > 10 THEN 'VIP' WHEN s > 500 AND purchase_frequency > 5 THEN 'Premium'
      WHEN s > 100 AND purchase_frequency > 2 THEN 'Regular' ELSE 'New' END AS customer_segment, TIMESTAMP '{NOW}' AS _gold_created_at FROM r""",
)
def rfm_segments(t: Tables):
    as_of = F.lit("2002-01-01").cast("date")
    df = aggregates.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice", as_of, now())
    return df.withColumns({"total_spent": F.round("total_spent", 2), "avg_order_value": F.round("avg_order_value", 4)})


def _rollup(level: str):
    @query(
        f"time_rollup_{level}" if level != "month" else "time_rollup",
        f"SELECT CAST(date_trunc('{level}', o_orderdate) AS DATE) AS period, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    )
    def run(t: Tables):
        metrics = {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}
        return aggregates.time_rollup(t.orders, "o_orderdate", level, metrics, "o_orderstatus")


for _level in aggregates.LEVELS:
    _rollup(_level)


@query("max_watermark", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS watermark FROM orders")
def max_watermark(t: Tables):
    return aggregates.max_watermark(t.orders, "o_orderdate")


STAT_COLUMNS = ["l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_shipdate"]


@query(
    "column_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count,"
        f" CAST(round((count(*) - count({c})) * 100.0 / count(*), 2) AS DOUBLE) AS null_percentage, "
        + (f"round(avg({c}), 6)" if c not in ("l_returnflag", "l_shipdate") else "NULL::DOUBLE")
        + f" AS avg_value, {'NULL::DOUBLE' if c in ('l_returnflag', 'l_shipdate') else f'CAST(max({c}) AS DOUBLE)'} AS max_value FROM lineitem"
        for c in STAT_COLUMNS
    ),
)
def column_stats(t: Tables):
    df = aggregates.column_stats(t.lineitem.select(*STAT_COLUMNS))
    number = F.when(~F.col("column_name").isin("l_returnflag", "l_shipdate"), F.col("max_value").try_cast("double"))
    return df.withColumns({"avg_value": F.round("avg_value", 6), "max_value": number}).drop("data_type", "min_value")


ASSETS = """SELECT d.doc_id AS id, d.source, CASE d.lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'jpg' WHEN 'de' THEN 'mp3' ELSE 'mp4' END AS file_type,
 CASE l.quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' ELSE 'pending' END AS extraction_status, d.n_chars AS file_size_bytes,
 CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 500 AS INTEGER)) AS processed_at
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def assets(t: Tables):
    lang, quality = F.col("lang"), F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "source",
        F.when(lang == "en", "pdf").when(lang == "fr", "jpg").when(lang == "de", "mp3").otherwise("mp4").alias("file_type"),
        F.when(quality == 1, "success").when(quality == 0, "failed").otherwise("pending").alias("extraction_status"),
        F.col("n_chars").alias("file_size_bytes"),
        ((F.col("n_chars") % 100).cast("double") / 100).alias("confidence"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 500 AS INT))").alias("processed_at"),
    )


@query(
    "asset_stats",
    f"""SELECT CASE file_type WHEN 'pdf' THEN 'document' WHEN 'jpg' THEN 'image' WHEN 'mp3' THEN 'audio' ELSE 'video' END AS category,
    count(*) AS count, CAST(sum(file_size_bytes) AS BIGINT) AS size_bytes FROM ({ASSETS}) GROUP BY 1""",
)
def asset_stats(t: Tables):
    return aggregates.asset_stats(assets(t))


@query(
    "asset_quality",
    f"""SELECT file_type, count(*) AS total, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (extraction_status = 'failed') AS failed,
    count(*) FILTER (extraction_status = 'success') AS success, count(*) FILTER (extraction_status = 'pending') AS pending,
    round(count(*) FILTER (extraction_status = 'success') * 100.0::DOUBLE / count(*), 1) AS quality_score FROM ({ASSETS}) GROUP BY 1""",
)
def asset_quality(t: Tables):
    return aggregates.asset_quality(assets(t)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "extraction_success",
    f"""SELECT file_type, 'model-' || (id % 3) AS model, count(*) AS success_count, round(avg(confidence), 6) AS avg_confidence, min(processed_at) AS first_processed, max(processed_at) AS last_processed
    FROM ({ASSETS}) WHERE extraction_status = 'success' GROUP BY 1, 2""",
)
def extraction_success(t: Tables):
    df = assets(t).withColumn("model", F.concat(F.lit("model-"), (F.col("id") % 3).cast("string")))
    return aggregates.extraction_success(df).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "asset_aging",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'pending' END AS extraction_status,
    round(epoch(TIMESTAMP '{NOW}' - ts) / 3600, 3) AS hours_since_created FROM events WHERE event_type IN ('error', 'view')""",
)
def asset_aging(t: Tables):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("success")
    df = t.events.select("event_id", status.alias("extraction_status"), F.col("ts").alias("created_at"))
    return aggregates.asset_aging(df, now()).select(
        "event_id", "extraction_status", F.round("hours_since_created", 3).alias("hours_since_created")
    )


@query(
    "quarantine_summary",
    """SELECT 'table_' || (user_id % 5) AS source_table, 'web' AS domain, count(*) AS total_quarantined, count(*) FILTER (event_type = 'view') AS pending,
    count(*) FILTER (event_type = 'click') AS fixed, count(*) FILTER (event_type = 'purchase') AS reprocessed,
    count(*) FILTER (value > 100) AS severity_critical, count(*) FILTER (value > 50 AND value <= 100) AS severity_high, count(*) FILTER (value <= 50) AS severity_warning,
    max(ts) AS last_quarantine_date FROM events GROUP BY 1, 2""",
)
def quarantine_summary(t: Tables):
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "fixed").when(kind == "purchase", "reprocessed").otherwise("rejected")
    severity = F.when(F.col("value") > 100, "CRITICAL").when(F.col("value") > 50, "HIGH").otherwise("WARNING")
    df = t.events.select(
        F.concat(F.lit("table_"), (F.col("user_id") % 5).cast("string")).alias("source_table"),
        F.lit("web").alias("domain"),
        status.alias("resolution_status"),
        severity.alias("severity"),
        F.col("ts").alias("quarantined_at"),
    )
    return aggregates.quarantine_summary(df)


RULE_LOG = """SELECT event_id AS execution_id, 'Brand#' || (user_id % 40) AS rule_id, ts AS executed_at, value * 10 AS processing_time_ms,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows_processed, (value % 10) / 10 AS failure_rate FROM events"""


def rule_log(t: Tables):
    return t.events.select(
        F.col("event_id").alias("execution_id"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 40).cast("string")).alias("rule_id"),
        F.col("ts").alias("executed_at"),
        (F.col("value") * 10).alias("processing_time_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_processed"),
        ((F.col("value") % 10) / 10).alias("failure_rate"),
    )


@query(
    "rule_activity",
    f"""SELECT r.rule_id, rule_name, category, r.category <> 'SMALL' AS is_active, count(DISTINCT execution_id) AS total_executions, round(avg(processing_time_ms), 4) AS avg_execution_time_ms, round(avg(failure_rate), 6) AS avg_failure_rate
    FROM ({RULES_SQL}) r LEFT JOIN ({RULE_LOG}) e ON r.rule_id = e.rule_id WHERE r.category <> 'SMALL' GROUP BY ALL""",
)
def rule_activity(t: Tables):
    rules = rules_table(t).withColumn("is_active", F.col("category") != "SMALL")
    df = aggregates.rule_activity(rules, rule_log(t))
    return df.withColumns(
        {"avg_execution_time_ms": F.round("avg_execution_time_ms", 4), "avg_failure_rate": F.round("avg_failure_rate", 6)}
    )


@query(
    "rule_performance",
    f"""WITH h AS (SELECT rule_id, CAST(executed_at AS DATE) AS metric_date, CAST(hour(executed_at) AS INTEGER) AS metric_hour, avg(processing_time_ms) AS a, max(processing_time_ms) AS mx,
      min(processing_time_ms) AS mn, count(*) AS n, CAST(sum(rows_processed) AS BIGINT) AS r, avg(failure_rate) AS f FROM ({RULE_LOG}) GROUP BY 1, 2, 3),
    g AS (SELECT *, f - lag(f) OVER (PARTITION BY rule_id ORDER BY metric_date, metric_hour) AS d FROM h)
    SELECT rule_id, metric_date, metric_hour, round(a, 4) AS avg_execution_time_ms, mx AS max_execution_time_ms, mn AS min_execution_time_ms, n AS total_executions,
    r AS total_rows_processed, round(f, 6) AS avg_failure_rate, CASE WHEN d < -0.05 THEN 'improving' WHEN d > 0.05 THEN 'degrading' ELSE 'stable' END AS trend_direction FROM g""",
)
def rule_performance(t: Tables):
    df = aggregates.rule_performance(rule_log(t))
    return df.withColumns(
        {"avg_execution_time_ms": F.round("avg_execution_time_ms", 4), "avg_failure_rate": F.round("avg_failure_rate", 6)}
    )


@query(
    "run_metrics",
    """WITH l AS (SELECT 'table_' || (user_id % 37) AS table_name, CASE WHEN event_type = 'signup' THEN 'load' ELSE 'transform' END AS operation,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS executed_at, value AS duration_seconds FROM events),
    r AS (SELECT *, executed_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOURS AS fresh FROM l WHERE operation = 'transform')
    SELECT count(DISTINCT table_name) AS total_pipelines, count(DISTINCT table_name) FILTER (fresh) AS active_pipelines, count(*) FILTER (fresh) AS recent_runs,
    count(*) FILTER (fresh AND status = 'success') AS recent_success, round(avg(duration_seconds) FILTER (fresh AND status = 'success'), 4) AS avg_duration_seconds,
    round(count(*) FILTER (fresh AND status = 'success') * 100.0::DOUBLE / count(*) FILTER (fresh), 1) AS success_rate,
    count(*) FILTER (fresh AND status <> 'success') AS failed_runs FROM r""",
)
def run_metrics(t: Tables):
    log = t.events.select(
        F.concat(F.lit("table_"), (F.col("user_id") % 37).cast("string")).alias("table_name"),
        F.when(F.col("event_type") == "signup", "load").otherwise("transform").alias("operation"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").alias("executed_at"),
        F.col("value").alias("duration_seconds"),
    )
    df = aggregates.run_metrics(log, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return df.withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 4))


@query(
    "event_sequence",
    """WITH r AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT user_id, count(*) AS total_events, min(ts) AS first_event, max(ts) AS last_event FROM events GROUP BY 1)
    SELECT user_id, (rn - 1) // 50 AS part, string_agg(event_type, ',' ORDER BY rn) AS events, any_value(total_events) AS total_events,
    any_value(first_event) AS first_event, any_value(last_event) AS last_event FROM r JOIN s USING (user_id) GROUP BY 1, 2""",
)
def event_sequence(t: Tables):
    df = aggregates.event_sequence(t.events, "user_id", "ts", "event_type", "event_id", part_rows=50)
    return df.withColumn("events", F.array_join("events", ","))


@query(
    "asset_event_sequence",
    f"""WITH r AS (SELECT user_id AS id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT id, count(*) AS total_events, min(ts) AS first_event, max(ts) AS last_event FROM r GROUP BY 1)
    SELECT id, (rn - 1) // 50 AS part, string_agg(event_type, ',' ORDER BY rn) AS events, any_value(total_events) AS total_events,
    any_value(first_event) AS first_event, any_value(last_event) AS last_event, any_value(file_type) AS file_type, any_value(source) AS source FROM r JOIN s USING (id) LEFT JOIN ({ASSETS}) a USING (id) GROUP BY 1, 2""",
)
def asset_event_sequence(t: Tables):
    events = t.events.select(F.col("user_id").alias("id"), "ts", "event_type", "event_id")
    df = aggregates.asset_event_sequence(events, assets(t), "id", "ts", "event_type", "event_id", part_rows=50)
    return df.withColumn("events", F.array_join("events", ","))


@query(
    "gold_asset_metadata",
    f"""SELECT count(*) AS total_gold_assets, count(DISTINCT file_type) AS unique_file_types, count(DISTINCT source) AS unique_sources,
    min(processed_at) AS earliest_asset, max(processed_at) AS latest_asset, round(avg(confidence), 6) AS avg_confidence_score FROM ({ASSETS}) WHERE extraction_status = 'success'""",
)
def gold_asset_metadata(t: Tables):
    df = aggregates.gold_metadata(aggregates.promote(assets(t)))
    return df.withColumn("avg_confidence_score", F.round("avg_confidence_score", 6))


@query("gold_promote", f"SELECT id, source, file_type, confidence, processed_at FROM ({ASSETS}) WHERE extraction_status = 'success'")
def gold_promote(t: Tables):
    return aggregates.promote(assets(t))


@query(
    "gold_refresh",
    f"""SELECT count(*) AS total_assets, count(*) FILTER (file_type <> 'pdf') AS new_assets, TIMESTAMP '{NOW}' AS refreshed_at
    FROM ({ASSETS}) WHERE extraction_status = 'success'""",
)
def gold_refresh(t: Tables):
    gold = aggregates.promote(assets(t))
    return aggregates.refresh_report(gold, gold.filter("file_type = 'pdf'"), now())


SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey"]


@query("count_distinct_approx", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, true AS sketch_is_close FROM lineitem" for c in SKETCHED))
def count_distinct_approx(t: Tables):
    """The exact counts, and whether the sketch is within three times its stated relative error of them."""
    sketch = aggregates.distinct_fast(t.lineitem, SKETCHED, rsd=0.02)
    found = sketch.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("sketch")) for c in SKETCHED])))
    exact = distinct_counts(t.lineitem, SKETCHED)
    return exact.join(found, "column_name").select(
        "column_name", "distinct_count", (F.abs(F.col("sketch") - F.col("distinct_count")) <= 0.06 * F.col("distinct_count")).alias("sketch_is_close")
    )


# ---------------------------------------------------------------- windows


@query(
    "dedup_keyed",
    "SELECT event_id, user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def dedup_keyed(t: Tables):
    df = windows.deduplicate(t.events, "user_id, event_type", ["ts", "event_id"], "last")
    return df.select("event_id", "user_id", "event_type", "ts", "value")


@query(
    "cdc_latest",
    "SELECT user_id AS _cdc_key, event_id AS _cdc_lsn, ts AS _cdc_timestamp, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def cdc_latest(t: Tables):
    changes = t.events.select(
        F.col("user_id").alias("_cdc_key"), F.col("event_id").alias("_cdc_lsn"), F.col("ts").alias("_cdc_timestamp"), "value"
    )
    return windows.latest_changes(changes)


@query(
    "dedup_hash",
    "SELECT max(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY 2",
)
def dedup_hash(t: Tables):
    return windows.dedup_by_hash(t.documents.select("doc_id", F.md5("text").alias("h")), "h", ["doc_id"])


@query("dedup_exact", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def dedup_exact(t: Tables):
    df = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), F.lit("x").alias("_batch"))
    return windows.drop_exact(df).drop("_batch")


@query(
    "dedup_exact_count",
    "SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS rows_removed FROM documents",
)
def dedup_exact_count(t: Tables):
    texts = t.documents.select("text")
    return windows.removed_count(texts, windows.drop_exact(texts))


@query(
    "rank_functions",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER d AS rk, dense_rank() OVER d AS dr, lag(o_orderkey, 2) OVER w AS before2, lead(o_totalprice) OVER w AS next_price
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey), d AS (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC)""",
)
def rank_functions(t: Tables):
    df = windows.add_window(
        t.orders,
        ["o_orderpriority"],
        ["o_orderdate desc", "o_orderkey"],
        "rn",
        "rk",
        "dr",
        ties=1,
        shifts={"before2": ("o_orderkey", 2), "next_price": ("o_totalprice", -1)},
    )
    return df.select("o_orderkey", "rn", "rk", "dr", "before2", "next_price")


@query(
    "forward_fill",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events""",
)
def forward_fill(t: Tables):
    df = t.events.withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.forward_fill(df, "user_id", ["ts", "event_id"], "value").select("event_id", "value")


@query(
    "top_values",
    """SELECT o_custkey AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 2) AS percentage
    FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_values(t: Tables):
    return windows.top_k(t.orders, "o_custkey", 10)


@query("recent_rows", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def recent_rows(t: Tables):
    return windows.recent(t.events, ["ts", "event_id"], 20, 5, {"event_type": "click"}).select("event_id", "ts", "event_type")


@query("recent_rows_deep", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 20 OFFSET 700")
def recent_rows_deep(t: Tables):
    """A page far down, found by the time at its ends; tasks hold at most 100 rows of it."""
    return windows.recent(t.events, ["ts", "event_id"], 20, 700, held=100).select("event_id", "ts", "event_type")


# ---------------------------------------------------------------- set operations


@query(
    "union_tables",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def union_tables(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sets.union_tables(df.filter("o_orderstatus = 'F'"), [df])


@query(
    "union_by_name",
    "SELECT c_custkey AS key, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
)
def union_by_name(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return sets.union_tables(a, [b], by="name")


@query("union_distinct", "SELECT 'u' || user_id AS node, 'user' AS layer FROM events UNION SELECT event_type, 'type' FROM events")
def union_distinct(t: Tables):
    users = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), F.lit("user").alias("layer"))
    return sets.union_distinct(users, t.events.select("event_type", F.lit("type")))


OLD_LISTING = "SELECT p_brand AS table_name, p_name AS column_name, min(CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END) AS data_type FROM part WHERE p_size < 40 GROUP BY 1, 2"
NEW_LISTING = "SELECT p_brand AS table_name, p_name AS column_name, max(CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'string' END) AS data_type FROM part WHERE p_size > 3 GROUP BY 1, 2"


def listings(t: Tables):
    kind = F.when(F.col("p_size") % 2 == 0, "int").otherwise("string")
    keys = [F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name")]
    old = t.part.filter("p_size < 40").groupBy(*keys).agg(F.min(kind).alias("data_type"))
    return old, t.part.filter("p_size > 3").groupBy(*keys).agg(F.max(kind).alias("data_type"))


@query(
    "schema_diff",
    f"""WITH j AS (SELECT table_name, column_name, o.data_type AS ot, n.data_type AS nt FROM ({OLD_LISTING}) o FULL JOIN ({NEW_LISTING}) n USING (table_name, column_name)),
    g AS (SELECT table_name, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (ot IS NULL), '') AS added,
    coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (nt IS NULL), '') AS removed,
    coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (ot <> nt), '') AS changed FROM j GROUP BY 1)
    SELECT *, removed = '' AND changed = '' AS is_compatible FROM g""",
)
def schema_diff(t: Tables):
    df = sets.schema_diff(*listings(t)).drop("summary")
    return df.withColumns({c: F.array_join(c, ",") for c in ("added", "removed", "changed")})


@query(
    "schema_version",
    f"""WITH h AS (SELECT 1 AS v, table_name, md5(string_agg(column_name || ':' || data_type, '|' ORDER BY column_name || ':' || data_type)) AS h, count(*) AS c FROM ({OLD_LISTING}) GROUP BY 2),
    n AS (SELECT table_name, md5(string_agg(column_name || ':' || data_type, '|' ORDER BY column_name || ':' || data_type)) AS h, count(*) AS c FROM ({NEW_LISTING}) GROUP BY 1)
    SELECT n.table_name, n.h AS schema_hash, n.c AS column_count, CAST(CASE WHEN h.h IS NULL THEN 1 WHEN h.h = n.h THEN 1 ELSE 2 END AS INTEGER) AS version FROM n LEFT JOIN h ON h.table_name = n.table_name""",
)
def schema_version(t: Tables):
    old, new = listings(t)
    counts = t.part.groupBy(F.col("p_brand").alias("table_name")).agg(F.count("*").alias("row_count"))
    empty = t.spark.createDataFrame([], sets.CATALOG_SCHEMA)
    first = sets.register(empty, old, counts, F.lit("2024-01-01").cast("timestamp"))
    second = sets.register(first, new, counts, F.lit("2024-01-02").cast("timestamp"))
    return second.select("table_name", "schema_hash", "column_count", "version")


@query("schema_align", "SELECT s_suppkey, s_name, NULL::DATE AS since, s_acctbal FROM supplier")
def schema_align(t: Tables):
    from pyspark.sql import types as T

    target = T.StructType(
        [T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("since", T.DateType())]
    )
    return sets.align(t.supplier.select("s_acctbal", "s_name", "s_suppkey"), target)


DDL = """CASE event_type WHEN 'view' THEN 'CREATE TABLE t (id int)' WHEN 'click' THEN 'ALTER TABLE t ADD COLUMN c int' WHEN 'error' THEN 'ALTER TABLE t RENAME COLUMN a TO b'
 WHEN 'signup' THEN 'ALTER TABLE t DROP COLUMN c' ELSE 'ALTER TABLE t MODIFY COLUMN c bigint' END"""


@query(
    "ddl_changes",
    f"""SELECT event_id, 'db' AS database, 't' || user_id AS "table", {DDL} AS ddl, event_id * 1000 AS event_ms,
    CASE event_type WHEN 'view' THEN 'table_created' WHEN 'click' THEN 'column_added' WHEN 'error' THEN 'column_renamed' WHEN 'signup' THEN 'column_dropped' ELSE 'column_modified' END AS change_type FROM events""",
)
def ddl_changes(t: Tables):
    payload = F.struct(
        F.lit("db").alias("databaseName"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tableName"),
        F.expr(DDL).alias("ddl"),
        (F.col("event_id") * 1000).alias("ts_ms"),
    )
    events = t.events.select("event_id", F.to_json(F.struct(payload.alias("payload"))).alias("value"))
    return sets.classify_ddl(events).select("event_id", "database", "table", "ddl", "event_ms", "change_type")
