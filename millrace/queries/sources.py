"""Queries over sources, sinks and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import bronze
from millrace.queries.registry import Tables, query
from millrace.session import fresh_path
from millrace.sources import files, jdbc, kafka, layout, tables


@query("scan_bronze", "SELECT event_id, ts, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def scan_bronze(t: Tables):
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    df = tables.read_bronze(t.spark, t.path("events"), "incremental", "ts", cut)
    return df.select("event_id", "ts", "user_id", "value")


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_table(t: Tables):
    t.orders.createOrReplaceTempView("bronze_orders")
    df = tables.read_table(t.spark, "bronze_orders")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("scan_table_info", "SELECT 'bronze_customer' AS table_name, count(*) AS row_count, 5 AS n_columns FROM customer")
def scan_table_info(t: Tables):
    t.customer.createOrReplaceTempView("bronze_customer")
    info = tables.table_info(t.spark, "bronze_customer")
    return info.select("table_name", "row_count", F.size("columns").alias("n_columns"))


@query(
    "scan_files",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
)
def scan_files(t: Tables):
    path = fresh_path(t.spark, "csv")
    tables.write_files(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return files.read_files(t.spark, path, "csv")


@query("scan_files_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_files_json(t: Tables):
    path = fresh_path(t.spark, "json")
    tables.write_files(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "json")
    return files.read_files(t.spark, path, "jsonl")


LISTINGS = """
WITH cur AS (SELECT CAST(doc_id AS VARCHAR) AS key, md5(text) AS etag, n_chars AS size FROM documents),
prev AS (SELECT CAST(d.doc_id AS VARCHAR) AS key,
                CASE WHEN l.quality = 0 THEN 'stale' ELSE md5(d.text) END AS etag
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def _listings(t: Tables):
    cur = t.documents.select(
        F.col("doc_id").cast("string").alias("key"), F.md5("text").alias("etag"), F.col("n_chars").alias("size")
    )
    prev = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("key"),
        F.when(F.col("quality") == 0, F.lit("stale")).otherwise(F.md5("text")).alias("etag"),
    )
    return prev, cur


@query(
    "file_change_feed",
    LISTINGS
    + """SELECT cur.key, cur.etag, cur.size, CASE WHEN prev.key IS NULL THEN 'create' ELSE 'update' END AS op
    FROM cur LEFT JOIN prev ON cur.key = prev.key WHERE prev.key IS NULL OR prev.etag <> cur.etag""",
)
def file_change_feed(t: Tables):
    return files.diff_listing(*_listings(t))


@query(
    "file_change_feed_deletes",
    LISTINGS
    + """SELECT coalesce(prev.key, cur.key) AS key, prev.etag, NULL::BIGINT AS size,
        CASE WHEN prev.key IS NULL THEN 'delete' ELSE 'update' END AS op
    FROM cur LEFT JOIN prev ON cur.key = prev.key WHERE prev.key IS NULL OR prev.etag <> cur.etag""",
)
def file_change_feed_deletes(t: Tables):
    prev, cur = _listings(t)
    newer = prev.withColumn("size", F.lit(None).cast("bigint"))
    return files.diff_listing(cur, newer, emit_deletes=True)


@query(
    "quantile_bounds",
    """
WITH s AS (SELECT l_orderkey AS v, row_number() OVER (ORDER BY l_orderkey) - 1 AS pos, count(*) OVER () AS n FROM lineitem),
b AS (SELECT v, pos, n, n // 5 AS step FROM s)
SELECT CASE WHEN pos % step = 0 AND pos < step * 5 THEN CAST(pos // step AS INTEGER) ELSE 5 END AS split, v AS bound
FROM b WHERE (pos % step = 0 AND pos < step * 5) OR pos = n - 1""",
)
def quantile_bounds(t: Tables):
    return jdbc.partition_bounds(t.lineitem, "l_orderkey", 5)


TOPICS = "CASE WHEN event_type = 'view' THEN 'client.public.' || event_type || 's' WHEN event_type = 'click' THEN 'cdc_mysql.clicks' WHEN event_type = 'error' THEN 'errors' WHEN event_type = 'signup' THEN 'cdc.video.signup' ELSE 'cdc_postgres.shop.' || event_type END"


@query(
    "topic_to_table",
    f"""
WITH e AS (SELECT event_id, {TOPICS} AS topic FROM events),
p AS (SELECT *, string_split(topic, '.') AS parts FROM e
      WHERE (topic LIKE 'cdc\\_%' ESCAPE '\\' OR topic LIKE 'client.%' OR topic LIKE 'cdc.%')
        AND NOT regexp_matches(lower(topic), 'image|audio|video|document|media'))
SELECT event_id, topic,
  CASE WHEN len(parts) >= 3 THEN replace(replace(parts[1], 'cdc_', ''), 'client', 'postgres') ELSE replace(parts[1], 'cdc_', '') END AS source,
  CASE WHEN len(parts) >= 3 THEN parts[2] ELSE 'public' END AS schema,
  parts[len(parts)] AS "table",
  CASE WHEN len(parts) >= 3 THEN parts[2] || '.' || parts[3] ELSE parts[2] END AS full_name
FROM p""",
)
def topic_to_table(t: Tables):
    topics = t.events.select("event_id", F.expr(TOPICS).alias("topic"))
    return kafka.parse_topic(topics.filter(kafka.is_table_topic(F.col("topic"))))


@query(
    "table_preview",
    """SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total_rows
       FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50""",
)
def table_preview(t: Tables):
    return tables.preview(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 25, 50)


@query(
    "table_preview_deep",
    """SELECT l_returnflag, l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total_rows
       FROM lineitem ORDER BY l_returnflag, l_orderkey, l_linenumber LIMIT 25 OFFSET 3000""",
)
def table_preview_deep(t: Tables):
    """A page far down in an order whose first column has three values, so that rows are placed by a distributed sort."""
    df = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber")
    return tables.preview(df, ["l_returnflag", "l_orderkey", "l_linenumber"], 25, 3000, held=100)


@query("write_table", "SELECT o_orderkey AS id, o_orderpriority AS name FROM orders UNION ALL SELECT c_custkey, c_name FROM customer")
def write_table(t: Tables):
    name = "silver_names_" + fresh_path(t.spark, "t").rsplit("-", 1)[-1]
    path = fresh_path(t.spark, "table")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    t.spark.sql(f"CREATE TABLE {name} (id {rows.schema['id'].dataType.simpleString()}, name STRING) USING parquet LOCATION '{path}'")
    tables.write_table(rows, name, "incremental")
    tables.write_table(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), name, "incremental")
    return t.spark.table(name)


@query("write_files", "SELECT p_partkey, p_name, p_size, p_brand FROM part")
def write_files(t: Tables):
    path = fresh_path(t.spark, "parts")
    tables.write_files(t.part.select("p_partkey", "p_name", "p_size", "p_brand"), path, "parquet", ["p_brand"])
    return t.spark.read.parquet(path)


@query(
    "date_partition_cols",
    """SELECT event_id, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day FROM events""",
)
def date_partition_cols(t: Tables):
    return layout.add_partition_columns(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(
    "bronze_ingest",
    """SELECT o_orderkey, o_custkey, o_orderstatus, TIMESTAMP '2024-02-01 00:00:00' AS _ingestion_timestamp, 'erp' AS _source_system,
    'orders' AS _source_entity, 'run-1' AS _ingestion_id, 1 AS _schema_version,
    sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS _row_hash
    FROM orders""",
)
def bronze_ingest(t: Tables):
    job, _ = _ingested(t, 1)
    return tables.read_bronze(t.spark, f"{job.target}/_run=run-1")


def _ingested(t: Tables, runs: int):
    """Orders taken in once or twice; the second run has one more column. Returns the job and the catalogue rows."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    places = [fresh_path(t.spark, k) for k in ("bronze", "catalog", "profile", "lineage")]
    columns, entries = ["o_orderkey", "o_custkey", "o_orderstatus"], []
    for i in range(runs):
        job = bronze.BronzeJob("erp", "orders", f"run-{i + 1}", *places)
        entries.append(bronze.ingest(t.orders.select(*columns, *(["o_totalprice"] if i else [])), job, now))
    return job, entries


@query(
    "bronze_ingest_records",
    """SELECT v AS version, v + 2 AS column_count, (SELECT count(*) FROM orders) AS row_count, (SELECT count(*) FROM orders) AS lineage_rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS profiled_customers
    FROM (SELECT 1::BIGINT AS v UNION ALL SELECT 2)""",
)
def bronze_ingest_records(t: Tables):
    job, entries = _ingested(t, 2)
    edges = t.spark.read.parquet(job.lineage).select((F.size("columns") - 2).cast("long").alias("version"), F.col("row_count").alias("lineage_rows"))
    seen = [
        t.spark.read.parquet(f"{job.profile}/_run=run-{i}/columns").where("column_name = 'o_custkey'").select(F.lit(i).cast("long").alias("version"), F.col("unique_count").alias("profiled_customers"))
        for i in (1, 2)
    ]
    rows = entries[0].unionAll(entries[1]).select(F.col("version").cast("long").alias("version"), "column_count", "row_count")
    return rows.join(edges, "version").join(seen[0].unionAll(seen[1]), "version")


@query("multi_tenant_layout", "SELECT o_orderstatus AS tenant, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def multi_tenant_layout(t: Tables):
    path = fresh_path(t.spark, "tenants")
    layout.write_tenants(t.orders.withColumn("tenant", F.col("o_orderstatus")), path, "tenant")
    return (
        t.spark.read.parquet(path)
        .groupBy("tenant")
        .agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "batch_envelope",
    """
WITH r AS (SELECT o_orderstatus, o_orderkey, o_custkey,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, (rn - 1) // 100 + 1 AS batch_number, count(*) AS record_count,
  CAST(ceil(any_value(n) / 100.0) AS BIGINT) AS total_batches,
  string_agg('{"o_orderstatus":"' || o_orderstatus || '","o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}', '|' ORDER BY rn) AS records
FROM r GROUP BY 1, 2""",
)
def batch_envelope(t: Tables):
    rows = t.orders.select("o_orderstatus", "o_orderkey", "o_custkey")
    out = layout.to_envelopes(rows, ["o_orderstatus"], ["o_orderkey"], 100)
    return out.withColumn("records", F.array_join("records", "|"))


NAMES = "'f' || doc_id || CASE WHEN lang = 'en' THEN '.pdf' WHEN lang = 'fr' THEN '.MP3' WHEN lang = 'de' THEN '.jpg' WHEN source = 'src1' THEN '.webm' ELSE '' END"


@query(
    "file_router",
    f"""
WITH f AS (SELECT doc_id, {NAMES} AS file_name FROM documents UNION ALL
           SELECT page_id, regexp_extract(url, '([^/?#]*)/?([?#].*)?$', 1) FROM pages),
e AS (SELECT *, lower(regexp_extract(file_name, '[^/.]\\.([^./]+)$', 1)) AS ext FROM f)
SELECT doc_id, file_name,
  CASE WHEN ext = 'mp3' THEN 'audio' WHEN ext = 'webm' THEN 'video' WHEN ext = 'jpg' THEN 'images'
       WHEN ext IN ('pdf', 'html') THEN ext ELSE 'other' END AS file_type,
  CASE WHEN ext IN ('mp3', 'webm') THEN 'bronze-media-pending' ELSE 'bronze-ready' END AS destination
FROM e""",
)
def file_router(t: Tables):
    docs = t.documents.select("doc_id", F.expr(NAMES).alias("file_name"))
    pages = t.pages.select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("url", r"([^/?#]*)/?([?#].*)?$", 1).alias("file_name")
    )
    return files.route_files(docs.unionAll(pages), "file_name")


@query("write_quarantine", "SELECT rule_id, count(*) AS n_rows FROM (SELECT CASE WHEN l_discount >= 0.1 THEN 'discount' ELSE 'tax' END AS rule_id FROM lineitem WHERE l_discount >= 0.1 OR l_tax >= 0.08) GROUP BY 1")
def write_quarantine(t: Tables):
    bad = t.lineitem.filter("l_discount >= 0.1D OR l_tax >= 0.08D")
    bad = bad.withColumn("rule_id", F.expr("CASE WHEN l_discount >= 0.1D THEN 'discount' ELSE 'tax' END"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    path = layout.write_quarantine(bad, fresh_path(t.spark, "quarantine"), "job-1", now, by_rule=True)
    return t.spark.read.parquet(path).groupBy("rule_id").agg(F.count("*").alias("n_rows"))


@query("export_report", "SELECT o_orderstatus AS status, count(*) AS n_rows FROM orders GROUP BY 1")
def export_report(t: Tables):
    path = fresh_path(t.spark, "report")
    report = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_rows"))
    tables.write_report(report, path)
    return t.spark.read.schema("status string, n_rows bigint").json(path)


@query(
    "discover_tables",
    "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS source, 'o_year=' || year(o_orderdate) AS \"table\", true AS has_files FROM orders",
)
def discover_tables(t: Tables):
    path = fresh_path(t.spark, "lake")
    rows = t.orders.withColumn("o_year", F.year("o_orderdate"))
    tables.write_files(rows, path, "parquet", ["o_orderstatus", "o_year"])
    found = tables.discover_tables(t.spark, path)
    return found.select("source", "table", ((F.col("file_count") > 0) & (F.col("bytes") > 0)).alias("has_files"))


def _event_files(t: Tables) -> str:
    path = fresh_path(t.spark, "files")
    tables.write_files(t.events, path, "parquet", ["event_type"])
    return path


@query("list_files_since", "SELECT DISTINCT event_type, 'structured' AS type, true AS complete FROM events WHERE event_type LIKE '%i%'")
def list_files_since(t: Tables):
    listing = files.list_files(t.spark, _event_files(t), "2000-01-01 00:00:00", ["parquet"], "event_type=[^/]*i")
    kind = F.regexp_extract("key", "event_type=([^/]+)", 1)
    complete = F.bool_and((F.col("size") > 0) & (F.length("etag") == 32))
    return listing.groupBy(kind.alias("event_type"), "type").agg(complete.alias("complete"))


@query("media_inventory", "SELECT DISTINCT event_type, 'parquet' AS extension, 'other' AS media_type FROM events")
def media_inventory(t: Tables):
    found = files.media_inventory(t.spark, _event_files(t)).filter("extension = 'parquet'")
    return found.select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type"), "extension", "media_type").distinct()


@query("watermark_store", "SELECT 'events' AS name, max(event_id)::VARCHAR AS watermark FROM events UNION ALL SELECT 'orders', max(o_orderkey)::VARCHAR FROM orders")
def watermark_store(t: Tables):
    import datetime as dt

    from millrace.streaming.watermarks import Watermarks

    marks, now = Watermarks(t.spark, fresh_path(t.spark, "marks")), dt.datetime(2024, 2, 1)
    marks.set("events", "0", dt.datetime(2024, 1, 1))
    marks.advance("events", t.events, "event_id", now)
    marks.advance("orders", t.orders, "o_orderkey", now)
    return marks.table().select("name", "watermark")


@query(
    "profile_stored",
    """SELECT 'o_orderkey' AS column_name, 2 * count(*) AS row_count, 2 * count(*) - 2 * count(o_orderkey) AS null_count, min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high, true AS distinct_is_close, true AS median_is_close FROM orders
    UNION ALL SELECT 'o_custkey', 2 * count(*), 2 * count(*) - 2 * count(o_custkey), min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, true, true FROM orders
    UNION ALL SELECT 'o_orderstatus', 2 * count(*), 2 * count(*) - 2 * count(o_orderstatus), NULL, NULL, true, NULL FROM orders
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), true, true FROM orders""",
)
def profile_stored(t: Tables):
    """The profile of all runs of an entity, added up from what each run has left; sketched figures against exact ones."""
    job, _ = _ingested(t, 2)
    found = bronze.profile(t.spark, job)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    middles = {c: F.percentile_approx(c, 0.5, 100_000).cast("double") for c in columns if c != "o_orderstatus"}
    spans = {c: (F.max(c) - F.min(c)).cast("double") for c in middles}
    exact = t.orders.select(*columns).agg(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n"), middles.get(c, F.lit(None)).cast("double").alias("middle"), spans.get(c, F.lit(None)).cast("double").alias("span")) for c in columns]).alias("e")
    ).select(F.inline("e"))
    near = F.abs(F.col("distinct_count") - F.col("n")) <= 0.03 * F.col("n")
    return found.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "low", "high", near.alias("distinct_is_close"), (F.abs(F.col("median") - F.col("middle")) <= 0.05 * F.col("span")).alias("median_is_close")
    )
