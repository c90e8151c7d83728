"""Queries over lineage, audit, text and media tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lineage as L, media, text as X
from millrace.queries.registry import Tables, query
from millrace.queries.relations import ASSETS, assets
from millrace.session import fresh_path
from millrace.sources import versions
from millrace.streaming import gold

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def moment(value: str):
    return F.lit(value).cast("timestamp_ntz")


# ---------------------------------------------------------------- lineage and audit

EDGES = """SELECT 'bronze' AS source_layer, 'c.' || o_custkey AS source_table, 'silver' AS target_layer, 'o.' || o_orderkey AS target_table, 'load' AS transformation_type, o_orderdate AS created_at FROM orders
UNION ALL SELECT 'silver', 'o.' || l_orderkey, 'silver', 'p.' || l_partkey, 'clean', l_shipdate FROM lineitem
UNION ALL SELECT 'silver', 'p.' || l_partkey, 'gold', 's.' || l_suppkey, 'aggregate', l_shipdate FROM lineitem"""


def edges(t: Tables):
    def name(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    a = t.orders.select(
        F.lit("bronze").alias("source_layer"), name("c.", "o_custkey").alias("source_table"),
        F.lit("silver").alias("target_layer"), name("o.", "o_orderkey").alias("target_table"),
        F.lit("load").alias("transformation_type"), F.col("o_orderdate").alias("created_at"),
    )
    b = t.lineitem.select(
        F.lit("silver"), name("o.", "l_orderkey"), F.lit("silver"), name("p.", "l_partkey"), F.lit("clean"), "l_shipdate"
    )
    c = t.lineitem.select(
        F.lit("silver"), name("p.", "l_partkey"), F.lit("gold"), name("s.", "l_suppkey"), F.lit("aggregate"), "l_shipdate"
    )
    return a.unionAll(b).unionAll(c)


def _closure(start: str, near: str, far: str, depth: int | None = None) -> str:
    if depth is None:  # all that can be reached
        return f"""WITH RECURSIVE e AS (SELECT DISTINCT source_table, target_table FROM ({EDGES})), r AS (
          SELECT '{start}' AS t UNION SELECT e.{far} FROM r JOIN e ON e.{near} = r.t) SELECT t AS table_name FROM r WHERE t <> '{start}'"""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT source_table, target_table FROM ({EDGES})), r AS (
      SELECT '{start}' AS t, 0 AS d UNION SELECT e.{far}, r.d + 1 FROM r JOIN e ON e.{near} = r.t WHERE r.d < {depth})
    SELECT t AS table_name, CAST(min(d) AS INTEGER) AS depth FROM r WHERE t <> '{start}' GROUP BY 1"""


@query("lineage_downstream", _closure("c.7", "source_table", "target_table", 3))
def lineage_downstream(t: Tables):
    return L.lineage(edges(t), "c.7", "downstream", 3)


@query("lineage_upstream", _closure("p.3", "target_table", "source_table", 3))
def lineage_upstream(t: Tables):
    return L.lineage(edges(t), "p.3", "upstream", 3)


@query(
    "lineage_impact",
    f"""WITH u AS ({_closure('o.5', 'target_table', 'source_table')}), d AS ({_closure('o.5', 'source_table', 'target_table')})
    SELECT 'o.5' AS table_name, (SELECT count(*) FROM u) AS total_upstream, (SELECT count(*) FROM d) AS total_downstream,
    CASE WHEN (SELECT count(*) FROM d) > 5 THEN 'high' WHEN (SELECT count(*) FROM d) > 0 THEN 'medium' ELSE 'low' END AS risk_level""",
)
def lineage_impact(t: Tables):
    return L.impact(edges(t), "o.5")


@query("lineage_graph", f"SELECT source_table, target_table, transformation_type, count(*) AS transformation_count FROM ({EDGES}) GROUP BY 1, 2, 3")
def lineage_graph(t: Tables):
    return L.graph_edges(edges(t))


@query(
    "lineage_graph_nodes",
    f"""WITH e AS ({EDGES}), n AS (SELECT source_table AS table_name, source_layer AS layer, 0 AS n FROM e UNION ALL SELECT target_table, target_layer, 1 FROM e)
    SELECT table_name, min(layer) AS layer, CAST(sum(n) AS BIGINT) AS transformation_count, split_part(table_name, '.', 2) AS name FROM n GROUP BY 1""",
)
def lineage_graph_nodes(t: Tables):
    return L.graph_nodes(edges(t))


@query("lineage_layer_totals", f"WITH e AS ({EDGES}) SELECT layer, count(*) AS table_count FROM (SELECT source_layer AS layer, source_table FROM e UNION SELECT target_layer, target_table FROM e) GROUP BY 1")
def lineage_layer_totals(t: Tables):
    return L.layer_totals(edges(t))


@query(
    "lineage_summary",
    f"""SELECT source_layer, target_layer, count(*) AS transformation_count, count(DISTINCT source_table) AS unique_sources, count(DISTINCT target_table) AS unique_targets,
    min(created_at) AS first_seen, max(created_at) AS last_seen FROM ({EDGES}) WHERE created_at >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""",
)
def lineage_summary(t: Tables):
    return L.lineage_summary(edges(t), moment("1997-01-01"))


@query("lineage_trail", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def lineage_trail(t: Tables):
    return L.trail(t.events, "user_id", 7, "ts", "event_id").select("event_id", "ts", "event_type", "value")


@query("record_lineage", "SELECT 'bronze' AS source_layer, 'orders' AS source_table, 'silver' AS target_layer, 'orders_clean' AS target_table, count(*) AS row_count, true AS is_valid FROM orders")
def record_lineage(t: Tables):
    path = fresh_path(t.spark, "lineage")
    rows = t.orders.count()
    L.record_lineage(
        t.spark,
        path,
        {
            "source_layer": "bronze", "source_table": "orders", "target_layer": "silver", "target_table": "orders_clean",
            "transformation_type": "clean", "row_count": rows, "columns": t.orders.columns,
        },
    )
    stored = t.spark.read.schema(L.EDGE_SCHEMA).parquet(path)
    return stored.select("source_layer", "source_table", "target_layer", "target_table", "row_count", "is_valid")


AUDIT = """SELECT event_id, ts AS event_timestamp, CASE WHEN user_id % 3 = 0 THEN 'cdc' ELSE 'validation' END AS event_category, event_type,
 CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, 't' || (user_id % 9) AS table_name FROM events"""


def audit_rows(t: Tables):
    return t.events.select(
        "event_id",
        F.col("ts").alias("event_timestamp"),
        F.when(F.col("user_id") % 3 == 0, "cdc").otherwise("validation").alias("event_category"),
        "event_type",
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.concat(F.lit("t"), (F.col("user_id") % 9).cast("string")).alias("table_name"),
    )


@query(
    "history_by_day",
    f"""WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1),
    b AS (SELECT CAST(event_timestamp AS DATE) AS day, count(*) AS n, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'failure') AS f FROM ({AUDIT}) WHERE event_timestamp >= TIMESTAMP '2024-01-05' GROUP BY 1)
    SELECT day, coalesce(a.n, 0) AS lineage_count, coalesce(b.n, 0) AS audit_count, coalesce(s, 0) AS success_count, coalesce(f, 0) AS failure_count FROM a FULL JOIN b USING (day)""",
)
def history_by_day(t: Tables):
    return L.history_by_day(t.events.select(F.col("ts").alias("created_at")), audit_rows(t), moment("2024-01-05"))


@query(
    "history_by_layers",
    f"""SELECT CAST(created_at AS DATE) AS day, source_layer, target_layer, count(*) AS transformation_count, count(DISTINCT batch_id) AS batch_count
    FROM (SELECT *, source_table AS batch_id, transformation_type <> 'join' OR target_table NOT LIKE '%7' AS is_valid FROM ({EDGES})) WHERE is_valid AND created_at >= TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3""",
)
def history_by_layers(t: Tables):
    good = (F.col("transformation_type") != "join") | ~F.col("target_table").endswith("7")
    return L.lineage_history(edges(t).withColumns({"batch_id": F.col("source_table"), "is_valid": good}), moment("1997-01-01"))


@query(
    "history_by_category",
    f"""SELECT CAST(event_timestamp AS DATE) AS day, event_category, count(*) AS event_count, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'failure') AS failure_count
    FROM ({AUDIT}) WHERE event_timestamp >= TIMESTAMP '2024-01-05' GROUP BY 1, 2""",
)
def history_by_category(t: Tables):
    return L.audit_history(audit_rows(t), moment("2024-01-05"))


@query(
    "job_statistics",
    """SELECT o_orderpriority AS job_type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, count(*) AS job_count, CAST(sum(o_custkey) AS BIGINT) AS total_rows,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100 END), 4) AS avg_duration_seconds FROM orders GROUP BY 1, 2""",
)
def job_statistics(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = t.orders.select(F.col("o_orderpriority").alias("job_type"), status.alias("status"), F.col("o_custkey").alias("rows"), (F.col("o_totalprice") / 100).alias("duration_seconds"))
    return L.job_statistics(jobs).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 4))


@query(
    "combined_report",
    f"""WITH e AS (SELECT * FROM ({EDGES}) WHERE created_at >= TIMESTAMP '1997-01-01')
    SELECT 'layers' AS section, source_layer || ' -> ' || target_layer AS name, CAST(count(*) AS VARCHAR) AS value FROM e GROUP BY source_layer, target_layer
    UNION ALL SELECT 'audit', event_category || ' ' || status, CAST(count(*) AS VARCHAR) FROM ({AUDIT}) WHERE event_timestamp >= TIMESTAMP '1997-01-01' GROUP BY event_category, status
    UNION ALL SELECT 'tables', layer, CAST(count(*) AS VARCHAR) FROM (SELECT source_layer AS layer, source_table FROM e UNION SELECT target_layer, target_table FROM e) GROUP BY layer
    UNION ALL SELECT 'latest', source_table || ' -> ' || target_table, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM (SELECT * FROM e ORDER BY created_at DESC, source_table, target_table LIMIT 10)""",
)
def combined_report(t: Tables):
    return L.combined_report(edges(t), audit_rows(t), moment("1997-01-01"))


@query(
    "audit_summary",
    f"SELECT event_category, count(*) AS total_events, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'failure') AS failure_count FROM ({AUDIT}) WHERE event_timestamp >= TIMESTAMP '2024-01-10' GROUP BY 1",
)
def audit_summary(t: Tables):
    return L.audit_summary(audit_rows(t), moment("2024-01-10"))


@query(
    "audit_query",
    f"SELECT event_id, event_timestamp, event_type, status FROM ({AUDIT}) WHERE event_category = 'cdc' AND event_type LIKE '%i%' AND event_timestamp >= TIMESTAMP '2024-01-03' ",
)
def audit_query(t: Tables):
    df = L.audit(audit_rows(t), "cdc", "%i%", moment("2024-01-03"))
    return df.select("event_id", "event_timestamp", "event_type", "status")


@query(
    "quality_trend",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS measurements, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_score, min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS min_score,
    max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS max_score FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND event_type <> 'error' GROUP BY 1""",
)
def quality_trend(t: Tables):
    metadata = F.when(F.col("event_type") != "error", F.col("props"))
    rows = t.events.select(F.col("ts").alias("created_at"), metadata.alias("metadata"))
    return L.quality_trend(rows, moment("2024-01-08"), "$.k").withColumn("avg_score", F.round("avg_score", 6))


@query(
    "table_report",
    f"""WITH e AS ({EDGES}) SELECT 'p.3' AS table_name, count(*) FILTER (target_table = 'p.3') AS upstream_edges, count(*) FILTER (source_table = 'p.3') AS downstream_edges,
    count(DISTINCT source_table) FILTER (target_table = 'p.3') AS upstream_tables, count(DISTINCT target_table) FILTER (source_table = 'p.3') AS downstream_tables, max(created_at) AS last_change,
    (SELECT count(*) FROM events WHERE user_id = 3) AS audit_rows FROM e WHERE source_table = 'p.3' OR target_table = 'p.3'""",
)
def table_report(t: Tables):
    audits = t.events.select(F.concat(F.lit("p."), F.col("user_id").cast("string")).alias("table_name"))
    return L.table_report(edges(t), audits, "p.3")


@query(
    "ingestion_report",
    """WITH j AS (SELECT source, CASE WHEN source IN ('src1', 'src2') THEN 'FAILED' WHEN source = 'src3' THEN 'SKIPPED' ELSE 'SUCCESS' END AS status, count(*) AS r, count(DISTINCT lang) AS f, sum(n_chars) AS b FROM documents GROUP BY 1)
    SELECT count(*) AS total_jobs, count(*) FILTER (status = 'SUCCESS') AS successful_jobs, count(*) FILTER (status = 'FAILED') AS failed_jobs, count(*) FILTER (status = 'SKIPPED') AS skipped_jobs,
    CAST(sum(r) AS BIGINT) AS total_rows, CAST(sum(f) AS BIGINT) AS total_files, CAST(sum(b) AS BIGINT) AS total_bytes, round(sum(b)::DOUBLE / 1048576, 6) AS total_size_mb FROM j""",
)
def ingestion_report(t: Tables):
    s = F.col("source")
    jobs = t.documents.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_distinct("lang").alias("files"), F.sum("n_chars").alias("bytes")
    )
    jobs = jobs.withColumn("status", F.when(s.isin("src1", "src2"), "FAILED").when(s == "src3", "SKIPPED").otherwise("SUCCESS"))
    return L.ingestion_report(jobs).withColumn("total_size_mb", F.round("total_size_mb", 6))


@query(
    "event_gold_refresh",
    f"""WITH a AS ({ASSETS}) SELECT e.user_id AS asset_id, CASE WHEN e.event_type = 'error' THEN 'silver_failed' ELSE 'silver_processed' END AS event_type,
    CASE WHEN e.event_type = 'view' THEN 'base' ELSE e.event_type END AS model_used, CASE WHEN e.value > 30 THEN a.confidence ELSE e.value / 100 END AS quality_score,
    '{{"file_type":"' || a.file_type || '","source":"' || a.source || '","status":"' || CASE WHEN e.event_type = 'error' THEN 'failed' ELSE 'success' END || '"}}' AS metadata
    FROM events e JOIN a ON e.user_id = a.id""",
)
def event_gold_refresh(t: Tables):
    known = assets(t).withColumn("model", F.lit("base"))
    return L.lineage_from_events(completed(t), known, now()).select("asset_id", "event_type", "model_used", "quality_score", "metadata")


def completed(t: Tables):
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("asset_id"),
        "event_id",
        F.when(kind == "error", "failed").otherwise("success").alias("status"),
        F.when(kind != "view", kind).alias("ai_model_used"),
        F.when(F.col("value") <= 30, F.col("value") / 100).alias("ai_confidence_score"),
    )


@query(
    "event_gold_stream",
    f"""WITH a AS ({ASSETS}), l AS (SELECT e.user_id AS asset_id, CASE WHEN e.event_type = 'error' THEN 'silver_failed' ELSE 'silver_processed' END AS event_type,
    CASE WHEN e.event_type = 'view' THEN 'base' ELSE e.event_type END AS model_used, CASE WHEN e.value > 30 THEN a.confidence ELSE e.value / 100 END AS quality_score
    FROM events e JOIN a ON e.user_id = a.id)
    SELECT l.*, (SELECT count(*) FROM l) // 10 AS refreshes, (SELECT count(*) FROM a WHERE extraction_status = 'success') AS gold_assets FROM l""",
)
def event_gold_stream(t: Tables):
    """Two parts of the events, each a micro-batch; the lineage events, the refreshes they made due, and the Gold rows."""
    source, checkpoint = fresh_path(t.spark, "completed"), fresh_path(t.spark, "chk")
    known = assets(t).withColumn("model", F.lit("base"))
    cfg = gold.GoldStream(lambda: known, *[fresh_path(t.spark, n) for n in ("gold_lineage", "gold", "refreshes")])
    for part in range(2):  # each run finds the files of one more part and takes them as one batch
        completed(t).filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(completed(t).schema).parquet(source)
        gold.start_gold_stream(stream, cfg, checkpoint, available_now=True, now=now()).awaitTermination()
    rows = versions.read(t.spark, cfg.lineage).select("asset_id", "event_type", "model_used", "quality_score")
    refreshes = versions.VersionedTable(t.spark, cfg.gold).version().counts.get("refreshes", 0)
    gold_rows = versions.read(t.spark, cfg.gold).agg(F.count("*")).scalar()
    return rows.withColumns({"refreshes": F.lit(refreshes).cast("long"), "gold_assets": gold_rows})


# ---------------------------------------------------------------- text

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "text_metrics",
    """SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS word_count,
    CAST(length(text) AS INTEGER) AS char_count, md5(text) AS text_content FROM documents""",
)
def text_metrics(t: Tables):
    df = X.text_metrics(t.documents.select("doc_id", "text"), "text").drop("text")
    return df.withColumn("text_content", F.md5("text_content"))


def _keyword_sql(keep: str, extra: str) -> str:
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM x WHERE {keep} GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rk FROM c)
    SELECT doc_id, word, n AS count, CAST(rk AS INTEGER) AS rank{extra} FROM r WHERE rk <= 10"""


@query("keywords", _keyword_sql(f"length(word) > 3 AND word NOT IN {sql_list(X.SHORT_STOP_WORDS)}", ""))
def keywords(t: Tables):
    return X.keywords(t.documents, "doc_id", "text", 10)


@query(
    "keyword_relevance",
    _keyword_sql(
        f"regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN {sql_list(X.LONG_STOP_WORDS)}",
        ", floor(60 + n * 40.0::DOUBLE / max(n) OVER (PARTITION BY doc_id) + 0.5) / 100.0 AS relevance",
    ),
)
def keyword_relevance(t: Tables):
    return X.keyword_relevance(t.documents, "doc_id", "text", 10)


MOOD = f"""SELECT *, (p - n)::DOUBLE / greatest(p + n, 1) AS s FROM (SELECT *, len(list_filter({WORDS}, lambda w: w IN {sql_list(X.POSITIVE_WORDS)})) AS p, len(list_filter({WORDS}, lambda w: w IN {sql_list(X.NEGATIVE_WORDS)})) AS n FROM {{table}})"""
LABEL = "CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END"
CHEERED = "SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Great, thank you! Sorry.' WHEN doc_id % 3 = 1 THEN ' An error: lost and broken.' ELSE '' END AS text FROM documents"


def cheered(t: Tables):
    tail = F.when(F.col("doc_id") % 3 == 0, " Great, thank you! Sorry.").when(F.col("doc_id") % 3 == 1, " An error: lost and broken.").otherwise("")
    return t.documents.select("doc_id", F.concat("text", tail).alias("text"))


@query(
    "sentiment_lexicon",
    f"""SELECT doc_id, {LABEL} AS sentiment, floor(CASE WHEN s > 0.3 THEN least(95.0, 65 + s * 30) WHEN s < -0.3 THEN greatest(5.0, 35 + s * 30) ELSE 50 + s * 15 END + 0.5) / 100.0 AS sentiment_score
    FROM ({MOOD.replace('{table}', '(' + CHEERED + ')')})""",
)
def sentiment_lexicon(t: Tables):
    return X.sentiment(cheered(t), "text").select("doc_id", "sentiment", "sentiment_score")


@query("language_heuristic", "SELECT doc_id, CASE WHEN strlen(text) > length(text) THEN 'non-english' ELSE 'en' END AS language FROM documents")
def language_heuristic(t: Tables):
    return X.language(t.documents, "text").select("doc_id", "language")


NOTED = "SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' Paid $1,250.00 on 12/31/2023, see INV-20231-.' WHEN doc_id % 4 = 1 THEN ' Due March 3, 2024 for ticket#A77x9.' ELSE '' END AS text FROM documents"


def noted(t: Tables):
    key = F.col("doc_id") % 4
    tail = F.when(key == 0, " Paid $1,250.00 on 12/31/2023, see INV-20231-.").when(key == 1, " Due March 3, 2024 for ticket#A77x9.").otherwise("")
    return t.documents.select("doc_id", F.concat("text", tail).alias("text"))


_B, _A = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
FIELD_SQL = {
    "Date": _B + r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[\p{L}\p{N}_]+ \d{1,2},? \d{4})" + _A,
    "Amount": r"(\$[\d,]+(?:\.\d{2})?)",
    "Reference Number": _B + r"((?i:INV|ORDER|REF|CASE|TICKET)[#\-]?[\p{L}\p{N}_\-]{3,}[\p{L}\p{N}_])" + _A,
    "Email": r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
}


@query(
    "entity_extract",
    f"WITH n AS ({NOTED}) "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS field, regexp_extract(text, '{p}', 1) AS value, 0.75::DOUBLE AS confidence FROM n WHERE regexp_matches(text, '{p}')"
        for name, p in FIELD_SQL.items()
    ),
)
def entity_extract(t: Tables):
    return X.extract_fields(noted(t), "doc_id", "text")


@query(
    "summary_sentences",
    r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS p FROM documents)
    SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], ' ') ELSE text END AS summary FROM s""",
)
def summary_sentences(t: Tables):
    return X.summarise(t.documents, "text").select("doc_id", "summary")


@query(
    "speaker_stats",
    f"""WITH m AS (SELECT conv_id, role, {LABEL} AS mood, len(regexp_extract_all(text, '\\S+')) AS w FROM ({MOOD.replace('{table}', 'conversations')})),
    g AS (SELECT conv_id, role, mood, count(*) AS n, sum(w) AS w FROM m GROUP BY 1, 2, 3),
    p AS (SELECT conv_id, role, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(w) AS BIGINT) AS words, arg_min(mood, (-n, mood)) AS sentiment FROM g GROUP BY 1, 2)
    SELECT *, round(words * 100.0::DOUBLE / sum(words) OVER (PARTITION BY conv_id), 1) AS talk_share FROM p""",
)
def speaker_stats(t: Tables):
    return X.speaker_stats(t.conversations, "conv_id", "role", "text")


def _pii(kind: str) -> str:
    return X.PII_PATTERNS[kind]


@query(
    "pii_check",
    "SELECT doc_id, "
    + ", ".join(f"regexp_matches(text, '{p}') AS has_{k}" for k, p in X.PII_PATTERNS.items())
    + ", " + " OR ".join(f"regexp_matches(text, '{p}')" for p in X.PII_PATTERNS.values()) + " AS has_pii FROM documents",
)
def pii_check(t: Tables):
    return X.pii_flags(t.documents, "text").select("doc_id", "has_ssn", "has_credit_card", "has_passport", "has_pii")


@query(
    "pii_redact",
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{ssn}', '[SSN]', 'g'), '{credit_card}', '[CREDIT_CARD]', 'g'), '{passport}', '[PASSPORT]', 'g')) AS redacted FROM documents"
    .replace("{ssn}", _pii("ssn")).replace("{credit_card}", _pii("credit_card")).replace("{passport}", _pii("passport")),
)
def pii_redact(t: Tables):
    return X.redact(t.documents, "text").select("doc_id", F.md5("text").alias("redacted"))


@query(
    "chunk_text",
    "WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 1024 + 1, 1024) AS chunk_text FROM c",
)
def chunk_text(t: Tables):
    return X.chunk(t.documents, "doc_id", "text")


@query(
    "chunk_text_overlap",
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 900 + 1, 1000) AS chunk_text FROM c""",
)
def chunk_text_overlap(t: Tables):
    return X.chunk(t.documents, "doc_id", "text", 1000, 100)


# ---------------------------------------------------------------- media

NO_PII = " AND ".join(f"NOT regexp_matches(text, '{p}')" for p in X.PII_PATTERNS.values())


def _media_sql(rows: list[tuple[str, str]], table: str, media_type: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{media_type}' AS media_type, '{k}' AS rule_key, count(*) AS total, count(*) FILTER ({c}) AS passed, count(*) FILTER (NOT ({c})) AS failed, round(count(*) FILTER ({c}) * 100.0::DOUBLE / count(*), 1) AS pass_rate FROM {table}"
        for k, c in rows
    )


@query(
    "media_quality_rules",
    _media_sql(
        [
            ("min_resolution", "n_chars % 3000 >= 1280 AND n_chars % 1500 >= 720"),
            ("max_file_size_mb", "n_chars * 100000 <= 52428800"),
            ("format_whitelist", "lang IN ('en', 'fr')"),
        ],
        "documents",
        "image",
    ),
)
def media_quality_rules(t: Tables):
    chars = F.col("n_chars")
    df = t.documents.select(
        (chars % 3000).alias("width"),
        (chars % 1500).alias("height"),
        (chars * 100000).alias("size_bytes"),
        F.when(F.col("lang") == "en", "PNG").when(F.col("lang") == "fr", "jpeg").otherwise("gif").alias("extension"),
    )
    return media.media_quality(df, "image").drop("severity")


@query(
    "media_quality_documents",
    _media_sql([("min_text_length", "length(text) >= 50"), ("pii_redacted", NO_PII), ("language_detected", "lang <> 'es'")], "documents", "document"),
)
def media_quality_documents(t: Tables):
    df = t.documents.select(F.col("text").alias("extracted_text"), F.when(F.col("lang") != "es", F.col("lang")).alias("language"))
    return media.media_quality(df, "document").drop("severity")


@query("text_rule_min_length", "SELECT doc_id, length(text) >= 50 AS document_ok, length(text) >= 10 AS text_ok FROM documents")
def text_rule_min_length(t: Tables):
    col = F.col("text")
    return t.documents.select(
        "doc_id", media.min_length(col, "document").alias("document_ok"), media.min_length(col, "text").alias("text_ok")
    )
