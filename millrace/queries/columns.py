"""Queries over projections, filters and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import columns as op
from millrace.queries.registry import Tables, query

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("select_columns", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def select_columns(t: Tables):
    return op.select_columns(t.orders, ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query(
    "filter_expr",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 30 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag <> 'N'",
)
def filter_expr(t: Tables):
    df = op.filter_expr(t.lineitem, "l_quantity > 30 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag <> 'N'")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_triples",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P' AND o_custkey < 700",
)
def filter_triples(t: Tables):
    rules = [
        {"column": "o_totalprice", "operator": ">=", "value": 100000},
        {"column": "o_orderstatus", "operator": "!=", "value": "P"},
        {"column": "o_custkey", "operator": "<", "value": 700},
    ]
    return op.filter_triples(t.orders, rules).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("filter_equals", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'ECONOMY' AND p_size = 11")
def filter_equals(t: Tables):
    return op.filter_equals(t.part, {"p_type": "ECONOMY", "p_size": 11}).select("p_partkey", "p_name", "p_type")


@query("filter_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%wid%' OR lower(p_brand) LIKE '%wid%'")
def filter_search(t: Tables):
    return op.search(t.part, ["p_name", "p_brand"], "WID").select("p_partkey", "p_name")


RAW = "CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END"


@query(
    "cast_types",
    f"""SELECT event_id, TRY_CAST({RAW} AS INTEGER) AS k_int, TRY_CAST({RAW} AS DOUBLE) AS k_double,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""",
)
def cast_types(t: Tables):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    day = F.when(F.col("event_id") % 5 == 0, F.lit("someday")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    df = t.events.select("event_id", raw.alias("k_int"), raw.alias("k_double"), day.alias("day"))
    return op.cast_types(df, {"k_int": "integer", "k_double": "double", "day": "date", "not_there": "long"})


@query(
    "cdc_type_cast",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS amount,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS transaction_date FROM events""",
)
def cdc_type_cast(t: Tables):
    e = F.col("event_id")
    df = t.events.select(
        "event_id",
        F.when(e % 9 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(e % 4 == 0, F.lit("soon"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("transaction_date"),
    )
    out = op.cdc_type_cast(df, "shop_transactions")
    return out.withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))


@query(
    "normalize_columns",
    """SELECT c_custkey, lower(c_name) AS c_name, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment,
        round(c_acctbal, 1) AS c_acctbal, '+60' || c_custkey AS phone FROM customer""",
)
def normalize_columns(t: Tables):
    df = t.customer.select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name").alias("c_name"),
        "c_mktsegment",
        "c_acctbal",
        F.concat(F.lit("(+60) - "), F.col("c_custkey").cast("string")).alias("phone"),
    )
    return op.normalize(
        df,
        {
            "c_name": {"type": "lowercase", "trim": True},
            "c_mktsegment": {"type": "titlecase"},
            "c_acctbal": {"type": "round", "decimals": 1},
            "phone": {"type": "phone_format"},
        },
    )


@query("trim_strings", "SELECT doc_id, trim(text, ' ') AS text, lang || '' AS lang FROM documents")
def trim_strings(t: Tables):
    df = t.documents.select(
        "doc_id", "text", F.concat(F.lit(" "), F.col("lang"), F.lit("  ")).alias("lang")
    )
    return op.trim_strings(df)


@query(
    "standardize_auto",
    """SELECT event_id, trim(event_type) AS event_type, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS value,
        CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, date_trunc('second', ts) AS event_time FROM events""",
)
def standardize_auto(t: Tables):
    hole = F.col("event_id") % 10 == 0
    df = t.events.select(
        "event_id",
        F.concat(F.lit(" "), "event_type").alias("event_type"),
        F.when(~hole, F.col("value")).alias("value"),
        F.when(~hole, F.col("user_id")).alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    )
    out = op.standardize(df)
    return out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query(
    "standardize_typed",
    """SELECT c_custkey, '+60' || substr(CAST(1000000000 + c_custkey AS VARCHAR), 2) AS mobile,
        lower(c_name) || '@x.com' AS email, CAST(round(c_acctbal, 2) AS DOUBLE) AS amount,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE strftime(DATE '2020-01-01' + CAST(c_custkey % 900 AS INTEGER), '%Y-%m-%d') END AS created_at
        FROM customer""",
)
def standardize_typed(t: Tables):
    key = F.col("c_custkey")
    df = t.customer.select(
        "c_custkey",
        F.concat_ws("-", F.substring((key + 1000000000).cast("string"), 1, 3), F.substring((key + 1000000000).cast("string"), 4, 7)).alias("mobile"),
        F.concat(F.lit(" "), "c_name", F.lit("@X.com ")).alias("email"),
        F.col("c_acctbal").cast("string").alias("amount"),
        F.when(key % 3 == 0, F.lit("unknown"))
        .otherwise(F.concat(F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")).cast("string"), F.lit(" 10:30:00")))
        .alias("created_at"),
    )
    out = op.standardize_typed(df, ["created_at"], ["mobile"], ["email"], ["amount"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "add_silver_metadata",
    f"""SELECT o_orderkey, o_orderstatus, o_custkey, 'erp' AS _source_system, 'orders' AS _entity_name,
        TIMESTAMP '{NOW}' AS _ingestion_timestamp, 'job-1' AS _job_id,
        md5(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || '||' || coalesce(length(o_orderstatus) || ':' || o_orderstatus, '\\N') || '||' || length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey) AS _record_hash
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_custkey FROM orders)""",
)
def add_silver_metadata(t: Tables):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")
    return op.add_silver_metadata(t.orders.select("o_orderkey", status, "o_custkey"), "erp", "orders", "job-1", now())


@query(
    "row_hash",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS _row_hash FROM orders""",
)
def row_hash(t: Tables):
    return op.row_hash(t.orders, ["o_orderkey", "o_orderstatus", "o_custkey"]).select("o_orderkey", "_row_hash")


@query(
    "drop_technical_columns",
    f"SELECT o_orderkey, o_orderstatus, true AS _silver_quality_passed, TIMESTAMP '{NOW}' AS _gold_processed_at, 97.5::DOUBLE AS _quality_score FROM orders",
)
def drop_technical_columns(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus").withColumns(
        {"_bronze_path": F.lit("x"), "_silver_job": F.lit("y"), "_silver_quality_passed": F.lit(True)}
    )
    return op.to_gold(df, 97.5, now())


@query(
    "flatten_nested",
    """SELECT event_id, user_id AS actor_id, event_type AS actor_action_type, value AS actor_action_value,
        '["' || event_type || '","' || user_id || '"]' AS tags FROM events""",
)
def flatten_nested(t: Tables):
    action = F.struct(F.col("event_type").alias("type"), F.col("value").alias("value"))
    df = t.events.select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), action.alias("action")).alias("actor"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
    )
    return op.flatten(df)


@query("flatten_json_keys", "SELECT event_id, json_extract_string(props, '$.k') AS props_k, NULL::VARCHAR AS props_missing FROM events")
def flatten_json_keys(t: Tables):
    return op.flatten_json(t.events.select("event_id", "props"), {"props": ["k", "missing"]}, keep=False)


@query(
    "sanitize_complex",
    """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS info,
        '["' || o_orderpriority || '"]' AS tags, round(o_totalprice, 2)::DOUBLE AS price FROM orders""",
)
def sanitize_complex(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("info"),
        F.array("o_orderpriority").alias("tags"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("price"),
    )
    return op.sanitize(df)


@query(
    "custom_sql",
    "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal FROM customer WHERE c_acctbal > 0 GROUP BY 1",
)
def custom_sql(t: Tables):
    sql = "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal FROM input WHERE c_acctbal > 0 GROUP BY 1"
    return op.apply_sql(t.customer, sql)


ADHOC = """SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, o.o_orderstatus"""


@query("sql_query", ADHOC)
def sql_query(t: Tables):
    return op.run_query(t.spark, ADHOC, {"orders": t.orders, "customer": t.path("customer")})


TEMPLATES = {
    "query_templates": ("check_duplicates", "orders", "o_custkey", "o_orderdate"),
    "query_template_nulls": ("check_nulls", "orders", "o_custkey", "o_orderdate"),
    "query_template_dates": ("date_range", "orders", "*", "o_orderdate"),
    "query_template_values": ("value_distribution", "orders", "o_orderstatus", "o_orderdate"),
    "query_template_count": ("row_count", "lineitem", "*", "l_shipdate"),
    "query_template_stats": ("statistics", "part", "p_size", "p_partkey"),
}


def _template(name: str, template: str, table: str, column: str, order: str):
    sql = op.query_template(template, table, column, order)

    @query(name, sql)
    def run(t: Tables):
        return op.run_query(t.spark, sql, {table: getattr(t, table)}, limit=None)


for _name, _args in TEMPLATES.items():
    _template(_name, *_args)


@query(
    "mask_columns",
    """SELECT c_custkey, sha256(c_name) AS c_name, '[REDACTED]' AS c_mktsegment,
        repeat('*', greatest(len(phone) - 4, 0)) || right(phone, 4) AS phone
        FROM (SELECT c_custkey, c_name, c_mktsegment, CAST(60000000000 + c_custkey * 7919 AS VARCHAR) AS phone FROM customer)""",
)
def mask_columns(t: Tables):
    phone = (F.lit(60000000000) + F.col("c_custkey") * 7919).cast("string")
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment", phone.alias("phone"))
    return op.mask_columns(df, {"c_name": "hash", "c_mktsegment": "redact", "phone": "partial"})


@query("mask_encrypt", "SELECT s_suppkey, s_name FROM supplier")
def mask_encrypt(t: Tables):
    key = F.lit("0123456789abcdef")
    hidden = op.mask_columns(t.supplier.select("s_suppkey", "s_name"), {"s_name": "encrypt"}, key)
    return hidden.withColumn("s_name", F.aes_decrypt(F.unbase64("s_name"), key).cast("string"))
