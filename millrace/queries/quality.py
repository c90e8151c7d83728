"""Queries over data-quality rules, quarantine, validation and cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators import cleaning, quarantine, rules as R, sketches
from millrace.queries.registry import Tables, query
from millrace.queries.catalogue import HOLED, holed
from millrace.session import fresh_path
from millrace.sources.versions import VersionedTable

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _violations(name: str, source: Callable[[Tables], DataFrame], make: Callable[[Tables], R.Rule], ids: list[str], sql: str):
    """Register a query that returns the rows breaking one rule."""

    @query(name, sql)
    def run(t: Tables):
        marked = R.mark(source(t), [make(t)])
        return marked.filter(F.size(R.VIOLATIONS) > 0).select(*ids, F.element_at(R.VIOLATIONS, 1).alias("rule_id"))


EMAILS = "SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN replace(c_name, '#', '@') ELSE replace(c_name, '#', '.') || '@mail.example.com' END AS email, CASE WHEN c_custkey % 6 = 0 THEN '12-34' ELSE '+60 (12) 345-' || CAST(100000 + c_custkey AS VARCHAR) END AS phone FROM customer"


def contacts(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    bad = F.regexp_replace("c_name", "#", "@")
    good = F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@mail.example.com"))
    phone = F.concat(F.lit("+60 (12) 345-"), (key + 100000).cast("string"))
    return t.customer.select(
        "c_custkey",
        F.when(key % 20 == 0, bad).otherwise(good).alias("email"),
        F.when(key % 6 == 0, F.lit("12-34")).otherwise(phone).alias("phone"),
    )


_violations(
    "rule_not_null", holed, lambda t: R.rule("not_null", "value"), ["event_id"],
    f"SELECT event_id, 'not_null_value' AS rule_id FROM ({HOLED}) WHERE value IS NULL",
)
_violations(
    "rule_email", contacts, lambda t: R.rule("email", "email"), ["c_custkey"],
    f"SELECT c_custkey, 'email_email' AS rule_id FROM ({EMAILS}) WHERE NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')",
)
_violations(
    "rule_phone", contacts, lambda t: R.rule("phone", "phone"), ["c_custkey"],
    f"SELECT c_custkey, 'phone_phone' AS rule_id FROM ({EMAILS}) WHERE NOT regexp_matches(regexp_replace(phone, '[^0-9+]', '', 'g'), '^\\+?[0-9]{{10,15}}$')",
)
_violations(
    "rule_range", lambda t: t.lineitem, lambda t: R.rule("range", "l_quantity", min=5, max=45), ["l_orderkey", "l_linenumber"],
    "SELECT l_orderkey, l_linenumber, 'range_l_quantity' AS rule_id FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45",
)
_violations(
    "rule_length", lambda t: t.part, lambda t: R.rule("length", "p_name", min=8, max=11), ["p_partkey"],
    "SELECT p_partkey, 'length_p_name' AS rule_id FROM part WHERE length(p_name) NOT BETWEEN 8 AND 11",
)
_violations(
    "rule_regex", lambda t: t.customer, lambda t: R.rule("regex", "c_name", pattern="[1-5]$"), ["c_custkey"],
    "SELECT c_custkey, 'regex_c_name' AS rule_id FROM customer WHERE NOT regexp_matches(c_name, '[1-5]$')",
)
_violations(
    "rule_enum", lambda t: t.orders, lambda t: R.rule("enum", "o_orderstatus", values=["F", "O"]), ["o_orderkey"],
    "SELECT o_orderkey, 'enum_o_orderstatus' AS rule_id FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
)
_violations(
    "rule_sql", lambda t: t.lineitem, lambda t: R.rule("sql", name="cheap", expr="l_extendedprice * (1 - l_discount) < 50000"), ["l_orderkey", "l_linenumber"],
    "SELECT l_orderkey, l_linenumber, 'cheap' AS rule_id FROM lineitem WHERE NOT (l_extendedprice * (1 - l_discount) < 50000)",
)
_violations(
    "rule_unique", lambda t: t.lineitem, lambda t: R.rule("unique", columns=["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber", "l_partkey"],
    "SELECT l_orderkey, l_linenumber, l_partkey, 'unique_l_orderkey_l_linenumber' AS rule_id FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1",
)
_violations(
    "rule_foreign_key", lambda t: t.lineitem,
    lambda t: R.rule("foreign_key", "l_partkey", parent=t.part.filter("p_size < 40"), keys={"l_partkey": "p_partkey"}),
    ["l_orderkey", "l_linenumber"],
    "SELECT l_orderkey, l_linenumber, 'foreign_key_l_partkey' AS rule_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
)
_violations(
    "rule_cross_column",
    lambda t: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")),
    lambda t: R.rule("cross_column", name="ordered_before_shipped", expr="o_orderdate <= l_shipdate"), ["l_orderkey", "l_linenumber"],
    "SELECT l_orderkey, l_linenumber, 'ordered_before_shipped' AS rule_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate",
)
_violations(
    "rule_data_type",
    lambda t: t.events.withColumn("raw", F.when(F.col("event_id") % 11 == 0, "many").otherwise(F.get_json_object("props", "$.k"))),
    lambda t: R.rule("data_type", "raw", type="integer"), ["event_id"],
    "SELECT event_id, 'data_type_raw' AS rule_id FROM events WHERE event_id % 11 = 0",
)
_violations(
    "rule_not_empty",
    lambda t: t.part.withColumn("p_name", F.regexp_replace("p_name", "^[a-z]+ widget$", "  ")),
    lambda t: R.rule("not_empty", "p_name"), ["p_partkey"],
    "SELECT p_partkey, 'not_empty_p_name' AS rule_id FROM part WHERE regexp_matches(p_name, '^[a-z]+ widget$')",
)
_violations(
    "rule_not_future", lambda t: t.orders, lambda t: R.rule("not_future", "o_orderdate", as_of=F.lit("2000-06-01").cast("timestamp_ntz")), ["o_orderkey"],
    "SELECT o_orderkey, 'not_future_o_orderdate' AS rule_id FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'",
)
_violations(
    "rule_anomaly", lambda t: t.events, lambda t: R.rule("anomaly", "value"), ["event_id"],
    """SELECT event_id, 'anomaly_value' AS rule_id FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
_violations(
    "rule_custom", lambda t: t.part,
    lambda t: R.rule("custom", name="priced_by_size", fn=lambda df: df["p_retailprice"] > df["p_size"] * 19.5), ["p_partkey"],
    "SELECT p_partkey, 'priced_by_size' AS rule_id FROM part WHERE NOT (p_retailprice > p_size * 19.5)",
)


@query(
    "rule_cross_table",
    """SELECT 'orders_have_lines' AS rule_id, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS left_value, CAST((SELECT count(DISTINCT l_orderkey) FROM lineitem) AS DOUBLE) AS right_value,
    CAST(abs((SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS DOUBLE) AS difference,
    abs((SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) <= 10 AS passed""",
)
def rule_cross_table(t: Tables):
    return R.cross_table(
        "orders_have_lines",
        t.orders.agg(F.count("*").alias("n")),
        t.lineitem.agg(F.count_distinct("l_orderkey").alias("n")),
        tolerance=10,
    )


@query(
    "rule_drift",
    """WITH a AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-16'), b AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE ts < TIMESTAMP '2024-01-16')
    SELECT 'value' AS column_name, round(a.v, 6) AS mean, round(b.v, 6) AS base_mean, round(abs((a.v - b.v) / b.v), 6) AS mean_change, abs((a.v - b.v) / b.v) > 0.01 AS drifted FROM a, b
    UNION ALL SELECT 'user_id', round(a.u, 6), round(b.u, 6), round(abs((a.u - b.u) / b.u), 6), abs((a.u - b.u) / b.u) > 0.01 FROM a, b""",
)
def rule_drift(t: Tables):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    df = R.drift(t.events.filter(F.col("ts") >= cut), t.events.filter(F.col("ts") < cut), ["value", "user_id"], 0.01)
    return df.select(
        "column_name", *[F.round(c, 6).alias(c) for c in ("mean", "base_mean", "mean_change")], "drifted"
    )


@query(
    "rule_drift_stored",
    """WITH a AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-16'), b AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE ts < TIMESTAMP '2024-01-16'),
    l AS (SELECT quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS xs FROM events WHERE ts < TIMESTAMP '2024-01-16'), q AS (SELECT unnest(xs) AS x, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS p FROM l),
    k AS (SELECT max(abs((SELECT avg((value <= x)::INT) FROM events WHERE ts >= TIMESTAMP '2024-01-16') - p)) AS far FROM q)
    SELECT 'value' AS column_name, round(a.v, 4) AS mean, round(b.v, 4) AS base_mean, round(abs((a.v - b.v) / b.v), 4) AS mean_change, abs((a.v - b.v) / b.v) > 0.01 OR far > 0.2 AS drifted, true AS shape_is_close FROM a, b, k
    UNION ALL SELECT 'user_id', round(a.u, 4), round(b.u, 4), round(abs((a.u - b.u) / b.u), 4), abs((a.u - b.u) / b.u) > 0.01, true FROM a, b""",
)
def rule_drift_stored(t: Tables):
    """Profiles stored for each day of events; both periods are compared without reading an event again."""
    stored = VersionedTable(t.spark, fresh_path(t.spark, "profiles"))
    by_day = t.events.withColumn("day", F.to_date("ts"))
    stored.add(sketches.sketch(by_day, ["value", "user_id"], by=["day"]))
    old = F.col("day") < F.lit("2024-01-16").cast("date")
    found = sketches.drift(stored.read().filter(~old), stored.read().filter(old), 0.01, 0.2)
    return found.select(
        "column_name", *[F.round(c, 4).alias(c) for c in ("mean", "base_mean", "mean_change")], "drifted", (F.col("shape_change") < 0.2).alias("shape_is_close")
    )


@query(
    "rule_schema_contract",
    "SELECT 'Column ''c_name'' should be numeric.' AS issue, count(*) AS affected_rows FROM customer UNION ALL SELECT 'Missing column: email', count(*) FROM customer",
)
def rule_schema_contract(t: Tables):
    return R.contract_report(t.customer, {"c_custkey": "numeric", "c_name": "numeric", "email": "string"})


LINE_RULES = """WITH m AS (SELECT *, l_quantity > 45 AS r_qty, NOT l_returnflag IN ('A', 'N') AS r_flag, l_discount IS NULL AS r_disc FROM
 (SELECT * EXCLUDE l_discount, CASE WHEN l_discount >= 0.1 THEN NULL ELSE l_discount END AS l_discount FROM lineitem))"""


def line_frame(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("l_discount", F.when(F.col("l_discount") < 0.1, F.col("l_discount")))


def line_rules() -> list[R.Rule]:
    return [
        R.rule("not_null", "l_discount", name="disc", severity="error"),
        R.rule("range", "l_quantity", name="qty", severity="error", max=45),
        R.rule("enum", "l_returnflag", name="flag", severity="warning", values=["A", "N"]),
    ]


@query(
    "apply_rules",
    LINE_RULES
    + """ SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r_disc THEN 90 ELSE 100 END AS _quality_score, NOT (r_disc OR r_qty) AS _is_valid,
    concat_ws(',', CASE WHEN r_disc THEN 'NULL_l_discount' END, CASE WHEN r_qty THEN 'INVALID_RANGE_l_quantity' END, CASE WHEN r_flag THEN 'INVALID_ENUM_l_returnflag' END) AS _quality_flags FROM m""",
)
def apply_rules(t: Tables):
    split = R.apply_rules(line_frame(t), line_rules())
    out = ["l_orderkey", "l_linenumber", "l_partkey", "_quality_score", "_is_valid", "_quality_flags"]
    return split.valid.select(*out).unionAll(split.rejected.select(*out))


REPORT_ROW = "SELECT '{0}' AS rule_id, count(*) AS processed, count(*) FILTER ({1}) AS failed, count(*) FILTER (NOT {1}) AS passed, round(count(*) FILTER (NOT {1}) * 100.0::DOUBLE / count(*), 2) AS pass_rate FROM m"


@query(
    "apply_rules_report",
    LINE_RULES + " " + " UNION ALL ".join(REPORT_ROW.format(*p) for p in [("disc", "r_disc"), ("qty", "r_qty"), ("flag", "r_flag")]),
)
def apply_rules_report(t: Tables):
    report = R.apply_rules(line_frame(t), line_rules()).report
    return report.select("rule_id", "processed", "failed", "passed", "pass_rate")


@query(
    "rule_actions",
    LINE_RULES
    + """ SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_discount, 0.0) AS l_discount, CASE WHEN r_qty THEN 'quarantine' ELSE 'keep' END AS side FROM m""",
)
def rule_actions(t: Tables):
    rules = [
        R.rule("not_null", "l_discount", action="auto_fix", fix=F.lit(0.0)),
        R.rule("range", "l_quantity", action="quarantine_row", max=45),
        R.rule("enum", "l_returnflag", action="warn", severity="warning", values=["A", "N"]),
        R.rule("not_null", "l_orderkey", action="block_table", severity="critical"),
    ]
    split = R.enforce(line_frame(t), rules)
    out = ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"]
    kept = split.valid.select(*out, F.lit("keep").alias("side"))
    return kept.unionAll(split.rejected.select(*out, F.lit("quarantine").alias("side")))


FINANCE = """SELECT event_id AS transaction_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS customer_id, CASE WHEN event_id % 20 = 0 THEN -value ELSE value END AS amount,
 CASE WHEN event_id % 33 = 0 THEN 'XXX' ELSE 'USD' END AS currency FROM events"""


@query(
    "domain_rules",
    f"""WITH m AS ({FINANCE}) SELECT 'not_null_customer_id' AS rule_id, count(*) FILTER (customer_id IS NULL) AS failed FROM m UNION ALL SELECT 'not_null_transaction_id', 0 FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'not_null_amount', 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'range_amount', count(*) FILTER (amount < 0 OR amount > 1000000) FROM m UNION ALL SELECT 'enum_currency', count(*) FILTER (currency <> 'USD') FROM m""",
)
def domain_rules(t: Tables):
    e = F.col("event_id")
    df = t.events.select(
        e.alias("transaction_id"),
        F.when(e % 50 != 0, F.col("user_id")).alias("customer_id"),
        F.when(e % 20 == 0, -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.when(e % 33 == 0, "XXX").otherwise("USD").alias("currency"),
    )
    rules = R.domain_rules("finance")
    return R.rule_report(R.mark(df, rules), rules).select("rule_id", "failed")


@query(
    "run_checks",
    """WITH m AS (SELECT l_quantity > 45 AS q, NOT l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) AS f, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS u FROM lineitem),
    s AS (SELECT round(count(*) FILTER (NOT q AND NOT f AND NOT u) * 100.0::DOUBLE / count(*), 2) AS table_score FROM m)
    """
    + " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, count(*) AS processed, count(*) FILTER ({c}) AS failed, count(*) FILTER (NOT {c}) AS passed, any_value(table_score) AS table_score FROM m, s"
        for i, c in [("qty", "q"), ("part", "f"), ("line", "u")]
    ),
)
def run_checks(t: Tables):
    rules = [
        R.rule("range", "l_quantity", name="qty", max=45),
        R.rule("foreign_key", "l_partkey", name="part", parent=t.part.filter("p_size < 40"), keys={"l_partkey": "p_partkey"}),
        R.rule("unique", columns=["l_orderkey", "l_linenumber"], name="line"),
    ]
    return R.run_checks(t.lineitem, rules).select("rule_id", "processed", "failed", "passed", "table_score")


QUARANTINED = """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS record, rule_id, severity FROM
 (SELECT o_orderkey, o_orderstatus, 'status' AS rule_id, 'warning' AS severity FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, o_orderstatus, 'late_key', 'error' FROM orders WHERE o_orderkey > 1000)"""


def order_quarantine(t: Tables) -> DataFrame:
    rules = [
        R.rule("enum", "o_orderstatus", name="status", severity="warning", values=["F", "O"]),
        R.rule("range", "o_orderkey", name="late_key", max=1000),
    ]
    return quarantine.quarantine_records(t.orders.select("o_orderkey", "o_orderstatus"), rules, "orders", now())


@query(
    "quarantine_records",
    f"SELECT record, rule_id, severity, md5('orders|' || rule_id || '|' || record) AS quarantine_id, 'pending' AS resolution_status, TIMESTAMP '{NOW}' AS quarantined_at FROM ({QUARANTINED})",
)
def quarantine_records(t: Tables):
    return order_quarantine(t).select("record", "rule_id", "severity", "quarantine_id", "resolution_status", "quarantined_at")


@query(
    "quarantine_recurrence",
    f"SELECT rule_id, record, CASE WHEN rule_id = 'status' THEN 2 ELSE 1 END::BIGINT AS recurring_count, TIMESTAMP '{NOW}' AS first_seen, CASE WHEN rule_id = 'status' THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '{NOW}' END AS last_seen FROM ({QUARANTINED})",
)
def quarantine_recurrence(t: Tables):
    first = order_quarantine(t)
    again = first.filter("rule_id = 'status'").withColumn("quarantined_at", F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))
    return quarantine.recurrence(first.unionAll(again)).drop("source_table")


@query(
    "resolve_quarantine",
    f"SELECT record, rule_id, CASE WHEN rule_id = 'status' THEN 'fixed' ELSE 'pending' END AS resolution_status, CASE WHEN rule_id = 'status' THEN 'ops' END AS resolved_by FROM ({QUARANTINED})",
)
def resolve_quarantine(t: Tables):
    records = order_quarantine(t)
    done = quarantine.resolve(records, records.filter("rule_id = 'status'"), "fixed", "ops", now())
    return done.select("record", "rule_id", "resolution_status", "resolved_by")


@query("reprocess_quarantine", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def reprocess_quarantine(t: Tables):
    records = order_quarantine(t)
    done = quarantine.resolve(records, records.filter("rule_id = 'status'"), "fixed", "ops", now())
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])
    return quarantine.reprocess(done, schema)


@query(
    "generate_rules",
    "SELECT * FROM (VALUES "
    + ", ".join(
        [
            "('order_id_not_null', 'not_null', 'order_id', 'critical')", "('order_id_unique', 'unique', 'order_id', 'critical')",
            "('total_value_not_null', 'not_null', 'total_value', 'high')", "('total_value_positive_range', 'sql', 'total_value', 'high')",
            "('order_date_not_null', 'not_null', 'order_date', 'high')", "('order_date_not_future', 'not_future', 'order_date', 'high')",
            "('status_not_null', 'not_null', 'status', 'high')", "('status_non_empty', 'not_empty', 'status', 'warning')",
        ]
    )
    + ") v(rule_id, rule_type, columns, severity) WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)",
)
def generate_rules(t: Tables):
    df = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("total_value"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )
    return quarantine.rules_frame(df, quarantine.generate_rules(df)).select("rule_id", "rule_type", "columns", "severity")


VALIDATED = """SELECT 'not_null_l_quantity' AS rule_id, 0::BIGINT AS affected_rows, count(*) AS total_rows, true AS passed FROM lineitem
UNION ALL SELECT 'l_quantity_below', count(*) FILTER (l_quantity < 3), count(*), count(*) FILTER (l_quantity < 3) = 0 FROM lineitem
UNION ALL SELECT 'l_quantity_above', count(*) FILTER (l_quantity > 50), count(*), count(*) FILTER (l_quantity > 50) = 0 FROM lineitem
UNION ALL SELECT 'l_returnflag_pattern', count(*) FILTER (NOT regexp_matches(l_returnflag, '^[AN]')), count(*), false FROM lineitem
UNION ALL SELECT 'unique_l_orderkey_l_linenumber', (SELECT count(*) FROM (SELECT 1 FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1)), count(*), false FROM lineitem
UNION ALL SELECT 'taxed', count(*) FILTER (NOT l_tax > 0), count(*), false FROM lineitem"""


def line_validator() -> quarantine.Validator:
    return (
        quarantine.Validator()
        .not_null("l_quantity")
        .range("l_quantity", 3, 50)
        .pattern("l_returnflag", "[AN]", severity="warning")
        .unique("l_orderkey", "l_linenumber")
        .custom("taxed", lambda df: F.col("l_tax") > 0, severity="warning")
    )


@query("validate_report", VALIDATED)
def validate_report(t: Tables):
    return line_validator().validate(t.lineitem).select("rule_id", "affected_rows", "total_rows", "passed")


@query("validate_verdict", "SELECT false AS passed, true AS has_errors, true AS has_warnings FROM lineitem LIMIT 1")
def validate_verdict(t: Tables):
    return quarantine.verdict(line_validator().validate(t.lineitem))


@query(
    "completeness_gate",
    f"""WITH c AS (SELECT count(value) / count(*) AS v, count(kind) / count(*) AS k FROM ({HOLED}))
    SELECT column_name, round(completeness, 6) AS completeness, round((3 + v + k) / 5, 4) AS score, round((3 + v + k) / 5, 4) >= 0.95 AS passed
    FROM c, (SELECT 'event_id' AS column_name, 1.0::DOUBLE AS completeness UNION ALL SELECT 'user_id', 1.0 UNION ALL SELECT 'event_type', 1.0 UNION ALL SELECT 'value', v FROM c UNION ALL SELECT 'kind', k FROM c)""",
)
def completeness_gate(t: Tables):
    df = holed(t).drop("ts").withColumn("_batch", F.lit(None).cast("string"))
    return quarantine.completeness(df).withColumn("completeness", F.round("completeness", 6))


@query(
    "quality_gate",
    f"""WITH h AS (SELECT event_id, event_type, value FROM ({HOLED})), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM h)
    SELECT 'Missing column: amount' AS issue FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'Column ''event_type'' should be numeric.' FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'Missing values found in column: value' FROM h GROUP BY ALL HAVING count(value) < count(*)
    UNION ALL SELECT 'Outliers found in column: value' FROM h, q WHERE value > b + 1.5 * (b - a) OR value < a - 1.5 * (b - a) GROUP BY ALL HAVING count(*) > 0
    UNION ALL SELECT 'Data volume check failed: only ' || count(*) || ' rows present.' FROM h HAVING count(*) < 1000000000
    UNION ALL SELECT 'Column ''event_type'' has inconsistent types.' FROM region WHERE r_regionkey = 0""",
)
def quality_gate(t: Tables):
    df = holed(t).select("event_id", "event_type", "value")
    return quarantine.quality_gate(df, {"amount": "numeric", "event_type": "numeric", "value": "numeric"}, 1_000_000_000)


@query(
    "quality_score_cdc",
    """WITH s AS (SELECT user_id, count(*) AS b, count(*) FILTER (event_type <> 'error') AS a, count(*) FILTER (event_type = 'error' AND value > 50) AS i FROM events GROUP BY 1)
    SELECT user_id, round(greatest(0, least(100, 100 - least((b - a) * 100.0::DOUBLE / b, 30) - i * 5)), 4) AS score FROM s""",
)
def quality_score_cdc(t: Tables):
    kept = F.col("event_type") != "error"
    s = t.events.groupBy("user_id").agg(
        F.count("*").alias("b"), F.count_if(kept).alias("a"), F.count_if(~kept & (F.col("value") > 50)).alias("i")
    )
    score = quarantine.score_retention(F.col("b"), F.col("a"), F.col("i"))
    return s.select("user_id", F.round(score, 4).alias("score"))


@query(
    "quality_alerts",
    """WITH s AS (SELECT 'u' || user_id AS "table", CAST(count(*) FILTER (event_type <> 'error') * 100 // count(*) AS BIGINT) AS score, CAST(count(*) FILTER (value < 20) * 100 // count(*) AS BIGINT) AS missing FROM events GROUP BY 1)
    SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN score < 60 THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN score < 60 THEN 'Quality score below threshold (' || score || ')' ELSE 'High missing value rate (' || missing || '%)' END AS issue FROM s WHERE score < 60 OR missing > 20""",
)
def quality_alerts(t: Tables):
    def percent(cond: Column) -> Column:
        return F.floor(F.count_if(cond) * 100 / F.count("*")).cast("bigint")

    scores = t.events.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table")).agg(
        percent(F.col("event_type") != "error").alias("score"), percent(F.col("value") < 20).alias("missing")
    )
    return quarantine.quality_alerts(scores)


@query(
    "clean_missing",
    f"""WITH h AS ({HOLED}), m AS (SELECT quantile_cont(value, 0.5) AS q FROM h)
    SELECT event_id, round(coalesce(value, q), 6) AS value, coalesce(kind, 'Unknown') AS kind FROM h, m""",
)
def clean_missing(t: Tables):
    empty = F.when(F.col("event_type") == "none", F.lit(1.0))
    df = cleaning.clean_missing(holed(t).select("event_id", "value", "kind", empty.alias("mostly_null")))
    return df.withColumn("value", F.round("value", 6))


@query(
    "cap_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
    SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value, value < lo OR value > hi AS value_has_outlier, value < lo OR value > hi AS _has_anomalies FROM events, f""",
)
def cap_outliers(t: Tables):
    df = cleaning.cap_outliers(t.events.select("event_id", "value"), "value")
    return df.withColumn("value", F.round("value", 6))


@query(
    "invalidate_values",
    """SELECT event_id, CASE WHEN user_id BETWEEN 0 AND 120 THEN user_id END AS age, CASE WHEN event_type IN ('active', 'view') THEN event_type END AS status FROM events""",
)
def invalidate_values(t: Tables):
    df = t.events.select("event_id", F.col("user_id").alias("age"), F.col("event_type").alias("status"))
    return cleaning.null_invalid(df, enums={"status": ["active", "view"]})


@query(
    "asset_constraints",
    """WITH a AS (SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN NULL WHEN d.lang = 'es' THEN 'raw/' || d.doc_id ELSE 'bronze/' || d.doc_id END AS bronze_key,
       CASE WHEN l.toxic = 1 THEN NULL ELSE 'silver/' || d.doc_id END AS silver_key, CASE WHEN l.quality = 1 THEN 'success' WHEN l.quality = 0 THEN 'broken' ELSE 'pending' END AS extraction_status,
       (d.n_chars % 120)::DOUBLE / 100 AS confidence FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, concat_ws(',', CASE WHEN bronze_key IS NULL THEN 'bronze_key_present' END, CASE WHEN NOT starts_with(bronze_key, 'bronze/') THEN 'bronze_key_prefix' END,
    CASE WHEN extraction_status = 'success' AND silver_key IS NULL THEN 'silver_key_on_success' END, CASE WHEN confidence > 1 THEN 'confidence_range' END, CASE WHEN extraction_status = 'broken' THEN 'known_status' END) AS broken FROM a""",
)
def asset_constraints(t: Tables):
    doc, lang = F.col("doc_id").cast("string"), F.col("lang")
    df = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(lang == "es", F.concat(F.lit("raw/"), doc)).when(lang != "de", F.concat(F.lit("bronze/"), doc)).alias("bronze_key"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, F.concat(F.lit("silver/"), doc)).alias("silver_key"),
        F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "broken").otherwise("pending").alias("extraction_status"),
        ((F.col("n_chars") % 120).cast("double") / 100).alias("confidence"),
        F.lit("bronze_ingested").alias("event_type"),
    )
    return R.mark(df, R.asset_rules()).select("doc_id", F.array_join(R.VIOLATIONS, ",").alias("broken"))


@query(
    "backfill_missing",
    f"""SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'bronze/MISSING/' || event_id ELSE 'bronze/' || event_id END AS bronze_key,
    CASE WHEN event_type = 'view' THEN 'silver/MISSING/' || event_id || '.json' END AS silver_key, CASE WHEN event_type = 'error' THEN TIMESTAMP '{NOW}' ELSE ts END AS created_at, false AS is_anomaly FROM events""",
)
def backfill_missing(t: Tables):
    ident, kind = F.col("event_id").cast("string"), F.col("event_type")
    df = t.events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("bronze/"), ident)).alias("bronze_key"),
        F.lit(None).cast("string").alias("silver_key"),
        F.when(kind == "view", "success").otherwise("failed").alias("extraction_status"),
        F.when(kind != "error", F.col("ts")).alias("processed_at"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("boolean").alias("is_anomaly"),
    )
    return cleaning.backfill_assets(df, now()).select("id", "bronze_key", "silver_key", "created_at", "is_anomaly")
