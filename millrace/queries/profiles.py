"""Queries over profiles and exploratory reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import profiling as P
from millrace.queries.catalogue import HOLED, holed
from millrace.queries.registry import Tables, query


def rounded(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


DOUBLED = f"SELECT user_id, event_type, kind, value FROM ({HOLED}) UNION ALL SELECT user_id, event_type, kind, value FROM ({HOLED}) WHERE event_type = 'click'"


def doubled(t: Tables):
    df = holed(t).select("user_id", "event_type", "kind", "value")
    return df.unionAll(df.filter("event_type = 'click'"))


OVERVIEW = f"""WITH d AS ({DOUBLED}), r AS (SELECT count(*) AS n, sum(CAST(value IS NULL AS INTEGER) + CAST(kind IS NULL AS INTEGER)) AS m FROM d), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d))"""


@query(
    "profile_overview",
    OVERVIEW
    + """ SELECT n AS row_count, 4 AS column_count, n - k AS duplicate_rows, CAST(m AS BIGINT) AS missing_cells, round((n - k) * 100.0::DOUBLE / n, 2) AS duplicate_percentage,
    round(m * 100.0::DOUBLE / (n * 4), 2) AS missing_percentage, round(100 - round(m * 100.0::DOUBLE / (n * 4), 2), 2) AS completeness_score FROM r, u""",
)
def profile_overview(t: Tables):
    return P.overview(doubled(t))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 5) AS mean, round(quantile_cont({c}, 0.5), 5) AS median, round(stddev_samp({c}), 5) AS std,
        round(quantile_cont({c}, 0.25), 5) AS q25, round(quantile_cont({c}, 0.75), 5) AS q75, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis,
        count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} > 0) AS positives FROM lineitem"""
        for c in NUMBERS
    ),
)
def profile_numeric(t: Tables):
    df = P.numeric_profile(t.lineitem, NUMBERS).drop("variance", "iqr")
    return rounded(df, "mean", "median", "std", "q25", "q75", "skewness", "kurtosis", digits=5)


def _categorical_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(*) AS unique_count, CAST(sum(n) AS BIGINT) AS non_null_count, arg_min(v, (-n, v)) AS most_frequent, max(n) AS most_frequent_count,
    arg_min(v, (n, v)) AS least_frequent, min(n) AS least_frequent_count, CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length, round(sum(length(v) * n) / sum(n), 4) AS avg_length,
    CASE WHEN count(*) > 50 THEN 'high' ELSE 'low' END AS cardinality,
    array_to_string((list(v || ':' || n ORDER BY n DESC, v))[1:10], ',') AS "values"
    FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)"""


@query("profile_categorical", " UNION ALL ".join(_categorical_sql(c) for c in ["p_name", "p_brand", "p_type"]))
def profile_categorical(t: Tables):
    df = P.categorical_profile(t.part).drop("null_count")
    return rounded(df, "avg_length", digits=4).withColumn("values", F.array_join("values", ","))


@query(
    "profile_datetime",
    "SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min, max(o_orderdate) AS max, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS range_days, count(*) - count(o_orderdate) AS null_count FROM orders",
)
def profile_datetime(t: Tables):
    return P.datetime_profile(t.orders)


FENCED = "SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"


@query(
    "profile_quality_score",
    f"""WITH d AS (SELECT event_type, kind, value FROM ({DOUBLED})), n AS (SELECT count(*) AS n, sum(CAST(value IS NULL AS INTEGER) + CAST(kind IS NULL AS INTEGER)) AS m FROM d), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d)),
    o AS (SELECT ({FENCED.format(c='value', t='d')}) AS o), s AS (SELECT 100 - m * 100.0::DOUBLE / (n * 3) AS completeness, 100 - (n - k) * 100.0::DOUBLE / n AS uniqueness, greatest(0, 100 - o * 100.0::DOUBLE / n) AS validity FROM n, u, o)
    SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(validity, 6) AS validity, round(0.4 * completeness + 0.3 * uniqueness + 0.3 * validity, 2) AS quality_score FROM s""",
)
def profile_quality_score(t: Tables):
    return rounded(P.quality_score(doubled(t).select("event_type", "kind", "value")), "completeness", "uniqueness", "validity")


SAMPLED = 500
SAMPLE_SQL = f"SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT {SAMPLED}"


@query(
    "profile_sampled",
    f"WITH s AS ({SAMPLE_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, (SELECT least(count(*), {SAMPLED}) FROM events) AS sampled_rows FROM s"
        for c, k in [("event_id", "numeric"), ("event_type", "categorical"), ("ts", "datetime"), ("user_id", "numeric"), ("value", "numeric")]
    ),
)
def profile_sampled(t: Tables):
    found = P.profile(t.events.select("event_id", "event_type", "ts", "user_id", "value"), sample=SAMPLED, key="event_id")
    columns = found["columns"].select("column_name", "kind", "row_count", "null_count", "unique_count")
    return columns.withColumn("sampled_rows", found["overview"].select("sampled_rows").scalar())


@query(
    "gold_quality_score",
    OVERVIEW
    + """ SELECT n AS row_count, round(100 - m * 100.0::DOUBLE / (n * 4), 4) AS completeness, round(greatest(0, 100 - m * 100.0::DOUBLE / (n * 4) - least((n - k) * 100.0::DOUBLE / n, 20)), 4) AS quality_score FROM r, u""",
)
def gold_quality_score(t: Tables):
    return P.gold_score(doubled(t))


@query(
    "missing_by_column",
    f"SELECT 'event_id' AS column_name, count(*) - count(event_id) AS missing_count FROM ({HOLED}) UNION ALL SELECT 'value', count(*) - count(value) FROM ({HOLED}) UNION ALL SELECT 'kind', count(*) - count(kind) FROM ({HOLED})",
)
def missing_by_column(t: Tables):
    return P.missing_by_column(holed(t).select("event_id", "value", "kind"))


def _describe_sql(c: str, kind: str) -> str:
    return f"""SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage,
    count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_percentage FROM part"""


@query(
    "describe_columns",
    " UNION ALL ".join(_describe_sql(c, k) for c, k in [("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"), ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric")]),
)
def describe_columns(t: Tables):
    return P.describe(t.part).drop("data_type")


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(CAST(floor((l_extendedprice - lo) * 10 / (hi - lo)) AS INTEGER) + 1, 10) AS bin FROM lineitem, s)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 10 * (i - 1), 4) AS low_edge, round(CASE WHEN i = 10 THEN hi ELSE lo + (hi - lo) / 10 * i END, 4) AS high_edge, (SELECT count(*) FROM b WHERE b.bin = i) AS count FROM range(1, 11) r(i), s""",
)
def histogram(t: Tables):
    return rounded(P.histogram(t.lineitem, "l_extendedprice", 10), "low_edge", "high_edge", digits=4)


@query(
    "skew_label",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(avg({c}), 5) AS mean, round(quantile_cont({c}, 0.5), 5) AS median, CASE WHEN min({c}) = max({c}) THEN 'constant' WHEN avg({c}) > quantile_cont({c}, 0.5) THEN 'right'
        WHEN avg({c}) < quantile_cont({c}, 0.5) THEN 'left' ELSE 'symmetric' END AS skew FROM lineitem"""
        for c in ["l_extendedprice", "l_quantity"]
    ),
)
def skew_label(t: Tables):
    return rounded(P.skew_label(t.lineitem, ["l_extendedprice", "l_quantity"]), "mean", "median", digits=5)


def _distribution_sql(c: str) -> str:
    """K² of D'Agostino and Pearson, written out."""
    return f"""WITH m AS (SELECT count({c})::DOUBLE AS n, skewness({c}) AS sk, kurtosis_pop({c}) + 3 AS b2 FROM lineitem),
    a AS (SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM m),
    b AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS q FROM a),
    k AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * q) - cbrt((1 - 2 / q) / (1 + x * sqrt(2 / (q - 4))))) / sqrt(2 / (9 * q)) AS z2 FROM b),
    p AS (SELECT *, exp(-(z1 * z1 + z2 * z2) / 2) AS pv FROM k)
    SELECT '{c}' AS column_name, round(sk, 5) AS skewness, round(pv, 5) AS p_value, CASE WHEN n < 8 THEN 'insufficient_data' WHEN pv > 0.05 THEN 'normal' WHEN abs(sk) < 0.5 THEN 'symmetric' WHEN sk > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution FROM p"""


@query("distribution_type", " UNION ALL ".join(f"({_distribution_sql(c)})" for c in ["l_quantity", "l_extendedprice", "l_tax"]))
def distribution_type(t: Tables):
    df = P.distribution_type(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(df, "skewness", "p_value", digits=5)


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("correlations", " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 5) AS correlation FROM lineitem" for a, b in PAIRS))
def correlations(t: Tables):
    return rounded(P.correlations(t.lineitem, NUMBERS), "correlation", digits=5)


WIDE = {f"x{i}": (i % 5 + 2, i % 7, 11 + i) for i in range(30)}


@query(
    "correlations_wide",
    "WITH w AS (SELECT "
    + ", ".join(f"CASE WHEN l_orderkey % {hole} <> 1 THEN l_quantity * {f} + l_partkey % {m} END AS {c}" for c, (hole, f, m) in WIDE.items())
    + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 5) AS correlation FROM w" for a, b in combinations(WIDE, 2)),
)
def correlations_wide(t: Tables):
    """Thirty columns with holes: all pairs from one Gram matrix."""
    wide = t.lineitem.select(
        *[F.when(F.col("l_orderkey") % hole != 1, F.col("l_quantity") * f + F.col("l_partkey") % m).alias(c) for c, (hole, f, m) in WIDE.items()]
    )
    return rounded(P.correlations(wide), "correlation", digits=5)


@query(
    "correlations_strong",
    "SELECT 'l_quantity' AS column1, 'gross' AS column2, round(corr(l_quantity, l_quantity * 2 + l_tax), 3) AS correlation FROM lineitem",
)
def correlations_strong(t: Tables):
    df = t.lineitem.select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("gross"), "l_discount")
    return P.correlations(df, threshold=0.7)


@query(
    "outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q),
    o AS (SELECT value FROM events, f WHERE value < lo OR value > hi)
    SELECT 'value' AS column_name, (SELECT count(*) FROM o) AS outlier_count, round((SELECT count(*) FROM o) * 100.0::DOUBLE / (SELECT count(value) FROM events), 2) AS outlier_percentage,
    round(lo, 5) AS lower_bound, round(hi, 5) AS upper_bound, (SELECT string_agg(CAST(CAST(v * 100 AS BIGINT) AS VARCHAR), ',') FROM (SELECT round(value, 2) AS v FROM o ORDER BY value LIMIT 5)) AS outlier_cents FROM f""",
)
def outliers(t: Tables):
    df = P.outliers(t.events, ["value"])
    cents = F.array_join(F.transform("outlier_values", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",")
    return df.select(
        "column_name", "outlier_count", "outlier_percentage", F.round("lower_bound", 5).alias("lower_bound"),
        F.round("upper_bound", 5).alias("upper_bound"), cents.alias("outlier_cents"),
    )


@query(
    "temporal_patterns",
    """SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date, count(DISTINCT o_orderdate) AS unique_dates, count(*) - count(o_orderdate) AS null_count,
    CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS range_days, (SELECT string_agg(m || ':' || n, ',' ORDER BY m) FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1)) AS monthly FROM orders""",
)
def temporal_patterns(t: Tables):
    return P.temporal(t.orders).drop("warning").withColumn("monthly", F.array_join("monthly", ","))


@query(
    "semantic_warnings",
    """WITH c AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '0' || c_custkey || '1' END AS code, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE 'a@b.com' END AS email, c_mktsegment AS segment_name FROM customer)
    SELECT 'code' AS column_name, 'leading_zeros' AS type, 'high' AS severity, CAST(count(*) FILTER (regexp_matches(code, '^0\\d+')) AS DOUBLE) AS measure FROM c
    UNION ALL SELECT 'email', 'invalid_format', 'medium', round(count(*) FILTER (email = 'a@b.com') * 100.0::DOUBLE / count(*), 1) FROM c
    UNION ALL SELECT 'segment_name', 'synthetic_data', 'low', round(count(DISTINCT segment_name) / count(*), 3) FROM c""",
)
def semantic_warnings(t: Tables):
    key = F.col("c_custkey")
    df = t.customer.select(
        F.when(key % 5 == 0, "x").otherwise(F.concat(F.lit("0"), key.cast("string"), F.lit("1"))).alias("code"),
        F.when(key % 10 == 0, F.col("c_name")).otherwise("a@b.com").alias("email"),
        F.col("c_mktsegment").alias("segment_name"),
    )
    return P.semantic_warnings(df)


@query(
    "uniqueness_signals",
    """SELECT 'o_orderkey' AS column_name, 'unique' AS signal FROM orders HAVING count(*) = count(DISTINCT o_orderkey) UNION ALL SELECT 'o_orderkey', 'sequential' FROM orders HAVING max(o_orderkey) - min(o_orderkey) + 1 = count(*)""",
)
def uniqueness_signals(t: Tables):
    return P.uniqueness(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(
    "patterns",
    """SELECT 'o_orderkey' AS column_name, 'potential_id' AS pattern FROM orders HAVING count(DISTINCT o_orderkey) > 0.95 * count(*) UNION ALL SELECT 'o_orderstatus', 'low_cardinality' FROM orders HAVING count(DISTINCT o_orderstatus) < 10
    UNION ALL SELECT 'one', 'constant' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'one', 'low_cardinality' FROM region WHERE r_regionkey = 0""",
)
def patterns(t: Tables):
    return P.patterns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).alias("one")))


@query(
    "insights",
    f"""WITH d AS (SELECT user_id, event_type, kind, CASE WHEN value > 60 THEN NULL ELSE value END AS value, CASE WHEN value < 200 THEN 0 ELSE 1 END AS flag FROM ({DOUBLED})), n AS (SELECT count(*) AS n, sum(CAST(value IS NULL AS INTEGER) + CAST(kind IS NULL AS INTEGER)) AS m FROM d),
    u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d))
    SELECT 'High missing data rate: ' || format('{{:.1f}}', m * 100.0::DOUBLE / (n * 5)) || '% - review data collection' AS message FROM n WHERE m * 100.0::DOUBLE / (n * 5) > 10
    UNION ALL SELECT 'Significant duplicates: ' || format('{{:.1f}}', (n - k) * 100.0::DOUBLE / n) || '% - verify data ingestion' FROM n, u WHERE (n - k) * 100.0::DOUBLE / n > 5
    UNION ALL SELECT 'Column ''flag'' has ' || format('{{:.1f}}', count(*) FILTER (flag = 0) * 100.0::DOUBLE / count(*)) || '% zeros - verify validity' FROM d""",
)
def insights(t: Tables):
    df = doubled(t).withColumn("flag", F.when(F.coalesce(F.col("value"), F.lit(999)) < 200, 0).otherwise(1))
    return P.insights(df.withColumn("value", F.when(~(F.col("value") > 60), F.col("value"))))


@query(
    "business_metrics",
    "SELECT round(sum(o_totalprice), 2) AS total_transaction_amount, round(avg(o_totalprice), 4) AS avg_transaction_amount, max(o_totalprice) AS max_transaction_amount, min(o_orderdate) AS date_start, max(o_orderdate) AS date_end FROM orders",
)
def business_metrics(t: Tables):
    df = P.business_metrics(t.orders, "transaction", {"amount": "o_totalprice", "date": "o_orderdate"})
    return df.withColumns(
        {"total_transaction_amount": F.round("total_transaction_amount", 2), "avg_transaction_amount": F.round("avg_transaction_amount", 4)}
    )


@query(
    "business_metrics_patients",
    "SELECT count(DISTINCT user_id) AS unique_patients, round(avg(user_id), 6) AS avg_age, CAST(min(user_id) AS DOUBLE) AS min_age, CAST(max(user_id) AS DOUBLE) AS max_age, CAST(quantile_cont(user_id, 0.5) AS DOUBLE) AS median_age FROM events",
)
def business_metrics_patients(t: Tables):
    return rounded(P.business_metrics(t.events, "patient", {"patient": "user_id", "age": "user_id"}), "avg_age")


@query(
    "table_classifier",
    """SELECT 'lineitem' AS table_name, count(*) AS row_count, 6::BIGINT AS column_count, 'FACT' AS table_type, 0.8::DOUBLE AS confidence, CASE WHEN count(DISTINCT part_id) > 1000 OR count(DISTINCT order_id) BETWEEN 1001 AND 0.5 * count(*) THEN 'Snowflake' ELSE 'Star' END AS schema_type, CASE WHEN count(DISTINCT price) > 0.95 * count(*) THEN 'l_extendedprice' ELSE '' END AS primary_keys,
    concat_ws(',', CASE WHEN count(DISTINCT order_id) < 0.5 * count(*) THEN 'order_id' END, 'part_id', 'supplier_id') AS foreign_keys, 3::BIGINT AS numeric_measures FROM (SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, l_extendedprice AS price FROM lineitem)
    UNION ALL SELECT 'nation', count(*), 3, 'DIMENSION', 0.7, 'Star', 'n_name,nation_id', 'region_id', 0 FROM nation""",
)
def table_classifier(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
        "l_quantity", "l_extendedprice", "l_discount",
    )
    nation = t.nation.select(F.col("n_nationkey").alias("nation_id"), "n_name", F.col("n_regionkey").alias("region_id"))
    both = P.classify_table(lines, "lineitem").unionByName(P.classify_table(nation, "nation"))
    return both.withColumns({c: F.array_join(c, ",") for c in ("primary_keys", "foreign_keys")})


def _eda_sql() -> str:
    """Twins of the report's sections that are plain counts; the others have their own queries above."""
    parts = []
    for table, columns in {"customer": ["c_custkey", "c_name", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]}.items():
        width = len(columns) + (table == "orders")  # its date has no counts here
        for metric, sql in {
            "row_count": "count(*)", "column_count": str(width), "duplicate_rows": f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)}{', o_orderdate' if table == 'orders' else ''} FROM {table}))",
            "missing_cells": "0", "duplicate_percentage": "0", "missing_percentage": "0", "completeness_score": "100",
        }.items():
            parts.append(f"SELECT '{table}' AS table_name, 'overview' AS section, NULL AS column_name, '{metric}' AS metric, CAST({sql} AS DOUBLE) AS value, NULL AS text FROM {table if '(' in sql else '(SELECT 1)'}")
        for c in [*columns, *(["o_orderdate"] if table == "orders" else [])]:
            for metric, sql in {"row_count": "count(*)", "null_count": f"count(*) - count({c})", "unique_count": f"count(DISTINCT {c})", "non_null_count": f"count({c})"}.items():
                parts.append(f"SELECT '{table}', 'columns', '{c}', '{metric}', CAST({sql} AS DOUBLE), NULL FROM {table}")
    parts.append("SELECT 'orders', 'business_metrics', NULL, 'max_transaction_amount', max(o_totalprice), NULL FROM orders")
    for c in ("o_orderkey", "o_totalprice", "o_custkey"):
        for metric, sql in {"count": f"count({c})", "min": f"min({c})", "max": f"max({c})", "median": f"quantile_cont({c}, 0.5)", "q25": f"quantile_cont({c}, 0.25)", "q75": f"quantile_cont({c}, 0.75)"}.items():
            parts.append(f"SELECT 'orders', 'numeric', '{c}', '{metric}', CAST({sql} AS DOUBLE), NULL FROM orders")
    parts.append("SELECT 'broken', 'failed', NULL, 'error', NULL, NULL FROM region WHERE r_regionkey = 0")
    return " UNION ALL ".join(parts)


@query("eda_report", _eda_sql())
def eda_report(t: Tables):
    broken = t.orders.select(F.raise_error(F.lit("unreadable")).cast("string").alias("x"), "o_orderkey")
    report = P.eda_report(
        {
            "customer": t.customer.select("c_custkey", "c_name", "c_mktsegment"),
            "broken": broken,
            "orders": t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
        },
        roles={"orders": {"kind": "transaction", "columns": {"amount": "o_totalprice", "date": "o_orderdate"}}},
    )
    key, metric = F.concat_ws(" ", "section", "metric"), F.col("metric")
    counted = (F.col("section") == "columns") & metric.isin("row_count", "null_count", "unique_count", "non_null_count")
    numeric = (F.col("section") == "numeric") & (F.col("table_name") == "orders") & metric.isin("count", "min", "max", "median", "q25", "q75")
    shown = report.where(F.col("section").isin("overview", "failed") | counted | numeric | (key == "business_metrics max_transaction_amount"))
    return shown.withColumn("text", F.lit(None).cast("string"))
