"""Queries over the transformation catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates, binning, cleaning, encoding, features, scaling, windows
from millrace.queries.registry import Tables, query

HOLED = """SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
 CASE WHEN event_id % 15 = 0 THEN NULL ELSE event_type END AS kind FROM events"""


def holed(t: Tables):
    e = F.col("event_id")
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        F.when(e % 10 != 0, F.col("value")).alias("value"),
        F.when(e % 15 != 0, F.col("event_type")).alias("kind"),
    )


def rounded(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("remove_nulls", f"SELECT event_id, value, kind FROM ({HOLED}) WHERE value IS NOT NULL AND kind IS NOT NULL")
def remove_nulls(t: Tables):
    return cleaning.remove_nulls(holed(t), ["value", "kind"]).select("event_id", "value", "kind")


@query("fill_nulls", f"SELECT event_id, coalesce(value, 0.5) AS value, coalesce(kind, 'none') AS kind FROM ({HOLED})")
def fill_nulls(t: Tables):
    df = cleaning.fill_nulls(holed(t), "value", 0.5)
    return cleaning.fill_nulls(df, "kind", "none").select("event_id", "value", "kind")


@query(
    "fill_nulls_stats",
    f"""WITH h AS ({HOLED}), m AS (SELECT avg(value) AS a, quantile_cont(value, 0.5) AS q FROM h),
    c AS (SELECT kind, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind LIMIT 1)
    SELECT event_id, round(coalesce(value, (SELECT a FROM m)), 6) AS v_mean, round(coalesce(value, (SELECT q FROM m)), 6) AS v_median,
    coalesce(kind, (SELECT kind FROM c)) AS kind FROM h""",
)
def fill_nulls_stats(t: Tables):
    df = holed(t).withColumns({"v_mean": F.col("value"), "v_median": F.col("value")})
    df = cleaning.fill_nulls(df, "v_mean", method="mean")
    df = cleaning.fill_nulls(df, "v_median", method="median")
    df = cleaning.fill_nulls(df, "kind", method="mode")
    return rounded(df, "v_mean", "v_median").select("event_id", "v_mean", "v_median", "kind")


TWICE = "SELECT * FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR, user_id, event_type, value, props FROM events WHERE event_type = 'click'"


def twice(t: Tables):
    again = t.events.filter("event_type = 'click'").withColumn("ts", F.expr("ts + INTERVAL 1 HOUR"))
    return t.events.unionAll(again)


@query(
    "remove_duplicates",
    f"SELECT event_id, max(ts) AS ts FROM ({TWICE}) GROUP BY event_id",
)
def remove_duplicates(t: Tables):
    return cleaning.remove_duplicates(twice(t), "event_id", "last", "ts").select("event_id", "ts")


@query("remove_duplicates_all", "SELECT DISTINCT user_id, event_type FROM events")
def remove_duplicates_all(t: Tables):
    return cleaning.remove_duplicates(t.events.select("user_id", "event_type"))


@query(
    "remove_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
)
def remove_outliers(t: Tables):
    return cleaning.remove_outliers(t.events, "value").select("event_id", "value")


@query(
    "remove_outliers_zscore",
    """WITH q AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE abs(l_extendedprice - a) <= 1.5 * s""",
)
def remove_outliers_zscore(t: Tables):
    df = cleaning.remove_outliers(t.lineitem, "l_extendedprice", "zscore", 1.5)
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("fix_typos", "SELECT p_partkey, regexp_replace(p_name, 'wid(get)?', 'gad$', 'g') AS p_name FROM part")
def fix_typos(t: Tables):
    return cleaning.fix_typos(t.part, "p_name", "wid(get)?", r"gad\$").select("p_partkey", "p_name")


LINE = ["l_orderkey", "l_linenumber"]


@query(
    "minmax_scale",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_quantity) AS qlo, max(l_quantity) AS qhi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice_scaled,
    round((l_quantity - qlo) / (qhi - qlo), 6) AS l_quantity_scaled FROM lineitem, s""",
)
def minmax_scale(t: Tables):
    out = ["l_extendedprice_scaled", "l_quantity_scaled"]
    df = scaling.minmax_scale(t.lineitem, ["l_extendedprice", "l_quantity"])
    return rounded(df, *out).select(*LINE, *out)


@query(
    "zscore_normalize",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / d, 6) + 0.0 AS l_extendedprice_normalized FROM lineitem, s""",
)
def zscore_normalize(t: Tables):
    df = scaling.zscore_normalize(t.lineitem, "l_extendedprice")
    return rounded(df, "l_extendedprice_normalized").select(*LINE, "l_extendedprice_normalized")


@query(
    "robust_scale",
    """WITH s AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / (b - a), 6) AS l_extendedprice_robust FROM lineitem, s""",
)
def robust_scale(t: Tables):
    df = scaling.robust_scale(t.lineitem, "l_extendedprice")
    return rounded(df, "l_extendedprice_robust").select(*LINE, "l_extendedprice_robust")


@query(
    "maxabs_scale",
    """WITH s AS (SELECT max(abs(c_acctbal)) AS m FROM customer)
    SELECT c_custkey, round(c_acctbal / m, 6) AS c_acctbal_maxabs FROM customer, s""",
)
def maxabs_scale(t: Tables):
    return rounded(scaling.maxabs_scale(t.customer, "c_acctbal"), "c_acctbal_maxabs").select("c_custkey", "c_acctbal_maxabs")


@query(
    "unit_vector",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS l_quantity_unit,
    round(l_tax / sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS l_tax_unit FROM lineitem""",
)
def unit_vector(t: Tables):
    df = scaling.unit_vector(t.lineitem, ["l_quantity", "l_tax"])
    return rounded(df, "l_quantity_unit", "l_tax_unit").select(*LINE, "l_quantity_unit", "l_tax_unit")


@query(
    "one_hot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O,
    CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""",
)
def one_hot(t: Tables):
    df = encoding.one_hot(t.orders, "o_orderstatus")
    return df.select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P")


RANKED = """WITH c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1)"""


@query("label_encode", RANKED + " SELECT o_orderkey, o_orderpriority, i AS o_orderpriority_encoded FROM orders JOIN c ON v = o_orderpriority")
def label_encode(t: Tables):
    df = encoding.label_encode(t.orders, "o_orderpriority")
    return df.select("o_orderkey", "o_orderpriority", "o_orderpriority_encoded")


@query(
    "label_encode_wide",
    """WITH c AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS i FROM orders GROUP BY 1)
    SELECT o_orderkey, i AS o_custkey_encoded FROM orders JOIN c ON v = o_custkey""",
)
def label_encode_wide(t: Tables):
    return encoding.label_encode(t.orders, "o_custkey").select("o_orderkey", "o_custkey_encoded")


@query("label_encode_map", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS BIGINT) AS o_orderstatus_encoded FROM orders")
def label_encode_map(t: Tables):
    df = encoding.label_encode(t.orders, "o_orderstatus", {"O": 1, "F": 2})
    return df.select("o_orderkey", "o_orderstatus_encoded")


@query(
    "binary_encode",
    RANKED
    + """ SELECT o_orderkey, CAST(i & 1 AS INTEGER) AS o_orderpriority_bit0, CAST((i >> 1) & 1 AS INTEGER) AS o_orderpriority_bit1,
    CAST((i >> 2) & 1 AS INTEGER) AS o_orderpriority_bit2 FROM orders JOIN c ON v = o_orderpriority""",
)
def binary_encode(t: Tables):
    df = encoding.binary_encode(t.orders, "o_orderpriority")
    return df.select("o_orderkey", *[f"o_orderpriority_bit{b}" for b in range(3)])


@query(
    "target_encode",
    """WITH g AS (SELECT avg(o_totalprice) AS a FROM orders),
    c AS (SELECT o_custkey AS v, (sum(o_totalprice) + 5 * any_value(a)) / (count(*) + 5) AS e FROM orders, g GROUP BY 1)
    SELECT o_orderkey, round(e, 3) AS o_custkey_target FROM orders JOIN c ON v = o_custkey""",
)
def target_encode(t: Tables):
    df = encoding.target_encode(t.orders, "o_custkey", "o_totalprice", smoothing=5.0)
    return rounded(df, "o_custkey_target", digits=3).select("o_orderkey", "o_custkey_target")


@query(
    "frequency_encode",
    """WITH c AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS f FROM orders GROUP BY 1)
    SELECT o_orderkey, round(f, 6) AS o_orderpriority_frequency FROM orders JOIN c ON v = o_orderpriority""",
)
def frequency_encode(t: Tables):
    df = encoding.frequency_encode(t.orders, "o_orderpriority")
    return rounded(df, "o_orderpriority_frequency").select("o_orderkey", "o_orderpriority_frequency")


@query("group_sum", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem GROUP BY 1, 2")
def group_sum(t: Tables):
    df = aggregates.group_sum(t.lineitem, "l_returnflag, l_linestatus", ["l_quantity", "l_extendedprice"])
    return rounded(df, "l_quantity_sum", "l_extendedprice_sum", digits=2)


@query("group_avg", "SELECT l_suppkey, round(avg(l_discount), 6) AS l_discount_avg FROM lineitem GROUP BY 1")
def group_avg(t: Tables):
    return rounded(aggregates.group_avg(t.lineitem, "l_suppkey", "l_discount"), "l_discount_avg")


@query("group_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def group_count(t: Tables):
    return aggregates.group_count(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("group_min_max", "SELECT l_partkey, min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max FROM lineitem GROUP BY 1")
def group_min_max(t: Tables):
    return aggregates.group_min_max(t.lineitem, "l_partkey", "l_shipdate")


@query(
    "rolling_agg",
    """SELECT event_id, round(avg(value) OVER w, 4) AS value_rolling_avg, max(value) OVER w AS value_rolling_max FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_agg(t: Tables):
    df = windows.rolling_agg(t.events, "value", 7, "avg", "user_id", ["ts", "event_id"])
    df = windows.rolling_agg(df, "value", 7, "max", "user_id", ["ts", "event_id"])
    return rounded(df, "value_rolling_avg", digits=4).select("event_id", "value_rolling_avg", "value_rolling_max")


@query(
    "rolling_agg_long",
    """SELECT event_id, round(sum(value) OVER w, 3) AS value_rolling_sum, min(value) OVER w AS value_rolling_min FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def rolling_agg_long(t: Tables):
    """Windows of 1000 rows over pages of 64."""
    df = windows.rolling_agg(t.events, "value", 1000, "sum", "event_type", ["ts", "event_id"], 64)
    df = windows.rolling_agg(df, "value", 1000, "min", "event_type", ["ts", "event_id"], 64)
    return rounded(df, "value_rolling_sum", digits=3).select("event_id", "value_rolling_sum", "value_rolling_min")


@query(
    "equal_width_bin",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, least(CAST(floor((l_extendedprice - lo) * 10 / (hi - lo)) AS INTEGER) + 1, 10) AS l_extendedprice_bin FROM lineitem, s""",
)
def equal_width_bin(t: Tables):
    return binning.equal_width_bin(t.lineitem, "l_extendedprice", 10).select(*LINE, "l_extendedprice_bin")


@query(
    "equal_freq_bin",
    """WITH s AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
    SELECT p_partkey, 1 + CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) + CAST(p_retailprice > c AS INTEGER) AS p_retailprice_bin FROM part, s""",
)
def equal_freq_bin(t: Tables):
    return binning.equal_freq_bin(t.part, "p_retailprice", 4).select("p_partkey", "p_retailprice_bin")


@query(
    "custom_bin",
    "SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'medium' WHEN p_size >= 30 AND p_size < 45 THEN 'large' END AS p_size_bin FROM part",
)
def custom_bin(t: Tables):
    return binning.custom_bin(t.part, "p_size", [1, 10, 30, 45], ["small", "medium", "large"]).select("p_partkey", "p_size_bin")


@query(
    "quantile_bin",
    """WITH s AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, 1 + CAST(l_extendedprice > a AS INTEGER) + CAST(l_extendedprice > b AS INTEGER) AS l_extendedprice_bin FROM lineitem, s""",
)
def quantile_bin(t: Tables):
    return binning.quantile_bin(t.lineitem, "l_extendedprice", [0, 0.1, 0.9, 1]).select(*LINE, "l_extendedprice_bin")


@query(
    "extract_datetime",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day,
    CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(quarter(ts) AS INTEGER) AS ts_quarter,
    CAST(dayofweek(ts) + 1 AS INTEGER) AS ts_dayofweek FROM events""",
)
def extract_datetime(t: Tables):
    parts = ["year", "month", "day", "hour", "minute", "quarter", "dayofweek"]
    return features.extract_datetime(t.events, "ts", parts).select("event_id", *[f"ts_{p}" for p in parts])


@query("extract_datetime_millis", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS ms_hour, CAST(year(ts) AS INTEGER) AS ms_year FROM events")
def extract_datetime_millis(t: Tables):
    df = t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return features.extract_datetime(df, "ms", ["hour", "year"]).drop("ms")


@query(
    "calculate_age",
    """SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-06-15') AS INTEGER) AS o_orderdate_age_years,
    CAST(DATE '2024-06-15' - CAST(o_orderdate AS DATE) AS INTEGER) AS o_orderdate_age_days FROM orders""",
)
def calculate_age(t: Tables):
    df = features.calculate_age(t.orders, "o_orderdate", "2024-06-15")
    return df.select("o_orderkey", "o_orderdate_age_years", "o_orderdate_age_days")


@query(
    "combine_features",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_returnflag || '_' || l_linestatus AS flags,
    l_discount + l_tax AS both FROM lineitem""",
)
def combine_features(t: Tables):
    df = features.combine_features(t.lineitem, ["l_extendedprice", "l_quantity"], "ratio", "unit_price")
    df = features.combine_features(df, "l_returnflag, l_linestatus", "concat", "flags")
    df = features.combine_features(df, ["l_discount", "l_tax"], "sum", "both")
    return df.select(*LINE, "unit_price", "flags", "both")


@query("polynomial_features", "SELECT l_orderkey, l_linenumber, pow(l_quantity, 2) AS l_quantity_pow2, pow(l_quantity, 3) AS l_quantity_pow3 FROM lineitem")
def polynomial_features(t: Tables):
    return features.polynomial_features(t.lineitem, "l_quantity", 3).select(*LINE, "l_quantity_pow2", "l_quantity_pow3")


@query(
    "interaction_features",
    "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS l_quantity_x_l_discount, round(l_quantity * l_tax, 4) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem",
)
def interaction_features(t: Tables):
    df = features.interaction_features(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    df = rounded(df, "l_quantity_x_l_discount", "l_quantity_x_l_tax", digits=4)
    df = rounded(df, "l_discount_x_l_tax")
    return df.select(*LINE, "l_quantity_x_l_discount", "l_quantity_x_l_tax", "l_discount_x_l_tax")


@query("split_column", "SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name_part1, nullif(split_part(p_name, ' ', 2), '') AS p_name_part2, nullif(split_part(p_name, ' ', 3), '') AS p_name_part3 FROM part")
def split_column(t: Tables):
    return features.split_column(t.part, "p_name", " ", 3).select("p_partkey", *[f"p_name_part{i}" for i in (1, 2, 3)])


@query("extract_regex", r"SELECT page_id, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS url_extracted FROM pages")
def extract_regex(t: Tables):
    return features.extract_regex(t.pages, "url", r"page=([0-9]+)", 1).select("page_id", "url_extracted")


@query("parse_json", "SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events")
def parse_json(t: Tables):
    return features.parse_json(t.events, "props", ["k"]).select("event_id", "props_k")


@query(
    "parse_url",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS url_protocol, regexp_extract(url, '://([^/?#]+)', 1) AS url_host,
    regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS url_path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS url_query FROM pages""",
)
def parse_url(t: Tables):
    return features.parse_url(t.pages, "url").select("page_id", "url_protocol", "url_host", "url_path", "url_query")


@query(
    "log_transform",
    "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS l_extendedprice_log, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 6) END AS l_tax_log FROM lineitem",
)
def log_transform(t: Tables):
    df = features.log_transform(t.lineitem, ["l_extendedprice", "l_tax"])
    return rounded(df, "l_extendedprice_log", "l_tax_log").select(*LINE, "l_extendedprice_log", "l_tax_log")


@query("sqrt_transform", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS c_acctbal FROM customer")
def sqrt_transform(t: Tables):
    return rounded(features.sqrt_transform(t.customer, "c_acctbal"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("power_transform", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(pow(c_acctbal, 0.5), 6) END AS c_acctbal_power FROM customer")
def power_transform(t: Tables):
    df = features.power_transform(t.customer, "c_acctbal", 0.5)
    return rounded(df, "c_acctbal_power").select("c_custkey", "c_acctbal_power")


@query("reciprocal", "SELECT l_orderkey, l_linenumber, round(1 / nullif(l_tax, 0), 6) AS l_tax_reciprocal FROM lineitem")
def reciprocal(t: Tables):
    return rounded(features.reciprocal(t.lineitem, "l_tax"), "l_tax_reciprocal").select(*LINE, "l_tax_reciprocal")


@query("box_cox", "SELECT l_orderkey, l_linenumber, round((pow(l_extendedprice, 0.25) - 1) / 0.25, 6) AS l_extendedprice_boxcox FROM lineitem")
def box_cox(t: Tables):
    df = features.box_cox(t.lineitem, "l_extendedprice", 0.25)
    return rounded(df, "l_extendedprice_boxcox").select(*LINE, "l_extendedprice_boxcox")


@query(
    "hierarchy_rollup",
    """SELECT r_name AS region, n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS bal
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def hierarchy_rollup(t: Tables):
    mapping = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "nation")
    aggs = {"n": F.count("*"), "bal": F.round(F.sum("c_acctbal"), 2)}
    return features.hierarchy_rollup(df, "nation", "region", mapping, aggs, subtotals=True)


@query("categorize", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '5-LOW' THEN 'slow' ELSE 'usual' END AS o_orderpriority_category FROM orders")
def categorize(t: Tables):
    classes = {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"}
    df = features.categorize(t.orders, "o_orderpriority", classes, "usual")
    return df.select("o_orderkey", "o_orderpriority_category")


@query("round_values", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 0) AS x FROM lineitem")
def round_values(t: Tables):
    df = t.lineitem.withColumn("x", F.col("l_extendedprice") / 7)
    return features.round_values(df, "x", 0).select(*LINE, "x")


@query(
    "pivot_wide",
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O,
    round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1""",
)
def pivot_wide(t: Tables):
    df = features.pivot_wide(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return rounded(df, "F", "O", "P", digits=2)


@query(
    "melt_long",
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def melt_long(t: Tables):
    return features.melt_long(t.lineitem, LINE, ["l_quantity", "l_tax"])
