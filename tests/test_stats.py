import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.stats import approx_quantiles, exact_quantiles, one_row
from millrace.functions import stats
from millrace.operators import aggregates, cleaning, profiling, sketches
from millrace.operators.rules import drift


@pytest.mark.parametrize("shape", ["spread", "ties", "two_values", "constant", "nan", "between_heavy"])
def test_exact_quantiles_refine_to_the_exact_value(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "spread": rng.normal(size=20_000) * 1e6,
        "ties": np.where(rng.random(20_000) < 0.34, 5.0, rng.integers(0, 1000, 20_000) / 7),
        "two_values": np.where(rng.random(20_000) < 0.5, 1.0, 2.0),
        "constant": np.full(20_000, 4.0),
        "between_heavy": np.repeat([1.0, 2.0, 3.0], [9_970, 60, 9_970]),
        "nan": np.where(rng.random(20_000) < 0.3, np.nan, rng.random(20_000)),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": data}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x"], probs, small=60)
    for p in probs:
        assert got[("x", p)] == pytest.approx(np.nanquantile(data, p), rel=1e-9, abs=1e-9)


def test_quantiles_end_between_two_heavy_values(spark, monkeypatch):
    passes = []
    narrow = stats._narrow
    monkeypatch.setattr(stats, "_narrow", lambda data, targets: (passes.append(1), narrow(data, targets)))
    values = spark.range(100_000).selectExpr("case when id < 49990 then 1.0D when id < 50010 then 2.0D else 3.0D end as x")
    assert exact_quantiles(values, ["x"], [0.5], small=10) == {("x", 0.5): 2.0}
    assert len(passes) <= 3


def test_quantiles_keep_large_integers_and_decimals(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, Decimal("12345678901234567890.12")), (big, Decimal("12345678901234567890.12")), (big + 2, Decimal("1")), (None, None)], "i long, d decimal(38,2)")
    got = exact_quantiles(df, ["i", "d"], [0.5], own_type=True)
    assert got == {("i", 0.5): big, ("d", 0.5): Decimal("12345678901234567890.12")}
    filled = cleaning.fill_nulls(df, ["i"], method="median")
    assert filled.where("d is null").first().i == big
    even = spark.createDataFrame([(big,), (big + 2,), (big + 3,), (big + 1,)], "i long")
    assert exact_quantiles(even, ["i"], [0.5], own_type=True)[("i", 0.5)] == pytest.approx(big + 1.5)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {("x", 0.5): None}


def test_approx_quantiles_are_close(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    assert approx_quantiles(df, ["x"], [0.5])[("x", 0.5)] == pytest.approx(50_000, abs=50)


def test_statistics_are_computed_once(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    s = one_row(df, lo=F.min("x"), hi=F.max("x"))
    out = df.select(((F.col("x") - s["lo"]) / (s["hi"] - s["lo"])).alias("y"), s["hi"].alias("z"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedSubquery") >= 2


def _k2(x):
    """D'Agostino's K² written from the paper, for comparison."""
    n = len(x)
    d = x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    g1, b2 = m3 / m2**1.5, m4 / m2**2
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w = math.sqrt(-1 + math.sqrt(2 * (beta - 1)))
    z1 = math.asinh(y / math.sqrt(2.0 / (w * w - 1))) / math.sqrt(math.log(w))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    z = (b2 - e) / math.sqrt(var)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / sb**2))
    den = 1 + z * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - np.cbrt((1 - 2 / a) / den)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def test_distribution_type(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"normal": rng.normal(size=400), "right": rng.exponential(size=400), "left": -rng.exponential(size=400), "flat": rng.random(400)})
    got = {r["column_name"]: r for r in profiling.distribution_type(spark.createDataFrame(pdf)).collect()}
    for c in pdf:
        assert got[c]["p_value"] == pytest.approx(_k2(pdf[c].to_numpy()), rel=1e-6, abs=1e-300)
        assert got[c]["skewness"] == pytest.approx(pdf[c].skew(), rel=1e-9)
    assert [got[c]["distribution"] for c in pdf] == ["normal", "right_skewed", "left_skewed", "symmetric"]
    few = profiling.distribution_type(spark.createDataFrame([(float(i),) for i in range(5)], "x double")).first()
    assert few["distribution"] == "insufficient_data"


def test_profile_of_small_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (3, "c")], "id int, value string")
    assert profiling.overview(df).first()["duplicate_rows"] == 3
    df = spark.createDataFrame([(1,), (None,), (3,), (None,), (5,)], "col1 int")
    row = profiling.overview(df).first()
    assert (row["missing_cells"], row["missing_percentage"]) == (2, 40.0)
    df = spark.createDataFrame([(i,) for i in [*range(1, 100), 1000, 2000]], "value int")
    assert profiling.outlier_counts(df).first()["outlier_count"] >= 2
    df = spark.createDataFrame([(i, i) for i in range(1, 101)], "id int, value int")
    assert profiling.quality_score(df).first()["quality_score"] >= 90
    rows = [(1, None), (1, None), (2, None), (2, "a"), (None, "b"), (None, "c")]
    df = spark.createDataFrame(rows, "id int, value string")
    assert profiling.quality_score(df).first()["quality_score"] == 78.33


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.gamma(2.0, size=500)})
    row = profiling.numeric_profile(spark.createDataFrame(pdf)).first()
    assert row["skewness"] == pytest.approx(pdf["x"].skew(), rel=1e-9)
    assert row["kurtosis"] == pytest.approx(pdf["x"].kurtosis(), rel=1e-9)
    assert row["std"] == pytest.approx(pdf["x"].std(), rel=1e-9)
    assert row["q25"] == pytest.approx(pdf["x"].quantile(0.25), rel=1e-9)


def test_sampled_profile(spark):
    df = spark.range(5_000).selectExpr("id", "id % 7 as x")
    part = profiling.sample_rows(df, 1_000, "id")
    assert part.count() == 1_000 and part.exceptAll(profiling.sample_rows(df.repartition(3), 1_000, "id")).count() == 0
    found = profiling.profile(df, sample=1_000, key="id")
    assert found["overview"].first().sampled_rows == 1_000 and found["columns"].first().row_count == 1_000
    assert profiling.profile(df, sample=9_000, key="id")["overview"].first().sampled_rows == 5_000


def test_report_lists_a_table_that_fails_while_running(spark):
    good = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "id long, `x.y` string, v double")
    bad = good.withColumn("id", F.raise_error(F.lit("no such block")).cast("long"))
    report = profiling.eda_report({"bad": bad, "good": good}).collect()
    assert [(r.section, r.metric) for r in report if r.table_name == "bad"] == [("failed", "error")]
    assert {"overview", "columns", "patterns", "quality_score", "histogram v", "skew", "distributions", "correlations", "categorical"} <= {r.section for r in report if r.table_name == "good"}


def test_profiles_scan_the_table_twice_at_most(spark, tmp_path):
    spark.range(50).selectExpr(*[f"id % {i + 2} as c{i}" for i in range(12)]).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    for found in (aggregates.column_stats(wide), profiling.describe(wide), profiling.uniqueness(wide), profiling.patterns(wide)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2


def test_distinct_counts_of_awkward_values(spark):
    df = spark.createDataFrame([(0.0, b"\xff", None), (-0.0, b"\xfe", [1]), (float("nan"), None, [1])], "d double, b binary, a array<int>")
    assert dict(tuple(r) for r in stats.distinct_counts(df, ["d", "b", "a"]).collect()) == {"d": 1, "b": 2, "a": 1}
    assert [r.unique_count for r in profiling.describe(df.limit(0)).collect()] == [0, 0, 0]


def test_sketches_of_batches_add_up(spark):
    df = spark.range(4000).select(
        (F.col("id") % 7).alias("batch"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 13 % 1000) / 10).alias("v.w"),
        F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("id") / 4).alias("f"),
        (F.col("id") % 300).cast("string").alias("t"),
        F.array("id").alias("a"),
    )
    whole = {r["column_name"]: r for r in sketches.summary(sketches.merge(sketches.sketch(df.drop("batch")))).collect()}
    parts = {r["column_name"]: r for r in sketches.summary(sketches.merge(sketches.sketch(df, by=["batch"]))).collect()}
    assert whole.keys() == parts.keys() == {"v.w", "f", "t", "a"}
    plain = df.agg(F.avg("`v.w`"), F.min("`v.w`"), F.max("`v.w`"), F.count("`v.w`"), F.percentile("`v.w`", 0.5)).first()
    for found in (whole, parts):
        v = found["v.w"]
        assert (v.row_count, v.row_count - v.null_count, v.low, v.high) == (4000, plain[3], plain[1], plain[2])
        assert v["mean"] == pytest.approx(plain[0]) and v["median"] == pytest.approx(plain[4], abs=2)
        assert found["f"].null_count == 80 and found["f"]["mean"] is not None
        assert found["t"].distinct_count == pytest.approx(300, rel=0.05) and found["t"].median is None
        assert found["a"].distinct_count == pytest.approx(4000, rel=0.05) and found["a"].null_count == 0
    assert [whole[c].row_count for c in sorted(whole)] == [parts[c].row_count for c in sorted(parts)]


def test_drift_of_stored_profiles(spark):
    old = spark.range(2000).select((F.col("id") % 100).cast("double").alias("same"), (F.col("id") % 100).cast("double").alias("shape"), F.lit(5).alias("still"), F.col("id").cast("string").alias("t"))
    # the mean stays and the middle empties
    new = old.withColumn("shape", F.when(F.col("shape") < 50, 9.0).otherwise(90.0)).withColumn("still", F.when(F.col("t") > "5", 5))
    a, b = sketches.sketch(new), sketches.sketch(old)
    got = {r["column_name"]: r for r in sketches.drift(a, b, tolerance=0.1, shape_tolerance=0.1).collect()}
    plain = {r["column_name"]: r for r in drift(new, old, ["same", "shape", "still"], 0.1).collect()}
    assert got.keys() == plain.keys()
    for c, r in plain.items():
        assert got[c]["mean"] == pytest.approx(r["mean"]) and got[c]["null_share"] == pytest.approx(r["null_share"])
    assert [got[c]["drifted"] for c in ("same", "shape", "still")] == [False, True, True]
    assert got["shape"]["shape_change"] > 0.3 and got["same"]["shape_change"] < 0.05
    assert sketches.drift(sketches.sketch(new.limit(0)), b).filter("drifted").isEmpty()


def test_shared_folder_on_a_cluster():
    from millrace.session import _below_warehouse

    assert _below_warehouse("file:/w", "local[8]") == "file:/w/_shared" and _below_warehouse("hdfs://x/w/", "yarn") == "hdfs://x/w/_shared"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            _below_warehouse("file:/w", master)
