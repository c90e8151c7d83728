"""Windows over pages must equal plain windows, with a key that owns a third of the rows and many page edges."""

import pytest
from pyspark.sql import Window, functions as F

from millrace.functions import order as paging, seek
from millrace.functions.scalars import exact
from millrace.operators import profiling, windows
from millrace.sources import jdbc, layout

PAGE = 7


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string")))
    value = F.when(F.col("id") % 4 == 0, F.col("id") * 1.5)
    return spark.range(400).select("id", key.alias("k"), (F.col("id") % 9).alias("o"), value.alias("v"))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ranks(rows):
    w, ties = Window.partitionBy("k").orderBy(F.desc("o"), "id"), Window.partitionBy("k").orderBy(F.desc("o"))
    want = rows.select("id", F.row_number().over(w).alias("rn"), F.rank().over(ties).alias("rk"), F.dense_rank().over(ties).alias("dr"))
    got = windows.add_window(rows, ["k"], ["o desc", "id"], "rn", "rk", "dr", ties=1, page_rows=PAGE)
    same(got.select("id", "rn", "rk", "dr"), want)


def test_row_number_alone(rows):
    w = Window.partitionBy("k").orderBy("id")
    want = rows.select("id", F.row_number().over(w).alias("n"))
    same(windows.add_window(rows, ["k"], "id", "n", page_rows=PAGE).select("id", "n"), want)


def test_shift_and_rolling(rows):
    w = Window.partitionBy("k").orderBy("o", "id")
    want = rows.select("id", F.lag("v", 5).over(w).alias("a"), F.lead("v", 3).over(w).alias("b"), F.count("v").over(w.rowsBetween(-4, 0)).alias("c"))
    got = windows.add_window(rows, ["k"], ["o", "id"], shifts={"a": ("v", 5), "b": ("v", -3)}, page_rows=PAGE)
    got = windows.rolling_agg(got, "v", 5, "count", "k", ["o", "id"], PAGE).withColumnRenamed("v_rolling_count", "c")
    same(got.select("id", "a", "b", "c"), want)


@pytest.mark.parametrize("function", ["sum", "count", "avg", "min", "max"])
@pytest.mark.parametrize("window", [9, 50, 1000])
def test_frames_longer_than_a_page(rows, function, window):
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(-(window - 1), 0)
    plain = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}[function]
    want = rows.select("id", plain("v").over(w).alias("a"), plain("id").over(w).alias("b"))
    got = windows.rolling_agg(rows, ["v", "id"], window, function, "k", ["o", "id"], PAGE)
    same(got.select("id", F.col(f"v_rolling_{function}").alias("a"), F.col(f"id_rolling_{function}").alias("b")), want)


def test_long_frames_without_key(rows):
    w = Window.orderBy("id").rowsBetween(-99, 0)
    want = rows.select("id", F.max("v").over(w).alias("m"))
    same(windows.rolling_agg(rows, "v", 100, "max", [], "id", PAGE).select("id", F.col("v_rolling_max").alias("m")), want)


DEEP = {
    "number": lambda: F.col("id") * 7 % 391,
    "ties": lambda: F.col("id") % 3,
    "holes": lambda: F.when(F.col("id") % 4 != 0, F.col("id") * 5 % 399),
    "nothing": lambda: F.lit(None).cast("int"),
    "text": lambda: F.col("k"),
    "time": lambda: F.timestamp_seconds(F.col("id") * 3600 % 77_777),
    "day": lambda: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")),
    "float": lambda: F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3),
    "decimal": lambda: (F.col("id") / 8).cast("decimal(12,4)"),
}


@pytest.mark.parametrize("kind", sorted(DEEP))
def test_deep_pages(rows, kind):
    df = rows.withColumn("x y.z", DEEP[kind]()).select("id", exact("x y.z"))
    for down, last in ((False, False), (True, True), (False, True)):
        by = [seek.By("x y.z", down, last), seek.By("id", down)]
        everything = df.orderBy(*[b.order for b in by]).collect()
        for offset, limit in ((0, 10), (90, 20), (250, 7), (395, 20), (500, 5)):
            got = seek.page(df, by, limit, offset, held=30).collect()
            assert list(map(str, got)) == list(map(str, everything[offset : offset + limit])), (down, last, offset)


def test_gram_correlations(spark, rows):
    cells = [(F.when((F.col("id") + i) % (i + 2) != 0, (F.col("id") * (i + 3) % 101).cast("double") + 1e6 * i)).alias(f"a.{i}") for i in range(26)]
    wide = rows.select(*cells, F.lit(4.0).alias("constant"), F.lit(None).cast("double").alias("empty"))
    got = {(r["column1"], r["column2"]): r["correlation"] for r in profiling.correlations(wide).collect()}
    names = wide.columns
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    plain = [None if {"constant", "empty"} & set(pair) else F.corr(*map(exact, pair)) for pair in pairs]
    want = wide.agg(*[c.alias(f"r{i}") for i, c in enumerate(plain) if c is not None]).first()
    assert len(got) == len(pairs) == 28 * 27 // 2
    for i, pair in enumerate(pairs):
        assert got[pair] is None if plain[i] is None else got[pair] == pytest.approx(want[f"r{i}"], abs=1e-8)
    few = profiling.correlations(wide, ["a.0", "constant", "empty", "a.1"]).collect()
    assert [r["correlation"] for r in few if {"constant", "empty"} & {r["column1"], r["column2"]}] == [None] * 5


def test_many_columns_run(spark):
    wide = spark.range(200).select(*[((F.col("id") * (i + 1)) % 101).alias(f"c{i}") for i in range(300)])
    assert profiling.correlations(wide).count() == 300 * 299 // 2
    assert profiling.correlations(wide.limit(0)).filter("correlation is not null").isEmpty()


def test_forward_fill(rows):
    w = Window.partitionBy("k").orderBy("o", "id")
    want = rows.select("id", F.last("v", ignorenulls=True).over(w).alias("v"))
    same(windows.forward_fill(rows, "k", ["o", "id"], "v", PAGE).select("id", "v"), want)


def test_forward_fill_without_key(rows):
    w = Window.orderBy("id")
    want = rows.select("id", F.last("v", ignorenulls=True).over(w).alias("v"))
    same(windows.forward_fill(rows, [], "id", "v", PAGE).select("id", "v"), want)


def test_envelopes(rows):
    got = layout.to_envelopes(rows.filter("k IS NOT NULL"), ["k"], ["id"], 10, PAGE).collect()
    sizes = {}
    for r in got:
        assert len(r["records"]) == r["record_count"] <= 10
        sizes[r["k"]] = sizes.get(r["k"], 0) + r["record_count"]
    assert sizes["hot"] == 134
    assert {r["total_batches"] for r in got if r["k"] == "hot"} == {14}


def test_split_points_with_a_hot_value(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("x"))
    values = sorted(r[0] for r in df.collect())
    got = {r["split"]: r["bound"] for r in jdbc.partition_bounds(df, "x", 4).collect()}
    assert got == {**{i: values[i * 1500] for i in range(4)}, 4: values[-1]}
    small = spark.createDataFrame([(v,) for v in (4, 9, 2)], "x long")
    assert sorted(tuple(r) for r in jdbc.partition_bounds(small, "x", 5).collect()) == [(0, 2), (1, 4), (2, 9), (5, 9)]


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") % 13).alias("a"), "id")
    got = paging.sorted_positions(df, F.col("a"), F.col("id")).collect()
    order = sorted(got, key=lambda r: (r["a"], r["id"]))
    assert [r["_pos"] for r in order] == list(range(1000))


def test_keyed_first_row_is_limited_before_the_shuffle(rows):
    plan = windows.deduplicate(rows, "k", "id")._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle


def test_ordered_windows_take_map_columns(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, None), (1, 3, {"b": 2})], "k long, o long, m map<string,int>")
    numbered = paging.running(paging.paged(df, ["k"], [F.col("o")]), ["k"], paging.row_numbers("n"))
    assert [(r["o"], r["n"]) for r in numbered.orderBy("o").collect()] == [(1, 1), (2, 2), (3, 3)]
