import datetime as dt
import random

import pytest
from pyspark.sql import functions as F, types as T

from millrace.sources import versions
from millrace.streaming import cdc, monitor, silver


def replay(target, changes, policy):
    """One change after the other, as the policies are written."""
    table = dict(target)
    for _, key, op, value in sorted(changes):
        if op == "d":
            table.pop(key, None)
        elif policy == "upsert":
            table[key] = value
        elif key in table and op in ("u", "r"):
            table[key] = value
        elif key not in table and op in ("c", "r"):
            table[key] = value
    return table


@pytest.mark.parametrize("policy", ["snapshot", "upsert"])
def test_merge_equals_replay(spark, policy):
    rng = random.Random(4)
    target = [(k, f"t{k}") for k in range(0, 60, 2)]
    hot = [7] * 30
    changes = [(lsn, rng.choice([*range(60), *hot]), rng.choice("curd"), f"v{lsn}") for lsn in range(300)]
    t = spark.createDataFrame(target, "k int, v string")
    c = spark.createDataFrame(changes, "lsn int, k int, _cdc_operation string, v string")
    got = {r["k"]: r["v"] for r in cdc.apply_changes(t, c, ["k"], ["lsn"], policy).collect()}
    want = replay(target, changes, policy)
    assert got == want


def test_merge_ignores_late_changes(spark):
    t = spark.createDataFrame([(1, 10, "new")], "k int, lsn int, v string")
    c = spark.createDataFrame([(1, 9, "u", "old"), (2, 1, "c", "first")], "k int, lsn int, _cdc_operation string, v string")
    got = sorted(map(tuple, cdc.apply_changes(t, c, ["k"], ["lsn"]).select("k", "lsn", "v").collect()))
    assert got == [(1, 10, "new"), (2, 1, "first")]


def test_merge_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, lsn int, v string")
    c = spark.createDataFrame([(1, 5, "u", "x"), (3, 6, "c", "y")], "k int, lsn int, _cdc_operation string, v string")
    once = cdc.apply_changes(t, c, ["k"], ["lsn"])
    twice = cdc.apply_changes(once, c, ["k"], ["lsn"])
    assert cdc.differing_rows(once, twice, ["k"]).isEmpty()


def test_merge_text():
    sql = cdc.merge_sql("t", "s", ["id"], ["id", "v"])
    assert "ON t.id <=> s.id" in sql and "UPDATE SET t.v = s.v" in sql and "INSERT (id, v)" in sql


def test_operation_names(spark):
    names = ["c", "INSERT", "create", "u", "Replace", "update", "d", "DELETE", "r", "truncate", None]
    df = spark.createDataFrame([(n,) for n in names], "op string").select(cdc.normalize_op(F.col("op")))
    assert [r[0] for r in df.collect()] == ["c", "c", "c", "u", "u", "u", "d", "d", "r", None, None]


def test_keys_come_from_all_records(spark):
    df = spark.createDataFrame([('{"a": 1, "__op": "c"}', "c", 1000), ('{"b": 2}', "u", 2000)], "record string, operation string, source_ts_ms long")
    out = cdc.expand_record(df)
    assert out.columns == ["a", "b", "_cdc_operation", "_cdc_timestamp"]
    assert [(r["a"], r["b"]) for r in out.collect()] == [("1", None), (None, "2")]


def _bronze(spark, path, files):
    for i in range(files):
        rows = spark.range(20).select(
            (F.col("id") % 6).alias("_cdc_key"),
            (F.col("id") + 20 * i).alias("_cdc_lsn"),
            F.timestamp_seconds(F.col("id") + 20 * i).alias("_cdc_timestamp"),
            F.concat(F.lit(" "), F.col("id").cast("string")).alias("transaction_id"),
            F.when(F.col("id") % 5 == 0, -1.0).otherwise(F.col("id").cast("double")).cast("string").alias("amount"),
            F.lit("2024-01-01").alias("transaction_date"),
        )
        rows.coalesce(1).write.parquet(f"{path}/part{i}")
    return spark.read.option("recursiveFileLookup", "true").parquet(path).schema


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "bronze")
    schema = _bronze(spark, path, 3)
    cfg = silver.SilverStream("shop", "transactions", str(tmp_path / "silver"), str(tmp_path / "quarantine"))
    now = F.lit("2024-01-01").cast("timestamp")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    run = silver.start_silver_stream(stream, cfg, str(tmp_path / "chk"), True, now)
    run.awaitTermination()
    out = versions.read(spark, cfg.silver)
    # in every batch the newest change of key 3 fails; of the other keys the newest change of all batches is left
    assert sorted((r["_cdc_key"], r["_cdc_lsn"]) for r in out.collect()) == [(0, 58), (1, 59), (2, 54), (4, 56), (5, 57)]
    bad = versions.read(spark, cfg.quarantine)
    assert bad.count() == 3 and bad.filter("NOT _dq_negative_amount").count() == 0
    batch = spark.read.parquet(f"{path}/part0")
    clean, failed = silver.clean_batch(batch, cfg, now)
    assert clean.count() + failed.count() == 6
    before = sorted(map(tuple, out.collect()))
    silver.silver_sink(cfg, now)(spark.read.parquet(f"{path}/part1"), 1)
    spark.catalog.clearCache()
    assert sorted(map(tuple, versions.read(spark, cfg.silver).collect())) == before
    metrics = monitor.recent_progress(spark, [run])
    assert metrics.agg(F.sum("input_rows")).first()[0] == 60


def test_unusable_messages_go_to_the_error_folder(spark, tmp_path):
    rows = [('{"__op": "c", "__source_table": "t", "__source_db": "d"}',), ("broken",), ('{"__source_table": "t"}',)]
    parsed = cdc.parse_cdc(spark.createDataFrame(rows, "value string"))
    silver.route_batch(str(tmp_path / "ok"), str(tmp_path / "err"))(parsed, 0)
    assert versions.read(spark, str(tmp_path / "ok")).count() == 1
    errors = {r["error"] for r in versions.read(spark, str(tmp_path / "err")).collect()}
    assert errors == {"no source table", "no operation"}


def test_alerts(spark):
    rows = [("a", 1, 5, 1.0, 1.0, 10, 0, None), ("b", 2, 5, 1.0, 1.0, 10, 200_000, None), ("c", -1, 0, 0.0, 0.0, 0, 0, "boom")]
    got = {r["query"]: r["severity"] for r in monitor.alerts(spark.createDataFrame(rows, monitor.SCHEMA)).collect()}
    assert got == {"b": "WARNING", "c": "ERROR"}


@pytest.mark.parametrize("stored", [False, True])
def test_monitor_listener(spark, tmp_path, stored):
    watch = monitor.QueryMonitor(str(tmp_path / "progress") if stored else None)
    spark.streams.addListener(watch)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run = silver.start(stream, lambda df, i: df.count(), str(tmp_path / "chk"), "watched", True)
    run.awaitTermination()
    for _ in range(50):
        if watch.rows:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(watch)
    assert watch.metrics(spark).filter("query = 'watched'").agg(F.sum("input_rows")).first()[0] == 10


def test_late_duplicates_option(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1, 0, 1)), (2, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("ts", T.TimestampType())])
    stream = silver.drop_late_duplicates(silver.stream_table(spark, str(tmp_path / "in"), schema), ["id"], "ts", "1 hour")
    seen = []
    run = silver.start(stream, lambda df, i: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "chk"), "late", True)
    run.awaitTermination()
    assert sorted(seen) == [1, 2]
