"""Versioned tables: crashes, replays, conflicts, pruning by keys, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import key_filters, versions
from millrace.sources.versions import DataFile, VersionedTable, pack_files
from millrace.streaming import cdc, gold, silver


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_nothing_is_seen_before_the_list_is_published(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.numbers() == []
    table.add(spark.range(3).toDF("a"))
    table.write_files(spark.range(100).toDF("a"))  # a write that dies before its commit
    assert rows_of(table.read()) == [(0,), (1,), (2,)]
    table.add(spark.range(3, 5).toDF("a"), "w", 0)
    table.add(spark.range(3, 5).toDF("a"), "w", 0)  # the same batch again
    assert rows_of(table.read()) == [(i,) for i in range(5)]
    assert rows_of(table.read(1)) == [(0,), (1,), (2,)]


def test_of_two_writers_one_looks_again(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.add(spark.range(1).toDF("a"))
    second = versions.Version(2, table.version().schema, table.version().files)
    assert table._publish(second) and not table._publish(second)
    first_look, seen = table.version(), []
    real = table.version

    def late(number=None):
        if not seen and number is None:
            seen.append(1)
            VersionedTable(spark, table.path).add(spark.range(10, 11).toDF("a"))
            return first_look  # what this writer saw before the other one published
        return real(number)

    monkeypatch.setattr(table, "version", late)
    table.add(spark.range(20, 21).toDF("a"))
    assert rows_of(table.read()) == [(0,), (10,), (20,)]


def test_new_columns_are_added_and_types_kept(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.add(spark.createDataFrame([(1, "x")], "a long, b string"))
    table.add(spark.createDataFrame([(2, 0.5)], "a long, c double"))
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([(1, "x", None), (2, None, 0.5)], "a long, b string, c double"))
    with pytest.raises(ValueError):
        table.add(spark.createDataFrame([("1",)], "a string"))


def changed(spark, keys):
    return spark.createDataFrame([(k, "u" if i % 3 else "d", 10, f"new{k}") for i, k in enumerate(keys)], "k long, _cdc_operation string, lsn int, v string")


def test_few_files_are_rewritten_for_a_narrow_range(spark, tmp_path):
    target = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], file_rows=250, probe_from=0, filter_from=0)
    table.add(target.repartition(4), rows=20_000)
    before = table.version()
    assert len(before.files) == 80 and all(f.rows and f.low is not None for f in before.files)
    changes = changed(spark, [*range(5000, 5200), 20_005])
    after = cdc.merge_into(table, changes, ["lsn"], "upsert", writer="w", batch=1)
    gone = {f.path for f in before.files} - {f.path for f in after.files}
    assert 0 < len(gone) < 0.05 * len(before.files)
    want = cdc.apply_changes(target, changes, ["k"], ["lsn"], "upsert")
    assert rows_of(table.read().select("k", "v")) == rows_of(want.select("k", "v"))
    assert cdc.merge_into(table, changes, ["lsn"], "upsert", writer="w", batch=1).number == after.number


def test_filters_find_keys_where_ranges_do_not(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "part"], probe_from=0, filter_from=0)
    for i in range(12):  # every file spans nearly all keys
        rows = spark.range(200).select((F.col("id") * 12 + i).alias("k"), F.lit("é").alias("part"), F.lit(i).alias("v"))
        table.add(rows.coalesce(1))
    version = table.version()
    touched = spark.createDataFrame([(12 * 50 + 3, "é"), (12 * 70 + 3, "é")], "k long, part string")
    held = table.holding(version, touched)
    assert len(held) <= 3 and any(f in held for f in version.files if table.frame([f], version.schema).filter("v = 3").count())
    assert table.holding(version, spark.createDataFrame([(10**9, "é")], "k long, part string")) == []


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,2)", "timestamp", "int"])
def test_files_are_found_by_keys_of_any_kind(spark, tmp_path, kind):
    number = F.col("id").cast("int")
    key = {"string": F.concat(F.lit("k:%/+ "), number), "date": F.date_add(F.lit("1999-12-01").cast("date"), number), "timestamp": F.timestamp_seconds(number * 1000)}.get(kind, number)
    df = spark.range(60).select(key.cast(kind).alias("k"), "id").unionAll(spark.createDataFrame([(None, -1)], f"k {kind}, id long"))
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], file_rows=10, probe_from=0, filter_from=0)
    table.add(df, rows=61)
    base = table.version()
    for wanted in ("id = 7", "id in (0, 59)", "id = -1"):
        held = table.holding(base, df.filter(wanted))
        assert rows_of(table.frame(held, base.schema).filter(wanted)) == rows_of(df.filter(wanted))
        assert len(held) < len(base.files)


def test_partitions_with_odd_values(spark, tmp_path):
    rows = [("a:b/c%20", 1), ("é+ö", 2), (None, 3), ("", 4), ("a:b/c%20", 5)]
    df = spark.createDataFrame(rows, "p string, v long")
    table = VersionedTable(spark, str(tmp_path / "t"), partition_by=["p"])
    for i in range(4):
        table.add(df.withColumn("v", F.col("v") + 10 * i))
    want = [(p, v + 10 * i) for p, v in rows for i in range(4)]
    assert rows_of(table.read()) == sorted(want, key=repr)
    assert {f.part for f in table.version().files} >= {("a:b/c%20",), ("é+ö",), (None,)}
    version = table.compact()
    assert len(version.files) <= 5 and rows_of(table.read()) == sorted(want, key=repr)


def test_files_are_packed_first_fit_decreasing():
    files = [DataFile(f"data/w/{i}", size, part=(i % 2,)) for i, size in enumerate([5, 9, 4, 1, 6, 3, 2, 7])]
    bins = pack_files(files, 10)
    assert sorted(f.path for b in bins for f in b) == sorted(f.path for f in files)
    assert all(sum(f.size for f in b) <= 10 and len({f.part for f in b}) == 1 for b in bins) and len(bins) == 4


def test_many_batches_leave_few_files(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    most = 0
    for batch in range(200):
        table.add(spark.range(batch * 3, batch * 3 + 3, 1, 1).toDF("a"), "w", batch)
        silver.tidy(table)
        most = max(most, len(table.version().files))
    assert most <= silver.MAX_SMALL_FILES + 2
    assert rows_of(table.read()) == sorted(((i,) for i in range(600)), key=repr)
    assert table.vacuum(keep=2, older_than_seconds=-10) > 150
    assert rows_of(table.read()) == sorted(((i,) for i in range(600)), key=repr) and len(table.numbers()) == 2


def test_compaction_gives_way_to_a_merge(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    for i in range(4):
        table.add(spark.range(i * 10, i * 10 + 10, 1, 1).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    other, real = VersionedTable(spark, table.path, ["k"]), table.write_files

    def slow(df, rows=None):
        added = real(df, rows)
        cdc.merge_into(other, spark.createDataFrame([(5, "u", 1, "new")], "k long, _cdc_operation string, lsn int, v string"), ["lsn"], "upsert")
        return added

    monkeypatch.setattr(table, "write_files", slow)
    table.compact()
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 40 == table.read().count() and got[5] == "new"


def test_merge_starts_again_after_a_compaction(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    for i in range(4):
        table.add(spark.range(i * 10, i * 10 + 10, 1, 1).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    other, real, ran = VersionedTable(spark, table.path, ["k"]), table.write_files, []

    def slow(df, rows=None):
        added = real(df, rows)
        if not ran:
            ran.append(other.compact())
        return added

    monkeypatch.setattr(table, "write_files", slow)
    cdc.merge_into(table, spark.createDataFrame([(5, "u", 1, "new"), (6, "d", 1, "")], "k long, _cdc_operation string, lsn int, v string"), ["lsn"], "upsert")
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 39 == table.read().count() and got[5] == "new"


def bronze(spark, path, part):
    rng = random.Random(part)
    rows = [(rng.randint(0, 30), 100 * part + i, 1_700_000_000 + 100 * part + i, f"t{i}", rng.choice(["5.5", "-1", "7"]), "2024-01-01") for i in range(40)]
    df = spark.createDataFrame(rows, "_cdc_key long, _cdc_lsn long, s long, transaction_id string, amount string, transaction_date string")
    df.withColumn("_cdc_timestamp", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("crash", ["silver", "quarantine"])
def test_a_crash_between_files_and_list_loses_nothing(spark, tmp_path, monkeypatch, crash):
    """A run that dies between data and list, then the same checkpoint again, against a run without a crash."""
    results = {}
    for name in ("plain", "crashed"):
        source, base = str(tmp_path / f"{name}_in"), tmp_path / name
        cfg = silver.SilverStream("shop", "transactions", str(base / "silver"), str(base / "quarantine"))
        real, left = VersionedTable.commit, [2]

        def dying(self, *args, **kw):
            if self.path == getattr(cfg, crash):
                left[0] -= 1
                if left[0] == 0:
                    raise OSError("the driver is gone")
            return real(self, *args, **kw)

        for part in range(3):
            bronze(spark, source, part)
            schema = spark.read.parquet(source).schema
            for again in range(2):
                stream = spark.readStream.schema(schema).parquet(source)
                if name == "crashed" and part == 1 and not again:
                    monkeypatch.setattr(VersionedTable, "commit", dying)
                    left[0] = 1
                run = silver.start_silver_stream(stream, cfg, str(base / "chk"), True, F.lit("2024-02-01").cast("timestamp"))
                try:
                    run.awaitTermination()
                    assert not (name == "crashed" and part == 1 and not again)
                except Exception:
                    assert name == "crashed" and part == 1 and not again
                monkeypatch.setattr(VersionedTable, "commit", real)
        results[name] = rows_of(versions.read(spark, cfg.silver)), rows_of(versions.read(spark, cfg.quarantine))
    assert results["plain"] == results["crashed"] and len(results["plain"][0]) > 20 and results["plain"][1]


def test_gold_refreshes_are_counted_across_restarts(spark, tmp_path, monkeypatch):
    assets = spark.createDataFrame([(i, "pdf", "s3", "m", 0.5, "success" if i % 2 else "failed") for i in range(20)], "id long, file_type string, source string, model string, confidence double, extraction_status string")
    source = str(tmp_path / "in")
    cfg = gold.GoldStream(lambda: assets, *[str(tmp_path / n) for n in ("lineage", "gold", "refreshes")])
    schema = "asset_id long, status string, ai_model_used string, ai_confidence_score double"
    counts, total = [], 0
    for part, size in enumerate([7, 4, 25]):
        # every fifth event is of an asset that nobody knows
        spark.range(size).select((F.when(F.col("id") % 5 == 4, 999).otherwise(F.col("id") % 20)).cast("long").alias("asset_id"), F.lit(None).cast("string").alias("status"), F.lit("m").alias("ai_model_used"), F.lit(0.9).alias("ai_confidence_score")).coalesce(1).write.mode("append").parquet(source)
        total += size - size // 5
        if part == 2:  # the driver dies after the lineage rows and before the refresh
            monkeypatch.setattr(gold, "refresh", lambda *a: 1 / 0)
            with pytest.raises(Exception):
                gold.start_gold_stream(spark.readStream.schema(schema).parquet(source), cfg, str(tmp_path / "chk"), True).awaitTermination()
            monkeypatch.undo()
        gold.start_gold_stream(spark.readStream.schema(schema).parquet(source), cfg, str(tmp_path / "chk"), True).awaitTermination()
        counts.append(VersionedTable(spark, cfg.gold).version().counts.get("refreshes", 0))
        assert versions.read(spark, cfg.lineage).count() == total
    assert counts == [0, 1, 3]
    reports = rows_of(versions.read(spark, cfg.refreshes).select("refreshes", "total_assets", "new_assets"))
    assert reports == [(1, 10, 10), (3, 10, 0)]
    assert versions.read(spark, cfg.gold).count() == 10


def test_ranges_meet_files():
    files = [DataFile(f"f{i}", 1, 5, 10 * i, 10 * i + 9) for i in range(10)] + [DataFile("none", 1, 5), DataFile("empty", 1, 0)]
    hit = [f.path for f in key_filters.overlapping(files, [(12, 13), (29, 31), (200, 300)])]
    assert hit == ["f1", "f2", "f3", "none"]


def test_compaction_sorts_no_rows_without_keys(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(4):
        table.add(spark.range(i * 10, i * 10 + 10).repartition(2))
    plans, real = [], VersionedTable.write_files
    monkeypatch.setattr(VersionedTable, "write_files", lambda self, df, rows=None: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(self, df, rows))[1])
    version = table.compact()
    assert len(version.files) == 1 and sorted(r["id"] for r in table.read().collect()) == list(range(40))
    assert len(plans) == 1 and "Sort [" not in plans[0]


def test_gold_sink_holds_no_batch_in_memory(spark, tmp_path, monkeypatch):
    assets = spark.createDataFrame([(1, "pdf", "s", "m", 0.5, "success")], "id long, file_type string, source string, model string, confidence double, extraction_status string")
    cfg = gold.GoldStream(lambda: assets, *[str(tmp_path / n) for n in ("lineage", "gold", "refreshes")])
    batch = spark.createDataFrame([(i % 2, None, None, None) for i in range(40)], "asset_id long, status string, ai_model_used string, ai_confidence_score double")
    monkeypatch.setattr(type(batch), "persist", lambda *a, **k: pytest.fail("persisted"))
    for _ in range(2):  # the second time is a replay
        gold.gold_sink(cfg, F.lit("2024-01-01").cast("timestamp"))(batch, 0)
    assert versions.read(spark, cfg.lineage).count() == 20 == VersionedTable(spark, cfg.lineage).version().counts["events"]
    assert VersionedTable(spark, cfg.gold).version().counts["refreshes"] == 2


def test_filters_are_the_bitmaps_of_the_keys_without_sorting_them(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(0, 30_000, 1, 3).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), F.lit("x").alias("s")).write.parquet(path)
    rows = spark.read.parquet(path)
    made = key_filters.filters(rows, ["k", "s"], 4)
    positions = rows.select(F.col("_metadata.file_path").alias("file"), key_filters._block(["k", "s"], 4).alias("block"), "k", F.posexplode(F.array(*key_filters._positions(["k", "s"]))))
    want = positions.groupBy("file", "block").agg(F.bitmap_construct_agg("col").alias("bits"), F.count_if(F.col("pos") == 0).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


def test_merged_orders_are_kept_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    from millrace.queries import QUERIES

    orders = "id AS o_orderkey, id * 2 AS o_custkey, 'O' AS o_orderstatus, 1.5D AS o_totalprice"
    spark.range(2000).selectExpr(*orders.split(", ")).write.parquet(str(tmp_path / "orders.parquet"))
    events = "id AS event_id, 100 + id % 70 AS user_id, 'signup' AS event_type, 60D AS value"
    spark.range(100).selectExpr(*events.split(", ")).write.parquet(str(tmp_path / "events.parquet"))
    tables, real = [], versions.VersionedTable
    monkeypatch.setattr(versions, "FILE_ROWS", 40)
    monkeypatch.setattr(versions, "VersionedTable", lambda *a, **k: (tables.append(real(*a, **k)), tables[-1])[1])
    assert QUERIES["cdc_merge_files"](spark, str(tmp_path)).count() == 2000
    assert tables[0].file_rows == 40 and len(tables[0].version(1).files) >= 40
