import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import scalars
from millrace.sources import files, jdbc, kafka, layout, tables
from millrace.streaming.watermarks import Watermarks


def test_line_files_are_split(spark, tmp_path):
    lines = "\n".join(f"{i},{'x' * 50}" for i in range(20_000))
    (tmp_path / "big.csv").write_text("id,name\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = files.read_files(spark, str(tmp_path / "big.csv"), schema="id long, name string")
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000 and df.schema["id"].dataType.typeName() == "long"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_release_removes_what_was_staged(spark, tmp_path):
    import pathlib

    session.release(spark)
    staged = session.stage(spark.range(100))
    kept = staged.agg(F.sum("id").alias("s"))
    kept.write.parquet(str(tmp_path / "kept"))
    folder = pathlib.Path(session._staged[0].removeprefix("file:"))
    assert folder.exists() and session.release(spark) == 1 and not folder.exists()
    assert spark.read.parquet(str(tmp_path / "kept")).first().s == 4950 and session.release(spark) == 0


def test_writers_gather_their_partitions(spark, tmp_path):
    df = spark.range(2000).repartition(8).select("id", F.concat(F.lit("t"), F.col("id") % 5).alias("tenant"), F.lit("r").alias("rule_id"))
    layout.write_tenants(df, str(tmp_path / "t"), "tenant")
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 5
    for _ in range(2):  # the second try of the job replaces the first
        target = layout.write_quarantine(df, str(tmp_path / "q"), "job", F.lit("2024-01-01").cast("timestamp"), by_rule=True)
    assert spark.read.parquet(target).count() == 2000 and len(list((tmp_path / "q").rglob("*.parquet"))) == 1


def test_different_rows_have_different_hashes(spark):
    df = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), (None, "c"), ("\\N", "c")], "x string, y string")
    assert df.select(scalars.md5_of(["x", "y"]).alias("h")).distinct().count() == 4


def test_read_files_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,Ann\n2,\"Bo\nb\"\n".encode())
    df = files.read_files(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert df.columns == ["id", "name"] and [r["id"] for r in df.collect()] == ["1", "2"]
    (tmp_path / "o.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.read_files(spark, str(tmp_path / "o.json"), multi_line=True).count() == 1
    assert files.read_files(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"b": 3}\n')
    assert files.read_files(spark, str(tmp_path / "r.jsonl")).columns == ["a", "b"]
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    row = files.read_files(spark, str(tmp_path / "x.bin")).first()
    assert (row["size"], row["content_base64"]) == (2, "AAE=")
    with pytest.raises(ValueError):
        files.read_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "x.bin")])


def test_list_files_since(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("one.csv", "d/two.pdf", "d/three.MP4"):
        (tmp_path / name).write_text("x" * len(name))
    rows = {r["key"].rsplit("/", 1)[-1]: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert {k: r["type"] for k, r in rows.items()} == {"one.csv": "structured", "two.pdf": "document", "three.MP4": "video"}
    assert files.list_files(spark, str(tmp_path), exts=[".pdf"]).count() == 1
    assert files.list_files(spark, str(tmp_path), pattern="/d/").count() == 2
    assert files.list_files(spark, str(tmp_path), since="2999-01-01 00:00:00").count() == 0
    plan = files.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_media_inventory(spark, tmp_path):
    for name in ("a.JPG", "b.wav", "c.mkv", "d.docx", "e.xyz"):
        (tmp_path / name).write_text("x")
    got = {r["name"]: r["media_type"] for r in files.media_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": "image", "b.wav": "audio", "c.mkv": "video", "d.docx": "document", "e.xyz": "other"}


def test_discover_tables(spark, tmp_path):
    for where in ("pg/users", "pg/orders", "s3/logs", "quality_reports/x", ".hidden/y"):
        spark.range(10).repartition(2).write.parquet(str(tmp_path / where))
    (tmp_path / "pg" / "empty").mkdir()
    got = {(r["source"], r["table"]): r["file_count"] for r in tables.discover_tables(spark, str(tmp_path)).collect()}
    assert got == {("pg", "users"): 2, ("pg", "orders"): 2, ("s3", "logs"): 2}


def test_bronze_scan_pushes_the_watermark(spark, tmp_path):
    ref = tables.TableRef(str(tmp_path), "bronze", "finance", "pg", "tx")
    spark.range(100).write.parquet(ref.path + "/2024/01")
    (tmp_path / "bronze/finance/pg/tx/readme.txt").write_text("not parquet")
    df = tables.read_bronze(spark, ref, "incremental", "id", 89)
    assert df.count() == 10
    assert "GreaterThan(id,89)" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.read_bronze(spark, ref, "incremental")


def test_jdbc_options():
    o = jdbc.jdbc_options("jdbc:x", "t", "id", 1, 100_000, 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "1", "100001", "8")
    assert "partitionColumn" not in jdbc.jdbc_options("jdbc:x", "t", "id", 1, 900, 8, min_keys=1000)
    since = jdbc.jdbc_options("jdbc:x", "t", since=("ts", "2024-01-01 o'clock"))["dbtable"]
    assert since == "(SELECT * FROM t WHERE ts > '2024-01-01 o''clock') AS incremental"


def test_range_predicates_cover_every_key():
    preds = jdbc.range_predicates("id", [1, 10, 20, 30])
    assert preds == ["id < 10 OR id IS NULL", "id >= 10 AND id < 20", "id >= 20"]
    assert jdbc.range_predicates("id", [1, 9]) == ["1=1"]


def test_kafka_options():
    o = kafka.stream_options("h:9092", "cdc.*")
    assert o["subscribePattern"] == "cdc.*" and "maxOffsetsPerTrigger" not in o and o["failOnDataLoss"] == "false"
    assert kafka.stream_options("h:9092", "cdc.*", 500)["maxOffsetsPerTrigger"] == "500"
    b = kafka.batch_options("h:9092", ["a", "b"], dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    assert b["subscribe"] == "a,b" and b["startingTimestamp"] == "1704067200000" and "startingOffsets" not in b


def test_topics(spark):
    names = ["cdc_postgres.public.users", "client.public.t", "cdc_mysql.t", "single", "cdc.db.s.t"]
    df = kafka.parse_topic(spark.createDataFrame([(n,) for n in names], "topic string"))
    got = {r["topic"]: (r["source"], r["schema"], r["table"], r["full_name"]) for r in df.collect()}
    assert got["cdc_postgres.public.users"] == ("postgres", "public", "users", "public.users")
    assert got["client.public.t"] == ("postgres", "public", "t", "public.t")
    assert got["cdc_mysql.t"] == ("mysql", "public", "t", "t")
    assert got["single"][0] == "unknown"
    assert got["cdc.db.s.t"] == ("cdc", "db", "t", "db.s.t")
    slug = spark.range(1).select(kafka.table_slug(F.lit("Raw/My File (1).csv")).alias("s")).first()["s"]
    assert slug == "raw_my_file_1_csv"


def test_partition_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15),)], "ts timestamp")
    assert tuple(layout.add_partition_columns(df, "ts").first())[1:] == (2024, 1, 15)
    assert layout.add_partition_columns(df, "ts", hive=True).columns == ["ts", "year", "month", "day"]


def test_bronze_metadata(spark):
    df = spark.createDataFrame([(1, "Alice"), (1, "Alice"), (2, None)], "id int, name string")
    out = layout.add_bronze_metadata(df, "crm", "customers", "run", F.lit("2024-01-01").cast("timestamp"))
    assert len(out.columns) == 8
    hashes = [r["_row_hash"] for r in out.collect()]
    assert hashes[0] == hashes[1] != hashes[2] and len(hashes[0]) == 64


def test_watermarks(spark, tmp_path):
    assert Watermarks(spark, str(tmp_path / "none")).get("a", dt.datetime(2024, 1, 10)) is None  # reads everything
    marks, now = Watermarks(spark, str(tmp_path / "marks"), dt.timedelta(days=7)), dt.datetime(2024, 1, 10)
    assert marks.get("a", now) == "2024-01-03 00:00:00"
    rows = spark.createDataFrame([("2024-01-05",), ("2024-01-04",)], "ts string")
    assert marks.advance("a", rows, "ts", now) == "2024-01-05"
    assert marks.get("a", now) == "2024-01-05"
    assert marks.advance("a", rows.limit(0), "ts", now) is None
    assert marks.get("a", now) == "2024-01-05"
    marks.reset("a", dt.datetime(2024, 1, 11))
    assert marks.get("a", now) == "2024-01-03 00:00:00"
