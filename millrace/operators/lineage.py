"""Lineage edges, closures, graphs, and audit reports as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators.rules import LINEAGE_EVENTS, Rule, rule
from millrace.operators.windows import recent
from millrace.session import stage

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("source_layer", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("source_location", T.StringType()),
        T.StructField("target_layer", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("target_location", T.StringType()),
        T.StructField("transformation_type", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
LAYERS = ["source", "bronze", "silver", "gold"]


def edge_rules() -> list[Rule]:
    """What an edge must satisfy to be recorded."""
    return [
        rule("not_null", columns=["source_table", "target_table", "created_at"], name="edge_complete"),
        rule("enum", "source_layer", values=LAYERS),
        rule("enum", "target_layer", values=LAYERS),
        rule("sql", name="row_count_not_negative", expr="row_count >= 0"),
    ]


def event_rules() -> list[Rule]:
    """What an asset lineage event must satisfy."""
    return [rule("enum", "event_type", values=LINEAGE_EVENTS), rule("range", "quality_score", min=0, max=1)]


def record_lineage(spark: SparkSession, path: str, edge: Mapping[str, object]) -> None:
    """Append one edge to the edge table; unknown layers and missing tables are refused."""
    for side in ("source", "target"):
        if edge.get(f"{side}_layer") not in LAYERS or not edge.get(f"{side}_table"):
            raise ValueError(f"{side} layer and table are required; layers are {LAYERS}")
    row = {f.name: edge.get(f.name) for f in EDGE_SCHEMA.fields}
    row["is_valid"] = True if row["is_valid"] is None else row["is_valid"]
    spark.createDataFrame([tuple(row.values())], EDGE_SCHEMA).write.mode("append").parquet(path)


DIRECTIONS = {"downstream": ("source_table", "target_table"), "upstream": ("target_table", "source_table")}
# So many hops are walked one by one before what is left is folded up.
WALK = 4


def lineage(edges: DataFrame, table: str, direction: str = "downstream", depth: int | None = 3) -> DataFrame:
    """(table_name, depth): tables reachable from ``table`` with the smallest number of hops; cycles are cut.

    ``depth=None`` goes on until nothing new is found.
    """
    return closure(edges, table, [direction], depth).select("table_name", "depth")


def closure(edges: DataFrame, table: str, directions: Sequence[str] = ("downstream", "upstream"), depth: int | None = None) -> DataFrame:
    """(direction, table_name, depth): tables reachable in each of the directions, which are searched together.

    The first ``WALK`` hops go hop by hop, each with one look at the edges; most searches end there, bounded or not. A longer
    one folds up stretches without branches: a table with one way in, from a table with one way out, takes over that table's
    place by path doubling, which halves the remaining stretch in every round. What is left, joined by edges with lengths, is
    searched branch by branch. So the number of rounds is that of the branches on the longest way plus the logarithm of the
    longest stretch, each with rows of at most the number of edges; pairs of tables far apart are never made.
    """
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1, or None for no bound")
    sides = [
        edges.select(F.lit(d).alias("direction"), F.col(DIRECTIONS[d][0]).alias("near"), F.col(DIRECTIONS[d][1]).alias("far")) for d in directions
    ]
    hops = reduce(DataFrame.unionAll, sides).filter((F.col("near") != F.col("far")) & (F.col("far") != table))
    begin = F.explode(F.array(*[F.lit(d) for d in directions])).alias("direction")
    starts = edges.sparkSession.range(1).select(begin, F.lit(table).alias("node"), F.lit(0).alias("depth"))  # known to be small
    found = _walked(hops, starts, depth)
    found = _folded_search(hops, starts, depth) if found is None else found
    return found.filter("depth > 0").select("direction", F.col("node").alias("table_name"), "depth")


def _walked(hops: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame | None:
    """Tables within the bound, or all there are; None if more than ``WALK`` hops are needed to tell.

    Each hop is a join with the few tables found by the one before, which are written once.
    """
    reached, here = starts, starts
    for hop in range(1, WALK + 1):
        near = here.select("direction", F.col("node").alias("near"))
        met = hops.join(near, ["direction", "near"], "left_semi").select("direction", F.col("far").alias("node")).distinct()
        new = met.join(reached.select("direction", "node"), ["direction", "node"], "left_anti")
        here = stage(new, "hop").withColumn("depth", F.lit(hop))
        if here.isEmpty():
            return reached
        reached = reached.unionAll(here)
        if hop == depth:
            return reached
    return None


def _folded_search(hops: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """Tables at any distance: stretches without branches are folded up first."""
    hops = stage(hops.distinct(), "hops")
    ways_out = hops.groupBy("direction", F.col("near").alias("up")).agg(F.count("*").alias("out"))
    ways_in = hops.groupBy("direction", F.col("far").alias("node")).agg(F.count("*").alias("in"), F.min("near").alias("up"))
    attached = ways_in.filter("in = 1").join(ways_out.filter("out = 1"), ["direction", "up"])
    folded = _doubled(stage(attached.select("direction", "node", "up", F.lit(1).alias("off")), "stretch"))

    top = folded.select("direction", F.col("node").alias("near"), "up", "off")
    inner = folded.select("direction", F.col("node").alias("far"))
    begun = hops.join(inner, ["direction", "far"], "left_anti").join(top, ["direction", "near"], "left")
    ways = begun.select("direction", F.coalesce("up", "near").alias("node"), "far", (F.coalesce("off", F.lit(0)) + 1).alias("length"))
    ways = stage(ways.groupBy("direction", "node", "far").agg(F.min("length").alias("length")), "ways")
    reached, front = starts, starts
    for _ in count():
        steps = front.join(ways, ["direction", "node"]).select("direction", F.col("far").alias("node"), (F.col("depth") + F.col("length")).alias("depth"))
        best = steps.groupBy("direction", "node").agg(F.min("depth").alias("depth"))
        best = best if depth is None else best.filter(F.col("depth") <= depth)
        known = reached.select("direction", "node", F.col("depth").alias("_known"))
        nearer = best.join(known, ["direction", "node"], "left").filter("_known is null or depth < _known").drop("_known")
        front = stage(nearer, "front")
        if front.isEmpty():
            break
        reached = stage(reached.unionAll(front).groupBy("direction", "node").agg(F.min("depth").alias("depth")), "reached")
    inside = folded.join(reached.withColumnRenamed("node", "up"), ["direction", "up"])
    inside = inside.select("direction", "node", (F.col("depth") + F.col("off")).alias("depth"))
    everything = reached.unionAll(inside)
    return everything if depth is None else everything.filter(F.col("depth") <= depth)


def _doubled(attached: DataFrame) -> DataFrame:
    """(direction, node, up, off): the top of each attached table's stretch, and how far above it is.

    Each round looks up where the place looked up so far points to. Only a ring of attached tables goes on for ever; nothing
    leads into it from outside, so what still moves after more rounds than any stretch needs is dropped.
    """
    rows = attached.count()
    for done in count():
        further = attached.select("direction", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("off").alias("_off"))
        looked = attached.join(further, ["direction", "up"], "left")
        moving = F.col("_up").isNotNull()
        if 1 << done > rows:
            return stage(looked.filter(~moving).select("direction", "node", "up", "off"), "stretch")
        attached = stage(
            looked.select("direction", "node", F.coalesce("_up", "up").alias("up"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), moving.alias("moving")),
            "stretch",
        )
        if attached.filter("moving").isEmpty():
            return attached.drop("moving")
        attached = attached.drop("moving")


def impact(edges: DataFrame, table: str) -> DataFrame:
    """One row: how many tables feed the table and depend on it at any distance, and the risk of changing it."""
    found = closure(edges, table)
    n = F.col("total_downstream")
    counts = found.agg(
        F.count_if(F.col("direction") == "upstream").alias("total_upstream"), F.count_if(F.col("direction") == "downstream").alias("total_downstream")
    )
    return counts.select(
        F.lit(table).alias("table_name"),
        "total_upstream",
        "total_downstream",
        F.when(n > 5, "high").when(n > 0, "medium").otherwise("low").alias("risk_level"),
    )


def valid(edges: DataFrame) -> DataFrame:
    return edges.filter("is_valid") if "is_valid" in edges.columns else edges


def graph_edges(edges: DataFrame) -> DataFrame:
    """Count per (from, to, transformation type)."""
    return valid(edges).groupBy("source_table", "target_table", "transformation_type").agg(F.count("*").alias("transformation_count"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Tables with layer, short name and the number of transformations that produce them."""
    good = valid(edges)
    ends = good.groupBy(F.col("source_table").alias("table_name"), F.col("source_layer").alias("layer")).agg(
        F.lit(0).cast("bigint").alias("n")
    )
    ends = ends.unionAll(good.groupBy("target_table", "target_layer").agg(F.count("*").alias("n")))
    nodes = ends.groupBy("table_name").agg(F.min("layer").alias("layer"), F.sum("n").alias("transformation_count"))
    return nodes.withColumn("name", F.element_at(F.split("table_name", r"\."), -1))


def layer_totals(edges: DataFrame) -> DataFrame:
    """Number of different tables per layer, over both ends of the edges."""
    a = edges.select(F.col("source_layer").alias("layer"), F.col("source_table").alias("table_name"))
    b = edges.select("target_layer", "target_table")
    return a.union(b).distinct().groupBy("layer").agg(F.count("*").alias("table_count"))


def lineage_summary(edges: DataFrame, since: Column | None = None) -> DataFrame:
    """Per pair of layers: transformations, different tables, first and last time."""
    good = valid(edges)
    if since is not None:
        good = good.filter(F.col("created_at") >= since)
    return good.groupBy("source_layer", "target_layer").agg(
        F.count("*").alias("transformation_count"),
        F.count_distinct("source_table").alias("unique_sources"),
        F.count_distinct("target_table").alias("unique_targets"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def trail(events: DataFrame, key: str, value: object, ts: str, tie: str) -> DataFrame:
    """Events of one asset in time order, numbered from 1."""
    one = events.filter(F.col(key) == F.lit(value))
    return one.orderBy(ts, tie)


def lineage_history(edges: DataFrame, since: Column) -> DataFrame:
    """Per day and pair of layers, valid rows only: transformations and different batches, from the ``batch_id`` column."""
    good = valid(edges).filter(F.col("created_at") >= since)
    return good.groupBy(F.to_date("created_at").alias("day"), "source_layer", "target_layer").agg(
        F.count("*").alias("transformation_count"), F.count_distinct("batch_id").alias("batch_count")
    )


def audit_history(audit_rows: DataFrame, since: Column) -> DataFrame:
    """Per day and category: events, successes, failures."""
    recent_rows = audit_rows.filter(F.col("event_timestamp") >= since)
    return recent_rows.groupBy(F.to_date("event_timestamp").alias("day"), "event_category").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
    )


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Per job type and status: jobs, rows, and the mean duration of completed jobs in seconds."""
    done = F.when(F.lower("status") == "completed", F.col("duration_seconds"))
    return jobs.groupBy("job_type", "status").agg(
        F.count("*").alias("job_count"), F.sum("rows").alias("total_rows"), F.avg(done).alias("avg_duration_seconds")
    )


def combined_report(edges: DataFrame, audit_rows: DataFrame, since: Column, latest: int = 10) -> DataFrame:
    """A period in one table of (section, name, value): edges per pair of layers, audit rows per category and status,
    different tables per layer, and the ``latest`` transformations with their times."""
    good = valid(edges).filter(F.col("created_at") >= since)
    pair = F.concat_ws(" -> ", "source_layer", "target_layer")

    def part(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value"))

    audits = audit_rows.filter(F.col("event_timestamp") >= since).groupBy("event_category", "status").agg(F.count("*").alias("n"))
    newest = good.orderBy(F.col("created_at").desc(), "source_table", "target_table").limit(latest)
    return (
        part(good.groupBy("source_layer", "target_layer").agg(F.count("*").alias("n")), "layers", pair, F.col("n"))
        .unionAll(part(audits, "audit", F.concat_ws(" ", "event_category", "status"), F.col("n")))
        .unionAll(part(layer_totals(good), "tables", F.col("layer"), F.col("table_count")))
        .unionAll(part(newest, "latest", F.concat_ws(" -> ", "source_table", "target_table"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")))
    )


def history_by_day(
    lineage_rows: DataFrame, audit_rows: DataFrame, since: Column, lineage_ts: str = "created_at", audit_ts: str = "event_timestamp"
) -> DataFrame:
    """Per day: lineage rows, audit rows, and the audit rows split into success and failure."""
    a = lineage_rows.filter(F.col(lineage_ts) >= since).groupBy(F.to_date(lineage_ts).alias("day")).agg(
        F.count("*").alias("lineage_count")
    )
    b = audit_rows.filter(F.col(audit_ts) >= since).groupBy(F.to_date(audit_ts).alias("day")).agg(
        F.count("*").alias("audit_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
    )
    return a.join(b, "day", "full_outer").fillna(0)


def audit_summary(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Per category: events, successes, failures."""
    if since is not None:
        df = df.filter(F.col("event_timestamp") >= since)
    return df.groupBy("event_category").agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
    )


def audit(
    df: DataFrame,
    category: str | None = None,
    like: str | None = None,
    since: Column | None = None,
    n: int | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Audit rows of a category, type pattern and period; with ``n`` only the newest ones, newest first."""
    if category is not None:
        df = df.filter(F.col("event_category") == category)
    if like is not None:
        df = df.filter(F.col("event_type").like(like))
    if since is not None:
        df = df.filter(F.col("event_timestamp") >= since)
    return df if n is None else recent(df, ["event_timestamp", tie], n)


def quality_trend(edges: DataFrame, since: Column, path: str = "$.quality_score", ts: str = "created_at") -> DataFrame:
    """Per day: measurements and mean, lowest and highest quality score found in the JSON metadata."""
    score = F.get_json_object("metadata", path).try_cast("double")
    scored = edges.filter(F.col(ts) >= since).withColumn("_score", score).filter("_score IS NOT NULL")
    return scored.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("measurements"),
        F.avg("_score").alias("avg_score"),
        F.min("_score").alias("min_score"),
        F.max("_score").alias("max_score"),
    )


def table_report(edges: DataFrame, audit_rows: DataFrame, table: str) -> DataFrame:
    """One row: edges into and out of the table, neighbours, and audit rows that name it."""
    up, down = F.col("target_table") == table, F.col("source_table") == table
    audits = audit_rows.filter(F.col("table_name") == table).agg(F.count("*").alias("n")).scalar()
    return (
        valid(edges)
        .filter(up | down)
        .agg(
            F.count_if(up).alias("upstream_edges"),
            F.count_if(down).alias("downstream_edges"),
            F.count_distinct(F.when(up, F.col("source_table"))).alias("upstream_tables"),
            F.count_distinct(F.when(down, F.col("target_table"))).alias("downstream_tables"),
            F.max("created_at").alias("last_change"),
        )
        .select(F.lit(table).alias("table_name"), "*", audits.alias("audit_rows"))
    )


def ingestion_report(jobs: DataFrame) -> DataFrame:
    """One row over a list of jobs: counts by status, rows, files, bytes."""
    status = F.lower("status")
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(status == "success").alias("successful_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "skipped").alias("skipped_jobs"),
        F.sum("rows").alias("total_rows"),
        F.sum("files").alias("total_files"),
        F.sum("bytes").alias("total_bytes"),
        (F.sum("bytes") / (1024 * 1024)).alias("total_size_mb"),
    )


def lineage_from_events(events: DataFrame, assets: DataFrame, now: Column, source: str = "silver/", dest: str = "gold/") -> DataFrame:
    """Completion events of known assets as lineage events; works on a stream joined to the asset table.

    Values missing in the event come from the asset. Failed processing is its own event type.
    """
    known = assets.select(
        F.col("id").alias("asset_id"),
        "file_type",
        "source",
        F.col("model").alias("_model"),
        F.col("confidence").alias("_confidence"),
    )
    status = F.coalesce("status", F.lit("success"))
    details = F.struct("file_type", "source", status.alias("status"))
    return events.join(known, "asset_id").select(
        "asset_id",
        F.when(status == "success", "silver_processed").otherwise("silver_failed").alias("event_type"),
        now.alias("event_time"),
        F.coalesce("ai_model_used", "_model").alias("model_used"),
        F.coalesce("ai_confidence_score", "_confidence").alias("quality_score"),
        F.lit(source).alias("source_bucket"),
        F.lit(dest).alias("dest_bucket"),
        F.to_json(details).alias("metadata"),
    )
