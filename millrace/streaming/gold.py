"""Completion events as a stream: each becomes a lineage event of its asset, and the Gold table is made anew every few events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregates import promote, refresh_report
from millrace.operators.lineage import lineage_from_events
from millrace.sources.versions import VersionedTable
from millrace.streaming.silver import start, stream_id, tidy

# Fixed value: lineage events between two refreshes of the Gold table.
REFRESH_EVERY = 10


@dataclass(frozen=True)
class GoldStream:
    """Where lineage events, Gold rows and refresh reports go; ``assets`` gives the asset table as it is now."""

    assets: Callable[[], DataFrame]
    lineage: str
    gold: str
    refreshes: str
    every: int = REFRESH_EVERY


def gold_sink(cfg: GoldStream, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """The micro-batch function: lineage events of known assets, then the refresh that they make due.

    The number of lineage events is kept with the lineage table's versions and grows in the same step as its rows, so
    neither a restart nor a replayed batch counts an event twice or forgets one. A refresh is due for every ``every``
    events; a batch that makes several due refreshes once, as they would all see the same assets. The Gold table keeps the
    number of refreshes it has seen, so one that a crash has prevented is made up for by the replay.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        moment = F.current_timestamp() if now is None else now
        spark, writer = batch.sparkSession, stream_id(batch, "gold")
        assets = cfg.assets()
        lineage = VersionedTable(spark, cfg.lineage)
        if not lineage.applied(writer, batch_id):
            rows = lineage_from_events(batch, assets, moment)
            files = lineage.write_files(rows)
            count = lineage.frame(files, rows.schema).count()  # from the files' footers
            lineage.commit(rows.schema, files, writer=writer, batch=batch_id, counted={"events": count})
        tidy(lineage)
        refresh(spark, cfg, assets, lineage, moment)

    return process


def refresh(spark, cfg: GoldStream, assets: DataFrame, lineage: VersionedTable, moment: Column) -> int:
    """Make the Gold table anew if refreshes are due; returns how many were."""
    gold = VersionedTable(spark, cfg.gold)
    before = gold.version()
    due = lineage.version().counts.get("events", 0) // cfg.every - before.counts.get("refreshes", 0)
    if due > 0:
        after = gold.overwrite(promote(assets), counted={"refreshes": due})
        old = gold.frame(before.files, before.schema if before.files else after.schema)
        report = refresh_report(gold.frame(after.files, after.schema), old, moment)
        made = after.counts["refreshes"]
        VersionedTable(spark, cfg.refreshes).add(report.withColumn("refreshes", F.lit(made)), "gold", made)
    return max(due, 0)


def start_gold_stream(
    events: DataFrame, cfg: GoldStream, checkpoint: str, available_now: bool = False, now: Column | None = None
) -> StreamingQuery:
    """Stream of completion events → lineage events, Gold table and refresh reports."""
    return start(events, gold_sink(cfg, now), checkpoint, "event_gold", available_now)
