"""Embedded rows that keep arriving, merged into the stored table exactly once.

Every micro-batch is a keyed load (``plans.curate.load``): within a batch the last row of a key
wins, and a later batch wins over an earlier one. Structured Streaming offers a micro-batch again, under
its old number, when a query stopped between the load and its own note of it. The table's ledger is
committed with the data and has the query's id with the number of its last batch, so what is there
already is left out, and what is not is merged as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from catalith.plans.curate import load
from catalith.session import scratch_scope, settle
from catalith.sources.snapshots import SnapshotTable

#: What becomes of a micro-batch before it is loaded.
Prepare = Callable[[DataFrame, int], DataFrame]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def upsert_batch(
    table: SnapshotTable,
    pipeline_version: str,
    order: str = "row_pos",
    source: str | None = None,
    prepare: Prepare | None = None,
    clock: Callable[[], dt.datetime] = _now,
    on_report: Callable[[int, DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """The function that ``foreachBatch`` calls.

    ``source`` is the name in the ledger, by default the id that the query keeps in its
    checkpoint. ``prepare`` gets the rows and the batch's number, only for batches not loaded yet.
    """

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        name = source or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if table.has_batch(name, number):
            return
        with scratch_scope(spark, f"batch-{number}"):
            made = rows if prepare is None else prepare(rows, number)
            _, report = load(
                settle(made, "rows"), table, pipeline_version, clock(), order, batch_of=(name, number)
            )
            if on_report is not None and report is not None:
                on_report(number, report)

    return run


def upsert_stream(
    rows: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    pipeline_version: str,
    order: str = "row_pos",
    every: str | None = None,
    **options,
) -> StreamingQuery:
    """Start the load of a stream of embedded rows.

    With ``every`` (such as ``1 minute``) it goes on for good; without, it takes what is there
    and stops.
    """
    writer = rows.writeStream.foreachBatch(upsert_batch(table, pipeline_version, order, **options))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
