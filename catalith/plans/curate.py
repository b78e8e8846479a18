"""The curation job: clean, impute, augment, embed, load, report."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.operators import clean as cleaning
from catalith.operators import features, impute, upsert
from catalith.operators.embed import ModelFactory, embed_documents, spread
from catalith.operators.reports import union_reports
from catalith.session import build_session, scratch_path, scratch_scope, settle
from catalith.sources.export import write_report
from catalith.sources.raw import read_raw
from catalith.sources.snapshots import SnapshotTable, StaleBase, buckets_for

#: Times a load merges anew because another was committed first.
TRIES = 5


@dataclass
class CurationRun:
    """What a run leaves behind."""

    augmented: DataFrame
    reports: DataFrame
    version: int | None = None


def prepare(raw: DataFrame, order: str = "row_pos") -> DataFrame:
    """Clean, impute and augment, without reports."""
    cleaned = settle(cleaning.clean(raw, order), "cleaned")
    return features.augment(impute.impute(cleaned))


def load(
    rows: DataFrame,
    table: SnapshotTable,
    pipeline_version: str,
    run_at: dt.datetime,
    order: str = "row_pos",
    vectors: DataFrame | None = None,
    tries: int = TRIES,
    batch_of: tuple[str, int] | None = None,
) -> tuple[int, DataFrame | None]:
    """Merge embedded rows into the table; the new version and the load report.

    The rows should be stored: they are read once for the load and once for its
    report. Vectors that come apart are joined on ``order`` first; a row or a vector left
    over fails the load. Only the buckets the batch falls in are read and written again.
    When another load is committed meanwhile, the batch is merged again on top of it. A table that
    would outgrow its buckets fourfold is dealt over more of them.

    ``batch_of`` names the batch by its source and number. The table's ledger keeps them, and a
    batch it has already is left out; there is no report then.
    """
    if batch_of and table.has_batch(*batch_of):
        return table.latest(), None
    if vectors is not None:
        rows = upsert.attach_vectors(rows, vectors, order)
    batch = settle(upsert.bind(upsert.loadable(rows, order), pipeline_version), "batch")
    of_batch = upsert.item_id(F.col("title"), F.col("release_year"))
    for left in reversed(range(tries)):
        base = table.latest()
        if batch_of and table.has_batch(*batch_of):
            return base, None  # another run of this batch came first
        wide = buckets_for(table.rows() + batch.count())
        try:
            if base == 0 or wide > 4 * table.buckets():
                merged = upsert.merge(table.read(base) if base else None, batch, run_at)
                version = table.write(merged, base, width=max(wide, table.buckets()), batch=batch_of)
            else:
                place = table.bucket_of(of_batch).alias("b")
                touched = [r["b"] for r in batch.select(place).distinct().collect()]
                merged = upsert.merge(table.read(base, touched), batch, run_at)
                version = table.write(merged, base, touched, batch=batch_of)
            break
        except StaleBase:
            if not left:
                raise
    report = upsert.load_report(rows, table.read(version), pipeline_version)
    return version, report


def curate(
    raw: DataFrame,
    table: SnapshotTable | None = None,
    model: ModelFactory | None = None,
    dim: int = fixed.EMBEDDING_DIM,
    batch: int = fixed.EMBEDDING_BATCH,
    pipeline_version: str = "0.1.0",
    run_at: dt.datetime | None = None,
    order: str = "row_pos",
) -> CurationRun:
    """The whole job. Without a table it stops before embedding and loading.

    Each stage is written down once, so its report and the next stage read it
    instead of computing it again, and the model is not asked twice. What is not returned
    is removed when the job ends.
    """
    if table is not None and model is None:
        raise ValueError("a load needs a model")
    with scratch_scope(raw.sparkSession, "curate") as scope:
        run = _curate(raw, table, model, dim, batch, pipeline_version, run_at, order)
        return CurationRun(
            scope.keep(run.augmented, "rows"), scope.keep(run.reports, "reports"), run.version
        )


def _curate(
    raw: DataFrame,
    table: SnapshotTable | None,
    model: ModelFactory | None,
    dim: int,
    batch: int,
    pipeline_version: str,
    run_at: dt.datetime | None,
    order: str,
) -> CurationRun:
    run_at = run_at or dt.datetime.now(dt.timezone.utc)
    raw = settle(raw, "raw")
    kept = settle(cleaning.deduplicated(raw, order), "kept")
    cleaned = cleaning.validate_numerics(kept)
    medians = impute.medians(cleaned)
    augmented = settle(features.augment(impute.impute(cleaned, medians)), "augmented")
    reports = [
        cleaning.cleaning_report(raw, order, kept=kept),
        impute.imputation_report(cleaned, medians),
        features.augmentation_report(augmented),
    ]
    if table is None:
        return CurationRun(augmented, union_reports(*reports))
    embedded = embed_documents(spread(augmented), factory=model, dim=dim, batch=batch)
    embedded = settle(embedded, "embedded")
    version, report = load(embedded, table, pipeline_version, run_at, order)
    return CurationRun(embedded, union_reports(*reports, report), version)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Curate a raw catalog into a searchable table")
    parser.add_argument("raw", help="raw table")
    parser.add_argument("table", help="folder of the stored table")
    parser.add_argument("--format", default="json")
    parser.add_argument("--reports", help="folder for the stage reports")
    parser.add_argument("--dim", type=int, default=fixed.EMBEDDING_DIM)
    parser.add_argument("--model", help="module:factory of the embedding model")
    parser.add_argument("--dry-run", action="store_true", help="stop before embedding and load")
    args = parser.parse_args(argv)
    spark = build_session("curate")
    raw = read_raw(spark, args.raw, args.format)
    if args.dry_run:
        run = curate(raw)
    else:
        if not args.model:
            parser.error("--model is needed to load")
        module, _, name = args.model.partition(":")
        factory = getattr(importlib.import_module(module), name)
        run = curate(raw, SnapshotTable(spark, args.table), factory, dim=args.dim)
    write_report(run.reports, args.reports or scratch_path(spark, "reports"))


if __name__ == "__main__":
    main()
