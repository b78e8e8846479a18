"""A keyed table in buckets, kept as numbered snapshots.

Rows lie in buckets by their id. A snapshot is a list of which write holds each bucket, so a
load rewrites only the buckets it touches and shares the others. A snapshot counts
from the moment its list stands under its number; a load that fails half-way leaves
files that no list names.

Every write says which snapshot it is based on. Lists are put in place by a rename that does
not replace, so of two writers with the same base one fails with ``StaleBase``, and must
merge again on what the other left.

A list also holds the ledger: per source of batches, the last one the snapshot has. It is committed
with the data, so a batch that is offered again is recognised.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.operators import stats
from catalith.session import delete_path

#: The fewest buckets of a table.
BUCKETS = 16
#: Rows a bucket should have. A table that outgrows its buckets is dealt over more of them.
BUCKET_ROWS = 100_000
_FILTERED = ("decade", "major_genre", "mpaa_rating", "imdb_rating")
_TITLE = "_title_lower"


class StaleBase(RuntimeError):
    """The table moved on since the snapshot a write was based on."""


def buckets_for(rows: int) -> int:
    """How many buckets a table of so many rows calls for: a power of two."""
    return max(BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self._spark = spark
        self.path = path.rstrip("/")
        self._new_buckets = buckets

    def _file(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        conf = self._spark._jsparkSession.sessionState().newHadoopConf()
        return self._file("commits").getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        files, root = self._files(), self._file(folder)
        if not files.exists(root):
            return []
        return [status.getPath().getName() for status in files.listStatus(root)]

    def versions(self) -> list[int]:
        """Numbers of the committed snapshots."""
        names = self._names("commits")
        return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())

    def latest(self) -> int:
        """The last committed snapshot; 0 for a table that has none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        """``buckets``, ``schema``, and the write that holds each filled bucket."""
        if version == 0:
            return {"buckets": self._new_buckets, "schema": None, "writes": {}, "rows": {}, "ledger": {}}
        lines = self._spark.read.text(f"{self.path}/commits/{version}.json", wholetext=True)
        return json.loads(lines.first()["value"])

    def buckets(self) -> int:
        return self.manifest(self.latest())["buckets"]

    def rows(self) -> int:
        """Rows of the last snapshot, by its list."""
        return sum(self.manifest(self.latest())["rows"].values())

    def last_batch(self, source: str) -> int | None:
        """The last batch of a source that the last snapshot has."""
        return self.manifest(self.latest())["ledger"].get(source)

    def has_batch(self, source: str, number: int) -> bool:
        last = self.last_batch(source)
        return last is not None and number <= last

    def bucket_of(self, item_id: Column, buckets: int | None = None) -> Column:
        """The bucket of an id: its first 32 bits, modulo the number of buckets."""
        bits = F.conv(F.substring(item_id, 1, 8), 16, 10).cast("bigint")
        return F.pmod(F.coalesce(bits, F.lit(0)), F.lit(buckets or self.buckets())).cast("int")

    def _read(self, version: int, buckets: Sequence[int] | None, hidden: bool) -> DataFrame | None:
        listed = self.manifest(version)
        if listed["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(listed["schema"]))
        wanted = listed["writes"] if buckets is None else {str(b): None for b in buckets}
        paths = [
            f"{self.path}/data/{listed['writes'][b]}/bucket={b}" for b in wanted if b in listed["writes"]
        ]
        if not paths:
            df = self._spark.createDataFrame([], schema)
        else:
            df = self._spark.read.schema(schema).parquet(*paths)
        return df if hidden else df.drop(_TITLE)

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A committed snapshot, the last one by default, or some of its buckets.

        None when there is none.
        """
        wanted = self.latest() if version is None else version
        if wanted == 0 or (version is not None and wanted not in self.versions()):
            return None
        return self._read(wanted, buckets, hidden=False)

    def by_id(self, item_id: str) -> DataFrame:
        """The rows of one id: one bucket's files, and of these what a bloom filter lets through."""
        row = self._spark.range(1).select(self.bucket_of(F.lit(item_id)).alias("b")).first()
        return self._read(self.latest(), [row["b"]], False).where(F.col("id") == F.lit(item_id))

    def by_title(self, title: str) -> DataFrame:
        """The rows of a title in any case: bloom filters of the stored lower-case title skip the rest."""
        rows = self._read(self.latest(), None, True)
        same = F.col(_TITLE) == F.lower(F.lit(title)) if _TITLE in rows.columns else F.lit(False)
        return rows.where(same).drop(_TITLE)

    def changed_buckets(self, before: int, after: int, ignore: Sequence[str] = ("updated_at",)) -> list[int]:
        """Buckets in which two snapshots have other rows.

        Those that share their files are passed over, and the others compared by digests.
        """
        old, new = self.manifest(before), self.manifest(after)
        if old["buckets"] != new["buckets"]:
            raise ValueError("the snapshots are dealt over different numbers of buckets")
        written = {b for m in (old, new) for b in m["writes"] if old["writes"].get(b) != new["writes"].get(b)}
        suspects = sorted(map(int, written))
        if not suspects:
            return []
        place = self.bucket_of(F.col("id"), old["buckets"])
        sides = [
            stats.group_digests(self._read(version, suspects, hidden=False), place, ignore)
            for version in (before, after)
        ]
        return sorted(row["part"] for row in stats.differing_groups(*sides).collect())

    def changes(self, before: int, after: int, ignore: Sequence[str] = ("updated_at",)) -> DataFrame:
        """``stats.snapshot_changes`` of two snapshots, from the rows of the buckets that differ alone."""
        at = self.changed_buckets(before, after, ignore)
        sides = [self._read(version, at, hidden=False) for version in (before, after)]
        return stats.snapshot_changes(*sides, ignore=ignore)

    def write(
        self,
        df: DataFrame,
        based_on: int,
        buckets: Sequence[int] | None = None,
        width: int | None = None,
        batch: tuple[str, int] | None = None,
    ) -> int:
        """Store rows as the snapshot after ``based_on``; the new number.

        With ``buckets``, the rows replace these and the others stay as they are; without,
        they are the whole table, which may then be dealt over ``width`` buckets. ``batch``
        (source, number) enters the ledger. Rows are gathered by bucket; where a bucket is large,
        Spark splits it over several tasks and files. Files are sorted by the columns searches
        filter on. Raises ``StaleBase`` when another write was committed since.
        """
        if buckets is not None and width is not None:
            raise ValueError("only a whole table can get another number of buckets")
        if self.latest() != based_on:
            raise StaleBase(f"based on snapshot {based_on}, but {self.latest()} is committed")
        listed = self.manifest(based_on)
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        width = width or listed["buckets"]
        rows = df.withColumn("bucket", self.bucket_of(F.col("id"), width))
        if "title" in df.columns:
            rows = rows.withColumn(_TITLE, F.lower("title"))
        schema = rows.drop("bucket").schema
        by = ["bucket", *(c for c in _FILTERED if c in df.columns)]
        writer = rows.hint("rebalance", "bucket").sortWithinPartitions(*by).write.partitionBy("bucket")
        for column in ("id", _TITLE):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(folder)
        kept = {} if buckets is None else {
            b: w for b, w in listed["writes"].items() if int(b) not in set(buckets)
        }
        found = [n.removeprefix("bucket=") for n in self._names(f"data/{name}") if n.startswith("bucket=")]
        if buckets is not None and not {int(b) for b in found} <= set(buckets):
            delete_path(self._spark, folder)
            raise ValueError("rows outside the buckets they replace")
        counted = self._spark.read.schema(rows.schema).parquet(folder).groupBy("bucket").count() if found else None
        sizes = {str(r["bucket"]): r["count"] for r in counted.collect()} if counted else {}
        made = {
            "buckets": width,
            "schema": schema.json(),
            "writes": kept | {b: name for b in found},
            "rows": {b: listed["rows"][b] for b in kept} | sizes,
            "ledger": listed["ledger"] | ({batch[0]: batch[1]} if batch else {}),
        }
        try:
            self._commit(based_on + 1, json.dumps(made))
        except StaleBase:
            delete_path(self._spark, folder)
            raise
        return based_on + 1

    def _commit(self, version: int, text: str) -> None:
        """Put a snapshot's list under its number, unless one stands there already."""
        draft, place = self._file(f"commits/_{uuid.uuid4().hex}"), self._file(f"commits/{version}.json")
        stream = self._files().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self._spark._jvm
        conf = self._spark._jsparkSession.sessionState().newHadoopConf()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        options = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, options)
        except Py4JJavaError as error:
            self._files().delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise StaleBase(f"snapshot {version} was committed by another writer") from error
            raise

    def forget(self, keep: int = 1) -> list[int]:
        """Remove all but the last ``keep`` snapshots, and the files only they list."""
        known = self.versions()
        gone, left = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        listed = lambda versions: {
            (b, w) for v in versions for b, w in self.manifest(v)["writes"].items()
        }
        for bucket, write in listed(gone) - listed(left):
            delete_path(self._spark, f"{self.path}/data/{write}/bucket={bucket}")
        for version in gone:
            delete_path(self._spark, f"{self.path}/commits/{version}.json")
        return gone
