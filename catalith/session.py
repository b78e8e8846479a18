"""Session helpers: shared scratch space, lineage cuts, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of at most this many narrow rows may be broadcast by hand. It is counted
# first; beyond the bound another way is taken.
BROADCAST_ROWS = 100_000


# Settings the operators want where the session says nothing else. The JVM does
# not compile methods beyond 8000 bytes; past that size Spark should split the
# code of a wide projection rather than fuse it.
PREFERRED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the preferred settings to a session that was built elsewhere."""
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in PREFERRED.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "catalith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**PREFERRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate data, as the cluster names it.

    Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="catalith-"))
    return context.getCheckpointDir()


_SCOPES: list["Scope"] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below the open scope's."""
    root = _SCOPES[-1].path if _SCOPES else scratch_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scope:
    """While it is open, all scratch tables go to its folder, which is removed at its end."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = scratch_path(spark, name)
        self._outside = f"{self.path}-kept"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a result beside the folder, so that it outlasts the scope."""
        path = f"{self._outside}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[Scope]:
    """Give back what a job puts down on its way; ``keep`` what it returns."""
    scope = Scope(spark, name)
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        delete_path(spark, scope.path)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write an intermediate result down once, so later reads do not redo it.

    The table lies in the shared folder and outlasts executors. Its file size is
    known to the optimizer, which broadcasts it in a join only when that is below
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one is shuffled, and AQE
    splits its hot keys.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A job's own folder below the shared one, given back when the job ends.

    Use it as a context manager, or call ``remove`` once nothing reads the tables any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = scratch_path(spark, name)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``settle``, in this folder."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove one table of this folder that is not needed any more."""
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if f"/{self.path.rstrip('/').rsplit('/', 1)[-1]}/" in folder:
                delete_path(self.spark, folder)

    def remove(self) -> None:
        delete_path(self.spark, self.path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(where)] if files.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count up to the bound, never further."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows
