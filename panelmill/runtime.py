"""Shared-storage helpers: where intermediate tables live and how small sides are attached."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds under which a measured side may be broadcast: its rows, and its size by
# Spark's own statistics (bytes of the stored columns that are read).
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32 << 20

# Asks Spark to remove the shuffle files of a query as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = RLock()
_READERS: dict[str, int] = {}  # folder of a stored table: how many scopes and readers need it
_WRITING: dict[str, tuple[int, str | None]] = {}  # application: writes under way, setting before
_SCOPE: ContextVar[Scope | None] = ContextVar("panelmill_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the executor that wrote it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="panelmill-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten.

    Paths are grouped by application, so a finished application's tables can be
    removed together.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/panelmill-{application}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", *, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table and continue from that table.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    feeds), and, unlike a row checkpoint, keeps column pruning, filter pushdown
    and size statistics for everything downstream.  The shuffle files of the
    write go when it has ended: whoever reads on reads the table.  The table
    stays until ``release``, the end of the ``scope`` that it was written in, or
    (without one) as long as the folder.
    """
    path = write_once(df, label, "parquet", **({"compression": compression} if compression else {}))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, label: str, kind: str, **options: str) -> str:
    """Write ``df`` to a fresh path as files of a format of Spark's; they go when ``materialize`` says."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.format(kind).options(**options).save(path)
    folder = path.rsplit("/", 1)[1]
    with _LOCK:
        _READERS[folder] = 1
    scope_now = _SCOPE.get()
    if scope_now is not None:
        scope_now.folders.add(folder)
    return path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; writes from several threads share the setting."""
    application = spark.sparkContext.applicationId
    with _LOCK:
        many, before = _WRITING.get(application, (0, spark.conf.get(SHUFFLE_CLEANUP, None)))
        _WRITING[application] = (many + 1, before)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            many, before = _WRITING.pop(application)
            if many > 1:
                _WRITING[application] = (many - 1, before)
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def _folders(frame: DataFrame) -> set[str]:
    """Folders of the stored tables that ``frame`` reads."""
    return {part for file in frame.inputFiles() for part in file.split("/")[-2:-1] if part in _READERS}


def release(*frames: DataFrame | None) -> None:
    """Give up the stored tables that ``frames`` read: each is removed unless a ``reading`` still needs it.

    Frames over other data, released tables and None are passed over.
    """
    for frame in frames:
        if frame is not None:
            for folder in _folders(frame):
                _give_up(frame.sparkSession, folder)


def _give_up(spark: SparkSession, folder: str) -> None:
    with _LOCK:
        if folder not in _READERS:
            return
        _READERS[folder] -= 1
        if _READERS[folder] > 0:
            return
        del _READERS[folder]
    path = f"{shared_dir(spark)}/panelmill-{spark.sparkContext.applicationId}/{folder}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def reading(*frames: DataFrame) -> Iterator[None]:
    """Keeps the stored tables that ``frames`` read until the end of the block, whoever releases them inside."""
    with _LOCK:
        held = [(frame.sparkSession, folder) for frame in frames for folder in _folders(frame)]
        for _, folder in held:
            _READERS[folder] += 1
    try:
        yield
    finally:
        for spark, folder in held:
            _give_up(spark, folder)


class Scope:
    """Stored tables that go at the end of a block."""

    def __init__(self, outside: Scope | None) -> None:
        self.folders: set[str] = set()
        self.outside = outside

    def keep(self, frame: DataFrame) -> DataFrame:
        """Leave the tables that ``frame`` reads to the scope outside, if there is one."""
        kept = _folders(frame) & self.folders
        self.folders -= kept
        if self.outside is not None:
            self.outside.folders |= kept
        return frame


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Removes, at the end of the block, the tables stored in it (by any operator) but for those kept.

    Results are lazy and read such tables: write or collect them inside.
    Scopes nest, and threads that an operator starts belong to its scope.
    """
    own = Scope(_SCOPE.get())
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        for folder in own.folders:
            _give_up(spark, folder)


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as Spark's optimizer estimates it; of stored tables, that of the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def store(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """A materialized table and its row count, which file footers answer."""
    table = materialize(df, label)
    return table, table.count()


def attach(
    df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", *, rows: int | None = None
) -> DataFrame:
    """Join a derived side onto a large frame, null keys matching null keys.

    The side is stored and counted first, unless ``rows`` tells the size of a
    side that already is: within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` it
    is broadcast, so a hot key of ``df`` is never shuffled; beyond the bounds
    the join is left to Spark (sort-merge, with adaptive skew splitting).
    """
    if rows is None:
        side, rows = store(side, "side")
    if rows <= BROADCAST_ROWS and planned_bytes(side) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    left, right = df.alias("wide"), side.alias("side")
    matched = [F.col(f"wide.{_quoted(k)}").eqNullSafe(F.col(f"side.{_quoted(k)}")) for k in keys]
    extra = [F.col(f"side.{_quoted(c)}") for c in side.columns if c not in keys]
    return left.join(right, matched, how).select("wide.*", *extra)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
