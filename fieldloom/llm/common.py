"""What the corpus operators share: reading tables, the shared folder, written intermediates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FEW_ROWS = 10_000  # rows of a join's side (longs, some 40 bytes each) up to which it is broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs in one process
    (master ``local``, as in tests) a folder under the machine's temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and let go of its shuffle files: what reads the result reads the table."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, known to have at most ``rows`` rows: broadcast if they are few, else shuffled and merged.

    Left to itself Spark goes by the size of compressed files and takes an exploded table to be as large as the
    one it came from, so a few megabytes of nodes can reach the driver as hundreds of megabytes of posting lists.
    """
    return F.broadcast(side) if rows <= FEW_ROWS else side.hint("merge")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has none of, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_OPEN: ContextVar[tuple[Workspace, ...]] = ContextVar("open workspaces", default=())


class Workspace:
    """Intermediate tables that go when the ``with`` block that made them ends, whether it succeeds or not.

    ``materialize`` writes for the innermost open block; ``give`` writes for the block around it, so a result
    outlives the tables it was made of. Outside all blocks tables stay until the folder is cleared. Blocks are
    those of the thread (or context) at hand: operators that run side by side do not see each other's.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _OPEN.set(tuple(w for w in _OPEN.get() if w is not self))
        self.clear()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialize``, for this block."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        write_once(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def give(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialize``, for the block around this one."""
        around = _OPEN.get()[: _OPEN.get().index(self)]
        return (around[-1] if around else Workspace(self.spark)).keep(df, name)

    def drop(self, paths: list[str]) -> None:
        """Delete some of the tables; nothing that is still to be computed may read them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)
        self.paths = [p for p in self.paths if p not in paths]

    def clear(self) -> None:
        """Delete all tables kept so far."""
        self.drop(self.paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at files that outlive any executor, and what was computed once is read, not computed
    again, by every later use.
    """
    open_ = _OPEN.get()
    return (open_[-1] if open_ else Workspace(df.sparkSession)).keep(df, name)
