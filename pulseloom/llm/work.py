"""The shared work folder, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a temporary folder of its own and a cluster gets its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="pulseloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


#: Paths and names of tables that were made in scratch scopes, innermost last.
_SCOPES: list[list[tuple[str, str]]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/pulseloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(("path", path))
    return path


def new_table(name: str) -> str:
    """A fresh name for a table of the catalog."""
    name = f"{name}_{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(("table", name))
    return name


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged within this scope is deleted at its end, but for what goes through the function that it gives.

    Operators return frames that read staged tables, so a result has to be
    staged by that function, or written elsewhere, before the scope ends.
    """
    made: list[tuple[str, str]] = []
    _SCOPES.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        made.pop()
        return out

    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for kind, what in made:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {what}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(what)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows depends on files that outlive any executor, and a retried task
    sees the same rows again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands freed memory back to the system when its rows are done.

    Python workers live on from stage to stage; without this each keeps the most
    that any of its tasks took.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not a GNU system
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied
