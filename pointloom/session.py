"""What every job needs from its session: shipped code, the shared folder, written tables."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "_pointloom_shipped"
_LOG = logging.getLogger("pointloom")


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, whatever its working folder; once per context."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    folder = tempfile.mkdtemp(prefix="pointloom_ship_")
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(_PACKAGE.rglob("*.py")):
            target.write(source, source.relative_to(_PACKAGE.parent).as_posix())
    context.addPyFile(archive)
    setattr(context, _SHIPPED, True)


def progress(spark: SparkSession, stage: str) -> None:
    """Name the jobs that follow, as Spark's pages show them, and log the stage with the seconds since the one before."""
    now, before = time.monotonic(), spark.sparkContext.__dict__.get("_pointloom_stage")
    spark.sparkContext._pointloom_stage = now
    _LOG.info("%s%s", stage, "" if before is None else f" (after {now - before:.1f} s)")
    spark.sparkContext.setJobDescription(stage)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent in a local session, as in tests, a temporary folder is made; it goes with the
    session. On a cluster its absence is an error, since executors would write to their own disks.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_pointloom_shared", None)
    if not folder:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
        local = tempfile.mkdtemp(prefix="pointloom_shared_")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        context._pointloom_shared = folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cache, the table outlives executors; unlike a local checkpoint, any executor reads it. ``dropping`` removes
    the tables that a block has made.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path of a path; one without a scheme is local."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """The committed part files of a folder, in order, as one file, which appears when it is whole; empty without parts."""
    source, at = _hadoop(spark, folder)
    target, new = _hadoop(spark, path + ".new")
    _, done = _hadoop(spark, path)
    parts = sorted((x.getPath() for x in source.listStatus(at)), key=lambda p: p.getName()) if source.exists(at) else []
    if target.getScheme() == "file":
        target.setWriteChecksum(False)
    out = target.create(new, True)
    for part in parts:
        if part.getName().startswith("part-"):
            stream = source.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, spark._jsc.hadoopConfiguration(), False)
            stream.close()
    out.close()
    target.delete(done, False)
    target.rename(new, done)


_MADE: ContextVar[list[str]] = ContextVar("pointloom_tables", default=[])


@contextmanager
def dropping(spark: SparkSession) -> Iterator[Callable[[int], None]]:
    """Tables made in this block, and by this thread alone, may be removed in it: a call removes all but the last ``n`` of them."""
    made: list[str] = []
    token = _MADE.set(made)

    def drop(last: int = 0) -> None:
        behind = max(0, len(made) - last)
        for path in made[:behind]:
            remove(spark, path)
        del made[:behind]

    try:
        yield drop
    finally:
        outer = token.old_value
        _MADE.reset(token)
        if isinstance(outer, list):
            outer.extend(made)
