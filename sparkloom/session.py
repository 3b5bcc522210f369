"""Session and scratch-folder helpers shared by every operator family."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "4", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting (a test) gets a temporary folder of its own; on a cluster the
    executors would not see it, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


#: Folders written inside each open ``scratch_scope``.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote inside, but for what was written with ``keep``.

    For work whose result is written before the end; one scope at a time in a thread of work.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, folder in _scopes.pop():
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the files, never a
    rerun of what made them. The read-back plan also carries true file sizes,
    so the optimizer broadcasts it only if it is really small.
    """
    path = scratch_path(df.sparkSession, name)
    if _scopes and not keep:
        _scopes[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once all that read it is written itself.

    Only folders under this library's scratch folder are touched; ``df`` may
    have filters or fewer columns on top of the files.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/sparkloom/"
    bare = lambda path: re.sub(r"^file:/+", "/", path)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if bare(folder).startswith(bare(root)):
            _delete(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
