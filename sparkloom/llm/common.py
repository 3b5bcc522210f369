"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, materialize, scratch_path, shared_dir

__all__ = [
    "BLANKS",
    "WORD",
    "small_batches",
    "cut_lineage",
    "fresh",
    "materialize",
    "partitions_for",
    "read_table",
    "scratch_path",
    "shared_dir",
    "sized_semi_join",
    "text_or_empty",
    "trimmed",
]

#: A run of ASCII blanks, and a word: a run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for what is planned inside, unless the session sets a size itself.

    Spark's default of 64 MB a batch is held several times over in each task
    (in the JVM, in the Python worker, and as Python objects).
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if not spark.sparkContext.getConf().contains(key) and before in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; when a task is done, its worker gives free memory back to the system.

    Workers wait for the next task with what their allocators hold, and an
    executor has as many of them as it ever ran at once.
    """

    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def sized_semi_join(df: DataFrame, keys: DataFrame, key: str, limit_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys`` (distinct, written before).

    ``keys`` is broadcast only when a count shows at most ``limit_rows`` of
    them (8 to 16 bytes each); beyond that Spark shuffles both sides.
    """
    small = keys.count() <= limit_rows
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")
