"""What several operators share: tables in the scratch folder, free column names, samples, Arrow batches and the lower-casing of contracts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.sources.scratch import shared_dir

#: Word separators of the benchmark and licence contracts, as a Java/RE2/Python pattern of the word itself.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The white space of the shingle and line contracts.
BLANKS = " \t\n\x0b\x0c\r"


_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process has written so far, and tells how many tables that were.

    DataFrames that operators returned read these tables: write or count them before.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_tables)
    while _tables:
        folder = jvm.org.apache.hadoop.fs.Path(_tables.pop()).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators write inside ``with scratch(spark):`` is deleted at its end, also after an error.

    Write or count what they return inside, since it reads those tables.
    """
    before = _tables[:]
    _tables.clear()
    try:
        yield
    finally:
        clear_scratch(spark)
        _tables.extend(before)


def joinable(table: DataFrame) -> DataFrame:
    """A written table as the side of a join that brings marks to texts.

    While its files are within Spark's own bound for it (spark.sql.autoBroadcastJoinThreshold), it is broadcast and the
    texts stay where they are; beyond that both sides are exchanged and the marks are hashed, so no text is sorted.
    """
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= most else table.hint("shuffle_hash")


def fresh(columns: list[str], *names: str) -> list[str]:
    """For each of ``names`` one like it that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text, a null one as empty, in two columns. (A leading constant gives a second, independent hash.)"""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(7), whole)]


def salt_of_nulls(key: Column, text: Column) -> Column:
    """0, but for a null key a hash of its row's text: rows without a key then don't meet in one task of a join."""
    return F.when(key.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def drawn_by_hash(rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """``size`` of ``total`` rows, those with the smallest hashes of ``key``, the same ones each time.

    A bound on the hash leaves about ``size`` rows before they are sorted, so no task sorts more, however many rows
    there are: so many more that fewer than ``size`` pass once in 10**9 draws.
    """
    hashed = F.xxhash64(key)
    if total > size:
        share = (size + 6 * size**0.5 + 36) / total
        rows = rows.where(hashed <= int(-(2**63) + min(share, 1.0) * (2**64 - 1025)))
    return rows.orderBy(hashed, key).limit(size)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` has a fast path for the many texts that are pure ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


#: Rows in one Arrow batch between Spark and Python: texts can be long, and a worker holds a batch or two.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, unless the user has set a size of their own.

    The setting counts when a plan runs, which is after an operator has returned it, so it stays (see the README).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def _trimmed(run: Callable) -> Callable:
    """``run``, which gives memory that it has freed back to the system when its task ends: workers outlive tasks."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, with bounded batches and workers that stay small between tasks."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(_trimmed(run), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
