"""Small helpers shared by the corpus operators: column names, lineage cuts, streaming over sorted partitions."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each given one that no column of ``df`` has (Spark compares names without case)."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """The column of this very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add: its results replace them."""
    gone = {name.lower() for name in names}
    return df.select(*[quoted(name) for name in df.columns if name.lower() not in gone])


def text_or_empty(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that no later step computes it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_calls = count(1)


def give_back(every: int = 1) -> None:
    """Returns memory that this worker has freed to the system: workers are kept, and several share an executor.

    ``every``: does so once in so many calls only.
    """
    if next(_calls) % every:
        return
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, giving memory back when its partition ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return wrapped


def grouped(batches: Iterator[pa.RecordBatch], weight: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Record batches cut and gathered so that the strings of column ``weight`` hold about ``limit`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(weight))
        if column.nbytes <= limit - size:
            held.append(batch)
            size += column.nbytes
            continue
        start = 0
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for at, length in enumerate(lengths):
            if size and size + length > limit:
                if at > start:
                    held.append(batch.slice(start, at - start))
                yield held
                held, size, start = [], 0, at
            size += length
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held
