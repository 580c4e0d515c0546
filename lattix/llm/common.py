"""Expressions and helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def is_fold(id_col: str, n: int, remainder: int) -> Column:
    """Whether the id is in that fold (null id: in none)."""
    return F.coalesce(fold(id_col, n) == remainder, F.lit(False))


def row_count(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the Python worker, which lives on for other tasks, gives back the memory its pool keeps."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return lean_run


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of at most `rows` for what runs inside, so that texts of a batch take little memory; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: cuts lineage, and takes less disk than a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `stored`, once nothing reads them any more, and has the driver collect its garbage: the
    shuffle files and broadcasts of jobs that are done are deleted when their plans are collected, which may else take long."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            name = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            if name.getName().startswith("stored-"):
                name.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(name, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def join_dealt(rows: DataFrame, side: DataFrame, keys: list[str], how: str, many: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner or left semi join of rows with side, no task of which gets a hot key's rows.

    side has one row a key, and in column `many` (not returned) how often rows, `total` in all, have it.
    A key with over a parts-th of all rows is hot; fewer than `parts` keys can be, so their side is broadcast with that
    bound and their rows stay where they are.  All other keys are joined by a shuffle.
    """
    hot = F.col(many) * parts > F.lit(total)
    few = F.broadcast(side.where(hot).drop(many))
    rest = rows.join(F.broadcast(side.where(hot).select(*keys)), keys, "left_anti").join(side.where(~hot).drop(many), keys, how)
    return rows.join(few, keys, how).unionByName(rest)
