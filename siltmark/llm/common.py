"""What the text operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


LONG, STRING, BOOL, DOUBLE, INT = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


#: Rows and bytes that a Python worker turns into objects at once.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def slices(batch: pa.RecordBatch):
    """Pieces of a batch of at most SLICE_ROWS rows, shorter if rows are long: nothing of the size of a whole batch is built."""
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: Settings of a session that bound what goes to Python at once, and their bounds here.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers, and never raises, the session's bounds on a batch: with the usual 10,000 rows one of long texts takes over 100 MB on either side."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def let_go() -> None:
    """Gives freed memory back to the system, for workers that live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def map_texts(df: DataFrame, carry: Sequence[Column], text: Column, fields: Sequence[T.StructField], factory: Callable[[], Callable]) -> DataFrame:
    """Adds fields made from whole texts, batch by batch and without a shuffle.

    carry: aliased columns that pass through untouched. factory() runs once a task and returns a function from
    a list of UTF-8 byte strings (a null text is empty) to one list of values for each field.
    """
    bound_batches(df.sparkSession)
    chosen = df.select(*carry, F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("__text"))
    kept = chosen.schema.fields[:-1]
    types = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches):
        work = factory()
        for whole in batches:
            for b in slices(whole):
                made = work(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=names)
        let_go()

    return chosen.mapInArrow(run, T.StructType([*kept, *fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_rows(df: DataFrame) -> list[Column]:
    """carry for map_texts: every column of a row as one struct, so that no name can clash."""
    return [F.struct(*[col(c) for c in df.columns]).alias("__row")]


def rows_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the shared folder that the session names; only a local session without one, as in tests, gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[[^-]|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside lambda functions the optimizer would put its whole expression wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
