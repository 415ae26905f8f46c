"""Helpers that the operators share: rows through Arrow, and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}
#: Rows taken from an Arrow batch at a time, and rows and bytes after which an output batch is handed on.
TAKE_ROWS, GIVE_ROWS, GIVE_BYTES = 64, 2048, 8_000_000


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "a long, b string"."""
    return pa.schema([pa.field(*(lambda n, t: (n, ARROW[t]))(*part.split())) for part in ddl.split(", ")])


def taken(batches: Iterable[pa.RecordBatch], rows: int = TAKE_ROWS) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time so that long texts do not pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def given(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if not isinstance(x, list) else 16 * len(x) for x in row if isinstance(x, str | bytes | list))
        if len(held) >= GIVE_ROWS or size >= GIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def map_rows(df: DataFrame, ddl: str, step: Callable[[Iterator[tuple]], Iterable[tuple]], rows: int = TAKE_ROWS) -> DataFrame:
    """step sees each partition's rows as a stream of tuples, rows of them at a time, and yields rows of the schema ddl; both go through
    Arrow."""
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda batches: given(step(taken(batches, rows)), schema), ddl.replace("long", "bigint"))


def planes(counts: np.ndarray) -> bytes:
    """32-bit counts with all lowest bytes first, since the others are mostly zeros and shuffles are compressed."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and Spark runs in one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and safe when executors are lost.

    The tables stay until the scratch() around them ends, until clear_work(), or until the folder's owner removes them.
    """
    return kept_until(df, name)[0]


#: Paths written within each open scratch(), the innermost last.
_SCRATCH: list[list[str]] = []


def _written_to(df: DataFrame, path: str) -> DataFrame:
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_until(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """written(), and a function that removes the table once no frame that will still be computed reads it."""
    spark, path = df.sparkSession, f"{work_folder(df.sparkSession)}/quillmark/{name}-{uuid.uuid4().hex}"
    return _written_to(df, path), lambda: _remove(spark, path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what written() leaves inside, at the end. Frames made inside can't be used afterwards; write their rows before."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            _remove(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written() of what make() gives, without the tables that were written on the way to it: they go as soon as its rows are there."""
    path = f"{work_folder(spark)}/quillmark/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """kept_until(), for a table that outlives the scratch() around it."""
    held, _SCRATCH[:] = list(_SCRATCH), []
    try:
        return kept_until(df, name)
    finally:
        _SCRATCH[:] = held


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps now and not when the driver happens to collect garbage.

    Only disk is spared; without a driver JVM at hand nothing happens.
    """
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


#: Values whose totals running() forms together.
TOGETHER = 64


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's values the combination of all values before it (zero for the first).

    Totals are formed within runs of TOGETHER values and over the runs, so that long arrays take time in proportion, about.
    """
    total = lambda part, start: F.aggregate(part, start, combine)
    of = lambda i: F.floor(i / TOGETHER).cast("int")

    def each(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(of(F.size(own) - 1), F.lit(0))), lambda g: total(F.slice(own, g * TOGETHER + 1, TOGETHER), zero))
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        add = lambda state, x: F.struct(combine(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        begins = F.aggregate(runs, start, add, lambda state: state["out"])
        return F.transform(F.array(begins), lambda b: F.transform(own, lambda _, i: total(F.slice(own, of(i) * TOGETHER + 1, i % TOGETHER), F.get(b, of(i)))))[0]

    # one-element transforms name a value, so that it is computed once
    return F.transform(F.array(values), each)[0]


def clear_work(spark: SparkSession) -> None:
    """Removes what written() has left; frames that read it can't be used afterwards."""
    _remove(spark, f"{work_folder(spark)}/quillmark")
