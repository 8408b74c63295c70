"""What the text operators share: reading tables, adding columns in Arrow batches, cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Text handed to a batch function at once, in bytes. A single longer text is a batch of its own.
SLICE_BYTES = 1 << 20
#: Rows of texts that go to Python together, at most; Spark's default of 10,000 may be any number of bytes.
BATCH_ROWS = 1_000
#: Tables of so many narrow rows (some 24 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of a data folder, with the given columns or all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS where they are more: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows (of a few numbers) are counted and few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def private(df: DataFrame, name: str) -> str:
    """A column name that starts with ``name`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in pieces of at most ``limit`` bytes of text, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of text, or one row."""
    start = 0
    for piece in pieces(batch.column(text_at), limit):
        yield batch.slice(start, len(piece))
        start += len(piece)


def tidy() -> None:
    """Gives what a task has used back to the system: its worker lives on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def found_in(text: Column, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], raw: bool = False) -> Column:
    """A struct of ``fields`` computed from a text column in Arrow batches: only texts go to Python, only results come back.

    ``make`` runs once in each task and returns a function from a list of texts (None for null; UTF-8 bytes if
    ``raw``) to one list, numpy array or Arrow array per field.
    """
    modest_batches(SparkSession.active())
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = []
            for part in pieces(batch):
                found = work(part.to_pylist())
                parts.append(pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, types, strict=True)], names=names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, types, strict=True))))
        del work
        tidy()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Deterministic, but never to be computed twice for a filter and a column.
    return F.arrow_udf(run, T.StructType(fields)).asNondeterministic()(text.cast("binary") if raw else text)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], raw: bool = False) -> DataFrame:
    """``df`` with new columns computed from its text column (see ``found_in``), without a shuffle.

    A column of ``df`` that has the name of a new one, in any case, is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [df[c] for c in df.columns if c.lower() not in new]
    found = private(df, "_found")
    return df.withColumn(found, found_in(df[text_col], fields, make, raw)).select(*kept, *[F.col(f"{found}.{f.name}").alias(f.name) for f in fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            made = spark.sparkContext.getCheckpointDir()
        where = made
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        if df is not None and (path := vars(df).get("scratch")):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
