"""What the operators of this subpackage share: shared storage, Arrow batches, null texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: Rows in one Arrow batch; at a mean of a few KB a text this keeps a batch at about half a MB.
BATCH_ROWS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, the context's own checkpoint folder is taken. Only a local session,
    whose executors are threads of the driver, may do without either: it gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:  # with its scheme, which a path alone takes from fs.defaultFS
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``written`` has stored for these frames, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for tables of long texts.

    Spark reads the bound when a frame runs, not when it is described: a lazy frame leaves the session
    with this one value, which is the same for every operator here; a smaller one is left as it is.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold for the steps run inside, and are put back after them."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Small Arrow batches for the steps run inside."""
    return settings(spark, **{_BATCH.replace(".", "__"): str(rows)})


def whole_key(df: DataFrame, key: str) -> Column:
    """The key as 64-bit integer; a key of another kind is an error here rather than in a task."""
    if not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}; an integer key is needed")
    return F.col(key).cast("long")


def texts(df: DataFrame, *keep: Column | str, text: str = "text") -> DataFrame:
    """``keep`` and the text, with null texts as empty ones."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column is called that."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def kinds(df: DataFrame, *names: str) -> str:
    """Columns and types as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names or df.columns)


def map_rows(df: DataFrame, fn: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` (columns as Python lists -> output tuples) to each Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rows := fn(*[c.to_pylist() for c in b.columns]):
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list | None], schema: str) -> DataFrame:
    """Apply ``fn`` (batch -> columns as Arrow or numpy arrays, or None for no rows) to each Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (cols := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def lists(rows: np.ndarray, of: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    """For each of ``rows`` (sorted, distinct) the list of those values whose ``of`` (sorted) it is."""
    offsets = np.concatenate([np.searchsorted(of, rows), [len(of)]]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values))
