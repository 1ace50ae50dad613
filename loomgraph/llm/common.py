"""What the corpus operators share: the shared folder, intermediate tables and word hashing."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`materialise` returned; the frame can't be read afterwards."""
    delete_path(df.sparkSession, df._loomgraph_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nobody holds any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Ids up to this count, 16 bytes each, may be sent to every executor.
BROADCAST_IDS = 2_000_000


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column, distinct, written down), null for null: these are broadcast if they are counted to be few.

    Then the rows, which can hold whole texts, are not shuffled; beyond the bound they are.
    """
    few, wanted = ids.count() <= BROADCAST_IDS, ids.toDF("wanted_key")
    return rows.join(F.broadcast(wanted) if few else wanted, F.col(key).eqNullSafe(F.col("wanted_key")), "left_semi")


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n, F.lit(0))


def named(df: DataFrame, name: str) -> int:
    """Position of the column ``name``: written so, or else the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def columns_free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, as they need not see the driver's path."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    root, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="loomgraph-package-")
    with zipfile.ZipFile(f"{folder}/loomgraph.zip", "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(f"{folder}/loomgraph.zip")
    context._loomgraph_shipped = True


def arrow_schema(ddl: str) -> pa.Schema:
    """For use inside a task, to which the package is shipped: call it on the driver."""
    ship(SparkSession.getActiveSession())
    return to_arrow_schema(_parse_datatype_string(ddl))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def add_columns(documents: DataFrame, text: str, told: str, make: Callable[[], Callable[[list[str | None]], list[pa.Array]]]) -> DataFrame:
    """``documents`` with the columns ``told`` (DDL), which ``make()``'s function gives for a list of whole texts. No shuffle.

    Columns go by position, so any other names do; input columns with a name of ``told``, in any case, are replaced.
    """
    fields = _parse_datatype_string(told)
    new = {f.name.lower() for f in fields}
    keep = [k for k, c in enumerate(documents.columns) if c.lower() not in new]
    apart = documents.toDF(*(f"c{k}" for k in range(len(documents.columns))))
    frame = apart.select(*(f"c{k}" for k in keep), F.col(f"c{named(documents, text)}").alias("whole"))
    schema = StructType([*(StructField(documents.columns[k], documents.schema[k].dataType) for k in keep), *fields])
    arrow, names = arrow_schema(told), [*(documents.columns[k] for k in keep), *fields.names]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = make()
        for batch in frames:
            columns = tell(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(c.cast(f.type) for c, f in zip(columns, arrow, strict=True))], names=names)

    return frame.mapInArrow(run, schema)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of all ``rows``, a sample of bounded size, in one task; only the result, pickled, comes to the driver."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held = list(frames)
        model = fit(pa.Table.from_batches(held, schema=held[0].schema if held else arrow))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    arrow = arrow_schema(rows.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()[0])


#: What workers remember between tasks; a task drops what it doesn't use itself.
_REMEMBERED: list = []


def tidy(*keep) -> None:
    """At the start of a task: forget what other operators' tasks left in this worker, and give unused memory back."""
    for x in _REMEMBERED:
        if not any(x is k for k in keep):
            x.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


class WordHashes(dict):
    """Word bytes to 64-bit xxhash, remembered up to a bound; what is forgotten is hashed again."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        _REMEMBERED.append(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a 64-bit permutation of each value."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
