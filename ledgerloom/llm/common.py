"""What the operators of this subpackage share: reading, shared scratch tables and row-wise Arrow stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_folder, written

#: Text bytes that a Python worker holds as objects at once; longer single texts go alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under the cluster's spark.checkpoint.dir, seen by driver and executors alike; it goes with the driver's JVM.

    Only where the setting is absent (tests, local mode) a temporary folder takes its place; on a cluster that is an error.
    """
    return shared_folder(spark)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's named columns hold about `limit` bytes at most (or one row)."""
    if batch.num_rows == 0:
        return
    size = sum(batch.column(c).nbytes for c in columns)
    if size <= limit or batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), columns, limit)
    yield from slices(batch.slice(half), columns, limit)


def append_columns(df: DataFrame, fields: T.StructType, inputs: list[str], make: Callable[[], Callable[..., list]], limit: int = SLICE_BYTES, arrow: bool = False) -> DataFrame:
    """Row-wise stage in Arrow batches: all columns of df, then `fields`.

    `make()` runs once in each task and returns a function from the input columns (as Python lists, or Arrow arrays with `arrow`)
    to one list (or Arrow array) for each field.
    A column of df that has the name of a field is replaced, so clashing names never make two columns.
    """
    taken = {f.name for f in fields}
    keep = [f for f in df.schema if f.name not in taken]
    schema = T.StructType([*keep, *fields])
    names, made = [f.name for f in keep], to_arrow_schema(fields)
    columns = [f.name for f in df.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, inputs, limit):
                given = [part.column(columns.index(c)) for c in inputs]
                out = work(*(given if arrow else (x.to_pylist() for x in given)))
                arrays = [part.column(columns.index(c)) for c in names] + [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


_SLOT: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one large object that a Python worker keeps for its next tasks: another key's takes its place.

    Spark uses its workers again for later stages, so what each operator kept for itself would add up over a pipeline.
    """
    if key not in _SLOT:
        release()
        _SLOT[key] = make()
    return _SLOT[key]


def release() -> None:
    """Empty the slot and give freed memory back."""
    _SLOT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes that a remembered key and value take besides their own.
ENTRY_BYTES = 220


class Memory:
    """Values by key, bytes to bytes: two generations of half the bound each (and a batch more), so that what is in use outlives a full one."""

    def __init__(self, entries: int, size: int):
        self.entries, self.size, self.young, self.old, self.used = max(1, entries // 2), size // 2, {}, {}, 0

    def look_up(self, names: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The values of distinct names; `learn` makes those that are missing."""
        found = list(map(self.young.get, names))
        absent = [i for i, x in enumerate(found) if x is None]
        keys = [names[i] for i in absent]
        values = list(map(self.old.get, keys)) if self.old else [None] * len(keys)
        fresh = [k for k, x in enumerate(values) if x is None]
        if fresh:
            for k, x in zip(fresh, learn([keys[k] for k in fresh]), strict=True):
                values[k] = x
        for i, x in zip(absent, values, strict=True):
            found[i] = x
        self.young.update(zip(keys, values, strict=True))
        self.used += sum(map(len, keys)) + sum(map(len, values)) + ENTRY_BYTES * len(keys)
        if len(self.young) >= self.entries or self.used >= self.size:
            self.old, self.young, self.used = self.young, {}, 0
        return found


def segments(data: np.ndarray, cut: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct segments of joined texts, the number of each segment, and the place of each text's first segment (and the end).

    A segment starts where `cut` holds and at each of `bounds`, the places of the texts and of their end.
    """
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return names, coded.indices.to_numpy(), np.searchsorted(starts, bounds)


def joined(parts: list[bytes], number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn, number of ids of each) from the ids of distinct segments, as `segments` gives them."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    many = sizes[number]
    ends = np.append(0, np.cumsum(many))
    shift = (np.cumsum(sizes) - sizes)[number] - ends[:-1]
    place = np.repeat(shift, many)
    place += np.arange(len(place))
    return np.frombuffer(b"".join(parts), "<u4")[place], np.diff(ends[bounds])


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
