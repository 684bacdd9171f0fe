"""What the corpus operators share: staged tables in the cluster's shared folder, words, and hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_roots: dict[str, tuple[SparkSession, str]] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets a temporary one of its own; on a cluster that is an error, because
    executors would not see each other's files.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quarrylens-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; all of them go when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = (spark, f"{shared_dir(spark)}/quarrylens-{app}")
    return f"{_roots[app][1]}/{uuid.uuid4().hex[:12]}-{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them has been staged itself."""
    for table in tables:
        ref, path = _paths.pop(id(table), (None, ""))
        if ref is not None and ref() is table:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes every staged table of this application; results that still read them must be written first."""
    _, root = _roots.pop(spark.sparkContext.applicationId, (None, ""))
    if root:
        _delete(spark, root)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_roots.values()):
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            _roots.clear()


def words(text: str | None) -> list[bytes]:
    """The maximal runs of bytes outside space and \\x09-\\x0D, as bytes.split() cuts them."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash64(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), U64, len(items))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finalizer of splitmix64 over x plus a seed."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; order counts."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - n + 1), U64)
        for i in range(n):
            out = mix(out + h[i : i + len(out)], i + 1)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rest(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    """The columns that an operator carries along."""
    return [column(batch, n) for n in names]


def typed(df: DataFrame, names: list[str]) -> str:
    """The schema of carried columns, to go behind others."""
    kinds = dict(df.dtypes)
    return "".join(f", `{n}` {kinds[n]}" for n in names)


def slices(batch: pa.RecordBatch, text: int, size: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about size bytes of the text column at most, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def lean(run: Callable) -> Callable:
    """Gives memory back when a task's Python part ends: its worker stays for later tasks, beside others."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return kept
