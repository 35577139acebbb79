"""Shared pieces of the training-data operators: scratch tables, size-checked broadcasts, numpy hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A side may be broadcast only when its row count, taken from a written table, is at most this,
BROADCAST_ROWS = 200_000
#: and its strings, binaries and arrays (64 bytes an element) hold at most this.
BROADCAST_BYTES = 64 << 20

MASK64 = (1 << 64) - 1

#: Caches whose contents a Python worker keeps from task to task.
_KEPT: list = []


def kept(cached):
    """Registers an ``lru_cache`` with :func:`begin`."""
    _KEPT.append(cached)
    return cached


def begin(*mine) -> None:
    """Drop what tasks of other operators have left in this Python worker: all kept caches but ``mine``."""
    others = [c for c in _KEPT if c not in mine and c.cache_info().currsize]
    for c in others:
        c.cache_clear()
    if others:
        gc.collect()
        release()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (:func:`marlstone.session.shared_folder`)."""
    return shared_folder(spark)


#: Scratch folders made and not yet deleted, in order.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made inside once the scope ends without error, but for paths put into the list it
    yields. A result that still reads them must be written within: operators return plans over their scratch tables."""
    begin, keep = len(_MADE), []
    yield keep
    for path in _MADE[begin:]:
        if path not in keep:
            delete_path(spark, path)
    _MADE[begin:] = keep


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts the lineage without keeping anything on executors, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing reads it any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the (written) table is small; otherwise left to a shuffled join.

    Small is at most ``limit`` rows whose values of no fixed width hold at most BROADCAST_BYTES. A caller that passes
    ``rows`` vouches for narrow rows: numbers and digests only.
    """
    wide = 0
    if rows is None:
        kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
        parts = [F.octet_length(c) if t in ("string", "binary") else F.size(c) * 64 for c, t in kinds.items() if t in ("string", "binary", "array")]
        each = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)).cast("long") for p in parts], F.lit(0).cast("long"))
        rows, wide = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and wide <= BROADCAST_BYTES else df


def scan_width(df: DataFrame, target: int = 4 << 20, most: int = 50_000) -> int:
    """Shuffle partitions so that each holds about ``target`` bytes of input, by the sizes of the scanned files as the
    optimizer knows them: nothing is read. ``most`` bounds what the driver has to track; larger inputs get larger
    partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # rows handed over by Python have no known size
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // target), most), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64, vectorised; wraps modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """uint64 hashes to doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class ByteHasher:
    """Hashes of many byte ranges of one buffer at once, by prefix sums of a polynomial modulo 2**64.

    ``sum(b[i] * P**i)`` over a range, times ``P**-start``, depends on the range's bytes alone because P is odd and so
    has an inverse. Lengths are mixed in, and a finaliser spreads the bits.
    """

    P = 0x9E3779B97F4A7C15
    P_INV = pow(P, -1, 1 << 64)

    def __init__(self, n: int = 1 << 20):
        self._grow(n)

    def _grow(self, n: int) -> None:
        def powers(p: int) -> np.ndarray:
            x = np.full(n + 1, p, dtype=np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        self.up, self.down = powers(self.P), powers(self.P_INV)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._grow(1 << int(len(data)).bit_length())
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@kept
@lru_cache(maxsize=1)
def byte_hasher() -> ByteHasher:
    """One hasher, and so one table of powers, for each Python worker."""
    return ByteHasher()


def text_slices(texts: pa.Array, size: int = 1 << 20, most: int = 1 << 14):
    """(first row, list of texts, null as empty) for runs of rows of about ``size`` bytes: what Python holds at once."""
    held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = held[at - 1] if at else 0
        to = min(at + most, max(at + 1, int(np.searchsorted(held, before + size, "right"))))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def release() -> None:
    """Give what a finished task no longer needs back to the system; workers live on with the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: 1 for the ASCII white space that parts words: x20 and x09 to x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts with a space after each, and where each text starts (one entry more than texts)."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(blobs) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in blobs], out=at[1:])
    return np.frombuffer(b" ".join([*blobs, b""]), dtype=np.uint8), at


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with white space."""
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=np.int8(1)))
    return edge[0::2], edge[1::2]
