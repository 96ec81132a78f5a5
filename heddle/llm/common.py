"""Helpers that the corpus operators share: shared storage, Arrow batches, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Entries of a worker's cache of tokens; it is cut down when it grows beyond that.
CACHE_ENTRIES = 400_000
#: Entries of a worker's cache of word hashes; it is emptied when it grows beyond that.
HASH_ENTRIES = 200_000
#: Documents, and bytes of them, that a task works on at a time; a longer document is a step of its own.
STEP_ROWS, STEP_BYTES = 2000, 4 << 20
#: Stands for all rows of an Arrow batch.
WHOLE = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}
_caches: dict[str, Callable[[], None]] = {}
_owner = ""


def register_cache(module: str, clear: Callable[[], None]) -> None:
    """Tell how to empty what an operator's module keeps in a worker between tasks."""
    _caches[module] = clear


def release() -> None:
    """Give freed memory back to the system; Python workers are reused from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def enter(module: str) -> None:
    """A task of this module begins in this worker: what other operators keep here goes."""
    global _owner
    if module != _owner:
        _owner = module
        for name, clear in _caches.items():
            if name != module:
                clear()
        release()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while something runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset, as in local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-")
    return _local[app]


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, STEP_ROWS):
        df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more: all that was made of them is written."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A few rows of the driver as a table.

    An Arrow table needs no Python worker. A list given to createDataFrame() passes workers under other settings
    than those of Arrow functions: each executor would keep a second daemon with its workers beside the first.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _row_bytes(b: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's strings and binaries."""
    out = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return out


def slices(b: pa.RecordBatch, rows: int = STEP_ROWS, size: int = STEP_BYTES):
    """Consecutive slices of at most so many rows and about so many bytes, which bounds what a step holds."""
    ends = np.cumsum(_row_bytes(b))
    start = 0
    while start < b.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield b.slice(start, end - start)
        start = end


def map_arrow(df: DataFrame, fn, schema: str, rows: int = STEP_ROWS) -> DataFrame:
    """Apply fn(RecordBatch) -> dict of column values to each Arrow batch, in slices of at most so many rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        enter(fn.__module__)
        for b in batches:
            for part in slices(b, rows):
                yield pa.RecordBatch.from_pydict(fn(part), schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class WordHash(dict):
    """64-bit hash of a word (bytes), kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


_words = WordHash()
register_cache(__name__, _words.clear)


def hash_words(words: list[bytes]) -> np.ndarray:
    if len(_words) > HASH_ENTRIES:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


#: The first 64 bytes of XXH3's secret, as little-endian numbers.
_KEYS = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), "<u8")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Bytes of text whose words are hashed at a time.
_STEP = 1 << 20


def _rotated(h: np.ndarray, k: int) -> np.ndarray:
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k))


def _folded_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit products, joined by exclusive or."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    first, upper = a0 * b0, a1 * b0
    cross = (first >> half) + (upper & low) + a0 * b1
    return ((cross << half) | (first & low)) ^ ((upper >> half) + (cross >> half) + a1 * b1)


def _short_hashes(at: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 of words of up to 16 bytes; at: the 8 bytes from each place on."""
    u = np.uint64
    out = np.zeros(len(starts), np.uint64)
    k = np.flatnonzero(size < 4)
    x, n = at[starts[k]], size[k]
    byte = lambda p: (x >> (u(8) * p.astype(np.uint64))) & u(255)
    h = (byte(n * 0) << u(16)) | (byte(n >> 1) << u(24)) | byte(n - 1) | (n.astype(np.uint64) << u(8))
    h ^= (_KEYS[0] & u(0xFFFFFFFF)) ^ (_KEYS[0] >> u(32))
    h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
    out[k] = h ^ (h >> u(32))
    k = np.flatnonzero((size >= 4) & (size <= 8))
    low, n = u(0xFFFFFFFF), size[k]
    h = (at[starts[k] + n - 4] & low) + ((at[starts[k]] & low) << u(32)) ^ (_KEYS[1] ^ _KEYS[2])
    h ^= _rotated(h, 49) ^ _rotated(h, 24)
    h *= u(0x9FB21C651E98DF25)
    h = (h ^ ((h >> u(35)) + n.astype(np.uint64))) * u(0x9FB21C651E98DF25)
    out[k] = h ^ (h >> u(28))
    k = np.flatnonzero((size > 8) & (size <= 16))
    n = size[k]
    a, b = at[starts[k]] ^ (_KEYS[3] ^ _KEYS[4]), at[starts[k] + n - 8] ^ (_KEYS[5] ^ _KEYS[6])
    h = n.astype(np.uint64) + a.byteswap() + b + _folded_product(a, b)
    h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
    out[k] = h ^ (h >> u(32))
    return out


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) + 1 for x in texts])
    raw = b"".join([b" ", b" ".join(texts).lower(), bytes([32]) * 8])
    space = _SPACE[np.frombuffer(raw, np.uint8, int(ends[-1]) + 1)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edge[::2].copy(), edge[1::2]
    size = stops - starts
    h = _short_hashes(np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)), starts, size)
    far = np.flatnonzero(size > 16)
    h[far] = hash_words([raw[a:b] for a, b in zip(starts[far].tolist(), stops[far].tolist(), strict=True)])
    return h, np.diff(np.searchsorted(starts, ends, "right"), prepend=0)


def text_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """hash_words() of the words of all texts in turn, A-Z lower-cased, and the number of words of each text.

    Words of up to 16 bytes are hashed by numpy, without an object for each.
    """
    steps: list[list[bytes]] = []
    size = _STEP
    for x in texts:
        if size >= _STEP:
            steps.append([])
            size = 0
        steps[-1].append(x or b"")
        size += len(x or b"")
    found = [_hashes(x) for x in steps]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate([n, *x]) for n, *x in zip(none, *found, strict=True))  # type: ignore[return-value]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_FIN = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> _FIN[2])
    h = h * _FIN[0]
    h = h ^ (h >> _FIN[2])
    h = h * _FIN[1]
    return h ^ (h >> _FIN[2])


def windows(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all windows of `size` words; the whole sequence as one where it is shorter."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        size = n
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ words[k : n - size + 1 + k]) * _MIX[k % 5] + np.uint64(size)
        out ^= out >> np.uint64(29)
    return mix(out)
