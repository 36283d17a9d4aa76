"""Shared helpers: table access, durable intermediates, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch; Spark's own limit of bytes for a batch holds beside it.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = at or tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: they need not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        to = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """To be called by every operator that runs Python on the executors."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts lineage as checkpoint() does, but compressed and columnar; a lost executor
    loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_gridloom_path", None)
    if path is not None:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def one_thread() -> None:
    """To be called in tasks that multiply matrices: a machine's cores are shared out as tasks already, and threads of BLAS that wait for work take theirs."""
    if _THREADS:
        return
    _THREADS.append(1)
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line and ".so" in line}
    except OSError:
        return  # no such file on this system: nothing but time is lost
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_THREADS: list[int] = []
#: What a worker remembers between tasks, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """To be called in tasks that need memory of their own: workers are used again, and what other operators remember in them goes."""
    for owner, clear in CACHES.items():
        if owner != but:
            clear()


def raw(column: pa.Array) -> list[bytes]:
    """A string column as bytes objects, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            yield b


def _changes(t: pa.Table, columns: int) -> np.ndarray:
    """Where rows differ from the row before in the first columns (longs or ints, without nulls)."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in range(columns):
        x = t.column(c).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def group_ranges(t: pa.Table, columns: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal values in the first columns."""
    edges = [0, *_changes(t, columns).tolist(), t.num_rows]
    yield from zip(edges[:-1], edges[1:], strict=True)


def whole_groups(it: Iterator[pa.RecordBatch], columns: int, rows: int = 8192, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for b in batches(it):
        held.append(b)
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        t = pa.Table.from_batches(held)
        cut = _changes(t, columns)
        if len(cut):
            yield t.slice(0, cut[-1])
            t = t.slice(cut[-1])
        held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the well-known murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd multipliers for combining the hashes of consecutive words.
STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def windows(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k consecutive word hashes; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n] * STEP[0]
    for j in range(1, k):
        h = h * np.uint64(0x100000001B3) + words[j : j + n] * STEP[j % len(STEP)]
    return mix(h)


#: Two polynomial hashes: a value for each byte, and a base.
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, (2, 256), np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASE]
#: Texts are hashed together up to so many bytes.
CHUNK_BYTES = 4 << 20


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _POWERS[which]
    if len(held[0]) < n:
        size = 1 << (n - 1).bit_length()
        for j, base in enumerate((_BASE[which], pow(_BASE[which], -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            held[j] = np.cumprod(p, dtype=np.uint64)
    return held[0][:n], held[1][:n]


def prefix_hashes(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial hash: (out[e] - out[s]) * base**-s stands for bytes s to e, wherever they are."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[which][buf] * powers(len(buf), which)[0], out=out[1:])
    return out


class Words:
    """The words of several texts: `hash` of each, `start` and `end` in the joined bytes, and `at[i]:at[i + 1]` those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined.lower() if lower else joined
        self.buf = buf = np.frombuffer(self.joined, np.uint8)
        white = _WHITE[buf]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        acc = prefix_hashes(buf)
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((acc[self.end] - acc[self.start]) * powers(len(buf))[1][self.start] + size * STEP[1])
        self.text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.at = np.searchsorted(self.start, self.text_start)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
