"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: 0x20, 0x09-0x0D. It is also what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset, and gets a
    fresh one; elsewhere executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Paths that ``release`` removes; ``owned`` names another list for what is written within it.
_temporary: list[str] = []
_owner: contextvars.ContextVar[list[str]] = contextvars.ContextVar("owner", default=_temporary)
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def owned(paths: list[str]):
    """Tables written meanwhile are listed in paths, for their owner to release."""
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)


@contextlib.contextmanager
def configured(spark: SparkSession, **settings):
    """Settings (with __ for dots) that hold meanwhile."""
    before = {}
    for name, value in settings.items():
        key = name.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost executor
    costs only the tasks that read the files. Its shuffle files go when it is written. ``release`` or
    ``discard`` remove what isn't to be kept."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/trendloom/{name}-{uuid.uuid4().hex}"
    if not keep:
        _owner.get().append(path)
    with configured(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no lazy result reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _remove(df.sparkSession, path)
            if path in _owner.get():
                _owner.get().remove(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove the tables listed (all without an owner, if none are named). Results that read them must have been
    written."""
    paths = _temporary if paths is None else paths
    while paths:
        _remove(spark, paths.pop())


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker; one row
    may exceed the bytes alone. Plans are lazy, so the session keeps the bounds, unless it has lower ones."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def groups_of(sizes, limit: int):
    """Ranges [a, b) of neighbours whose sizes sum to about limit at most; one item may exceed it alone."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; it works in place on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial prefix sums modulo 2^64 over bytes that went through a random table.

    ``of(a, b)`` hashes the byte ranges [a, b) of the buffer, wherever they lie, and mixes the length in.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = _BYTE[data]
        terms *= powers(n, _BASE)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(n + 1, _BASE_INV)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.sums[b] - self.sums[a]
        x *= self.inverse[a]
        x ^= (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix64(x)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _SPACE[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def unique_name(taken: list[str], base: str) -> str:
    """base, or base with underscores until no column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df whose columns of these names (in any case) go by others meanwhile, and what to rename back."""
    taken, back = [*df.columns, *names], {}
    for c in df.columns:
        if c.lower() in names:
            back[unique_name(taken, "kept_")] = c
            taken.append(list(back)[-1])
    return df.withColumnsRenamed({c: kept for kept, c in back.items()}), back


def crc_of(doc_id) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, by: str, most: int) -> DataFrame:
    """At most about 1.5 * most rows of df, about equally many for each value of column by (fewer where it has
    fewer): those whose hash over doc_id and text is lowest. Only counts by value reach the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if not counts:
        return df.limit(0)
    each = max(1, most // len(counts))
    # hashes are uniform, so a threshold takes the wanted share of each value's rows
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * each / n)))))
    key = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 11) / float(1 << 53)
    return df.where(key < share[F.col(by)])


def among(rows: DataFrame, column: str, keys: DataFrame, kind: str = "left_semi", slots: int = 1 << 20) -> DataFrame:
    """Rows whose column's slot is taken (or, with left_anti, isn't) by a value of that column in keys.
    The broadcast has as many rows as there are slots at most; what it lets through still needs the real join."""
    mine = unique_name(rows.columns, "slot_")
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(slots))
    taken = F.broadcast(keys.select(slot(column).alias(mine)).distinct())
    return rows.join(taken, slot(column) == F.col(mine), kind)
