"""What the training-data operators share: tables, the shared folder, Arrow batches, hashes of words and comparison of bytes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrane.runtime import cut, shared_dir

__all__ = ["Scratch", "Words", "cut", "shared_dir", "table"]

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch at most (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows and bytes of Arrow batches in its session: texts are long, and a batch is held on both sides.

    The settings are read when the plan runs, so they can't be set back before; they only change how batches are cut.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(df.sparkSession.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("bB"))
        if now <= 0 or now > most:
            df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


class Scratch:
    """Tables and files of one operator below the shared folder; what delete() leaves goes when the application ends.

    Parquet keeps many short rows in far fewer bytes than a checkpoint does.
    """

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._path(self.at)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """df as a table that is written now. release: its shuffles' files go as soon as it is written, not at some later collection."""
        was = self.spark.conf.get(_CLEANUP)
        try:
            if release:
                self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def delete(self, *names: str) -> None:
        for name in names:
            path, files = self._path(f"{self.at}/{name}")
            files.delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS whose texts have at most `limit` bytes (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, at + BATCH_ROWS, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def ints(column: pa.Array) -> np.ndarray:
    """An integer column as int64; null becomes the least value, so it sorts first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


# --- hashes -----------------------------------------------------------------------------------------------------

_BASE, _GAMMA = 0x9E6C63D0876A3F6B | 1, np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), a bijection."""
    x = x + _GAMMA
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """Base ** i (or its inverse ** i) modulo 2 ** 64 for i < n at least."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have)
    return have


class Rolling:
    """Hashes of any runs of a sequence of 64-bit symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power("up", n + 1)[:n], out=self.sums[1:])
        self.down = _power("down", n + 1)

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every k consecutive symbols."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n] + np.uint64(k))


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CODE = np.arange(256)
#: Bytes of words, and what each byte counts as: plain words are runs without white space; folded words are runs of
#: letters, digits and everything beyond ASCII, with A-Z lower-cased.
PLAIN = (~_SPACE, np.arange(256, dtype=np.uint8))
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)
FOLDED = (((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_CODE >= 0x80), _LOWER)
#: Plain words with A-Z lower-cased.
LOWERED = (~_SPACE, _LOWER)


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Blocks of eight bytes up to which runs are hashed and compared side by side; longer runs go one by one.
_BLOCKS = 32


def _blocks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    held = np.zeros(len(raw) + 8, np.uint8)
    held[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", held.data, strides=(1,))


def run_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a chain of bijections over blocks of eight, BLAKE2 for very long runs.

    It has no algebra over places, so no family of texts collides by construction as it does under a polynomial modulo
    2 ** 64; runs of one length up to eight bytes never collide.
    """
    view, size = _blocks(raw), stop - start
    h = mix(size.astype(np.uint64) ^ np.uint64(0x6A09E667F3BCC908))
    h = mix(h ^ (view[start] & _MASK[np.minimum(size, 8)]))
    who = np.flatnonzero(size > 8)
    for k in range(1, _BLOCKS):
        if not len(who):
            return h
        h[who] = mix(h[who] ^ (view[start[who] + 8 * k] & _MASK[np.minimum(size[who] - 8 * k, 8)]))
        who = who[size[who] > 8 * (k + 1)]
    for i in who:
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_runs(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of size bytes at `at` in one and at `there` in other are the same bytes."""
    a, b = _blocks(one), _blocks(other)
    same = (a[at] ^ b[there]) & _MASK[np.minimum(size, 8)] == 0
    who = np.flatnonzero(same & (size > 8))
    for k in range(1, _BLOCKS):
        if not len(who):
            return same
        same[who] = (a[at[who] + 8 * k] ^ b[there[who] + 8 * k]) & _MASK[np.minimum(size[who] - 8 * k, 8)] == 0
        who = who[same[who] & (size[who] > 8 * (k + 1))]
    for i in who:
        same[i] = np.array_equal(one[at[i] : at[i] + size[i]], other[there[i] : there[i] + size[i]])
    return same


class Words:
    """The words of the texts of one column: hash, byte range and row of each, in order."""

    def __init__(self, column: pa.Array, kind: tuple[np.ndarray, np.ndarray]):
        raw, self.offsets = text_bytes(column)
        inside, as_byte = kind
        self.raw = raw
        n = len(raw)
        mask = np.zeros(n + 1, np.int8)
        mask[:n] = inside[raw]
        step = np.diff(mask, prepend=np.int8(0))
        edges = np.unique(self.offsets[1:-1])
        edges = edges[(edges > 0) & (edges < n)]
        split = edges[(mask[edges] == 1) & (mask[edges - 1] == 1)]  # two words that touch across rows
        self.start = np.flatnonzero(step == 1)
        self.stop = np.flatnonzero(step == -1)
        if len(split):
            self.start = np.sort(np.concatenate([self.start, split]))
            self.stop = np.sort(np.concatenate([self.stop, split]))
        #: The bytes as they count in comparisons.
        self.read = raw if as_byte is PLAIN[1] else as_byte[raw]
        self.hash = run_hashes(self.read, self.start, self.stop)
        #: Words of row i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, self.offsets, side="left")
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def cut(self, lo: int, hi: int) -> bytes:
        """The bytes from the first to the last of the words lo to hi (not included)."""
        return self.raw[self.start[lo] : self.stop[hi - 1]].tobytes() if hi > lo else b""

    def joined(self, keep: np.ndarray, body: np.ndarray) -> pa.Array:
        """The kept words of each row joined by one space; body: the bytes to take, raw or as they are read."""
        start, stop, row = self.start[keep], self.stop[keep], self.row[keep]
        edge = np.zeros(len(body) + 1, np.int8)
        edge[start] += 1
        edge[stop] -= 1  # a word may begin where another ends
        own_bytes = body[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        gap = np.ones(len(row), np.int64)  # no space after the last word of a row
        gap[:-1] = row[1:] == row[:-1]
        gap[-1:] = 0
        size = stop - start
        ends = np.cumsum(size + gap)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        own = np.ones(len(out), bool)
        own[ends[gap == 1] - 1] = False
        out[own] = own_bytes
        offsets = np.zeros(len(self.count) + 1, np.int64)
        np.add.at(offsets, row + 1, size + gap)
        return pa.Array.from_buffers(pa.large_binary(), len(self.count), [None, pa.py_buffer(np.cumsum(offsets).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())

    def same(self, at: np.ndarray, other: Words, there: np.ndarray) -> np.ndarray:
        """Whether the words with the numbers `at` are those of other with the numbers `there`, byte for byte."""
        size = self.stop[at] - self.start[at]
        return (size == other.stop[there] - other.start[there]) & same_runs(self.read, self.start[at], other.read, other.start[there], size)


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


class Bytes:
    """The bytes of the texts of one column as symbols."""

    def __init__(self, column: pa.Array):
        self.raw, self.first = text_bytes(column)

    @property
    def hash(self) -> np.ndarray:
        return _BYTES[self.raw]

    def __len__(self) -> int:
        return len(self.raw)

    def same(self, at: np.ndarray, other: Bytes, there: np.ndarray) -> np.ndarray:
        return self.raw[at] == other.raw[there]

    def cut(self, lo: int, hi: int) -> bytes:
        return self.raw[lo:hi].tobytes()
