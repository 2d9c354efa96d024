"""Chunks of rows in files of the shared folder, and an exchange of their 64-bit keys through hash buckets.

Finding what a corpus repeats needs each key to meet its equals, but not one row for each. A chunk (a few MB of texts)
is written once, into a file that its task's chunks share; later steps read it there by path and place, so that texts
never go through a shuffle again. A chunk sends each bucket one row with its keys packed as an array, a key once
however often the chunk has it, so a passage that a third of all rows hold costs a bucket one entry a chunk. The number
of buckets follows the size of the corpus, so a bucket holds a bounded number of entries.

The files are read and written with pyarrow's file systems (file, hdfs, s3, gs). A task that is run again writes a new
file; only the rows of the run that ended name theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import BATCH_ROWS, SLICE_BYTES, Scratch, ints, slices, small_batches

#: What a bucket holds on average at most, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 400_000, 64
#: From one chunk's number to the next.
STEP = 1 << (BATCH_ROWS - 1).bit_length()
#: Chunks that a task works on, on average at most.
TASK_CHUNKS = 8

_STORE = "chunk long, path string, at long, size long, n_bytes long, n_rows long"


class Store:
    """The chunks of a table: one row each with the place of its bytes, in the shared folder until delete().

    A chunk's number is a multiple of STEP, above its rows' count, so that number + place is a number of its own for each row.
    """

    def __init__(self, docs: DataFrame, order_by: str = "doc_id", text: str = "text", limit: int = SLICE_BYTES):
        self.scratch = Scratch(docs.sparkSession, "chunks")
        folder = f"{self.scratch.at}/files"

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, out, rows, at = TaskContext.get().partitionId() << 32, None, [], 0
            for part in slices(batches, text, limit):
                if out is None:
                    files, base = fs.FileSystem.from_uri(folder)
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.chunks"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                part = part.take(pa.array(np.argsort(ints(part.column(part.schema.get_field_index(order_by))), kind="stable")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                    stream.write_batch(part)
                body = sink.getvalue()
                out.write(body)
                rows.append((chunk, f"{folder}/{name}", at, body.size, part.get_total_buffer_size(), part.num_rows))
                chunk, at = chunk + STEP, at + body.size
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["chunk", "path", "at", "size", "n_bytes", "n_rows"])

        self.rows = self.scratch.write(small_batches(docs).mapInArrow(packed, _STORE), "manifest")
        total = self.rows.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
        self.n_bytes, self.n_chunks = total[0] or 0, total[1]
        least = min(self.n_chunks, 2 * docs.sparkSession.sparkContext.defaultParallelism)
        self.tasks = max(1, least, self.n_chunks // TASK_CHUNKS)

    def buckets(self, keys_per_byte: float) -> int:
        return max(LEAST_BUCKETS, int(self.n_bytes * keys_per_byte / BUCKET_KEYS) + 1)

    def each(self, work: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
        """What work(chunk, rows) yields for every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, path, at, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield from work(chunk, _read(path, at, size))

        return self.rows.select("chunk", "path", "at", "size").repartition(self.tasks, "chunk").mapInArrow(run, ddl)

    def with_mail(self, mail: list[DataFrame], work: Callable[[int, pa.RecordBatch, list[pa.Table]], Iterator[pa.RecordBatch]], schema: pa.Schema, ddl: str, missing_ok: bool = True, split: str | None = None) -> DataFrame:
        """What work(chunk, rows, mail) yields for every chunk, with the rows of each table of mail that name the chunk.

        Only mail is shuffled. Tables of mail have the columns chunk and others of binary type, the same in all.
        missing_ok: chunks without mail are worked on too. split: a column of mail, whose values are separate groups.
        """
        columns = [c for c in mail[0].columns if c not in ("chunk", split)]
        part = F.col(split).cast("long") if split else F.lit(0).cast("long")
        both, kinds = None, len(mail)
        for i, df in enumerate(mail):
            df = df.select("chunk", part.alias("_part"), F.lit(i).alias("_kind"), F.lit(None).cast("string").alias("_path"), F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_size"), *columns)
            both = df if both is None else both.unionByName(df)
        nothing = [F.lit(None).cast("binary").alias(c) for c in columns]
        place = self.rows.select("chunk", F.lit(0).cast("long").alias("_part"), F.lit(-1).alias("_kind"), F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("size").alias("_size"), *nothing)
        if split:  # every group needs the place: those beyond the first are few
            more = mail[0].where(part > 0).select("chunk", part.alias("_part")).distinct().join(self.rows, "chunk")
            place = place.unionByName(more.select("chunk", "_part", F.lit(-1).alias("_kind"), F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("size").alias("_size"), *nothing))
        both = both.unionByName(place)

        def run(table: pa.Table) -> pa.Table:
            kind = table.column("_kind").to_numpy()
            own = table.filter(pa.array(kind == -1))
            out = []
            if own.num_rows and (missing_ok or table.num_rows > own.num_rows):
                chunk, path, at, size = (own.column(c)[0].as_py() for c in ("chunk", "_path", "_at", "_size"))
                letters = table.select(columns)
                out = list(work(chunk, _read(path, at, size), [letters.filter(pa.array(kind == i)) for i in range(kinds)]))
            return pa.Table.from_batches(out, schema=schema)

        return both.repartition(self.tasks, "chunk", "_part").groupBy("chunk", "_part").applyInArrow(run, ddl)

    def delete(self) -> None:
        self.scratch.delete("files", "manifest")


def _read(path: str, at: int, size: int) -> pa.RecordBatch:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        source.seek(at)
        body = source.read_buffer(size)
    with pa.ipc.open_stream(body) as stream:
        return stream.read_all().combine_chunks().to_batches()[0]


def by_bucket(a: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by bucket; the buckets that have some; where they begin and the last ends."""
    at = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    begin = np.flatnonzero(np.diff(at[order], prepend=-1))
    return order, at[order][begin], np.append(begin, len(a))


def parts(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values between neighbouring edges as binary values."""
    body = np.ascontiguousarray(values)
    offsets = (np.asarray(edges, np.int64) * body.itemsize).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
    return whole.cast(pa.binary())


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays one after the other, and the size of each."""
    each = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return (np.concatenate(each) if each else np.zeros(0, kind)), np.array([len(x) for x in each], np.int64)


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (the first is the major one), then by place; whether each in that order begins a group; its group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, new, np.cumsum(new) - 1
