"""Deduplication of long byte strings with a logarithmic family of suffix indexes.

Of every WIDTH bytes at least one suffix is sampled: the one whose first SEED bytes have the least hash, so that equal
strings sample the same one. Sampled suffixes are dealt to buckets by that hash. In a bucket they come in batches in the
order of their documents. Each batch is sorted and merge-scanned against the levels that exist; what a level has already
is a match with its first place, the rest makes a new level, and levels of like size merge (linearly, both are sorted).
So n batches leave about log2(n) levels and each entry is merged about log2(n) times. Matches are extended both ways
byte by byte. Strings of WIDTH bytes that the first place doesn't settle go the same way with suffixes of LONGER bytes, and
what those leave by themselves (repeats.py): as a corpus grows, ever more strings of SEED bytes are known from elsewhere.

Defined results: a null or empty text has no bytes, no spans and the digest of nothing; a null doc_id sorts before all
others; rows that share a doc_id do not repeat each other. Empty tables give no rows. A text
of 2 ** 28 bytes or more raises an error; shorter ones are treated whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import Bytes
from terrane.llm.exchange import Store
from terrane.llm.repeats import Chunk, Kind, mark_repeats

WIDTH, SEED = 50, 20
#: Length of the strings that are tried where the first place of a suffix doesn't settle those of WIDTH bytes.
LONGER = 35
#: Bytes of a chunk; each byte is a symbol of eight bytes in several arrays.
CHUNK_BYTES = 2 << 20
#: Suffixes of a batch.
BATCH_KEYS = 1 << 15
_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


class Level:
    """Distinct keys in order, and what each stands for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __len__(self) -> int:
        return len(self.keys)

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys (in order) the level has, and their values."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == keys)
        return found, self.values[at[found]]

    def merged(self, other: Level) -> Level:
        """Both levels as one; no key is in both."""
        at = np.searchsorted(self.keys, other.keys)
        return Level(np.insert(self.keys, at, other.keys), np.insert(self.values, at, other.values))


class IndexFamily:
    """Levels whose sizes at least double from one to the next; a key is in one of them."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The first value that was ever added with each key; keys of the batch that are new join the family."""
        order = np.argsort(keys, kind="stable")
        own, first, which = np.unique(keys[order], return_index=True, return_inverse=True)
        known, new = values[order[first]], np.ones(len(own), bool)
        for level in self.levels:
            found, value = level.scan(own)
            known[found], new[found] = value, False
        if new.any():
            batch = Level(own[new], known[new])
            while self.levels and len(self.levels[-1]) <= 2 * len(batch):
                batch = self.levels.pop().merged(batch)
            self.levels.append(batch)
        out = np.zeros(len(keys), known.dtype)
        out[order] = known[which]
        return out


def family_earliest(a: np.ndarray, doc: np.ndarray, sender: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first holder of each key, batch by batch in the order of documents."""
    order, family = np.lexsort((place, sender, doc)), IndexFamily()
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), BATCH_KEYS):
        batch = order[lo : lo + BATCH_KEYS]
        out[batch] = family.add(a[batch], batch)
    return out


def _finish(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
    raw, offsets, covered = chunk.text.raw, chunk.first, chunk.covered()
    count = lambda mask: (sums := np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))[offsets[1:]] - sums[offsets[:-1]]
    begins = covered.copy()
    if len(begins):
        begins[1:] &= ~covered[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        begins[edge] = covered[edge]
    removed = count(covered)
    size = np.diff(offsets)
    kept = np.concatenate([[0], np.cumsum(size - removed)])
    body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(raw[~covered].tobytes())])
    return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(size), pa.array(removed), pa.array(count(begins)), body.cast(pa.binary())], schema=_SCHEMA)


def dedup_bytes(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text).

    Remove each byte that a string of `width` bytes covers which also starts in a document with a smaller doc_id.
    """
    store = Store(docs.select("doc_id", "text"), limit=CHUNK_BYTES)
    then = (LONGER,) if seed < LONGER < width else ()
    return mark_repeats(store, Kind(width, seed, True, Bytes, 1.0, then), _finish, _SCHEMA, _DDL, family_earliest)
