"""Substring deduplication by seed and extend.

Winnowed anchors of six words are the seeds. Each is joined with the place that has it first, the texts around both are
compared word by word both ways, and the equal runs of WIDTH words or more are the maximal repeats (see repeats.py). Words
that a repeated run covers are removed; the first occurrence stays.

Defined results: a null or empty text has no words and an empty kept text; a null doc_id sorts before all others; rows
that share a doc_id are told apart by the order in which they were stored. Empty tables give no rows. A text of 2 ** 28
words or more raises an error; shorter ones are treated whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import PLAIN, Words
from terrane.llm.exchange import Store
from terrane.llm.repeats import Chunk, Kind, mark_repeats

WIDTH, SEED = 20, 6


def _words(column: pa.Array) -> Words:
    return Words(column, PLAIN)


def _counts(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def dedup_substrings(docs: DataFrame, keep: tuple[str, ...] = (), width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, text, the columns in keep, n_words, n_removed and kept_text of every row of docs (doc_id, text).

    Remove each word covered by `width` consecutive words that also start earlier: in a smaller doc_id, or earlier in
    the same document. Windows are judged on the input, not on what is left.
    """
    docs = docs.select("doc_id", "text", *keep)
    fields = {f.name: f for f in docs.schema.fields}
    ddl = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in fields.items()) + ", n_words long, n_removed long, kept_text string"
    arrow = docs.limit(0).toArrow().schema
    schema = pa.schema([*arrow, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def finish(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        words, covered = chunk.text, chunk.covered()
        own = [rows.column(i).cast(f.type) for i, f in enumerate(arrow)]
        return pa.RecordBatch.from_arrays([*own, pa.array(words.count), pa.array(_counts(covered, words.first)), words.joined(~covered, words.raw).cast(pa.string())], schema=schema)

    return mark_repeats(Store(docs), Kind(width, seed, False, _words, 6.0), finish, schema, ddl)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with repeats removed; a text that loses nothing stays as it is."""
    done = dedup_substrings(docs, ("lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
