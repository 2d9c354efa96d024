"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of WIDTH words (one shorter window where the item is shorter). The words of a
window are ordered by how often all documents hold them, rarest first. A document that contains a whole window has its
rarest word, so one word is the necessary prefix: only places of documents that hold a window's rarest word are joined
with it. The word's offset gives where the window would begin; places where it would not fit in the document fall away
(length and position), and the rest are verified word by word on their bytes.

Items go in blocks of a fixed number of words. A block's windows are sent to all tasks (their size is bounded); each
block is one pass over the documents. Documents are not shuffled, whatever a window's frequency.

Defined results: null and empty texts have no words and are never hit; items that are null, empty or without an id take
no part; rows with the same item_id are one item; repeated document rows are judged each. An empty benchmark hits nothing.

The column contaminated counts items only. The pipeline's stage also drops a document with one item: if the windows that
occur cover over half of the words of an item's text of WIDTH words or more, in whatever order the document has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import FOLDED, Rolling, Words, cut, mix, slices, small_batches

WIDTH, MIN_ITEMS = 8, 2
#: Words of the items of one block, and pairs of place and window that are verified at once.
BLOCK_WORDS, PAIRS = 400_000, 2_000_000
_EMPTY = np.zeros(0, np.uint64)


class Windows:
    """The distinct windows of a block of items, and for each the items that hold it."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        self.width, self.ids = width, sorted(set(ids))
        place = {x: i for i, x in enumerate(self.ids)}
        words = Words(pa.array(texts, pa.string()), FOLDED)
        starts, sizes, items, texts_of = [], [], [], []
        for i, name in enumerate(ids):
            n, at = int(words.count[i]), int(words.first[i])
            size = min(width, n)
            if size:
                starts.append(np.arange(at, at + n - size + 1))
                sizes.append(np.full(n - size + 1, size))
                items.append(np.full(n - size + 1, place[name]))
                texts_of.append(np.full(n - size + 1, i))
        start, size, item, text = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, items, texts_of))
        self.count = words.count.astype(np.int64)
        self.vocabulary = np.unique(words.hash)
        if not len(start):
            self.hash, self.words, self.size = _EMPTY, np.zeros((0, width), np.uint64), np.zeros(0, np.int64)
            self.item_edge, self.item, self.text, self.place = np.zeros(1, np.int64), item, text, start
            return
        h = Rolling(words.hash).runs(start, start + size)
        other = Rolling(mix(words.hash ^ np.uint64(0x3C6EF372FE94F82B))).runs(start, start + size)
        order = np.lexsort((item, other, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])])
        one = order[new]
        self.hash, self.size = h[one], size[one]
        self.source, self.begin = words, start[one]
        column = start[one][:, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < self.size[:, None]
        self.words = np.where(inside, words.hash[np.minimum(column, len(words.hash) - 1)], np.uint64(0))
        self.item, self.item_edge = item[order], np.append(np.flatnonzero(new), len(order))
        self.text, self.place = text[order], start[order]

    def order_by(self, counts: np.ndarray) -> Windows:
        """Choose each window's rarest word by the counts of the vocabulary; equal counts go by hash."""
        n = len(self.hash)
        rank = np.zeros(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        own = np.where(np.arange(self.width)[None, :] < self.size[:, None], rank[np.searchsorted(self.vocabulary, self.words).clip(0, max(0, len(rank) - 1))], len(rank)) if n else np.zeros((0, self.width))
        self.offset = own.argmin(axis=1) if n else np.zeros(0, np.int64)
        rare = self.words[np.arange(n), self.offset]
        self.by_rare = np.argsort(rare, kind="stable")
        self.rare, first = np.unique(rare[self.by_rare], return_index=True)
        self.rare_edge = np.append(first, n)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.rare >> np.uint64(44)] = True
        return self

    def found_in(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Start (as a place among the words) and window of every occurrence."""
        at = np.flatnonzero(self.maybe[words.hash >> np.uint64(44)]) if len(self.rare) else np.zeros(0, np.int64)
        which = np.searchsorted(self.rare, words.hash[at])
        same = self.rare[np.minimum(which, len(self.rare) - 1)] == words.hash[at] if len(at) else np.zeros(0, bool)
        at, which = at[same], which[same]
        size = self.rare_edge[which + 1] - self.rare_edge[which]
        rolling, found, lo = Rolling(words.hash), [], 0
        ends = np.cumsum(size)
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            n, total = size[lo:hi], int(size[lo:hi].sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            window = self.by_rare[np.repeat(self.rare_edge[which[lo:hi]], n) + step]
            start = np.repeat(at[lo:hi], n) - self.offset[window]
            row = np.repeat(words.row[at[lo:hi]], n)
            fits = (start >= words.first[row]) & (start + self.size[window] <= words.first[row + 1])
            start, window = start[fits], window[fits]
            same = rolling.runs(start, start + self.size[window]) == self.hash[window]
            start, window = start[same], window[same]
            for j in range(self.width):  # byte for byte
                own = np.flatnonzero(j < self.size[window])
                same = np.ones(len(start), bool)
                same[own] = words.same(start[own] + j, self.source, self.begin[window[own]] + j)
                start, window = start[same], window[same]
            found.append((start, window))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


    def mostly_in(self, row: np.ndarray, window: np.ndarray, rows: int) -> np.ndarray:
        """For each of the rows, whether its windows cover over half of the words of one text of `width` words or more."""
        most = np.zeros(rows, bool)
        n_windows = max(1, len(self.hash))
        pairs = np.unique(row * n_windows + window)
        n = self.item_edge[pairs % n_windows + 1] - self.item_edge[pairs % n_windows] if len(pairs) else pairs
        ends, lo = np.cumsum(n), 0
        while lo < len(pairs):  # whole rows, about PAIRS places at once
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            hi = int(np.searchsorted(pairs, (pairs[hi - 1] // n_windows + 1) * n_windows))
            m = n[lo:hi]
            at = np.repeat(self.item_edge[pairs[lo:hi] % n_windows], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            own, text, place = np.repeat(pairs[lo:hi] // n_windows, m), self.text[at], self.place[at]
            order = np.lexsort((place, own))  # texts follow one another, so places are in order of texts too
            own, text, place = own[order], text[order], place[order]
            long = self.count[text] >= self.width
            own, text, place = own[long], text[long], place[long]
            if len(own):
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
                gain = np.full(len(own), self.width)
                gain[1:] = np.where(new[1:], self.width, np.minimum(self.width, place[1:] - place[:-1]))
                first = np.flatnonzero(new)
                most[own[first[2 * np.add.reduceat(gain, first) > self.count[text[first]]]]] = True
            lo = hi
        return most


def _blocks(items: DataFrame, width: int, limit: int) -> Iterator[Windows]:
    ids, texts, n = [], [], 0
    for r in items.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += r[1].count(" ") + 1 + len(r[1]) // 64
        if n >= limit:
            yield Windows(ids, texts, width)
            ids, texts, n = [], [], 0
    if ids:
        yield Windows(ids, texts, width)


def word_counts(docs: DataFrame, vocabulary) -> np.ndarray:
    """How often all documents hold each word of the broadcast, sorted vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> np.uint64(44)] = True
        total = np.zeros(len(known), np.int64)
        for part in slices(batches):
            h = Words(part.column(0), FOLDED).hash
            h = h[maybe[h >> np.uint64(44)]]
            at = np.searchsorted(known, h)
            at = at[known[np.minimum(at, len(known) - 1)] == h]
            total += np.bincount(at, minlength=len(known))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    total = np.zeros(len(vocabulary.value), np.int64)
    if len(total):
        rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        total[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


def contamination(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), width: int = WIDTH, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, the columns in keep, n_words, n_hit, items (sorted ids of items with occurring windows), contaminated and
    most (whether the document holds over half of one text of width words or more).

    docs: doc_id, text; items: item_id, text. A document word inside any occurrence of a window is hit.
    """
    spark = small_batches(docs).sparkSession
    docs = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    # hits: one bit a word, packed; found: the items so far
    state = docs.withColumns({"hits": F.lit(None).cast("binary"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "most": F.lit(False)})
    arrow, ddl = state.limit(0).toArrow().schema, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    done = 0
    for block in _blocks(items, width, block_words):
        if done:
            state = cut(state)
        sent = spark.sparkContext.broadcast(block.order_by(word_counts(docs, spark.sparkContext.broadcast(block.vocabulary))))
        state = state.mapInArrow(_pass(sent, arrow), ddl)
        done += 1
    if not done:
        empty = Windows([], [], width).order_by(np.zeros(0, np.int64))
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(empty), arrow), ddl)
    return state.select("doc_id", *keep, "n_words", "n_hit", "items", (F.size("items") >= min_items).alias("contaminated"), "most")


def _pass(sent, schema: pa.Schema):
    at = {n: i for i, n in enumerate(schema.names)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        names = np.array(block.ids, dtype=object)
        for part in slices(batches):
            words = Words(part.column(at["text"]), FOLDED)
            start, window = block.found_in(words)
            edge = np.zeros(len(words.hash) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.size[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            row, n = words.row[start], block.item_edge[window + 1] - block.item_edge[window]
            item = block.item[np.repeat(block.item_edge[window], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            pairs = np.unique(np.repeat(row, n) * max(1, len(names)) + item)
            rows, item = pairs // max(1, len(names)), pairs % max(1, len(names))
            edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
            before, earlier = part.column(at["items"]).to_pylist(), part.column(at["hits"]).to_pylist()
            some = np.flatnonzero((np.diff(edges) > 0) | np.array([bool(x) for x in before], bool))
            hits, found = [None] * part.num_rows, [[]] * part.num_rows
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            most = block.mostly_in(words.row[start], window, part.num_rows) | np.array(part.column(at["most"]).to_pylist(), bool)
            for i in some:
                own = hit[words.first[i] : words.first[i + 1]].copy()
                if earlier[i]:
                    own |= np.unpackbits(np.frombuffer(earlier[i], np.uint8), count=len(own)).astype(bool)
                hits[i], n_hit[i] = np.packbits(own).tobytes(), own.sum()
                found[i] = sorted({*before[i], *names[item[edges[i] : edges[i + 1]]]})
            new = {"hits": pa.array(hits, pa.binary()), "n_words": pa.array(words.count), "n_hit": pa.array(n_hit), "items": pa.array(found, pa.list_(pa.string())), "most": pa.array(most)}
            yield pa.RecordBatch.from_arrays([new[n].cast(f.type) if n in new else part.column(at[n]).cast(f.type) for n, f in zip(schema.names, schema, strict=True)], schema=schema)

    return task


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without those that hold windows of MIN_ITEMS items or more, or most of one."""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    return contamination(docs, items, columns[1:]).where(~F.col("contaminated") & ~F.col("most")).select(*columns)
