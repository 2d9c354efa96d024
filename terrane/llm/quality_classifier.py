"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(w . x - t_j) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ... The
features x are fractions of a text's words by hashed word and by hashed shape (letter case, marks at the end, digits),
and how much the text repeats itself. The weights are fitted on at most FIT_ROWS labelled rows (those whose ids have
the least hash), whose packed features come to the driver; all documents are then scored where they are read.

Defined results: null and empty texts have no words and the score of the intercept; rows are neither merged nor
dropped; labels that are null don't train; without labels of two grades every document has the highest grade. Of
documents that share a labelled id the least text trains.

In the query a document that is good but toxic has the middle grade: it is well written, so the words that make a text
poor should not be learnt from it, yet a clean one is worth more. Selection is by the tail probability of grade 1, the
expected grade ranks what is selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import PLAIN, Rolling, Words, mix, slices, small_batches

#: Labelled rows to fit on at most; slots of hashed words and shapes; rounds of fitting; tail probability to keep a text.
FIT_ROWS, WORD_SLOTS, SHAPE_SLOTS, ROUNDS, KEEP = 6_000, 1 << 12, 1 << 8, 300, 0.5
#: Shares of repeated words, neighbours and runs of four, of marks among the characters, and whether there are words.
DENSE = 5
WIDTH = WORD_SLOTS + SHAPE_SLOTS + DENSE
_SIGNS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"$#*%&|"), 1):
    _SIGNS[np.frombuffer(_chars, np.uint8)] = _i
_SIGNS[0x80:] = 2
_SIGN_SYMBOL = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))


def _again(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of a row's hashes that it has had before."""
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=len(n)) / np.maximum(1, n) if len(order) else np.zeros(len(n))


class Features:
    """Features of a slice of texts: slot of each word's hash and shape, words by row, and dense ones."""

    def __init__(self, column: pa.Array):
        plain = Words(column, PLAIN)
        self.row, self.n = plain.row, plain.count
        rows = len(self.n)
        self.word = (plain.hash >> np.uint64(64 - 12)).astype(np.int64) % WORD_SLOTS
        # a shape: how often each kind of character begins a run in the word, whatever the order
        sign = _SIGNS[plain.raw]
        lone = np.ones(len(sign), bool)
        lone[1:] = sign[1:] != sign[:-1]
        lone[plain.start] = True
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(lone, _SIGN_SYMBOL[sign], np.uint64(0)), dtype=np.uint64)])
        self.shape = (mix(sums[plain.stop] - sums[plain.start]) % np.uint64(SHAPE_SLOTS)).astype(np.int64)
        dense = np.zeros((rows, DENSE))
        if len(plain.hash):
            dense[:, 0] = _again(plain.hash, plain.row, self.n)
            twin = (plain.hash[1:] == plain.hash[:-1]) & (plain.row[1:] == plain.row[:-1])
            dense[:, 1] = np.bincount(plain.row[1:][twin], minlength=rows) / np.maximum(1, self.n)
            if len(plain.hash) >= 4:
                inside = plain.row[3:] == plain.row[:-3]
                dense[:, 2] = _again(Rolling(plain.hash).grams(4)[inside], plain.row[:-3][inside], self.n)
            marks = np.concatenate([[0], np.cumsum(sign >= 5)])
            dense[:, 3] = (marks[plain.offsets[1:]] - marks[plain.offsets[:-1]]) / np.maximum(1, np.diff(plain.offsets))
            dense[:, 4] = self.n > 0
        self.dense = dense

    def score(self, weights: np.ndarray) -> np.ndarray:
        each = weights[self.word] + weights[WORD_SLOTS + self.shape]
        return np.bincount(self.row, weights=each, minlength=len(self.n)) / np.maximum(1, self.n) + self.dense @ weights[-DENSE:]

    def packed(self) -> list[tuple[bytes, bytes]]:
        """Slots and values of each row."""
        out = []
        edges = np.concatenate([[0], np.cumsum(self.n)])
        for i in range(len(self.n)):
            a, b = edges[i], edges[i + 1]
            x = np.bincount(np.concatenate([self.word[a:b], WORD_SLOTS + self.shape[a:b]]), minlength=WIDTH) / max(1, b - a)
            x[-DENSE:] = self.dense[i]
            at = np.flatnonzero(x)
            out.append((at.astype(np.uint16).tobytes(), x[at].astype(np.float32).tobytes()))
        return out


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(indptr: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, width: int, rounds: int = ROUNDS, penalty: float = 1e-4) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by Adam on all rows."""
    n, row = len(grade), np.repeat(np.arange(len(grade)), np.diff(indptr))
    share = np.array([(grade >= j).mean() for j in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # thresholds are a first one and the logs of the gaps, so they stay in order
    theta = np.concatenate([[first[0]], np.log(np.maximum(1e-2, np.diff(first)))])
    w, m, v = np.zeros(width), np.zeros(width + len(theta)), np.zeros(width + len(theta))
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        score = np.bincount(row, weights=value * w[slot], minlength=n)
        tail = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -60, 60))), np.zeros(n)])
        p = np.maximum(1e-9, tail[np.arange(n), grade] - tail[np.arange(n), grade + 1])
        slope = tail * (1 - tail)
        by_score = (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p
        by_cut = np.zeros((n, grades + 1))
        by_cut[np.arange(n), grade] -= slope[np.arange(n), grade] / p
        by_cut[np.arange(n), grade + 1] += slope[np.arange(n), grade + 1] / p
        down = by_cut[:, 1:grades].mean(axis=0)
        g_theta = np.concatenate([[down.sum()], [down[j:].sum() * np.exp(theta[j]) for j in range(1, len(theta))]])
        g = -np.concatenate([np.bincount(slot, weights=value * by_score[row], minlength=width) / n - penalty * w, g_theta])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, theta = w - step[:width], theta - step[width:]
    return Ordinal(w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and the label columns of at most `rows` labels: those whose ids have the least hash.

    The ids are few by that bound, so they are sent to the scan of docs. Of rows that share an id the least text counts.
    """
    some = labels.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(rows).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy(*labels.columns).agg(F.min("text").alias("text")).select("doc_id", "text", *[c for c in labels.columns if c != "doc_id"])


def fit_quality(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS) -> Ordinal | None:
    """ratings: doc_id, grade from 0. None where there are fewer than two grades."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            packed = Features(part.column(0)).packed()
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())], names=["grade", "slots", "values"])

    sample = labelled_sample(docs, ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade")), rows)
    got = sample.select("text", "grade").mapInArrow(features, "grade int, slots binary, values binary").toArrow()
    grade = got.column("grade").to_numpy()
    if len(np.unique(grade)) < 2:
        return None
    slots = [np.frombuffer(x.as_buffer(), np.uint16) for x in got.column("slots")]
    values = [np.frombuffer(x.as_buffer(), np.float32) for x in got.column("values")]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in slots])])
    return fit_ordinal(indptr, np.concatenate(slots).astype(np.int64), np.concatenate(values).astype(np.float64), grade, int(grade.max()) + 1, WIDTH)


def grade_documents(docs: DataFrame, ratings: DataFrame, keep: tuple[str, ...] = (), rows: int = FIT_ROWS, threshold: float = KEEP) -> DataFrame:
    """doc_id, the columns in keep, expected_grade, tail_probability (of grade 1 or more) and selected."""
    model = fit_quality(small_batches(docs), ratings, rows)
    docs = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    out = ["doc_id", *keep, "expected_grade", "tail_probability"]
    scored = docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(1.0)}).select(*out)
    if model is None:
        return scored.withColumn("selected", F.lit(True))
    types = dict(scored.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names = part.schema.names
            tails = sent.value.tails(Features(part.column(names.index("text"))).score(sent.value.weights))
            columns = [part.column(names.index(c)) for c in out[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])], names=out)

    done = docs.mapInArrow(score, ", ".join(f"`{c}` {types[c]}" for c in out))
    return done.withColumn("selected", F.col("tail_probability") >= threshold)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: good but toxic; 2: good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def only_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) that the classifier selects."""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    return grade_documents(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")), columns[1:]).where("selected").select(*columns)
