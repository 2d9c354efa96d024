"""Toxicity by a weighted finite-state grammar over clauses.

Words are tagged as insult, threat, target, negation, reported speech or other. Each clause (what stands between marks
of punctuation) that holds an insult or a threat runs through the composition of three small transducers: negation
relabels what follows within a few words, reported speech relabels the rest of the clause, and the target transducer
joins an insult or threat with a person named nearby. What comes out is a set of labels for the clause, such as
"insult at a target, not negated, not reported". A text's score is the logistic of the weights of its labels, each
times the log of one plus the number of clauses that have it: a word alone, negated or quoted, counts less.

Fitting uses at most FIT_ROWS labelled rows outside the held-out third (those whose ids have the least hash). The
lexicon is a seed list and stems: one that several toxic texts have which are no copies of each other, and few other
texts, is an insult; less precise ones that toxic texts without an insult have are slurs, with weights of their own. The
weights have the grammar's own as prior means.

Defined results: null and empty texts have no clauses and the score of the intercept; a null id is neither held out nor
used to fit. Rows are neither merged nor dropped. Without toxic labels the seeds and prior weights stand.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import FOLDED, Rolling, Words, byte_symbols, cut, slices, small_batches
from terrane.llm.quality_classifier import labelled_sample

FIT_ROWS, PREDICT = 10_000, 0.7
#: A stem is an insult if so many toxic texts, no two of them near copies, have it and so few other texts; a less
#: precise one is a slur if it helps with toxic texts that have no insult.
STEM_TEXTS, STEM_PRECISION, SLUR_GAIN, SLUR_PRECISION = 5, 0.95, 3, 0.5
#: Bytes of the stems; 0 is the whole word.
STEM_BYTES = (0, 4, 5, 6, 7, 8, 9)
OTHER, INSULT, THREAT, SLUR, TARGET, NEGATION, REPORT = range(7)
#: The seeds of each tag.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown vermin imbecile idiota estúpido estúpida imbécil basura inútil asqueroso crétin débile ordure minable stupide blöd dumm abschaum versager widerlich",
    THREAT: "kill hurt destroy murder beat strangle matar destruir golpear tuer détruire frapper töten schlagen vernichten",
    TARGET: "you your yours he she they him her them tú usted ustedes él ella ellos tu toi vous il elle ils du dich ihr euch er sie",
    NEGATION: "not no never neither nor isn aren don nunca ni tampoco ne pas jamais nicht kein keine nie",
    REPORT: "said says say told wrote writes quoted called claimed dijo dice escribió dit disait écrit sagte sagt schrieb",
}
_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?;:\n\r()[]{}\"", np.uint8))


# --- the grammar ----------------------------------------------------------------------------------------------------


class Negation:
    """After a negation, SCOPE words are negated."""

    SCOPE = 3
    start = 0

    @staticmethod
    def step(state: int, tag: int, label: tuple) -> tuple[int, tuple]:
        label = (*label, state > 0) if label else label
        return (Negation.SCOPE if tag == NEGATION else max(0, state - 1)), label


class Reported:
    """After a verb of saying, the rest of the clause is reported."""

    start = 0

    @staticmethod
    def step(state: int, tag: int, label: tuple) -> tuple[int, tuple]:
        return (1 if tag == REPORT else state), ((*label, state == 1) if label else label)


class Aimed:
    """A target within SCOPE words before joins at once; one after it joins what waits."""

    SCOPE = 4
    start = (0, 0, ())

    @staticmethod
    def step(state: tuple, tag: int, label: tuple) -> tuple[tuple, tuple]:
        near, wait, held = state
        out = ()
        if held and tag == TARGET:
            out, held = ((*held, True),), ()
        elif held and (wait == 0 or label):
            out, held = ((*held, False),), ()
        if label:
            if near:
                out = (*out, (*label, True))
            else:
                held, wait = label, Aimed.SCOPE
                return (max(0, near - 1), wait, held), out
        return (Aimed.SCOPE if tag == TARGET else max(0, near - 1), max(0, wait - 1), held), out


#: (tag, negated, reported, aimed) of each label, and the grammar's weights.
LABELS = [(t, *x) for t in (INSULT, THREAT, SLUR) for x in itertools.product((False, True), repeat=3)]
PRIOR = np.array([{INSULT: 1.6, THREAT: 0.2, SLUR: 0.8}[t] * (0.4 if neg else 1) * (0.5 if said else 1) + (1.0 if aimed else 0) * (0 if neg else 1) for t, neg, said, aimed in LABELS])


class Composed:
    """The composition of the three transducers; transitions are made when first met, and they are few."""

    def __init__(self):
        self.table: dict = {}
        self.ends: dict = {}

    def run(self, tags: bytes) -> set[int]:
        """The labels of a clause, as places in LABELS."""
        state, found = (Negation.start, Reported.start, Aimed.start), set()
        for tag in tags:
            key = (state, tag)
            if key not in self.table:
                label = (tag,) if INSULT <= tag <= SLUR else ()
                a, label = Negation.step(state[0], tag, label)
                b, label = Reported.step(state[1], tag, label)
                c, out = Aimed.step(state[2], tag, label)
                self.table[key] = (a, b, c), tuple(LABELS.index(x) for x in out)
            state, out = self.table[key]
            found.update(out)
        if state[2][2]:
            found.add(LABELS.index((*state[2][2], False)))
        return found


# --- words ----------------------------------------------------------------------------------------------------------


def _stems(words: Words, rolling: Rolling, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that have a stem of n bytes, and its hash."""
    if n == 0:
        return np.arange(len(words.hash)), words.hash
    at = np.flatnonzero(words.stop - words.start > n)
    return at, rolling.runs(words.start[at], words.start[at] + n) ^ np.uint64(n)


class Text:
    def __init__(self, column: pa.Array):
        self.words = Words(pc.utf8_lower(column), FOLDED)
        self.rolling = Rolling(byte_symbols(self.words.raw))

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in STEM_BYTES:
            yield _stems(self.words, self.rolling, n)


def word_hash(word: str) -> np.uint64:
    return Words(pa.array([word]), FOLDED).hash[0]


class Lookup:
    """Sorted hashes and their values, behind a filter of a bit per leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.value = hashes[order], values[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes >> np.uint64(44)] = True

    def find(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = self.maybe[h >> np.uint64(44)]
        at, h = at[some], h[some]
        k = np.searchsorted(self.hash, h)
        same = self.hash[np.minimum(k, len(self.hash) - 1)] == h if len(self.hash) else np.zeros(len(h), bool)
        return at[same], self.value[k[same]]


@dataclass
class Model:
    stems: np.ndarray
    slurs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([PRIOR, [-4.0]]))

    def __post_init__(self):
        hashes, tags = [*self.stems, *self.slurs], [INSULT] * len(self.stems) + [SLUR] * len(self.slurs)
        for tag, text in SEEDS.items():
            for w in text.split():
                hashes.append(word_hash(w))
                tags.append(tag)
        h, first = np.unique(np.array(hashes, np.uint64), return_index=True)
        self.lookup, self.machine = Lookup(h, np.array(tags, np.uint8)[first]), Composed()

    def labels(self, column: pa.Array) -> np.ndarray:
        """For each text how many of its clauses have each label."""
        text = Text(column)
        words = text.words
        tag = np.zeros(len(words.hash), np.uint8)
        for at, h in text.stems():
            at, value = self.lookup.find(at, h)
            tag[at] = np.where((tag[at] == OTHER) | (value == INSULT), value, tag[at])
        out = np.zeros((len(words.count), len(LABELS)))
        hot = np.flatnonzero((tag >= INSULT) & (tag <= SLUR))
        if len(hot):
            clause = np.concatenate([[0], np.cumsum(_BREAK[words.raw])])[words.start] + words.row
            some = np.unique(clause[hot])
            lo, hi = np.searchsorted(clause, some), np.searchsorted(clause, some, side="right")
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                for k in self.machine.run(tag[a:b].tobytes()):
                    out[words.row[a], k] += 1
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.log1p(self.labels(column)) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


# --- fitting ----------------------------------------------------------------------------------------------------------


def choose_stems(rows: np.ndarray, stem: np.ndarray, toxic: np.ndarray, n_stems: int) -> tuple[list[int], list[int]]:
    """Insults and slurs: (rows, stem) are the pairs of text and stem, each once."""
    order = np.lexsort((rows, stem))
    rows, stem = rows[order], stem[order]
    edge = np.searchsorted(stem, np.arange(n_stems + 1))
    seen = np.bincount(stem[toxic[rows]], minlength=n_stems)
    clean = np.bincount(stem, minlength=n_stems) - seen
    by_row = np.argsort(rows, kind="stable")
    of_row = np.searchsorted(rows[by_row], np.arange(len(toxic) + 1))
    stems_of = {r: set(stem[by_row[of_row[r] : of_row[r + 1]]].tolist()) for r in np.flatnonzero(toxic).tolist()}

    def independent(k: int) -> bool:
        """Whether enough toxic texts have the stem that share less than half of their stems with the texts before."""
        apart: list[set[int]] = []
        for r in rows[edge[k] : edge[k + 1]].tolist():
            if toxic[r] and all(len(stems_of[r] & x) < 0.5 * len(stems_of[r] | x) for x in apart):
                apart.append(stems_of[r])
                if len(apart) >= STEM_TEXTS:
                    return True
        return False

    # more than chance gives one of so many stems
    base = max(1e-3, min(0.5, toxic.mean()))
    enough = seen >= max(STEM_TEXTS, (np.log(max(1, n_stems)) + 4) / -np.log(base))
    insults = [k for k in np.flatnonzero(enough & (seen >= STEM_PRECISION * (seen + clean))).tolist() if independent(k)]
    left = stems_of.keys() - {r for k in insults for r in rows[edge[k] : edge[k + 1]].tolist()}
    open_ = np.zeros(len(toxic), bool)
    open_[list(left)] = True
    gain = np.bincount(stem[open_[rows]], minlength=n_stems)
    slurs = [k for k in np.flatnonzero(enough & (gain >= SLUR_GAIN) & (seen >= SLUR_PRECISION * (seen + clean))).tolist() if independent(k)]
    return insults, sorted(set(slurs) - set(insults))


def fit_weights(counts: np.ndarray, toxic: np.ndarray, rounds: int = 30, spread: float = 3.0) -> np.ndarray:
    """Logistic regression on the labels' logs with the grammar's weights as prior means (deviation `spread`), by Newton's method."""
    x = np.column_stack([np.log1p(counts), np.ones(len(counts))])
    prior = np.concatenate([PRIOR, [-4.0]])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (p - toxic) + (w - prior) / spread**2
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """labels: doc_id, toxic. What comes to the driver is bounded by `rows`: counts of stems, then hits of each row."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    sample = cut(labelled_sample(docs, known, rows).select("text", "toxic"))

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = Text(part.column(0))
            row, h = (np.concatenate(x) for x in zip(*((text.words.row[at], h) for at, h in text.stems()), strict=True))
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            value, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["stem", "n"])

    frequent = sample.where("toxic").select("text").mapInArrow(stems, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= STEM_TEXTS)
    found = np.sort(frequent.select("stem").toArrow().column("stem").to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(Lookup(found, np.arange(len(found), dtype=np.int32)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = Text(part.column(0))
            row, stem = [], []
            for at, h in text.stems():
                at, k = sent.value.find(at, h)
                row.append(text.words.row[at])
                stem.append(k)
            pairs = np.unique(np.concatenate(row).astype(np.int64) << 32 | np.concatenate(stem).astype(np.int64))
            edge = np.searchsorted(pairs >> 32, np.arange(part.num_rows + 1))
            low = (pairs & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([low[a:b].tobytes() for a, b in itertools.pairwise(edge)], pa.binary())], names=["toxic", "stems"])

    got = sample.mapInArrow(hits, "toxic boolean, stems binary").toArrow()
    toxic = got.column("toxic").to_numpy()
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.uint64))
    each = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("stems")]
    pair_rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    insults, slurs = choose_stems(pair_rows, np.concatenate(each), toxic, len(found))
    model = Model(found[insults], found[slurs])
    told = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = told.value.labels(part.column(0))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["toxic", "counts"])

    got = sample.mapInArrow(counted, "toxic boolean, counts binary").toArrow()
    counts = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in got.column("counts")])
    return Model(model.stems, model.slurs, fit_weights(counts, got.column("toxic").to_numpy().astype(float)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(part.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, predict: float = PREDICT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out rows are never looked at."""
    model = fit_toxicity(small_batches(docs), labels.where(~held_out(F.col("doc_id"))), rows)
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= predict).cast("int").alias("predicted"))
