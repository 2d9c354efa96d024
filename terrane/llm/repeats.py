"""Seed and extend: which windows of a sequence also start earlier, by winnowed anchors that are extended both ways.

Every window of `width` symbols has an anchor: the `gram` symbols within it with the least hash (the leftmost of equals).
Equal windows have equal anchors at the same offset; the windows in a row with one anchor make a span.

1. Seeds: each chunk sends its anchors to hash buckets, an anchor once however often the chunk has it. A bucket joins
   each with the one place that has it first, never with all places, so that no pairs within a group arise.
2. Extension: the chunk of the first place sends the text around it, neighbouring anchors as one stretch. The other
   chunk compares symbol by symbol from the anchors outwards. Runs of at least `width` equal symbols are the maximal
   repeats: all windows in them start earlier too.
3. A window that has a known anchor but lies in no such run may still equal one around a later place of the anchor.
   These windows go through the same two steps with longer anchors, at last with whole windows (their hash, the place
   that has it first, its text, comparison). Short anchors get common as a corpus grows; a round of longer ones in
   between (Kind.then) leaves few windows to send by themselves.

All verdicts come from comparing the texts; hashes only choose what is compared. Places are ordered by (doc_id, chunk,
place); rows that share a doc_id go in the order in which they were stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Rolling, Scratch, ints
from terrane.llm.exchange import Store, by_bucket, first_of, joined, parts

_PLACE = np.uint64((1 << 28) - 1)
#: Places of one first chunk that a bucket sends in one row; a chunk that many others copy is read by several tasks.
MAIL_PLACES = 4096

_SENT = "bucket int, chunk long, docs binary, counts binary, a binary, place binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("a", pa.binary()), ("place", pa.binary())])
_FOUND = "chunk long, split long, own binary, place binary, first binary"
_TEXTS = pa.schema([("chunk", pa.int64()), ("lo", pa.binary()), ("size", pa.binary()), ("text", pa.binary()), ("place", pa.binary()), ("at", pa.binary()), ("doc", pa.binary()), ("of", pa.binary())])
_TEXTS_DDL = "chunk long, lo binary, size binary, text binary, place binary, at binary, doc binary, of binary"


@dataclass(frozen=True)
class Kind:
    """width and gram in symbols; text(column) gives the symbols (Words or Bytes): hash, first (where rows begin, and the end), same and cut.

    across: only an equal in a smaller doc_id counts; else an earlier one in the same document counts too.
    then: longer grams, whose anchors are tried in this order before whole windows.
    """

    width: int
    gram: int
    across: bool
    text: Callable[[pa.Array], object]
    bytes_per_symbol: float
    then: tuple[int, ...] = ()


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    size, n = 1, len(keys) - width + 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:n], keys[width - size : width - size + n])


class Chunk:
    """The texts of a chunk as symbols, and which places begin a window."""

    def __init__(self, number: int, batch: pa.RecordBatch, kind: Kind):
        self.number, self.kind, w = number, kind, kind.width
        self.text = kind.text(batch.column(batch.schema.get_field_index("text")))
        self.first, n = self.text.first, len(self.text)
        if n > int(_PLACE):
            raise ValueError("one text has more symbols than a chunk can hold")
        self.ids = ints(batch.column(batch.schema.get_field_index("doc_id")))
        edge = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(np.diff(self.first) >= w)
        edge[self.first[long]] += 1
        edge[self.first[long + 1] - w + 1] -= 1
        self.valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        self.repeated = np.zeros(n, bool)

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def compare(self, other, own_lo: np.ndarray, other_lo: np.ndarray, size: np.ndarray, doc: np.ndarray, number: np.ndarray, place: np.ndarray) -> None:
        """Mark the windows within own_lo + size that are equal to those at other_lo of the text other.

        doc, number (of the chunk) and place say where the other stretch stands, since only what is earlier counts.
        """
        low = np.maximum(0, -own_lo)
        own_lo, other_lo, place, size = own_lo + low, other_lo + low, place + low, size - low
        size = np.minimum(size, len(self.valid) - own_lo)
        w = self.kind.width
        some = size >= w
        own_lo, other_lo, place, size, doc, number = (x[some] for x in (own_lo, other_lo, place, size, doc, number))
        lo = 0
        ends = np.cumsum(size)
        while lo < len(size):  # a bounded number of symbols at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), side="right")))
            n = size[lo:hi]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(own_lo[lo:hi], n) + step
            differ = np.concatenate([[0], np.cumsum(~self.text.same(own, other, np.repeat(other_lo[lo:hi], n) + step))])
            at = np.flatnonzero(step <= np.repeat(n, n) - w)
            at = at[(differ[at + w] == differ[at]) & self.valid[own[at]]]
            if len(at):
                which = np.repeat(np.arange(lo, hi), n)[at]
                own, there = own[at], place[which] + step[at]
                mine = self.ids[self.row(own)]
                earlier = doc[which] < mine
                if not self.kind.across:
                    earlier |= (doc[which] == mine) & ((number[which] < self.number) | ((number[which] == self.number) & (there < own)))
                self.repeated[own[earlier]] = True
            lo = hi

    def covered(self) -> np.ndarray:
        """Whether a repeated window covers each symbol."""
        edge = np.zeros(len(self.repeated) + self.kind.width + 1, np.int32)
        at = np.flatnonzero(self.repeated)
        edge[at] += 1
        edge[at + self.kind.width] -= 1
        return np.cumsum(edge)[: len(self.repeated)] > 0


class Spans(Chunk):
    """The spans of a chunk, and of each anchor the first span that has it."""

    def __init__(self, number: int, batch: pa.RecordBatch, kind: Kind):
        super().__init__(number, batch, kind)
        self.rolling = Rolling(self.text.hash)

    def choose(self, gram: int, asked: np.ndarray) -> None:
        """The spans of the windows asked for, by their anchors of gram symbols."""
        w, n = self.kind.width, len(self.text)
        self.start = self.stop = self.at = np.zeros(0, np.int64)
        self.a = np.zeros(0, np.uint64)
        if gram == w:
            self.start = self.at = np.flatnonzero(asked)
            self.stop = self.start + 1
            self.a = self.rolling.runs(self.at, self.at + w)
        elif n >= w and asked.any():
            window, reach = np.flatnonzero(asked), w - gram
            if len(window) * 4 > n:
                grams = self.rolling.grams(gram)
                keys, near, first = grams & ~_PLACE, np.arange(len(grams)), window
            else:  # only the places within windows asked for; those of a window stay neighbours
                edge = np.zeros(n + 1, np.int32)
                edge[window] = 1
                np.subtract.at(edge, window + reach + 1, 1)
                near = np.flatnonzero(np.cumsum(edge) > 0)
                keys, first = self.rolling.runs(near, near + gram) & ~_PLACE, np.searchsorted(near, window)
            keys |= near.astype(np.uint64)
            place = (_least(keys, reach + 1)[first] & _PLACE).astype(np.int64)
            new = np.ones(len(window), bool)
            new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
            self.start, self.at = window[new], place[new]
            self.stop = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1] + 1  # windows, half open
            self.a = self.rolling.runs(self.at, self.at + gram)
        self.lead = _leads(self.a)
        self.sent = np.flatnonzero(self.lead == np.arange(len(self.a)))


def _leads(keys: np.ndarray) -> np.ndarray:
    """For each key the place of the first that is equal."""
    order, new, group = first_of(keys)
    lead = np.zeros(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)][group] if len(order) else 0
    return lead


def _rows(chunk: Chunk, places: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that gets keys; documents as runs."""
    order, some, edges = by_bucket(keys, buckets)
    doc = chunk.ids[chunk.row(places[order])]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    new[edges[:-1]] = True
    run = np.flatnonzero(new)
    size = np.diff(run, append=len(doc)).astype(np.uint32)
    runs = np.searchsorted(run, edges)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk.number)), parts(doc[run], runs), parts(size, runs), parts(keys[order], edges), parts(places[order].astype(np.int32), edges)], schema=_SENT_ARROW)


#: Gets the keys of a bucket with document, sender and place; gives the index of each key's first holder.
Earliest = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sorted_earliest(a: np.ndarray, doc: np.ndarray, sender: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.lexsort((place, sender, doc, a))
    new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
    out = np.zeros(len(a), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def first_places(sent: DataFrame, earliest: Earliest, across: bool) -> DataFrame:
    """For the chunks that have a key first: which places of which chunks have it too.

    A place whose key stands first in a document of the same id, where that doesn't count, goes back to its own chunk
    with the place -1.
    """

    def bucket(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("chunk")
        chunk = table.column("chunk").to_numpy()
        a, size = joined(table.column("a"), np.uint64)
        doc = np.repeat(joined(table.column("docs"), np.int64)[0], joined(table.column("counts"), np.uint32)[0])
        place = joined(table.column("place"), np.int32)[0]
        sender = np.repeat(np.arange(len(size)), size)
        of = earliest(a, doc, sender, place)
        hit = np.flatnonzero(of != np.arange(len(a)))
        of = of[hit]
        back = (doc[of] == doc[hit]) & across
        src = np.where(back, sender[hit], sender[of])
        first = np.where(back, -1, place[of]).astype(np.int32)
        order = np.lexsort((place[hit], sender[hit], src))
        src, first, hit = src[order], first[order], hit[order]
        begin = np.flatnonzero(np.diff(src, prepend=-1))
        number = np.arange(len(src)) - np.repeat(begin, np.diff(begin, append=len(src)))
        edges = np.append(np.flatnonzero(number % MAIL_PLACES == 0), len(src))
        at = edges[:-1]
        return pa.table({"chunk": pa.array(chunk[src[at]]), "split": pa.array(number[at] // MAIL_PLACES), "own": parts(chunk[sender[hit]], edges), "place": parts(place[hit], edges), "first": parts(first, edges)})

    return sent.groupBy("bucket").applyInArrow(bucket, _FOUND)


def stretches(keys: tuple[np.ndarray, ...], there: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places with equal keys whose surroundings (before and after) touch, as stretches: order, stretch of each in order, its first in order, begin, end.

    lo and hi hold each place's surroundings; they are part of what must be equal.
    """
    order = np.lexsort((there, lo, *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = there[order][1:] - there[order][:-1] > before + after
        for k in (lo, *keys):
            new[1:] |= k[order][1:] != k[order][:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order))[: len(head)] - 1
    begin = np.maximum(lo[order][head], there[order][head] - before)
    end = np.minimum(hi[order][head], there[order][tail] + after)
    return order, np.cumsum(new) - 1, order[head], begin, end


def send_texts(store: Store, found: DataFrame, kind: Kind, before: int, after: int) -> DataFrame:
    """The texts around first places, for the chunks that have their keys too."""

    def texts(number: int, batch: pa.RecordBatch, mail: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        own, _ = joined(mail[0].column("own"), np.int64)
        place, first = (joined(mail[0].column(c), np.int32)[0].astype(np.int64) for c in ("place", "first"))
        back = np.flatnonzero(first < 0)
        empty = np.zeros(0, np.int64)
        if len(back):
            yield _letter(number, empty, empty, b"", place[back], np.full(len(back), -1), empty, number)
        some = np.flatnonzero(first >= 0)
        if not len(some):
            return
        own, place, first = own[some], place[some], first[some]
        x = Chunk(number, batch, kind)
        row = x.row(first)
        order, which, head, begin, end = stretches((place - first, own), first, x.first[row], x.first[row + 1], before, after)
        shift = (place - first)[head]
        edges = np.append(np.flatnonzero(np.concatenate([[True], own[head][1:] != own[head][:-1]])), len(head))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            body = [x.text.cut(b, e) for b, e in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
            a, b = np.searchsorted(which, (lo, hi))
            size = np.array([len(t) for t in body])
            yield _letter(int(own[head[lo]]), begin[lo:hi] + shift[lo:hi], size, b"".join(body), place[order[a:b]], which[a:b] - lo, x.ids[row[head[lo:hi]]], number, begin[lo:hi])

    return store.with_mail([found], texts, _TEXTS, _TEXTS_DDL, missing_ok=False, split="split")


def _letter(to: int, lo: np.ndarray, size: np.ndarray, body: bytes, place: np.ndarray, at: np.ndarray, doc: np.ndarray, of: int, there: np.ndarray = np.zeros(0, np.int64)) -> pa.RecordBatch:
    pack = lambda x, t: pa.array([np.asarray(x).astype(t).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([to]), pack(lo, np.int32), pack(size, np.int32), pa.array([body], pa.binary()), pack(place, np.int32), pack(at, np.int32), pack(doc, np.int64), pack(np.append(of, there), np.int64)], schema=_TEXTS)


class Letters:
    """The stretches of text that a chunk got, as one text with a row for each, and the places that asked for them."""

    def __init__(self, mail: pa.Table, kind: Kind):
        number = lambda c, t: joined(mail.column(c), t)
        self.lo, count = number("lo", np.int32)
        self.lo = self.lo.astype(np.int64)
        size, _ = number("size", np.int32)
        self.doc, _ = number("doc", np.int64)
        of = [np.frombuffer(x.as_buffer(), np.int64) for x in mail.column("of")]
        self.of = np.repeat(np.array([x[0] for x in of], np.int64), count)
        self.there = np.concatenate([x[1:] for x in of]) if of else np.zeros(0, np.int64)
        body = b"".join(x.as_py() for x in mail.column("text"))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])
        self.text = kind.text(column)
        place, each = number("place", np.int32)
        at, _ = number("at", np.int32)
        order = np.argsort(place, kind="stable")
        self.place = place.astype(np.int64)[order]
        #: The stretch that a place asked for, or -1.
        self.at = np.where(at < 0, -1, at + np.repeat(np.cumsum(count) - count, each))[order].astype(np.int64)

    def settle(self, chunk: Chunk) -> None:
        """Compare each stretch where it was asked for."""
        first = self.text.first
        chunk.compare(self.text, self.lo, first[:-1], np.diff(first), self.doc, self.of, self.there)

    def follow(self, chunk: Chunk, place: np.ndarray, lead: np.ndarray, before: int, after: int) -> None:
        """Compare places with the place of the chunk that has the same key first (lead), and with the text it got."""
        row = chunk.row(lead)
        _, _, head, begin, end = stretches((place - lead,), lead, chunk.first[row], chunk.first[row + 1], before, after)
        number = np.full(len(head), chunk.number)
        chunk.compare(chunk.text, begin + (place - lead)[head], begin, end - begin, chunk.ids[row[head]], number, begin)
        if not len(self.place):
            return
        which = np.minimum(np.searchsorted(self.place, lead), len(self.place) - 1)
        some = np.flatnonzero((self.place[which] == lead) & (self.at[which] >= 0))
        place, lead, at = place[some], lead[some], self.at[which[some]]
        first = self.text.first
        there = first[at] + lead - self.lo[at]  # the key's place in the text that came
        _, _, head, begin, end = stretches((place - there,), there, first[at], first[at + 1], before, after)
        of = at[head]
        chunk.compare(self.text, begin + (place - there)[head], begin, end - begin, self.doc[of], self.of[of], self.there[of] + begin - first[of])


def _bits(mask: np.ndarray) -> pa.Array:
    return pa.array([pa.compress(np.packbits(mask).tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _mask(column: pa.ChunkedArray, n: int) -> np.ndarray:
    body = pa.decompress(column[0].as_buffer(), decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def mark_repeats(store: Store, kind: Kind, finish: Callable[[pa.RecordBatch, Chunk], pa.RecordBatch], schema: pa.Schema, ddl: str, earliest: Earliest = sorted_earliest) -> DataFrame:
    """finish(rows, chunk) of every chunk, whose covered() tells of each symbol if a repeated window has it."""
    scratch = Scratch(store.rows.sparkSession)
    buckets, w = store.buckets(2 / (kind.width - kind.gram + 2) / kind.bytes_per_symbol), kind.width
    grams = (kind.gram, *kind.then, w)

    def anchors(number: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = Spans(number, rows, kind)
        x.choose(kind.gram, x.valid)
        yield _rows(x, x.at[x.sent], x.a[x.sent], buckets)

    def settled(number: int, rows: pa.RecordBatch, mail: list[pa.Table], gram: int) -> tuple[Spans, np.ndarray]:
        """The chunk after the letters for its anchors of gram symbols, and the windows that may still repeat."""
        x, got = Spans(number, rows, kind), Letters(mail[0], kind)
        n, asked = len(x.repeated), x.valid
        if len(mail) > 1:
            x.repeated, asked = _mask(mail[1].column("text"), n), _mask(mail[1].column("place"), n)
        x.choose(gram, asked)
        got.settle(x)
        later = np.flatnonzero(x.at != x.at[x.lead])
        got.follow(x, x.at[later], x.at[x.lead[later]], w - gram, w)
        # the windows of known anchors that are in no run
        known = np.isin(x.at, got.place)
        known[later] = True
        edge = np.zeros(n + 1, np.int8)
        edge[x.start[known]] += 1
        edge[x.stop[known]] -= 1
        return x, np.cumsum(edge[:-1], dtype=np.int8).astype(bool) & ~x.repeated

    def ask(gram: int, longer: int) -> Callable[[int, pa.RecordBatch, list[pa.Table]], Iterator[pa.RecordBatch]]:
        def work(number: int, rows: pa.RecordBatch, mail: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            x, left = settled(number, rows, mail, gram)
            x.choose(longer, left)
            yield _rows(x, x.at[x.sent], x.a[x.sent], buckets)
            empty = pa.array([b""], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([number]), _bits(left), empty, _bits(x.repeated), empty], schema=_SENT_ARROW)

        return work

    def marked(number: int, rows: pa.RecordBatch, mail: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield finish(rows, settled(number, rows, mail, w)[0])

    nothing = F.lit(None).cast("binary")
    sent, state = store.each(anchors, _SENT), []
    for k, gram in enumerate(grams):
        found = scratch.write(first_places(sent, earliest, kind.across), f"first-{k}", release=True)
        mail = [send_texts(store, found, kind, w - gram, w), *state]
        if gram == w:
            return store.with_mail(mail, marked, schema, ddl)
        left = scratch.write(store.with_mail(mail, ask(gram, grams[k + 1]), _SENT_ARROW, _SENT), f"left-{k}", release=True)
        scratch.delete(f"first-{k}", f"left-{k - 1}")
        sent = left.where("bucket >= 0")
        state = [left.where("bucket = -1").select("chunk", nothing.alias("lo"), nothing.alias("size"), F.col("a").alias("text"), F.col("docs").alias("place"), nothing.alias("at"), nothing.alias("doc"), nothing.alias("of"))]
    raise AssertionError("grams end with the width")
