"""Sampled segmentation into the pieces of a public vocabulary, and lossless decoding.

A text is cut where no piece reaches across (before the first of a run of spaces, and around characters that no longer
piece holds); each unit has a lattice whose arcs are the pieces that match. Forward filtering sums the weights of all
ways to reach a place; backward sampling draws the last piece of a unit with its share of that sum, then the one before
it, and so on. All units of a slice are filtered and sampled at once, place by place; a unit that occurs often is
filtered once. Pieces are found by a double-array trie, a byte of all places at a time. Draws are hashes of the seed, the
row's key, the unit's number in the row and the step, so they are the same however rows are dealt out.

A piece's weight is exp(scale * score). A character without a piece of its own becomes its UTF-8 bytes, as does the
mark that stands for a space in the vocabulary, so that decoding gives the text back byte for byte.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; a null key counts as the least
number; rows with the same key and text get the same pieces. Rows are neither merged nor dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import ints, mix, run_hashes, same_runs, slices, small_batches, text_bytes

SPACE = "▁"
#: Exponent of a point of score; seed of the draws; what a character's bytes cost beside the least score.
SCALE, SEED, BYTES_COST = 5e-4, 17, 10.0
#: Bytes of text that are encoded at once, and rows that are decoded at once.
_SLICE, _DECODED = 1 << 19, 100
_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4


@dataclass(frozen=True)
class Vocabulary:
    """pieces: the bytes of each id (a space as one byte; None for control pieces); byte_ids: the ids of the 256 bytes."""

    pieces: list[bytes | None]
    scores: list[float]
    byte_ids: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], np.full(256, -1, np.int64)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        pieces.append(None if special else piece.replace(SPACE, " ").encode())
        scores.append(model.get_score(i))
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks pieces for single bytes, so it can't be lossless")
    return Vocabulary(pieces, scores, byte_ids)


class Trie:
    """Byte strings as a double array: the child of state s by byte c is t = base[s] + c, if owner[t] is s."""

    def __init__(self, body: list[bytes]):
        child: list[dict[int, int]] = [{}]
        ends = {}
        for i, piece in enumerate(body):
            node = 0
            for c in piece:
                node = child[node].setdefault(c, len(child))
                if node == len(child):
                    child.append({})
            ends.setdefault(node, i)
        # each node's children go to the first places that are free; a place is looked for beyond those of single bytes
        free, state, low = bytearray(b"\1") * (2 * len(child) + 1024), [0] * len(child), 256
        base, owner = [0] * len(free), [-1] * len(free)
        for node, to in enumerate(child):  # a node comes after its parent
            if not to:
                continue
            codes = sorted(to)
            low = at = free.index(1, low)
            while not all(free[at - codes[0] + c] for c in codes):
                at = free.index(1, at + 1)
            at -= codes[0]
            base[state[node]] = at
            for c in codes:
                free[at + c], owner[at + c], state[to[c]] = 0, state[node], at + c
            if at + 1024 > len(free):
                more = len(free)
                free, base, owner = free + bytearray(b"\1") * more, base + [0] * more, owner + [-1] * more
        self.base, self.owner = np.array(base, np.int32), np.array(owner, np.int32)
        #: The string that ends in a state, or -1.
        self.final = np.full(len(self.base), -1, np.int32)
        for node, i in ends.items():
            self.final[state[node]] = i

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: the places of those in at where a string of n symbols stands, and which; no string has a symbol beyond 255."""
        state, n = np.zeros(len(at), np.int32), 0
        while len(at):
            to = self.base.take(state) + symbols.take(at + n)
            on = np.flatnonzero(self.owner.take(to) == state)
            at, state, n = at.take(on), to.take(on), n + 1
            which = self.final.take(state)
            hit = np.flatnonzero(which >= 0)
            yield at.take(hit), which.take(hit)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, scale: float = SCALE, seed: int = SEED):
        ids = [i for i, p in enumerate(vocabulary.pieces) if p]
        body = [vocabulary.pieces[i] for i in ids]
        self.trie, self.id = Trie(body), np.array(ids, np.int32)
        self.weight = np.array([vocabulary.scores[i] for i in ids]) * scale
        self.byte_ids, self.byte_weight = vocabulary.byte_ids, min(vocabulary.scores) * scale - BYTES_COST
        self.seed = mix(np.array([seed], np.uint64))[0]
        # where texts may be cut
        self.lone = np.ones(256, bool)
        self.lone[0x80:] = False
        for p in body:
            if len(p) > 1:
                self.lone[np.frombuffer(p, np.uint8)] = False
        self.lone[0x20] = False
        self.at_spaces = not any(b" " in p.lstrip(b" ") for p in body)

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(raw) + 1, bool)
        if self.at_spaces:
            space = raw == 0x20
            begins[1:-1] = space[1:] & ~space[:-1]
        lone = self.lone[raw]
        begins[:-1] |= lone
        begins[1:] |= lone
        begins[offsets] = True
        return np.flatnonzero(begins[:-1])

    def _lattice(self, raw: np.ndarray, edge: np.ndarray):
        """Ways to the nodes of all units: nodes by place and then by unit (the longest first), so that a place is one block.

        Gives the last node of each unit, the number of first nodes, where the arcs into each node begin, and of each
        arc its first node, the sum of the shares up to it (2 for the last one of a node), piece or -1, first byte, ids.
        """
        size = np.diff(edge)
        rank = np.zeros(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        longest = int(size.max()) if len(size) else 0
        wide = np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1]  # units with that place
        block = np.concatenate([[0], np.cumsum(wide)])
        # bytes of units with a symbol of no byte after each
        unit = np.repeat(np.arange(len(size)), size + 1)
        first = edge[:-1] + np.arange(len(size))
        node = block[np.arange(len(unit)) - first[unit]] + rank[unit]
        inner = np.ones(len(unit), bool)
        inner[edge[1:] + np.arange(len(size))] = False
        symbols = np.full(len(unit), 256, np.int32)
        symbols[inner] = raw
        at = np.flatnonzero(inner & ((symbols & 0xC0) != 0x80))
        own = _CHAR_BYTES[symbols & 0xFF]
        single = np.zeros(len(unit), bool)
        found = []
        for n, (i, which) in enumerate(self.trie.walk(symbols, at), 1):
            single[i[own.take(i) == n]] = True
            found.append((node.take(i), node.take(i + n), which))
        bare = at[~single[at]]
        stop = np.minimum(bare + own[bare], (edge[1:] + np.arange(len(size)))[unit[bare]])
        into = node[stop]
        count = np.bincount(into, minlength=len(unit))
        for _, b, _ in found:
            count[b] += 1  # those of one length have ends of their own
        bound = np.concatenate([[0], np.cumsum(count)])
        here = bound[:-1].copy()
        a, which = np.zeros(bound[-1], np.int64), np.full(bound[-1], -1, np.int32)
        for from_, b, k in found:
            to = here.take(b)
            a[to], which[to] = from_, k
            here[b] = to + 1
        order = np.argsort(into, kind="stable")
        to = here[into[order]] + np.arange(len(order)) - np.searchsorted(into[order], into[order])
        first_byte, width = np.zeros(len(a), np.int64), np.ones(len(a), np.int64)
        a[to] = node[bare[order]]
        first_byte[to], width[to] = (bare - unit[bare])[order], (stop - bare)[order]
        weight = np.where(which < 0, self.byte_weight, self.weight.take(which))
        total = np.full(len(unit), -np.inf)
        total[: block[1]] = 0.0
        for lo, hi in zip(block[1:-1].tolist(), block[2:].tolist(), strict=True):
            p, q = bound[lo], bound[hi]
            if p == q:
                continue
            value = total.take(a[p:q]) + weight[p:q]
            n = count[lo:hi]
            some = np.flatnonzero(n)
            groups, n = bound[lo:hi][some] - p, n[some]
            most = np.maximum.reduceat(value, groups)
            total[lo + some] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, n)), groups))
        upto = np.exp(total.take(a) + weight - np.repeat(total, count))
        nodes, k = np.flatnonzero(count > 1), 1
        while len(nodes):
            arc = bound.take(nodes) + k
            upto[arc] += upto.take(arc - 1)
            k += 1
            nodes = nodes[count.take(nodes) > k]
        upto[bound[1:][count > 0] - 1] = 2.0
        return block[size] + rank, int(block[1]) if len(size) else 0, bound, a, upto, np.where(which < 0, -1, self.id.take(which)), first_byte, width

    def encode(self, texts: pa.Array, keys: np.ndarray) -> pa.Array:
        empty = pc.equal(pc.binary_length(texts), 0).fill_null(True)
        marked = pc.if_else(empty, pa.scalar("", pa.string()), pc.binary_join_element_wise(pa.scalar(" "), texts.fill_null(""), ""))
        raw, offsets = text_bytes(marked)
        begin = self._units(raw, offsets[:-1][np.diff(offsets) > 0]) if len(raw) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(raw))[: len(begin)]
        row = np.searchsorted(offsets, begin, side="right") - 1
        number = np.arange(len(begin)) - np.searchsorted(begin, offsets)[row]
        draw = mix(mix(keys.astype(np.uint64) ^ self.seed)[row] ^ mix(number.astype(np.uint64)))
        h = run_hashes(raw, begin, end)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        one, word = order[new], np.cumsum(new) - 1
        # units with one hash share a lattice if they are the same bytes; others get their own
        size = (end - begin)[order]
        odd = np.flatnonzero((size != size[new][word]) | ~same_runs(raw, begin[order], raw, begin[one][word], size))
        word[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, order[odd]])
        size = end[one] - begin[one]
        edge = np.concatenate([[0], np.cumsum(size)])
        bytes_at = np.repeat(begin[one] - edge[:-1], size) + np.arange(edge[-1])
        units = raw[bytes_at]
        last, firsts, bound, a, upto, piece, first_byte, width = self._lattice(units, edge)
        # backward sampling, in order of the unit so that neighbours are near
        who, node = order, last[word]
        taken, step = [], 0
        while len(who):
            u = (mix(draw.take(who) + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = bound.take(node)
            on = np.flatnonzero(upto.take(arc) <= u)
            while len(on):
                arc[on] += 1
                on = on[upto.take(arc.take(on)) <= u.take(on)]
            taken.append((who, arc))
            node = a.take(arc)
            on = np.flatnonzero(node >= firsts)
            who, node = who.take(on), node.take(on)
            step += 1
        count = np.zeros(len(begin), np.int64)
        for who, arc in taken:
            count[who] += width[arc]
        left = np.cumsum(count)
        out = np.zeros(int(left[-1]) if len(left) else 0, np.int32)
        for who, arc in taken:
            left[who] -= width[arc]
            plain = piece[arc] >= 0
            out[left[who[plain]]] = piece[arc[plain]]
            for j in range(4):
                some = ~plain & (width[arc] > j)
                out[left[who[some]] + j] = self.byte_ids[units[first_byte[arc[some]] + j]]
            # later draws of a unit stand before earlier ones
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=len(keys)))]).astype(np.int64)
        made = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(out))
        return pc.if_else(texts.is_null(), pa.scalar(None, made.type), made) if texts.null_count else made


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        body = [p or b"" for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            body[i] = bytes([b])
        self.raw, self.size = np.frombuffer(b"".join(body), np.uint8), np.array([len(p) for p in body])
        self.start = np.cumsum(self.size) - self.size

    def decode(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        size = self.size[ids]
        ends = np.cumsum(size)
        out = self.raw[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        some = np.diff(sums) > 0
        lead = np.ones(len(out), bool)
        lead[sums[:-1][some]] = False  # the space before each text
        offsets = sums - np.concatenate([[0], np.cumsum(some)])
        made = pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[lead].tobytes())]).cast(pa.string())
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), made) if lists.null_count else made


def _columns(keep: list[str], df: DataFrame) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in keep)


def encode_sampled(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = (), scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """doc_id, the columns in keep and ids (array<int>), a segmentation sampled with the row's doc_id as key.

    The vocabulary (tens of thousands of pieces, whatever the corpus) is sent to all tasks.
    """
    keep = ["doc_id", *keep]
    docs = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary, scale, seed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            own = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_arrays([*(own[c] for c in keep), sent.value.encode(own["text"], ints(own["doc_id"]))], names=[*keep, "ids"])

    return small_batches(docs).mapInArrow(work, _columns(keep, docs) + "ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep and decoded, the text of ids."""
    keep = ["doc_id", *keep]
    encoded = encoded.select("ids", *keep) if "ids" not in keep else encoded.select(*keep)
    sent = encoded.sparkSession.sparkContext.broadcast(Decoder(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _DECODED):
                part = batch.slice(at, _DECODED)
                own = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                yield pa.RecordBatch.from_arrays([*(own[c] for c in keep), sent.value.decode(own["ids"])], names=[*keep, "decoded"])

    return encoded.mapInArrow(work, _columns(keep, encoded) + "decoded string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_pieces and lossless: whether decoding gives the text back."""
    done = decode(encode_sampled(docs, vocabulary, ("text",)), vocabulary, ("text", "ids"))
    return done.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
