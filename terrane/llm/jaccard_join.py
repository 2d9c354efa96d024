"""Near duplicates by a grouped prefix join on word n-grams.

A document is its set of distinct n-grams, ordered by how many documents hold each (counted over the whole corpus), the
rarest first. Two sets with Jaccard similarity of the threshold or more share an n-gram among the first of each (the
prefix), and at the first that they share, what is left of each set bounds what they can have in common.

1. Chunks send their n-grams to hash buckets, which answer with the number of documents (exchange.py).
2. Documents with the same prefix and size are one group, those with the same words one class within it. Only a group's
   n-grams that other documents have go on, with their place in the prefix and the size of the set.
3. Pairs of groups are filtered by size and place where they share an n-gram. First each group meets only the group that
   comes earliest in its n-gram's order of places (the star of a cluster); members are verified, links make components,
   and pairs within one component need no test any more. What is left between components, usually little, is verified
   too: rounds of stars as long as there are many such pairs, then all of them.
4. Members are verified on their words, not on hashes.

Defined results: null and empty texts have no n-grams and are linked with nothing; a text of fewer words than n has its
whole sequence as one n-gram; a null doc_id is linked with nothing and has no component; rows that share a doc_id are one
vertex. Every input row gives a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import LOWERED, Rolling, Scratch, Words, cut, ints, mix
from terrane.llm.exchange import STEP, Store, by_bucket, first_of, joined, parts
from terrane.operators.components import connected_components

#: Bytes of a chunk.
CHUNK_BYTES = 2 << 20
#: Words of an n-gram and least similarity in the pipeline's stage.
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: Rounds of stars at most before all pairs that are left, and how many pairs a member may have left for that.
ROUNDS, FEW = 4, 4
_NULL = np.iinfo(np.int64).min
_SENT = "bucket int, chunk long, a binary, n binary"
_MAIL = pa.schema([("chunk", pa.int64()), ("bucket", pa.binary()), ("codes", pa.binary())])
_NODE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("word1", pa.int64()), ("word2", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_NODE_DDL = "doc_id long, row long, n long, word1 long, word2 long, set1 long, set2 long, keys array<long>, places array<int>"


class Sets:
    """The sorted n-gram sets of a chunk: hashes one row after the other, and where rows begin."""

    def __init__(self, batch: pa.RecordBatch, words: int):
        x = Words(batch.column(batch.schema.get_field_index("text")), LOWERED)
        rolling = Rolling(x.hash)
        at = np.flatnonzero(x.row[words - 1 :] == x.row[: len(x.row) - words + 1]) if len(x.row) >= words else np.zeros(0, np.int64)
        short = np.flatnonzero((x.count > 0) & (x.count < words))
        h = np.concatenate([rolling.runs(at, at + words), rolling.runs(x.first[short], x.first[short] + x.count[short])])
        row = np.concatenate([x.row[at], short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.words = x
        self.ids = ints(batch.column(batch.schema.get_field_index("doc_id")))
        self.hash, self.row = h[new], row[new]
        self.edge = np.searchsorted(self.row, np.arange(batch.num_rows + 1))
        self.n = np.diff(self.edge)


class Prefixes(Sets):
    """Sets with the n-grams of each prefix that other documents have, in order, and the signatures of words and prefix."""

    def __init__(self, batch: pa.RecordBatch, words: int, percent: int, level_of):
        super().__init__(batch, words)
        level = level_of(self.hash)
        order = np.lexsort((self.hash, level, self.row))
        size = np.where(self.n > 0, self.n + (-percent * self.n // 100) + 1, 0)
        ends = np.cumsum(size)
        place = np.arange(int(size.sum())) - np.repeat(ends - size, size)
        take = order[np.repeat(self.edge[:-1], size) + place]
        token, row = self.hash[take], self.row[take]
        known = mix(self.n.astype(np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(0xA5A5)), dtype=np.uint64)])
        self.group = np.stack([(Rolling(token).runs(ends - size, ends) ^ known), mix(sums[ends] - sums[ends - size] + known)], 1).view(np.int64)
        self.digest = np.zeros((len(self.n), 2), np.int64)
        text = self.words.joined(np.ones(len(self.words.start), bool), self.words.read)
        for i in np.flatnonzero(self.n):
            self.digest[i] = np.frombuffer(hashlib.blake2b(text[int(i)].as_buffer(), digest_size=16).digest(), np.int64)
        # a chunk's first document of a group gives the group's n-grams
        some = np.flatnonzero((self.n > 0) & (self.ids != _NULL))
        by, new, _ = first_of(self.group[some, 0], self.group[some, 1])
        lead = np.zeros(len(self.n), bool)
        lead[some[by[new]]] = True
        held = lead[row] & (level[take] > 0)
        self.token, self.place = token[held], place[held].astype(np.int32)
        self.token_edge = np.searchsorted(row[held], np.arange(len(self.n) + 1))


def _levels(total: np.ndarray) -> np.ndarray:
    """One byte that grows with the count of documents, 0 for one."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(1, total)))).astype(np.uint8)


def _count(sent: DataFrame) -> DataFrame:
    """For each bucket and chunk the levels of its n-grams."""

    def bucket(table: pa.Table) -> pa.Table:
        a, size = joined(table.column("a"), np.uint64)
        n, _ = joined(table.column("n"), np.uint8)
        order = np.argsort(a)
        new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        codes = np.zeros(len(a), np.uint8)
        codes[order] = _levels(total)[np.cumsum(new) - 1]
        own = np.array([table.column("bucket")[0].as_py()], np.int32).tobytes()
        return pa.table([table.column("chunk"), pa.array([own] * len(size), pa.binary()), parts(codes, np.append(0, np.cumsum(size)))], schema=_MAIL)

    return sent.groupBy("bucket").applyInArrow(bucket, "chunk long, bucket binary, codes binary")


def _level_of(mail: pa.Table, buckets: int):
    """Gives the levels of a chunk's n-grams from its mail, which has those of each distinct one in order of buckets."""
    codes = {int.from_bytes(b.as_py(), "little"): np.frombuffer(c.as_buffer(), np.uint8) for b, c in zip(mail.column("bucket"), mail.column("codes"), strict=True)}

    def level_of(h: np.ndarray) -> np.ndarray:
        own, which = np.unique(h, return_inverse=True)
        if not len(own):
            return np.zeros(0, np.uint8)
        order, some, _ = by_bucket(own, buckets)
        level = np.zeros(len(own), np.uint8)
        level[order] = np.concatenate([codes[b] for b in some.tolist()])
        return level[which]

    return level_of


def _grams(text: bytes, words: int) -> set:
    w = text.split(b" ")
    return {tuple(w)} if len(w) < words else set(zip(*(w[i:] for i in range(words)), strict=False))


class Verifier:
    """Compares the sets of pairs of rows on their words, which it reads once for each row asked for."""

    def __init__(self, store: Store, scratch: Scratch, words: int, percent: int):
        self.store, self.scratch, self.words, self.percent, self.round = store, scratch, words, percent, 0

    def _texts(self, rows: DataFrame) -> DataFrame:
        schema = pa.schema([("row", pa.int64()), ("text", pa.binary())])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = [np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(asked, pa.binary())], names=["chunk", "rows"])

        def texts(chunk: int, batch: pa.RecordBatch, mail: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            asked = np.unique(joined(mail[0].column("rows"), np.int64)[0])
            own = batch.take(pa.array(asked - chunk))
            x = Words(own.column(own.schema.get_field_index("text")), LOWERED)
            yield pa.RecordBatch.from_arrays([pa.array(asked), x.joined(np.ones(len(x.start), bool), x.read)], schema=schema)

        asked = rows.groupBy((F.col("row") - F.pmod("row", F.lit(STEP))).alias("chunk")).agg(F.collect_set("row").alias("rows"))
        return self.store.with_mail([asked.mapInArrow(packed, "chunk long, rows binary")], texts, schema, "row long, text binary", missing_ok=False)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets are similar enough. Joins can split a row with many pairs."""
        words, percent = self.words, self.percent
        rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        texts = self.scratch.write(self._texts(rows), f"texts{self.round}")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, one = None, set()
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i, (a, x, y) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3), strict=True)):
                    if a != last:
                        last, one = a, _grams(x.as_py(), words)
                    other = _grams(y.as_py(), words)
                    both = len(one & other)
                    keep[i] = 100 * both >= percent * (len(one) + len(other) - both)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

        left, right = texts.withColumnsRenamed({"row": "a", "text": "text_a"}), texts.withColumnsRenamed({"row": "b", "text": "text_b"})
        found = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")
        found = self.scratch.write(found, f"links{self.round}")
        self.scratch.delete(f"texts{self.round}")
        self.round += 1
        return found


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their sets of `words`-grams; component_id is the
    smallest doc_id reachable by links, the document's own included.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    store = Store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), limit=CHUNK_BYTES)
    buckets = store.buckets(1 / 6.5)

    def send(chunk: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        token, n = np.unique(Sets(rows, words).hash, return_counts=True)
        order, some, edges = by_bucket(token, buckets)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk)), parts(token[order], edges), parts(np.minimum(n, 255).astype(np.uint8)[order], edges)], names=["bucket", "chunk", "a", "n"])

    def nodes_of(chunk: int, rows: pa.RecordBatch, mail: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        x = Prefixes(rows, words, percent, _level_of(mail[0], buckets))
        edges = pa.array(x.token_edge, pa.int32())
        columns = [x.ids, chunk + np.arange(len(x.n)), x.n, x.digest[:, 0], x.digest[:, 1], x.group[:, 0], x.group[:, 1]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.ListArray.from_arrays(edges, pa.array(x.token.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(x.place))], schema=_NODE)

    nodes = scratch.write(store.with_mail([_count(store.each(send, _SENT))], nodes_of, _NODE, _NODE_DDL), "nodes")
    real = nodes.where((F.col("n") > 0) & (F.col("doc_id") != _NULL))
    # classes (the same words), in groups (the same prefix and size)
    classes = real.groupBy("word1", "word2").agg(F.min(F.struct("doc_id", "row")).alias("of"), F.min("n").alias("n"), F.min("set1").alias("set1"), F.min("set2").alias("set2"))
    classes = scratch.write(classes.select("word1", "word2", "set1", "set2", "n", F.col("of.doc_id").alias("least"), F.col("of.row").alias("row")), "classes")
    groups = classes.groupBy("set1", "set2").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("size"))
    held = real.where(F.size("keys") > 0).groupBy("set1", "set2").agg(F.min_by(F.struct("n", "keys", "places"), "row").alias("of"))
    entries = held.select("set1", "set2", F.col("of.n").cast("int").alias("n"), F.explode(F.arrays_zip("of.keys", "of.places")).alias("e")).select("set1", "set2", "n", F.col("e.keys").alias("key"), F.col("e.places").alias("place"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("key")
    rest_of = F.col("n") - F.col("place")
    # a set of up to `most` n-grams can be similar to one of n of which the first shared stands at place
    most = (F.floor(rest_of * F.lit(100 + percent) / F.lit(percent) + F.lit(1e-9)) - F.col("n")).cast("int").alias("most")
    entries = scratch.write(entries.join(several, "key").join(groups.select("set1", "set2", "lead"), ["set1", "set2"]).select("key", "set1", "set2", "n", "place", "lead", most), "entries")
    verifier = Verifier(store, scratch, words, percent)

    # each group with the earliest of each of its n-grams, each class with the lead of its group
    centre = entries.groupBy("key").agg(F.min(F.struct("place", "lead", "n", "most")).alias("c")).select("key", F.col("c.lead").alias("a"), F.col("c.n").alias("a_n"), F.col("c.most").alias("a_most"))
    met = entries.join(centre, "key").where("lead <> a AND n <= a_most AND a_n <= most").select("a", "set1", "set2").distinct()
    members = classes.select("set1", "set2", F.col("row").alias("b"))
    inside = members.join(groups.where("size > 1"), ["set1", "set2"]).where("b <> lead").select(F.col("lead").alias("a"), "b")
    same_id = scratch.write(_rows_of_one_document(real, classes), "same_id")
    tested = scratch.write(met.join(members, ["set1", "set2"]).select("a", "b").unionByName(inside).distinct(), "tested0")
    links = same_id.unionByName(verifier.links(tested))
    part = cut(connected_components(links))

    # what is left between components: members where they share an n-gram, or a whole prefix
    whole = members.join(groups.where("size > 1"), ["set1", "set2"]).join(classes.select(F.col("row").alias("b"), "n"), "b")
    whole = whole.select(F.xxhash64("set1", "set2", F.lit(1)).alias("key"), F.col("b").alias("x"), F.col("n").cast("int").alias("n"), F.lit(0).alias("place"), F.col("n").cast("int").alias("most"))
    placed = entries.join(members, ["set1", "set2"]).select("key", F.col("b").alias("x"), "n", "place", "most").unionByName(whole)
    for turn in range(1, ROUNDS + 1):
        now = placed.join(part.withColumnRenamed("v", "x"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
        apart = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(_order(turn), "x", "n", "most", "c")).alias("m")).where("lo <> hi")
        now = scratch.write(now.join(apart.select("key", "m"), "key").select("key", "x", "n", "most", "c", F.col("m.x").alias("m_x"), F.col("m.n").alias("m_n"), F.col("m.most").alias("m_most"), F.col("m.c").alias("m_c")), f"now{turn}")
        few = now.where("c <> m_c").select("key", "x", "n", "most", "c")
        others = now.select("key", F.col("x").alias("y"), F.col("n").alias("y_n"), F.col("most").alias("y_most"), F.col("c").alias("y_c"), (F.col("c") != F.col("m_c")).alias("also"))
        left = few.join(others, "key").where("c <> y_c AND n <= y_most AND y_n <= most AND (NOT also OR x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        rows = now.count()
        done = rows == 0 or turn == ROUNDS or left.limit(FEW * rows + 1).count() <= FEW * rows
        if not done:  # another star: all against the member that this turn puts first
            left = now.where("c <> m_c AND n <= m_most AND m_n <= most").select(F.least("x", "m_x").alias("a"), F.greatest("x", "m_x").alias("b"))
        if rows:
            seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            left = scratch.write(left.distinct().join(seen, ["a", "b"], "left_anti"), f"tested{turn}")
            tested = seen.unionByName(left)
            new = verifier.links(left)
            if not new.isEmpty():
                links = links.unionByName(new)
                part = cut(connected_components(links))
        if done:
            break

    # every class has its component's smallest doc_id, and every document its class's
    found = classes.join(part.withColumnRenamed("v", "row"), "row", "left").select("word1", "word2", "least", F.coalesce("component", "row").alias("component"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = scratch.write(found.join(least, "component").select("word1", "word2", "component_id"), "found")
    rows = real.select("doc_id", "n", "word1", "word2").join(found, ["word1", "word2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    own = F.when(F.col("doc_id") != _NULL, F.col("doc_id"))
    alone = nodes.where((F.col("n") == 0) | (F.col("doc_id") == _NULL)).select(own.alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))
    store.delete()
    return rows.unionByName(alone)


def _order(turn: int) -> Column:
    """Which member of a key all others meet: the earliest first, then by a hash that changes with the turn."""
    return F.col("place").cast("long").alias("at") if turn == 1 else F.xxhash64("c", F.lit(turn)).alias("at")


def _rows_of_one_document(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id; hardly any document has such rows."""
    again = real.groupBy("doc_id").agg(F.min("word1").alias("lo"), F.max("word1").alias("hi")).where("lo <> hi").select("doc_id")
    own = real.join(again, "doc_id").select("doc_id", "word1", "word2").join(classes.select("word1", "word2", "row"), ["word1", "word2"]).select("doc_id", "row")
    first = own.groupBy("doc_id").agg(F.min("row").alias("a"))
    return own.join(first, "doc_id").where("row <> a").select("a", F.col("row").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with the document of smallest doc_id of each component; others go.

    Documents link if their sets of STAGE_WORDS words are alike to STAGE_PERCENT or more; the defaults are those of op10.
    Documents without words and rows without an id stay. Of repeated rows, with the same doc_id (null too) and text, one
    stays: the least by lang, source and n_chars. Rows of one doc_id with different texts stay or go together.
    """
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select(*columns)
    found = near_duplicates(docs, STAGE_WORDS, STAGE_PERCENT).where("doc_id IS NOT NULL").groupBy("doc_id")
    found = cut(found.agg(F.max(F.col("component_id") != F.col("doc_id")).alias("gone"), (F.count(F.lit(1)) > 1).alias("again")).where("gone OR again"))
    single = docs.where("doc_id IS NOT NULL").join(found.select("doc_id"), "doc_id", "left_anti")
    several = docs.where("doc_id IS NULL")
    again = found.where("again AND NOT gone").select("doc_id")
    if not again.isEmpty():  # else texts would be dealt out twice for nothing
        several = several.unionByName(docs.join(again, "doc_id", "left_semi"))
    least = several.groupBy("doc_id", "text").agg(F.min(F.struct(*columns[2:])).alias("rest"))
    return single.unionByName(least.select("doc_id", "text", "rest.*"))
