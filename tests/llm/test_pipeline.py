"""The pipeline, stage by stage, against brute force; what hashes alone would get wrong; clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import toxicity as tox
from terrane.llm.decontaminate import contamination
from terrane.llm.jaccard_join import near_duplicates
from terrane.llm.quality_classifier import Features, fit_quality, grade_documents, grade_of
from terrane.llm.sentencepiece_sampling import Decoder, load_vocabulary, round_trip
from terrane.llm.substring_dedup import dedup_substrings
from terrane.llm.suffix_dedup import dedup_bytes
from terrane.llm.topk_search import exact_topk
from terrane.llm.url_reputation import domain_of, judge_urls, named, suffix_of
from terrane.llm.warc import round_trip as warc_round_trip

np = pytest.importorskip("numpy")
SPACE = "[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def linked(rows, words, percent):
    """The smallest doc_id reachable from each, by all pairs."""
    sets = {}
    for d, t in rows:
        w = re.findall(SPACE, (t or "").lower())
        sets[d] = set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    at = {d: d for d in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (i := len(sets[a] & sets[b])) and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def near_copies(rng, n, size=120):
    """Copies of a few texts, and copies of copies, with changes that leave many pairs just under 85 %."""
    vocab = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(vocab) for _ in range(size)] for _ in range(3)]
    out = []
    for i in range(n):
        w = list(rng.choice(base) if i < 30 or rng.random() < 0.6 else out[-rng.randrange(1, 20)])
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(size)] = rng.choice(vocab)
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_copies_around_the_threshold(spark):
    rows = near_copies(random.Random(11), 300)
    expected = linked(rows, 4, 85)
    assert 3 < len(set(expected.values())) < 200  # links, and many that fall just under
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in got.collect()} == expected


def test_hashes_decide_nothing(spark):
    """Two words that a polynomial hash modulo 2 ** 64 can't tell apart are told apart."""
    t = u = "a"
    for _ in range(10):
        t, u = t + t.translate(str.maketrans("ab", "ba")), t.translate(str.maketrans("ab", "ba")) + t
    u = t.translate(str.maketrans("ab", "ba"))
    assert len(t) == 1024 and t != u
    start = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{start} {t}"), (2, f"{start} {u}")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_removed for r in dedup_substrings(df).collect()} == {1: 0, 2: 0}
    two = spark.createDataFrame([(1, t), (2, u)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in near_duplicates(two).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_hit for r in contamination(two, spark.createDataFrame([("x", t)], "item_id string, text string")).collect()} == {1: 1, 2: 0}
    assert all(r.lossless for r in round_trip(two, load_vocabulary(corpus_pipeline.PIECES)).collect())
    same = {r.doc_id: bytes(r.kept).decode() for r in dedup_bytes(two).collect()}
    grams = {t[i : i + 50] for i in range(len(t) - 49)}
    gone = [any(u[j : j + 50] in grams for j in range(max(0, i - 49), min(i, len(u) - 50) + 1)) for i in range(len(u))]
    assert same == {1: t, 2: "".join(c for c, g in zip(u, gone) if not g)}


def made(rng):
    vocab = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstlnp"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, items = text(30), [(f"b{i}", text(16)) for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        if i % 6 == 0:
            t, q = "BUY!! NOW!! $$$ " * rng.randrange(4, 9), 0
        else:
            t, q = text(rng.randrange(30, 90)), 1
            if i % 5 == 1:
                t = f"{t} {passage}"
            if i % 7 == 2:
                t = f"{t} {items[i % 6][1]}"
            if rows and i % 4 == 3 and rows[-1][1]:
                w = rows[-1][1].split()
                w[0] = "changed"
                t = " ".join(w)
        rows.append((i, t, "en", "s", len(t)))
        if i % 2 == 0:
            labels.append((i, q, int(i % 40 == 4)))
    rows += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (None, None, None, None, None), rows[7], rows[7], (302, "é " * 3000, "xx", "s", 6000), (303, "y" * 20_000, "xx", "s", 20_000)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = made(random.Random(8))
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(r):
    return (-1 if r[0] is None else r[0], r[1] or "", r[1] is None)


def test_stages(spark, folder):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # quality: scores recomputed from the features, row by row
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_quality(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    import pyarrow as pa

    def kept(text):
        x = Features(pa.array([text], pa.string()))
        n = max(1, int(x.n[0]))
        score = sum(model.weights[s] for s in x.word) / n + sum(model.weights[4096 + s] for s in x.shape) / n + float(x.dense[0] @ model.weights[-5:])
        return 1 / (1 + np.exp(-(score - model.thresholds[0]))) >= 0.5

    good = stages["quality"](spark, docs, folder)
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sorted(map(tuple, good.collect()), key=key)
    assert rows == sorted((tuple(r) for r in docs.select(*good.columns).collect() if kept(r[1])), key=key)
    assert not any("BUY" in (r[1] or "") for r in rows) and sum(r[0] is not None and r[0] < 240 for r in rows) == 180  # the others are BUY texts and copies of them
    good = spark.createDataFrame(rows, SCHEMA).repartition(2)
    # near duplicates
    at = linked([r[:2] for r in rows if r[0] is not None], 5, 80)
    one = stages["near_duplicates"](spark, good, folder)
    got = sorted(map(tuple, one.collect()), key=key)
    expected = sorted({r for r in rows if r[0] is None or at[r[0]] == r[0]}, key=key)
    assert got == expected and len(got) < len(rows)
    # repeated runs of twenty words
    seen, left = set(), {}
    for r in got:
        w = re.findall(SPACE, r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        left[r[0]] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1]
    unique = stages["repeated_substrings"](spark, one, folder)
    assert {r.doc_id: r.text for r in unique.collect()} == left and any(a != b for (*_, a), b in zip([(r[0], r[1]) for r in got], [left[r[0]] for r in got]))
    # benchmark items
    items = {r.item_id: re.findall("[a-z0-9]+", r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    bad = set()
    for d, t in left.items():
        w = re.findall("[a-z0-9]+", (t or "").lower())
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        found = {k: [i for i in range(len(x) - 7) if tuple(x[i : i + 8]) in own] for k, x in items.items()}
        if sum(bool(x) for x in found.values()) >= 2 or any(2 * len({i + j for i in x for j in range(8)}) > len(items[k]) for k, x in found.items()):
            bad.add(d)
    clean = stages["decontamination"](spark, unique, folder)
    assert bad and {r.doc_id for r in clean.collect()} == set(left) - bad
    # pieces
    pieces = stages["pieces"](spark, clean, folder).collect()
    v = Decoder(load_vocabulary(corpus_pipeline.PIECES))
    assert {r.doc_id: v.decode(pa.array([r.ids], pa.list_(pa.int32())))[0].as_py() for r in pieces} == {d: t for d, t in left.items() if d not in bad}
    assert all(r.n_pieces == len(r.ids or []) for r in pieces)


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)
    assert got == sorted(map(tuple, docs.collect()), key=str) and len(got) > 50


def test_stages_on_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark):
    """Extra columns named like results or inner columns change nothing."""
    extra = {c: F.lit("clash") for c in ("score", "rank", "host", "path", "sha1", "payload", "response", "blocked", "hits", "items", "word", "expected_grade", "n", "chunk", "held_out", "lead")}
    vectors = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, 6])], "vec_id long, vector array<long>")
    assert exact_topk(vectors.withColumns(extra), F.col("vec_id") == 0).collect() == exact_topk(vectors, F.col("vec_id") == 0).collect()
    texts = spark.createDataFrame([(i, f"some words {i} you fool" if i % 2 else f"good words {i}", i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    known = texts.select("doc_id", "toxic")
    assert sorted(tox.toxicity(texts.withColumns(extra), known).collect()) == sorted(tox.toxicity(texts, known).collect())
    grades = texts.select("doc_id", F.col("toxic").alias("grade"))
    assert sorted(grade_documents(texts.withColumns(extra), grades).collect()) == sorted(grade_documents(texts, grades).collect())
    pages = spark.createDataFrame([(1, "http://a.com/x", "one"), (2, "http://a.com/y", "one")], "page_id long, url string, html string")
    columns = ("page_id", "record_type", "refers_to", "payload_digest")
    assert sorted(warc_round_trip(pages.withColumns(extra)).select(*columns).collect()) == sorted(warc_round_trip(pages).select(*columns).collect())
    bad = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    assert sorted(judge_urls(pages.withColumns(extra), bad, []).collect()) == sorted(judge_urls(pages, bad, []).collect())
    items = spark.createDataFrame([("i", "good words 2")], "item_id string, text string")
    assert sorted(contamination(texts.withColumns(extra), items).collect()) == sorted(contamination(texts, items).collect())


def test_large_products(spark):
    vectors = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 22]), (2, [5])], "vec_id long, vector array<long>")
    assert [r.score for r in exact_topk(vectors, F.col("vec_id") == 0).orderBy("rank").collect()] == [1 << 62, 5 << 40]
    beyond = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_topk(beyond, F.col("vec_id") == 0).collect()


def test_null_and_infinite_components(spark, tmp_path):
    from terrane.llm.queries import op1_topk_search

    rows = [(0, [1.0, 0.5]), (100, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [0.25, -0.0004]), (7, [0.25, -0.0004])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op1_topk_search(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 1024 * 256 - 512), (0, 2, 7, 1024 * 256 - 512)]


def test_host_groups(spark):
    hosts = ["a.com:8080", "u:p@x.a.com", "a.co.uk.", "www.b.gov.au", "192.0.2.7", "[2001:db8::1]:80", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("name", named(F.col("host")))
    got = {r.host: (r.s, r.d) for r in df.select("host", suffix_of(F.col("name")).alias("s"), domain_of(F.col("name")).alias("d")).collect()}
    assert got["a.com:8080"] == got["u:p@x.a.com"] == ("com", "a.com") and got["a.co.uk."] == ("co.uk", "a.co.uk") and got["www.b.gov.au"] == ("gov.au", "b.gov.au")
    assert got["192.0.2.7"] == ("192.0.2.7",) * 2 and got["[2001:db8::1]:80"] == ("[2001:db8::1]",) * 2 and got["localhost"] == ("localhost",) * 2 and got[""] == ("", "")


def test_quality_held_out(spark):
    """Grades of documents whose labels did not train are told apart."""
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "or", "is", "um", "et")]
    rows = []
    for i in range(900):
        grade = i % 3
        w = [rng.choice(vocab) for _ in range(40)]
        if grade == 0:
            w = [rng.choice(["CLICK", "NOW!!", "$$$", rng.choice(vocab)]) for _ in w]
        elif grade == 1:
            w = [x if rng.random() < 0.8 else "grobish" for x in w]
        rows.append((i, " ".join(w), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    got = {r.doc_id: r for r in grade_documents(df, df.where("doc_id % 2 = 0").select("doc_id", "grade")).collect()}
    held = [(got[i].expected_grade, g) for i, _, g in rows if i % 2]
    assert sum(round(x) == g for x, g in held) > 0.9 * len(held)
    assert sum(got[i].selected == (g > 0) for i, _, g in rows if i % 2) > 0.95 * len(held)
