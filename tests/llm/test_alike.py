"""Near copies by similarity, and the pipeline's verdicts by row."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from casefile.llm import alike


def _texts(seed=3):
    """Texts of 30 to 400 words with copies that have a few words replaced, and a common passage."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(25)]
    out = ["one two", "One  two", "", None, "alone"]
    for i in range(40):
        base = [word() for _ in range(r.randint(30, 400))] + passage * (i % 3 == 0)
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, round(len(copy) * r.choice([0.01, 0.02, 0.022, 0.03])))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def _kept(ids, texts):
    sets = [alike.shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * len(np.union1d(a, sets[j])) - 1e-9:
                linked += both < len(a)
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    best = [min(g, key=lambda i: (ids[i] is None, ids[i] or 0)) for g in groups.values()]
    return sorted((str(ids[i]), str(texts[i])) for i in best), linked


def test_every_pair_of_the_similarity_is_linked(spark):
    texts = _texts()
    ids = list(range(len(texts)))
    want, linked = _kept(ids, texts)
    assert linked > 30
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == want


def test_long_copies_with_edits(spark):
    """At Jaccard 0.82 fingerprints differ by more than eight bits on average."""
    r, rows = random.Random(9), []
    for k in range(30):
        base = [f"v{r.randrange(9000)}" for _ in range(300)]
        copy = list(base)
        for at in range(20, 280, 44):  # six words: 30 of 296 shingles
            copy[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 60, 2))


def test_bitmaps_never_part_similar_sets():
    r = np.random.default_rng(2)
    for n in (1, 7, 60, 1000, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in (0, n // 20, n // 10, n // 3):
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, gone // 2).astype(np.uint64)]))
            for words in (alike.FOLD_WORDS, alike.WIDE_WORDS):
                apart = np.bitwise_count((alike.fold(a, words) ^ alike.fold(b, words)).view(np.uint64)).sum()
                assert apart <= len(np.setxor1d(a, b))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_dedup_stage(spark, docs, "").count() == 0


def test_every_row_has_its_own_verdict(spark, sf_dir):
    """Null and repeated ids: a rejected row takes no other with it, and of equal texts one row stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.quality_rules_stage, corpus_pipeline.quality_classifier_stage):
        alone = {r.doc_id for r in stage(spark, docs, sf_dir).select("doc_id").collect()}
        # rows of a third get the null id, of another third one id; labels stay with the other rows' ids
        other = docs.withColumn("was", F.col("doc_id")).withColumn("doc_id", F.when(F.col("was") % 3 == 0, F.lit(None)).when(F.col("was") % 3 == 1, F.lit(-5)).otherwise(F.col("was")).cast("long"))
        kept = [r for r in stage(spark, other, sf_dir).select("doc_id", "was").collect()]
        assert {r.was for r in kept if r.was % 3 == 0} and {r.was for r in kept if r.was % 3 == 1}
        assert len(kept) == len({r.was for r in kept}) and len({r.was for r in kept} ^ alone) < 0.1 * len(alone)


def test_one_row_of_equal_texts_stays(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    for ids in ([4, 4, 4], [None, None], [None, 7, 7], [9, 3, None]):
        docs = spark.createDataFrame([(i, text) for i in ids] + [(1, "another text that shares nothing at all")], "doc_id long, text string")
        got = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").filter(F.col("text") == text).collect()]
        assert got == [min((i for i in ids if i is not None), default=None)]


def _shared_passage(n, r):
    """Texts of 900 words of their own before one passage of 300 words, which begins beyond 4,000 characters."""
    passage = " ".join(f"p{r.randrange(9000)}" for _ in range(300))
    return [(i, " ".join(f"own{i}x{r.randrange(10**6)}" for _ in range(900)) + " " + passage) for i in range(n)]


def test_a_passage_at_the_end_of_many_texts_makes_no_meetings(spark):
    """Texts that meet at shingles of a passage do so pair by pair: with the square of their number."""
    docs = spark.createDataFrame(_shared_passage(100, random.Random(4)), "row long, t string").withColumn("id", F.col("row")).repartition(3)
    marked = alike._marked(docs.select("row", "id", "t"), alike.common_shingles(docs, alike.WORDS), alike.WORDS)
    assert alike._matched(marked.withColumnRenamed("row", "node")).count() == 0


def test_counts_behind_the_order_are_exact(spark, monkeypatch):
    texts = [t for t in _texts(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, t string").repartition(4)
    h, n = np.unique(np.concatenate([alike.shingle_set(t) for t in texts]) >> np.uint64(24), return_counts=True)
    monkeypatch.setattr(alike, "COUNTED_OF", 1)
    for common, matched in ((2, alike.MATCHED), (3, 20)):  # 20: the parts of the hash space are halved
        monkeypatch.setattr(alike, "COMMON", common)
        monkeypatch.setattr(alike, "MATCHED", matched)
        got = alike.common_shingles(docs)
        assert np.array_equal(got[0], h[n >= common]) and np.array_equal(got[1], n[n >= common])
    most = int((n >= 4).sum())
    monkeypatch.setattr(alike, "MOST_COMMON", most)  # only the most frequent ones are told apart
    assert np.array_equal(alike.common_shingles(docs)[0], h[n >= 4])
    assert len(alike.common_shingles(docs.limit(0))[0]) == 0


def test_the_order_never_decides_the_pairs(spark, monkeypatch):
    texts = _texts(8)
    ids = list(range(len(texts)))
    want, linked = _kept(ids, texts)
    assert linked > 30
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    for of, common, most in ((1, 1, 40), (2, 2, 2_000_000)):
        monkeypatch.setattr(alike, "COUNTED_OF", of)
        monkeypatch.setattr(alike, "COMMON", common)
        monkeypatch.setattr(alike, "MOST_COMMON", most)
        got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == want


def _stragglers(r, n, edits):
    """Copies of one text of 300 words, each with words replaced at places of its own."""
    base = [f"b{i}" for i in range(300)]
    out = []
    for i in range(n):
        copy = list(base)
        for k, at in enumerate(r.sample(range(5, 295), edits)):
            copy[at] = f"e{i}x{k}"
        out.append(" ".join(copy))
    return out


def test_a_pair_meets_few_times_however_much_it_shares(spark, monkeypatch):
    """Near copies that are parts of their own: the join made a row for every shingle that two prefixes share."""
    monkeypatch.setattr(alike, "COMMON", 10**6)  # shingles of the group are not put last, so all its prefixes meet
    docs = spark.createDataFrame(list(enumerate(_stragglers(random.Random(6), 40, 3))), "row long, t string").withColumn("id", F.col("row"))
    nodes = alike.written(alike._marked(docs.select("row", "id", "t"), alike.common_shingles(docs), alike.WORDS).withColumnRenamed("row", "node"), "nodes")
    got = [tuple(p) for p in alike._met(alike._meeting(alike._matched(nodes), nodes, nodes.select("node", F.col("node").alias("root")))).collect()]
    marks = {m.node: (set(np.frombuffer(m.prefix, np.uint64).tolist()), m.n, np.array(m.fold, np.int64)) for m in nodes.collect()}
    plain = {}
    for a, (x, n, f) in marks.items():
        for b, (y, m, g) in marks.items():
            apart = int(np.bitwise_count((f ^ g).view(np.uint64)).sum())
            if a < b and x & y and 9 * apart <= n + m and 9 * min(n, m) >= 4 * (n + m):
                plain[a, b] = len(x & y)
    assert set(got) == set(plain) and len(plain) > 300
    assert sum(plain.values()) > 20 * len(plain) and len(got) < 3 * len(plain)


def test_one_node_of_each_shingle_gathers_a_group_before_all_pairs_meet(spark, monkeypatch):
    """The first candidates may leave a group in parts; all pairs of its nodes were tested then."""
    monkeypatch.setattr(alike, "_TURNS", alike._TURNS[:0])  # no hubs of equal minimum hashes
    tested, counted = alike._tested, []

    def noted(pairs, *rest, **more):
        counted.append(pairs.distinct().count())
        return tested(pairs, *rest, **more)

    monkeypatch.setattr(alike, "_tested", noted)
    texts = _stragglers(random.Random(7), 60, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(int(i) for i, _ in _kept(list(range(60)), texts)[0])
    assert len(got) == 1 and counted[-1] < 60
