"""Classifier, URLs, shards, vectors and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.llm import graph, quality_cnn, sharding, url_templates, vector_dedup
from casefile.llm.queries import URL_RULES

rng = random.Random(5)


def test_components(spark):
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


GOOD = "the cat sat on the mat and looked at the moon over the quiet river "


def _junk(i):
    return " ".join(f"w{i}%%% x### &&&" for _ in range(20))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, GOOD * (1 + i % 4) if i % 3 else _junk(i), int(i % 3 > 0)) for i in range(360)] + [(1000, None, None), (1001, "", None), (1002, GOOD * 3000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_classifier(spark, labelled):
    labels = labelled.select(F.col("doc_id").alias("id"), "label")
    got = {r.id: r for r in quality_cnn.quality_scores(labelled.withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash")), labels).collect()}
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values() if r.id < 360) == len(held)
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 363
    assert quality_cnn.quality_scores(labelled.limit(0), labels).count() == 0
    flat = quality_cnn.quality_scores(labelled.limit(5), labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]


def test_scorer_is_the_model():
    m = quality_cnn.fitted([GOOD.encode(), b"%% ## && " * 40, GOOD.encode() * 9, b"$$$ " * 300], [1, 0, 1, 0], epochs=2)
    s, score = m.shape, quality_cnn.Scorer(m)
    for text in ("", "a", "abcdefgh", GOOD * 7, "é" * 501, "x" * 70000):
        pos = quality_cnn._positions(text.encode(), s)
        resp = np.maximum(m.embed[pos].reshape(len(pos), -1) @ m.conv + m.bias, 0)
        starts = quality_cnn._chunk_starts(-(-len(pos) // s.cell), s) * s.cell
        pool = np.stack([resp[a : a + s.chunk * s.cell].max(axis=0) for a in starts])
        z = np.concatenate([pool.mean(axis=0), pool.max(axis=0)]) @ m.dense + m.offset
        assert abs(score(text) - 1 / (1 + np.exp(-z))) < 1e-3


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "https://example.com/en/81", "http://x.example.net/de/8/9", "http://net/de/1", "http://anet/de/1", "http://b.org/es/", "http://b.org/es",
    "http://b.org?/es/", "http://b.org#a://c/d", "x://y://z/a", "http://h.test/" + "a/" * 12, "http://ÜBER.com/en/Ä",
]


def test_urls(spark):
    rows = [(i, u, "c", "c") for i, u in enumerate(URLS)] + [(100 + i, f"http://h.test/{'bad' if i % 2 else 'fine'}/{i}/page.html", "c", "c") for i in range(200)] + [(100, "http://h.test/fine/0/page.html", "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(100 + i, i % 2 == 0) for i in range(0, 160)] + [(1, None)], "id long, good boolean")
    got = url_templates.url_verdicts(pages, URL_RULES, labels).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for i, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (by[i].host, by[i].path) == (host, path)
        assert by[i].rule == (max(fits)[1] if fits else None) and by[i].verdict == (max(fits)[2] if fits else "allow")
    assert {by[100 + i].verdict for i in range(1, 200, 2)} == {"block"} and {by[100 + i].verdict for i in range(0, 200, 2)} == {"allow"}
    assert url_templates.url_verdicts(pages.limit(0), URL_RULES, labels).count() == 0


def test_similar_branches_merge(spark):
    rows = [("h", f"/{b}/{i}", (i % 4 > 0) if b != "odd" else False) for b in ("a", "b", "odd") for i in range(60)]
    got = {r.template for r in url_templates.templates(spark.createDataFrame(rows, "host string, path string, good boolean")).collect()}
    assert "/odd/{number}" in got


def test_branches_part_at_any_depth(spark):
    rows = [(i, f"http://h/a/b/c/d/e/f/g/{'bad' if i % 2 else 'good'}/x/y", i % 2 == 0) for i in range(60)]
    rows += [(100, "http://g" + "/deep" * 300, True), (101, "http://g", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.id: r for r in url_templates.url_verdicts(pages, [], pages.select(F.col("page_id").alias("id"), "good")).collect()}
    assert {r.verdict for i, r in got.items() if i < 60 and i % 2} == {"block"}
    assert {r.verdict for i, r in got.items() if i < 60 and i % 2 == 0} == {"allow"}
    assert got[0].template.endswith("/good/x/y") and got[100].template == "/deep" * 300 and got[101].template == ""


def test_shards(spark):
    rows = [(i, "é" * (i % 50) if i % 9 else None, "c") for i in range(1500)] + [(3, "again", "c"), (None, "n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.sharded(docs).collect()
    assert len(got) == len(rows)
    plain = {}
    for r in got:
        t = next((t or "" for i, t, _ in rows if i == r.id and zlib.crc32((t or "").encode()) == r.text_crc32))
        assert r.size == len(t.encode()) + 8
        plain.setdefault(r.id, set()).add(r.shard)
        assert r.grown_shard in (r.shard, 24)
    assert all(len(s) == 1 for s in plain.values())
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # the shard is decided by the key and the number of shards alone: a plain version agrees
    import hashlib
    from math import log

    def bid(i, s):
        return log((int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))

    for r in got[:300]:
        if r.id is not None:
            assert r.shard == max(range(24), key=lambda s, i=r.id: (bid(i, s), s))
    heavy = docs.select(sharding.shard_of(F.col("doc_id"), [1, 0, 3]).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] for r in heavy}
    assert 1 not in n and 2 < n[2] / n[0] < 4.5
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    own = np.random.default_rng(0)
    rows, dim = [], 24
    for label in (0, 1, None):
        centres = own.normal(size=(6, dim))
        for _ in range(45):
            rows.append([len(rows), (centres[own.integers(6)] + own.normal(scale=0.25, size=dim)).tolist(), label])
    rows += [[len(rows) + k, rows[k][1], 0] for k in range(0, 12, 3)]  # copies
    odd = [None, [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] * dim, [], [1.0, 2.0], [3.0, 6.0], [1e300] * dim, [1e-300] * dim]
    rows += [[1000 + k, v, 0] for k, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.id: r for r in vector_dedup.near_duplicates(df).collect()}

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    def cosine(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    link = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
                link[a[0]].add(b[0])
                link[b[0]].add(a[0])
    for i, near in link.items():
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near), min(seen), min(seen) == i)
    assert sum(map(len, link.values())) > 100
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns
        now = after.cache()
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
        ids = kept
    want = {tuple(r) for r in p.STAGES[-1][1](spark, now, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()}
    got = p.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert {tuple(r) for r in got} == want and {r.doc_id for r in got} == ids
