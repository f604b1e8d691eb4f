"""Findings of round 3."""

import re
import shutil

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from casefile.functions import text
from casefile.llm import suffix_index
from casefile.llm.store import written
from casefile.operators import images, knn_index, similarity
from casefile.operators.numbering import spread
from casefile.plans import catalog


def test_stages_after_the_first_do_without_documents(spark, sf_dir, tmp_path):
    """the raw table goes once stage 1 has written its result."""
    given = tmp_path / "sf"
    shutil.copytree(sf_dir, given)
    docs = spark.read.parquet(f"{given}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = written(stage(spark, docs, str(given)), name)
        if k == 0:
            raw = given / "documents.parquet"
            shutil.rmtree(raw) if raw.is_dir() else raw.unlink()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(given)).count() > 0


def test_blocks_at_one_place_each_give_their_pairs(spark):
    """two blocks of one place and hash are two pairs with a third."""
    rows = [(1, 0, 0, 0x0F0F), (1, 0, 0, 0x0F0F), (1, 100, 100, 0x0F0F), (2, 0, 0, 0x0F0F)]
    found = similarity.copied_blocks(spark.createDataFrame(rows, "image_id int, x int, y int, hash long")).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 100, 100, 1.0)] * 2


def test_equal_frequencies_get_equal_bits():
    """in a symmetric image, mirrored frequencies are equal but for rounding; the median's own pair decided by chance."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        cells = rng.integers(0, 256, (8, 8))
        bits = np.array(list(f"{images.perceptual_hash(np.kron(cells + cells.T, np.ones((2, 2))) / 2) % (1 << 64):064b}")).reshape(8, 8)
        assert (bits == bits.T).all()


def test_class_pairs_link_every_image(spark, sf_dir):
    """an image's turned copy is a bit away, so none is without a link, whatever its id."""
    rows = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    member = {r.vec_id: r.representative for r in catalog.hash_members(spark, sf_dir).collect()}
    linked = {x for r in catalog.image_class_pairs(spark, sf_dir).collect() if r.a != r.b for x in (r.a, r.b)}
    assert {i for i in rows if member[i] in linked} == rows


def test_places_are_those_of_the_pattern(spark):
    """F8, F13 to F15: places by one pass with marks, for few matches, many, none, and texts that hold the mark."""
    texts = ["", "none", "12", "a 12 é😀 345", "12345 " * 400, "x 1 ￿ 22 ￿", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.matches(F.col("t"), r"\d+").alias("m"))
    for r in rows.collect():
        want = None if texts[r.i] is None else [(m.start(), m.group()) for m in re.finditer(r"\d+", texts[r.i])]
        assert (None if r.m is None else [tuple(x) for x in r.m]) == want


def test_costly_rows_are_many_tasks(spark):
    """F8, F10 to F17: tasks by rows, not by bytes."""
    rows = spark.range(1000).coalesce(1)
    assert spread(rows, "id", each=100).rdd.getNumPartitions() == 10 and spread(rows, "id", each=1000).rdd.getNumPartitions() == 1
    assert spread(rows, "id", each=300).count() == 1000


def test_nearest_by_blocks(spark):
    """parts and blocks, ties, copies, vectors that are null, short or hold null, against plain distances."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)] + [(300, None), (301, [1.0]), (302, [1.0, None, 2.0]), (303, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = similarity.nearest_batch(df, df.filter("id % 50 = 0 or id > 300"), "id", "v", "id", "v", 7, block=3).collect()

    def away(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return (2, 0.0)
        d = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return (1, 0.0) if d != d else (0, d)

    for i, v in rows:
        if i % 50 == 0 or i > 300:
            want = sorted((away(v, w), j) for j, w in rows)[:7]
            assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [j for _, j in want]


def test_cut_needs_no_second_search(monkeypatch):
    """runs name their places, so a chunk's last round neither gets its codes again nor finds its blocks anew."""
    shared = b"a passage of more than fifty bytes that stands in several documents, twice in the last of them"
    docs = [[(1, shared), (2, b"own words before " + shared)], [(3, shared + b" and some words between=" + shared)]]
    chunks = [suffix_index.Chunk.unpack(suffix_index.Chunk.pack(pa.array([i for i, _ in d]), pa.array([t.decode() for _, t in d]))) for d in docs]
    codes = suffix_index._shared([x for c in chunks for _, x in suffix_index._anchor_rows(c, 1)])
    runs = suffix_index._matches([x for c, code in zip(chunks, codes, strict=True) for _, x in suffix_index._content_rows(c, {0: code}, 1)])
    monkeypatch.setattr(suffix_index, "blocks_of", None)
    gone = [suffix_index._cut(c, {}, {0: r} if r else {}, 1)[: c.ends[-1]] for c, r in zip(chunks, runs, strict=True)]
    n = len(shared)
    assert gone[0].sum() == n and gone[0][-n:].all() and gone[1].sum() == 2 * n and gone[1][:n].all() and gone[1][-n:].all()


def test_hot_anchors_are_seen_beyond_127_blocks(monkeypatch):
    """a chunk that has 1,000 different blocks of an anchor says so, but for a twelfth; it said 127."""
    rng = np.random.default_rng(5)
    texts = [b"a passage of fifty bytes that all documents share " + bytes(rng.integers(97, 123, 40, np.uint8)) for _ in range(1000)]
    chunk = suffix_index.Chunk.unpack(suffix_index.Chunk.pack(pa.array(range(1000)), pa.array([t.decode() for t in texts])))
    found = suffix_index.blocks_of(chunk.text, chunk.ends)
    anchors, times = np.unique(found.anchor, return_counts=True)
    most = anchors[times.argmax()]
    differ = len(np.unique(found.content[found.anchor == most]))
    assert differ > 500
    monkeypatch.setattr(suffix_index, "HOT", differ * 9 // 10)
    (_, blob), = suffix_index._anchor_rows(chunk, 1)
    code = np.frombuffer(suffix_index._UNZIP.decompress(suffix_index._shared([blob])[0]), np.uint8)
    assert code[np.searchsorted(anchors, most)] == 2


def test_cells_meet_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """cells of a few rows, clusters in pieces and blocks of queries give what plain distances give, far from the origin and with copies."""
    monkeypatch.setattr(knn_index, "CELL", 40)
    monkeypatch.setattr(knn_index, "BLOCK", 7)
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(30, 0.01, (200, 3)), np.full((100, 3), 5.0)]) + 1e7
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = knn_index.VectorIndex.build(df.filter("id % 3 > 0"), "id", "v", str(tmp_path / "index"))
    index.append(df.filter("id % 3 = 0"), "id", "v")
    got = {(r.query_id, r["rank"]): r.id for r in index.search(df.filter("id % 10 = 0"), "id", "v", 6).collect()}
    for i, v in rows[::10]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in rows)[:6]
        assert [got[i, r] for r in range(1, 7)] == [j for _, j in near]
    cells = index._cells()
    each = np.add.reduceat(cells.n[cells.order], cells.start)
    assert each.sum() == len(rows) and (cells.pieces == -(-each // 40)).all() and len(cells.start) > 10
