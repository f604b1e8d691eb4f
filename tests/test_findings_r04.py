"""Findings of round 4."""

from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from casefile.llm import suffix_index
from casefile.operators import similarity
from casefile.plans import catalog
from tests.test_catalog import plain


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    return con


def test_images_of_one_md5_are_all_linked(spark, duck, sf_dir):
    """every pair of vectors that the first SQL gave, by equal MD5 or near hashes, is among those of now."""
    first = f"""
    WITH h AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 <> 0 THEN {catalog._SQL_BITS} END AS p, {catalog._SQL_BITS} AS d, md5((vec_id % 97)::VARCHAR) AS m FROM embeddings)
    SELECT a, b, ph, dh, CASE WHEN known THEN 1 - ph / 64.0::DOUBLE ELSE 0 END AS similarity, same FROM (
      SELECT x.id AS a, y.id AS b, coalesce(bit_count(xor(x.p, y.p)), 64)::INT AS ph, coalesce(bit_count(xor(x.d, y.d)), 64)::INT AS dh, x.p IS NOT NULL AND y.p IS NOT NULL AS known, x.m = y.m AS same
      FROM h x JOIN h y ON x.id < y.id) WHERE same OR (ph <= 10 AND dh <= 10)"""
    want = set(duck.execute(first).fetchall())
    got = {tuple(r)[:6] for r in catalog.image_duplicates(spark, sf_dir).collect()}
    assert len(want) > 1000 and want <= got


def test_classes_of_one_md5_are_all_linked(spark, duck, sf_dir):
    """as the first SQL had them: classes by hash and MD5, all pairs of an MD5 or near."""
    first = f"""
    WITH c AS (SELECT h, m, min(vec_id) AS id, count(*) AS n FROM (SELECT vec_id, h, md5((vec_id % 7)::VARCHAR) AS m FROM {catalog._SQL_HASHES}) GROUP BY h, m)
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.m = b.m AS same_md5, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 8
    UNION ALL SELECT a.id, b.id, bit_count(xor(a.h, b.h))::INT, true, a.n, b.n FROM c a JOIN c b ON a.id < b.id AND a.m = b.m AND bit_count(xor(a.h, b.h)) > 8"""
    names = ["a", "b", "distance", "same_md5", "n_a", "n_b"]
    want = [dict(zip(names, r, strict=True)) for r in duck.execute(first).fetchall()]
    got = [r.asDict() for r in catalog.image_class_pairs(spark, sf_dir).filter("a <> b").collect()]
    assert plain(got, names) == plain(want, names) and len(want) > 10_000


def test_block_copies_send_no_row_thousands_of_times(spark):
    """rows that reach a task, by blocks of an image, against brute force; copies of a row give each their pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 60, np.int64)
    rows = [(int(i % 3), int(rng.integers(0, 300)), int(rng.integers(0, 300)), int(base[rng.integers(60)] ^ (1 << int(rng.integers(63))))) for i in range(600)]
    rows = rows + rows[:20] + [(None, 1, 1, 5), (1, 1, 1, None), (1, None, 200, rows[1][3])]
    want = Counter()
    for a, b in product(rows, rows):
        if a[0] is None or a[0] != b[0] or None in a or None in b or (a[2], a[1]) >= (b[2], b[1]) or (abs(a[1] - b[1]) < 32 and abs(a[2] - b[2]) < 32):
            continue
        if (apart := (a[3] ^ b[3]).bit_count() if a[3] ^ b[3] >= 0 else ((a[3] ^ b[3]) % (1 << 64)).bit_count()) <= 16:
            want[a[0], a[1], a[2], b[1], b[2], 1 - apart / 64] += 1
    df = spark.createDataFrame(rows, "image_id int, x int, y int, hash long")
    found = similarity.copied_blocks(df, least=0.75)
    assert Counter(tuple(r) for r in found.filter("ax is not null and bx is not null").collect()) == want and len(want) > 500
    left, right = similarity._cells(df.filter("hash is not null"), "image_id", 50, "x", "y", "hash")
    n = {r.image_id: r["count"] for r in df.filter("image_id is not null and hash is not null").groupBy("image_id").count().collect()}
    assert left.count() + right.count() == sum(m * (-(-m // 50) + 1) for m in n.values())


def test_windows_that_stand_once_stay_out_of_suffix_arrays(monkeypatch):
    """blocks that share an anchor only; their windows stand once, so none is sorted, and what is cut is what brute force cuts."""
    rng = np.random.default_rng(6)
    own = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, gram = own(120), own(16)
    docs = [(i, own(60) + gram + own(60) + (passage if i % 10 == 0 else "") + own(30)) for i in range(200)]
    chunk = suffix_index.Chunk.unpack(suffix_index.Chunk.pack(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])))
    codes = {b: suffix_index._shared([x])[0] for b, x in suffix_index._anchor_rows(chunk, 1)}
    sent, sorted_ = suffix_index._contents(chunk, codes, 1).windows.sum(), []
    add = suffix_index.IndexFamily.add
    monkeypatch.setattr(suffix_index.IndexFamily, "add", lambda self, text, places, doc: sorted_.append(len(places)) or add(self, text, places, doc))
    (_, blob), = suffix_index._content_rows(chunk, codes, 1)
    gone = suffix_index._cut(chunk, {}, {0: suffix_index._matches([blob])[0]}, 1)
    seen, want = {}, []
    for _, t in docs:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if t[k : k + 50] in seen:
                mark[k : k + 50] = True
        seen |= {t[k : k + 50]: 1 for k in range(len(t) - 49)}
        want.append(mark)
    assert (gone[: chunk.ends[-1]] == np.concatenate(want)).all() and gone.any()
    assert 0 < sum(sorted_) < sent / 2
