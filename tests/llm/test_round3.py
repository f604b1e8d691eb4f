"""Fill-in-middle, passage removal and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casefile.llm import conversation_trie, fill_middle, suffix_index
from casefile.llm.suffix_index import WINDOW

own = random.Random(33)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# --- fill in the middle ---------------------------------------------------------------------------


def plain_fim(i, t, seed=42, percent=50, spm=80, marks=("<P>", "<S>", "<M>")):
    t, units = t or "", UNIT.findall(t or "")
    n, x = len(units), sha(f"{seed}:{'' if i is None else i}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, t
    a, b = sorted(v % (n + 1) for v in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


@pytest.fixture(scope="module")
def fim_rows():
    parts = ["a", "é", "€", "𝄞", " ", "\n", "\v", "<", "P", "S", "M", ">", "<P", "x" * 200, " " * 300, " ", "\0"]
    rows = [(i, "".join(own.choices(parts, k=own.randint(0, 40)))) for i in range(150)]
    return rows + [(None, None), (None, "a b c d e"), (3, ""), (4, " \n "), (5, "<P> here"), (5, "<P> here"), (6, "a <S><M>"), (7, "wörter und mehr " * 20_000)]


@pytest.mark.parametrize("percent,spm,marks", [(50, 80, ("<P>", "<S>", "<M>")), (100, 30, ("<P>", "<S>", "<M>")), (100, 50, ("<|pre|>", "<|suf|>", "<|mid|>"))])
def test_fill_in_middle(spark, fim_rows, percent, spm, marks):
    docs = spark.createDataFrame(fim_rows, "doc_id long, text string").withColumn("h1", F.lit("x")).withColumn("id", F.lit(1))
    out = fill_middle.transformed(docs.repartition(3), percent=percent, percent_spm=spm, sentinels=marks)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    want = [(i, *plain_fim(i, t, 42, percent, spm, marks), t or "") for i, t in fim_rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_the_automaton_forgets_and_chunks_agree(monkeypatch):
    auto = fill_middle.Automaton(("<P>", "<PS>", "P<"))
    assert auto.reach <= 3
    text = "".join(own.choices("<PS> é\n", k=500)).encode()
    whole = None
    for size in (1, 3, 7, 256, 4096):
        monkeypatch.setattr(fill_middle, "CHUNK", size)
        found = fill_middle.scan_texts(np.frombuffer(text, np.uint8), np.array([len(text)]), auto, lambda u, s: np.stack([u // 3, u // 2], axis=1))
        assert whole is None or all(np.array_equal(a, b) for a, b in zip(found, whole, strict=True))
        whole = found
    s = text.decode()
    assert whole[1][0] == sum(any(s[: i + 1].endswith(m) for m in auto.sentinels) for i in range(len(s)))


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.transformed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- repeated passages ----------------------------------------------------------------------------


def plain_marks(docs):
    first = {}
    key = lambda i: 2**63 - 1 if i is None else i
    for i, t in docs:
        for p in range(len(t) - WINDOW + 1):
            w = t[p : p + WINDOW]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in docs:
        mark = np.zeros(len(t), bool)
        for p in range(len(t) - WINDOW + 1):
            if first[t[p : p + WINDOW]] < key(i):
                mark[p : p + WINDOW] = True
        out.append(mark)
    return out


def rounds(docs, per, buckets):
    """The operator's rounds over chunks of ``per`` documents, in this process."""
    chunks = [docs[a : a + per] for a in range(0, len(docs), per)]
    chunks = [suffix_index.Chunk.unpack(suffix_index.Chunk.pack(pa.array([i for i, _ in c], pa.int64()), pa.array([t.decode("latin1") for _, t in c]))) for c in chunks]

    def answered(sent, each):
        by_bucket, out = defaultdict(list), [{} for _ in chunks]
        for c, rows in enumerate(sent):
            for b, x in rows:
                by_bucket[b].append((c, x))
        for b, rows in by_bucket.items():
            for (c, _), y in zip(rows, each([x for _, x in rows]), strict=True):
                if y:
                    out[c][b] = y
        return out

    codes = answered([list(suffix_index._anchor_rows(c, buckets)) for c in chunks], suffix_index._shared)
    runs = answered([list(suffix_index._content_rows(c, k, buckets)) for c, k in zip(chunks, codes, strict=True)], suffix_index._matches)
    marks = []
    for c, k, r in zip(chunks, codes, runs, strict=True):
        marks += np.split(suffix_index._cut(c, k, r, buckets)[: c.ends[-1]], c.ends[:-1])
    return marks


@pytest.mark.parametrize("seed", range(24))
def test_removed_passages(monkeypatch, seed):
    rand = random.Random(seed)
    for name, values in (("HOT", [0, 1, 5, 60_000]), ("SEGMENT", [64, 300, 1 << 20]), ("BATCH", [1, 60, 500, 1 << 18]), ("MOST_WINDOWS", [3, 128])):
        monkeypatch.setattr(suffix_index, name, rand.choice(values))
    suffix_index._made.clear()
    letters = rand.choice(["a", "ab", "abcdefgh", "a\0"])
    text = lambda n: "".join(rand.choices(letters, k=n))
    pool = [text(rand.choice([40, 49, 50, 51, 80, 200])) for _ in range(6)]
    docs = [(rand.choice([None, *range(-3, 20)]), "".join(rand.choice([rand.choice(pool), text(rand.randint(0, 30))]) for _ in range(rand.randint(0, 5))).encode()) for _ in range(rand.randint(1, 25))]
    got = rounds(docs, rand.choice([1, 4, 30]), rand.choice([1, 7]))
    assert all(np.array_equal(a, b) for a, b in zip(plain_marks(docs), got, strict=True))
    suffix_index._made.clear()


def test_passages_removed(spark):
    shared = "a passage of more than fifty bytes that stands in several documents, ünïcode too"
    rows = [(4, shared), (2, "first " + shared + " end"), (9, "x" * 400 + shared), (9, "x" * 400 + shared), (None, shared), (None, "own words of a row without an id, of which there are enough to make a window"),
            (5, None), (6, ""), (7, "short"), (8, "long " * 30_000 + shared), (10, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("bytes", F.lit("b")).repartition(3)
    got = suffix_index.passages_removed(docs).collect()
    want = []
    for (i, t), mark in zip(rows, plain_marks([(i, (t or "").encode()) for i, t in rows]), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark, [0]]))).reshape(-1, 2).tolist()
        raw = np.frombuffer((t or "").encode(), np.uint8)
        want.append((i, len(raw), edges, raw[~mark].tobytes()))
    assert sorted(map(repr, want)) == sorted(repr((r.id, r.n_bytes, [list(s) for s in r.spans], bytes(r.kept))) for r in got)
    assert suffix_index.passages_removed(docs.limit(0)).collect() == []


def test_levels_stay_few():
    family, rand = suffix_index.IndexFamily(), np.random.default_rng(4)
    for i in range(64):
        text = rand.integers(97, 123, 149, np.uint8)
        family.add(text, np.arange(100), np.full(100, i))
        assert len(family.levels) <= 8 and sum(map(len, family.levels)) == 100 * (i + 1)


# --- conversations --------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    for v in turns.values():
        v.sort(key=lambda x: x[:2])
    rebuilt = {c: [x[2:] for x in turns.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4]] + [x[2:] for x in v[zlib.crc32(str(c).encode()) % 4 :]] for c, v in turns.items()}
    members, kids, total, out = defaultdict(list), defaultdict(list), {}, []
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        total[k] = (sum(total[x][0] for x in kids[k]) or 1, (len(members[k]) - 1) * words + sum(total[x][1] for x in kids[k]))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *total[k], sha(ends)))
    return sorted(out)


def test_trie(spark):
    rows = [
        (c, None if t == 0 and own.random() < 0.2 else t, own.choice(["user", None]), own.choice(["a b", None, "c  d\te ", "x"]))
        for c in [*range(40), *range(41, 90), -5, -20, 1000, 1003] for t in range(own.choice([1, 1, 2, 3, 5, 8]))
    ]
    rows += [(7, 100 + i, "u", f"long {i % 3}") for i in range(300)] + [(None, 1, "u", "no conversation")]
    rows += [(c, i, "u", f"nested {i}") for c in range(200, 212) for i in range(c - 198)]  # each goes on where the one before ends
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("d")).withColumn("part", F.lit("p"))
    got = sorted(tuple(r) for r in conversation_trie.trie(df).collect())
    assert got == plain_trie(rows)


def test_ties_and_repeated_turns(spark):
    rows = [(3, 1, "u", "b"), (3, 1, "u", "a"), (3, 1, "u", "a"), (4, 1, "u", "a"), (4, 1, "u", "b"), (4, 1, "u", "a")]
    got = conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.depth): r for r in got}
    h3, h4 = (zlib.crc32(str(c).encode()) % 4 for c in (3, 4))
    assert by[(3, 0)].n_convs == 2 and by[(3, 0)].saved_tokens == (3 - h3 if h3 == h4 else by[(3, 0)].saved_tokens)
    assert conversation_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
