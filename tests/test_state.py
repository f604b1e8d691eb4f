"""Indexes, logs, limits, streams and files that last longer than a query."""

import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casefile.functions import checks
from casefile.operators import admission, numbering, similarity
from casefile.operators.cache_log import CacheLog
from casefile.operators.knn_index import VectorIndex
from casefile.sinks import file_writer
from casefile.sinks import reports
from casefile.streaming import live

own = random.Random(8)


# --- nearest neighbours ---------------------------------------------------------------------------


def plain_nearest(rows, asked, k):
    out = set()
    for q, v in asked:
        near = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in rows)[:k]
        out |= {(q, r, i) for r, (_, i) in enumerate(near, 1)}
    return out


def test_index_finds_the_nearest_in_few_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 10, (30, 6))
    rows = [(i, (centers[i % 30] + rng.normal(0, 0.3, 6)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(9)]  # ties by id
    usable, odd = rows, [(3000, None), (3001, []), (3002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3003, [float("nan")] * 6)]
    df = lambda r: spark.createDataFrame(r, "id long, v array<double>").withColumn("cluster", F.lit("x")).withColumn("away", F.lit("y"))
    index = VectorIndex.build(df(rows[:900] + odd), "id", "v", str(tmp_path / "index"))
    index.append(df(rows[900:1400]), "id", "v")
    index.append(df(rows[1400:]), "id", "v")
    asked = [(i, v) for i, v in usable if i % 100 == 0] + [(9000, [50.0] * 6), (9001, rows[7][1])]
    for k in (1, 5, 12):
        got = {(r.query_id, r["rank"], r.id) for r in index.search(df(asked + odd), "id", "v", k).collect()}
        assert got == plain_nearest(usable, asked, k)
    assert index.visited_share(df(asked), "id", "v") < 0.12
    few = index.search(df(asked[:1]), "id", "v", 5000).count()
    assert few == len(usable)


def test_index_of_little_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "two"))
    assert [tuple(r) for r in index.search(df, "id", "v").orderBy("query_id", "rank").collect()] == [(q, r, r, 0.0) for q in (1, 2) for r in (1, 2)]


def test_index_of_nothing_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", str(tmp_path / "none"))


# --- admission ------------------------------------------------------------------------------------


@pytest.mark.parametrize("gap,limits", [(20, (2, 10, 30.0)), (400, (2, 10, 30.0)), (1, (5, 7, 0.0)), (300, (1, 3, 7200.0))])
def test_one_busy_key_in_pieces(spark, gap, limits):
    calls, now = [], 0
    for i in range(3000):
        now += own.randint(0, 2 * gap)
        calls.append(("busy", i, now))
    calls += [(None, 5000 + i, i * 40) for i in range(60)] + [("rare", 6000, 5), ("rare", 6001, None)]
    df = spark.createDataFrame(calls, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("piece", F.lit("p"))
    got = {r.id: r.admitted for r in admission.admission(df, "k", "ts", "id", *limits, pieces=7).collect()}
    for key in ("busy", None, "rare"):
        times = sorted((s, i) for k, i, s in calls if k == key and s is not None)
        flags = admission.admitted_flags([float(s) for s, _ in times], *limits)
        assert [got[i] for _, i in times] == flags
    assert got[6001] is False and len(got) == len(calls)


def test_walk_goes_on_from_any_state():
    for _ in range(200):
        limits = admission.Limits(own.choice([1, 2, 5]), own.choice([1, 3, 10]), own.choice([0, 1, 30, 4000]))
        times = np.sort(np.array([own.randint(0, own.choice([60, 3000, 90000])) * 1_000_000 for _ in range(60)]))
        k = own.randint(0, 60)
        first, state = admission.walked(times[:k], (), limits)
        second, _ = admission.walked(times[k:], state, limits)
        flags = admission.admitted_flags((times / 1e6).tolist(), limits.per_minute, limits.per_hour, limits.interval)
        assert [*first, *(second + k)] == [i for i, ok in enumerate(flags) if ok]


# --- running answers ------------------------------------------------------------------------------

TEXTS = ["a <think>hidden</think> b", "x<think>never closed", "<th<think>q</think>ink> more", "no tags <at all", "<think></think>", "ab<think>1</think>cd<think>2</think>ef<t"]


def test_kept_tail_shows_what_the_whole_text_shows():
    for text in TEXTS:
        for _ in range(60):
            cuts = sorted(own.sample(range(len(text) + 1), own.randint(0, 4)))
            chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            held, shown, out, whole, seen = "", 0, [], "", 0
            for c in chunks:
                held, shown, piece = live.shown_after(held, shown, c)
                out.append(piece)
                whole = live._closed_removed(whole + c)  # the whole text at every step, as a client would have it
                at = whole.find(live.OPEN)
                at = at if at >= 0 else len(whole) - max(n for n in range(7) if whole.endswith(live.OPEN[:n]))
                assert piece == whole[seen:at]
                seen = max(seen, at)
            assert "".join(live.visible(chunks)) == "".join(out) + whole[seen:]
            assert len(held) < 40


def test_visible_stream(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    schema, sent = "stream string, seq long, chunk string, final boolean", {}
    batches = [[] for _ in range(3)]
    for n, text in enumerate(TEXTS):
        cuts = sorted(own.sample(range(len(text) + 1), 5))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        sent[str(n)] = chunks
        for i, c in enumerate(chunks):
            batches[min(2, own.randint(0, i) // 2)].append((str(n), i, c, i == len(chunks) - 1))
    batches[2].append(("0", 0, "again", False))  # repeated: ignored
    batches[2].append(("open", 0, "a <think>b", False))  # quiet: shown in the end
    found = lambda: session.read.schema("stream string, seq long, piece string, final boolean").parquet(str(tmp_path / "out")).collect()
    for n, batch in enumerate(batches):  # a restart from the checkpoint between batches
        session.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chunks = session.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = live.visible_stream(chunks, "stream", "seq", "chunk", "final", quiet=1 if n == 2 else 3600).writeStream.outputMode("append").format("parquet")
        query = out.option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(processingTime="200 milliseconds").start()
        for _ in range(300):
            if any(p.numInputRows for p in query.recentProgress) and (n < 2 or any(r.stream == "open" and r.final for r in found())):
                break
            time.sleep(0.2)
        query.stop()
    rows = found()
    assert [r.piece for r in sorted((r for r in rows if r.stream == "open"), key=lambda r: r.seq)] == ["a ", "<think>b"]
    for name, chunks in sent.items():
        mine = sorted((r for r in rows if r.stream == name), key=lambda r: r.seq)
        assert "".join(r.piece for r in mine) == "".join(live.visible(chunks)) and [r.final for r in mine][-1:] == [True]


# --- cache ----------------------------------------------------------------------------------------


def test_cache_log_is_a_dictionary(spark, tmp_path):
    log, want, batch = CacheLog(spark, f"file://{tmp_path}/cache"), {}, 0
    assert log.entries().collect() == []
    for _ in range(10):
        changes = []
        for seq in range(own.randint(1, 6)):
            op, key = own.choice(["put", "put", "put", "remove", "clear"] if own.random() < 0.4 else ["put", "remove"]), f"k{own.randint(0, 5)}"
            changes.append((None, seq, "clear", None) if op == "clear" else (key, seq, op, f"v{own.random()}" if op == "put" else None))
            if op == "clear":
                want.clear()
            elif op == "put":
                want[key] = changes[-1][3]
            else:
                want.pop(key, None)
        rows = spark.createDataFrame(own.sample(changes, len(changes)), "key string, seq long, op string, value string")
        assert log.apply(batch, rows) and not log.apply(batch, rows.limit(0))  # a replay changes nothing
        batch += 1
        if own.random() < 0.4:
            log.compact()
        assert {r.key: r.value for r in log.entries().collect()} == want
    before = log.entries()
    log.put(spark.createDataFrame([("new", "1"), ("k0", "x")], "id string, v string"), "id", "v")
    log.compact()
    assert {r.key: r.value for r in before.collect()} == want  # a reader keeps its version
    log.invalidate(F.col("value") == "x")
    assert {r.key: r.value for r in log.entries().collect()} == {k: v for k, v in want.items() if k != "k0"} | {"new": "1"}
    log.clear()
    log.vacuum()
    assert log.entries().count() == 0 and len(list((tmp_path / "cache" / "log").iterdir())) == 2
    (tmp_path / "cache" / "log" / "99").mkdir()  # what a failed try left does not count
    assert log.entries().count() == 0 and log.apply(99, spark.createDataFrame([("z", 0, "put", "1")], "key string, seq long, op string, value string"))
    assert log.entries().count() == 1


def test_cache_log_follows_a_stream(spark, tmp_path):
    schema = "key string, seq long, op string, value string"
    log = CacheLog(spark, f"file://{tmp_path}/cache")
    for rows in ([("a", 0, "put", "1"), ("b", 1, "put", "2")], [("a", 0, "remove", None), ("c", 1, "put", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = log.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "mark")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
    assert {r.key: r.value for r in log.entries().collect()} == {"b": "2", "c": "3"}


# --- files, numbers, angles, errors ---------------------------------------------------------------


def test_files_written_by_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("r%d.txt", "id").alias("name"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), F.lit(1).alias("other"))
    file_writer.write_files(rows.repartition(4), f"file://{tmp_path}/out")
    found = {p.name: p.read_text() for p in (tmp_path / "out").glob("part-*/*")}
    assert found == {f"r{i}.txt": f"text {i}" for i in range(40)} and not (tmp_path / "out" / "_temporary").exists()
    bad = rows.repartition(4).withColumn("name", F.when(F.col("name") == "r7.txt", "a/b").otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        file_writer.write_files(bad, f"file://{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("part-*")) and not (tmp_path / "bad" / "_temporary").exists()
    file_writer.write_files(rows.limit(2), f"file://{tmp_path}/out", "overwrite")
    assert len(list((tmp_path / "out").glob("part-*/*"))) == 2


def test_numbers_and_sections(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None, f"t{i}") for i in own.sample(range(500), 200)], "i long, g long, t string")
    got = numbering.numbered(rows, [F.desc("i")], "n", 1).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == sorted((r.i for r in got), reverse=True) and sorted(r.n for r in got) == list(range(1, 201))
    assert numbering.numbered(rows.limit(0), [F.desc("i")]).collect() == []
    by = {}
    for r in reports.consolidated(rows, "g", "i", "t").collect():
        by.setdefault(r.g, []).append((r.pos, r.section, r.first, r.n))
    for g in (None, 0, 1, 2):
        mine = sorted(r.i for r in got if r.g == g)
        assert sorted(by[g]) == [(k, f"### report_{k}\nt{i}", mine[0], len(mine)) for k, i in enumerate(mine, 1)]


def test_widest_angles(spark):
    groups = {f"g{n}": [own.choice([own.uniform(-400, 800), float(own.randint(0, 360)), own.gauss(90, 3)]) for _ in range(own.choice([1, 2, 3, 8, 40]))] for n in range(25)}
    rows = [(k, a) for k, v in groups.items() for a in v] + [("none", None)]
    got = {r.image: r for r in similarity.widest_angle(spark.createDataFrame(rows, "i string, a double").repartition(3), "i", "a").collect()}
    gap = lambda x, y: min(abs(x - y) % 360, 360 - abs(x - y) % 360)
    for k, v in groups.items():
        assert got[k].max_gap == pytest.approx(max(gap(x, y) for x in v for y in v), abs=1e-9)
    assert got["none"].max_gap is None and got["none"].verdict == "inconclusivo"


def test_many_angles_of_one_image(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("i"), (F.col("id") * 0.00085 + 20).alias("a"))  # all within 170 degrees
    r = similarity.widest_angle(rows, "i", "a").first()
    assert r.max_gap == pytest.approx(199_999 * 0.00085, abs=1e-9)


def test_one_rule_for_errors(spark):
    cases = [(s, m) for s in (None, 0, 400, 401, 403, 404, 418, 422, 429, 499, 500, 503) for m in ("", "timeout", "Billing stopped", "INVALID_API_KEY")]
    rows = spark.createDataFrame(cases, "s int, m string").select("s", "m", checks.transient(F.col("s"), F.col("m")).alias("t")).collect()
    assert all(r.t == checks.repeatable(r.s, r.m) for r in rows) and len({r.t for r in rows}) == 2
