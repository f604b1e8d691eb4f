"""Sources, sinks, engine clients, image kernels and streams."""

import json
import struct
import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.operators import admission, images, incremental, similarity
from casefile.sinks import reports
from casefile.sources import clients, files
from casefile.streaming import live


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    gradient = np.tile(np.arange(256)[None, :, None], (128, 1, 3))
    noise = rng.integers(0, 256, (128, 256, 3))
    copied = np.full((128, 256, 3), 128) + rng.integers(-2, 3, (128, 256, 3))
    patch = rng.integers(0, 256, (48, 48, 3))
    copied[8:56, 8:56] = patch
    copied[64:112, 160:208] = patch
    shadow = np.full((128, 256, 3), 200)
    shadow[20:50, 20:60] = 10
    shadow[80:110, 150:200] = 20
    for name, x in {"gradient": gradient, "noise": noise, "copied": copied, "flat": np.full((64, 64, 3), 90), "shadow": shadow}.items():
        (d / f"{name}.png").write_bytes(png(x))
    (d / "again.PNG").write_bytes(png(gradient))
    (d / "broken.png").write_bytes(b"not an image")
    (d / "notes.txt").write_text("x")
    return d


def test_image_scan(spark, folder):
    found = files.image_files(spark, str(folder))
    assert {r.name for r in found.collect()} == {"gradient", "noise", "copied", "flat", "shadow", "again", "broken"} and "content" not in found.columns
    assert files.image_files(spark, str(folder / "missing")).count() == 0


def test_image_kernels(spark, folder):
    rows = images.measured(files.decoded_images(spark, str(folder))).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)).cache()
    by = {r.name: r for r in rows.collect()}
    assert set(by) == {"gradient", "noise", "copied", "flat", "shadow", "again"}  # the broken one is dropped
    assert (by["gradient"].phash, by["gradient"].dhash) == (by["again"].phash, by["again"].dhash)
    assert by["flat"].contrast == 0 and by["flat"].blur == 0 and by["flat"].colors == ["#5a5a5a"] and abs(by["flat"].brightness - 90 / 255) < 1e-9
    assert by["noise"].blur > 1000 > by["gradient"].blur
    regions = sorted((round(r.cx), round(r.cy), r.area) for r in by["shadow"].regions)
    assert regions == [(40, 34, 1200), (174, 94, 1500)]
    verdicts = {r.name: r.v for r in rows.select("name", images.hidden_data_verdict(F.col("bits")).alias("v")).collect()}
    assert verdicts["noise"] == "suspeito" and verdicts["flat"] == "nenhum"
    blocks = rows.select(F.col("name").alias("image_id"), F.explode("blocks").alias("b")).select("image_id", "b.*")
    pairs = similarity.copied_blocks(blocks).groupBy("image").count().collect()
    n = {r.image: r["count"] for r in pairs}
    assert n.get("copied", 0) >= 9 and n.get("noise", 0) == 0
    dup = similarity.image_duplicates(similarity.image_classes(rows.withColumn("md5", F.md5("name")), "name", "phash", "dhash", "md5")[0]).collect()
    assert ("again", "gradient", 0, 0) in {(r.a, r.b, r.ph_distance, r.dh_distance) for r in dup}


def test_banded_join_is_brute_force(spark):
    import random

    own = random.Random(0)
    values = [own.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for flips in (7, 8, 9):
            x = v
            for b in own.sample(range(64), flips):
                x ^= 1 << b
            values.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,)], "h long")
    m = (1 << 64) - 1
    for near in (0, 3, 8, 10, 12, 16):
        rows = similarity.near_hashes(df, "h", near).collect()
        got = {(r.a, r.b): r.distance for r in rows}
        assert got == {(a, b): ((a & m) ^ (b & m)).bit_count() for a in signed for b in signed if a < b and ((a & m) ^ (b & m)).bit_count() <= near}
        assert len(rows) == len(got)
        parts = similarity.segments(near)
        share = sum(sum(comb(w, i) for i in range(n + 1)) / 2**w for _, w, n in parts)
        assert share < {0: 1e-4, 3: 1e-3, 8: 0.003, 10: 0.007, 12: 0.017, 16: 0.071}[near]  # candidates among uniform hashes


def test_classes_of_images(spark):
    rows = [(1, 5, 6, "a"), (2, 5, 6, "a"), (3, None, 6, "b"), (4, 7, 6, "b"), (5, 5, 6, None), (6, 5, 6, None), (7, None, None, None), (8, None, None, None), (9, 1 << 40, 6, "c")]
    classes, members = similarity.image_classes(spark.createDataFrame(rows, "i long, p long, d long, m string"), "i", "p", "d", "m")
    assert {r.id: (r.p, r.d, r.n) for r in classes.collect()} == {1: (5, 6, 2), 3: (7, 6, 2), 5: (5, 6, 2), 7: (None, None, 2), 9: (1 << 40, 6, 1)}
    assert {r.id: r.representative for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    got = {(r.a, r.b): (r.ph_distance, r.dh_distance, r.same_md5, r.n_a, r.n_b) for r in similarity.image_duplicates(classes, 3).collect()}
    assert got == {(1, 1): (0, 0, True, 2, 2), (3, 3): (0, 0, True, 2, 2), (5, 5): (0, 0, False, 2, 2), (7, 7): (64, 64, False, 2, 2), (1, 5): (0, 0, False, 2, 2), (1, 3): (1, 0, False, 2, 2), (3, 5): (1, 0, False, 2, 2),
                   (1, 9): (3, 0, False, 2, 1), (5, 9): (3, 0, False, 2, 1)}


def test_markdown_and_json_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.json").write_text(json.dumps({"image_path": "p", "status": "completed", "reports": ["r"]}) + "\nnot json\n")
    assert [(r.id, r.document) for r in files.markdown_files(spark, str(tmp_path)).collect()] == [("a", "# é")]
    rows = files.json_store(spark, str(tmp_path / "c.json"), files.CHECKPOINT_ENTRY).collect()
    assert [r.status for r in rows] == ["completed", None]
    assert files.json_store(spark, str(tmp_path / "none.json"), files.CHECKPOINT_ENTRY).count() == 0


def test_keyframes(spark):
    df = spark.range(0, 400).select(F.col("id").alias("f"), F.lit(100).alias("fps"), F.lit("v").alias("s"))
    got = {r.name: r.f for r in files.keyframes(df, "f", "fps", "s").collect()}
    assert got == {"v_00m00s.jpg": 90, "v_00m01s.jpg": 180, "v_00m02s.jpg": 270, "v_00m03s.jpg": 390}


def test_retry_delays():
    delays = []
    calls = iter([ValueError("timeout"), ValueError("timeout"), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert clients.retried(call, clients.Retry(2, 1.0, 2.0, 60.0, False), delays.append) == "done" and delays == [1.0, 2.0]
    with pytest.raises(ValueError):
        clients.retried(lambda: (_ for _ in ()).throw(ValueError("Incorrect API key")), clients.Retry(5), delays.append)
    assert delays == [1.0, 2.0]


def test_clients_and_fallback(spark):
    def first():
        def call(row):
            if row["id"] % 2:
                raise ValueError("billing: first is down")
            return f"one {row['id']}"

        return call

    def second():
        def call(row):
            if row["id"] == 3:
                raise ValueError("billing: second is down")
            return f"two {row['id']}"

        return call

    got = {r.id: (r.text, r.text_error, r.text_status) for r in clients.with_fallback(spark.range(4), first, second, "text").collect()}
    assert got == {0: ("one 0", None, "completed"), 1: ("two 1", None, "fallback"), 2: ("one 2", None, "completed"), 3: (None, "billing: first is down", "failed")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a<b>", "x & y", ""), ("c", "<z>", "t")], "name string, one string, two string")
    df = df.withColumn("m", reports.markdown(F.col("name"), {"One": F.col("one"), "Two": F.col("two")})).withColumn("h", reports.html(F.col("name"), {"One": F.col("one")}, image=F.lit(b"p")))
    rows = {r.name: r for r in df.collect()}
    assert rows["a<b>"].m == "# a<b>\n\n## One\n\nx & y\n\n## Two\n\nNão disponível.\n"
    assert "x &amp; y" in rows["a<b>"].h and "&lt;z&gt;" in rows["c"].h and "base64,cA==" in rows["c"].h
    done, failed = reports.export(df, str(tmp_path / "out"), "name", {"md": "m", "html": "h", "pdf": "m", "json": "missing"})
    assert set(done) == {"md", "html"} and set(failed) == {"json"}
    assert spark.read.text(done["md"]).filter("name = 'c'").first()[0] == "# c"
    t = spark.range(1).select(reports.telemetry_table(F.array(F.struct(F.lit("ocr").alias("stage"), F.lit("cached").alias("status"), F.lit(0.42).alias("duration_ms"), F.lit("a|b").alias("detail")))).alias("t")).first().t
    assert t.split("\n")[-1] == "| ocr | cached | 0.42 | a/b |"
    counts = spark.range(1).select(F.lit(3).alias("total"))
    assert "- … 5 more" in reports.batch_markdown(counts, {"Ids": spark.range(25).select("id", F.lit(1).alias("n"))})


def test_signature():
    a = {"export_formats": ["md", "json", "md"], "mode": "geral"}
    assert incremental.job_signature(a) == incremental.job_signature({"mode": "geral", "export_formats": ["json", "md"]}) != incremental.job_signature({"mode": "geral", "export_formats": ["json"]})
    assert incremental.reset_reason("x", "x", True, None) is None and incremental.reset_reason("x", "y", True, None) == "signature" and incremental.reset_reason(None, "y", False, None) == "version"


def test_admission():
    assert admission.admitted_flags([0, 0.4, 0.5, 59.9, 60.0], 2, 100, 0.5) == [True, False, True, False, True]
    assert admission.admitted_flags([0, 10, 20, 3599, 3600], 10, 2, 1) == [True, True, False, False, True]


def test_visible_chunks():
    assert list(live.visible(["a <thi", "nk>hid", "den</think>", " b", " c"])) == ["a ", " b", " c"]
    assert list(live.visible(["a <", "b"])) == ["a ", "<b"] and list(live.visible(["x<think>y"])) == ["x", "<think>y"]
    assert list(live.visible(["<think>x", "y</think>out"])) == ["out"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", 1, "<think>a"), ("s", 2, "b</think>"), ("s", 3, "yes"), ("t", 1, "no")], "stream string, seq int, chunk string").write.parquet(src)
    live_rows = spark.readStream.schema("stream string, seq int, chunk string").parquet(src)
    q = live.reassembled(live_rows, "stream", "seq", "chunk").writeStream.outputMode("complete").format("memory").queryName("chunks").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stream, r.content) for r in spark.table("chunks").collect()} == {("s", "yes"), ("t", "no")}


def test_event_time_and_admission_streams(spark, tmp_path):
    src = str(tmp_path / "ev")
    base = spark.createDataFrame([("k", 0), ("k", 1), ("k", 5), ("k", 70), ("j", 3)], "key string, s int").select("key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    base.coalesce(1).write.parquet(src)
    schema = "key string, ts timestamp"
    q = live.admission_stream(spark.readStream.schema(schema).parquet(src), "key", "ts", 2, 100, 2.0).writeStream.outputMode("append").format("memory").queryName("adm").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.t - 1_700_000_000, r.admitted) for r in spark.table("adm").collect())
    assert got == [("j", 3.0, True), ("k", 0.0, True), ("k", 1.0, False), ("k", 5.0, True), ("k", 70.0, True)]
    q = live.windowed_rate(spark.readStream.schema(schema).parquet(src), "ts", "key", "1 minute").writeStream.outputMode("complete").format("memory").queryName("rate").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("rate").collect()) == 5
