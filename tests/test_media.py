"""Error levels, ghosts, low bits, shadows, preprocessing, documents, clients' keeping: against plain versions."""

import io
import math
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.operators import images, preprocess, recompression, records
from casefile.sinks import file_writer, documents, file_writer
from casefile.sources import clients, files

rng = np.random.default_rng(4)


def smooth(h=96, w=120):
    y, x = np.mgrid[:h, :w]
    return np.stack([128 + 90 * np.sin(x / 20 + c) * np.cos(y / 17) for c in range(3)], axis=2).round()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    pasted = smooth()
    pasted[16:48, 24:72] = rng.integers(0, 256, (32, 48, 3))
    for name, x in {"smooth": smooth(), "pasted": pasted, "flat": np.full((40, 40, 3), 90)}.items():
        (d / f"{name}.png").write_bytes(preprocess.png(x))
    return d


def plain_block(block, table):
    """One 8 x 8 block through the defining sums."""
    c = lambda k: math.sqrt(1 / 8) if k == 0 else math.sqrt(2 / 8)
    basis = np.array([[c(k) * math.cos(math.pi * k * (2 * n + 1) / 16) for n in range(8)] for k in range(8)])
    found = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            found[u, v] = sum((block[y, x] - 128) * basis[u, y] * basis[v, x] for y in range(8) for x in range(8))
    found = np.round(found / table) * table
    return np.array([[sum(found[u, v] * basis[u, y] * basis[v, x] for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]) + 128


def test_recompression_of_gray_blocks_is_the_definition():
    block = rng.integers(0, 256, (8, 8)).astype(float)
    for quality in (95, 75, 40):
        table = recompression.table(recompression.LUMA, quality)
        got = recompression.recompressed(np.repeat(block[..., None], 3, axis=2), quality)
        assert np.abs(got[..., 0] - np.clip(np.round(plain_block(block, table)), 0, 255)).max() <= 1
    x = smooth(33, 41)
    assert recompression.recompressed(x, 95).shape == x.shape and np.abs(x - recompression.recompressed(x, 100)).mean() < 2


def plain_regions(mask, diagonal):
    seen, out = set(), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal
    for start in zip(*np.nonzero(mask), strict=True):
        if start in seen:
            continue
        own, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for dy, dx in steps:
                at = (y + dy, x + dx)
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and at not in seen:
                    seen.add(at)
                    todo.append(at)
        out.append(sorted(own))
    return sorted(out)


@pytest.mark.parametrize("diagonal", [False, True])
def test_areas(diagonal):
    for share in (0.3, 0.55, 0.9):
        mask = rng.random((23, 31)) < share
        label, n = images.labelled(mask, diagonal)
        got = sorted(sorted(zip(*np.nonzero(label == k), strict=True)) for k in range(n))
        assert got == plain_regions(mask, diagonal) and (label[~mask] == -1).all()
    assert images.labelled(np.zeros((4, 5), bool))[1] == 0


def test_hotspots():
    bright = np.zeros((100, 120), bool)
    bright[20:30, 30:50] = True
    bright[90, 100] = True  # widened to 9 x 9: an outline of 64, over a thousandth of 12,000
    assert sorted(recompression.hotspots(bright)) == [(26, 16, 54, 34), (96, 86, 105, 95)]
    assert recompression.hotspots(np.zeros((9, 9), bool)) == []
    assert recompression.hotspots(np.pad(np.ones((1, 1), bool), 200)) == []  # too small for that image


def test_shadows_take_the_widened_box():
    x = np.full((80, 100), 200.0)
    x[20:40, 30:60] = 10
    x[20:40, 30:36] = np.linspace(10, 55, 6)
    x[60:62, 5:9] = 0  # too small
    (cx, cy, area, angle), = images.dark_regions(x)
    ys, xs = np.nonzero(x < 60)
    big = ys < 50
    gy, gx = np.gradient(x[15:45, 25:65])
    assert (round(cx, 9), round(cy, 9), area) == (round(xs[big].mean(), 9), round(ys[big].mean(), 9), big.sum())
    assert abs(angle - math.degrees(math.atan2(gy.mean(), gx.mean())) % 360) < 1e-9


def test_low_bits_of_all_channels(spark):
    x = rng.integers(0, 256, (15, 7, 3), np.uint8)
    every, *own = images.low_bits(x.tobytes(), 3)
    bits = np.concatenate([x.reshape(-1, 3)[:, c] & 1 for c in (2, 1, 0)])
    pairs = [0] * 4
    for a, b in zip(bits[0::2], bits[1::2], strict=False):
        pairs[a * 2 + b] += 1
    assert every == (len(bits), int(bits.sum()), pairs) and [o[0] for o in own] == [105] * 3
    kind = "n long, ones long, pairs array<long>"
    rows = [
        ("provavel", [(4000, 2000, [700, 300, 300, 700]), *[(1000, 500, [125] * 4)] * 3]),
        ("suspeito", [(4000, 2000, [500] * 4), *[(1000, 10, [240, 4, 4, 2])] * 3]),
        ("suspeito", [(4000, 800, [900, 300, 300, 500]), (1000, 500, [125] * 4), (1000, 500, [125] * 4), (1000, 1, [249, 1, 0, 0])]),
        ("nenhum", [(4000, 800, [900, 300, 300, 500]), (1000, 500, [125] * 4), (1000, 5, [245, 2, 3, 0]), (1000, 1, [249, 1, 0, 0])]),
    ]
    df = spark.createDataFrame(rows, f"want string, bits array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    assert all(r.want == r.got for r in df.select("want", images.hidden_data_verdict(F.col("bits")).alias("got")).collect())


def test_block_hashes_are_the_loop():
    x = rng.integers(0, 256, (70, 90)).astype(float)
    x[:30, :40] = 7  # without texture
    want = []
    for top in range(0, 70 - 15, 8):
        for left in range(0, 90 - 15, 8):
            b = x[top : top + 16, left : left + 16]
            if b.var() >= 50:
                s = b[::2, ::2]
                want.append((left, top, images.as_long(s > s.mean())))
    assert sorted(images.block_hashes(x)) == sorted(want)
    assert images.block_hashes(x[:10, :10]) == [] and images.block_hashes(np.zeros((64, 64))) == []


def test_error_levels_of_files(spark, folder):
    rows = {re.search(r"([^/]+)\.png", r.path)[1]: r for r in recompression.measured(files.decoded_images(spark, str(folder))).collect()}
    assert rows["flat"].max_error == 0 and rows["flat"].hotspots == [] and rows["flat"].ghosts == []
    assert rows["pasted"].mean_error > 2 * rows["smooth"].mean_error and rows["smooth"].bright_percent == 0


def test_ghosts_are_the_loop(monkeypatch):
    monkeypatch.setattr(recompression, "GHOST_LEAST_GAP", 0.5)  # hits are rare at 3
    noise = np.repeat(rng.integers(0, 256, (96, 130, 1)), 3, axis=2).astype(float)
    x = np.concatenate([recompression.recompressed(noise, 60), noise])
    errors = {q: np.abs(x - recompression.recompressed(x, q)).mean(axis=2) for q in (90, 85, 80, 75, 70, 60)}
    want = []
    for top in range(0, x.shape[0] - 31, 32):
        for left in range(0, x.shape[1] - 31, 32):
            own = {q: e[top : top + 32, left : left + 32].mean() for q, e in errors.items()}
            mean = sum(own.values()) / 6
            if np.std(list(own.values())) >= 0.1:
                hit = next((q for q, e in own.items() if mean - e > 0.5 and e < 0.5 * mean), None)
                if hit:
                    want.append((left, top, hit, round(mean - own[hit], 9)))
    got = [(a, b, q, round(g, 9)) for a, b, q, g in recompression.ghosts(x)]
    assert got == want and len(want) > 0
    assert recompression.ghosts(x[:20, :20]) == []


def test_orientations():
    x = np.arange(2 * 3 * 3).reshape(2, 3, 3).astype(float)
    upright = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 6: np.rot90(x, 3), 8: np.rot90(x, 1), None: x, 99: x}
    for k, want in upright.items():
        assert (preprocess.oriented(x, k) == want).all()
    for k, turns in ((5, 1), (7, 3)):
        assert (preprocess.oriented(x, k) == np.rot90(x, turns)[:, ::-1]).all()


def test_steps():
    dark = np.full((50, 50, 3), 30.0)
    out, lit = preprocess.enhanced(dark)
    assert lit and out.mean() > 55  # factor 2 at most, then contrast about the mean
    assert preprocess.enlarged(np.zeros((100, 200, 3))).shape == (300, 600, 3) and preprocess.enlarged(np.zeros((400, 500, 3))).shape == (800, 1000, 3)
    assert preprocess.thumbnail(np.zeros((100, 400, 3)), 200).shape == (50, 200, 3)
    noisy = smooth(40, 50) + rng.normal(0, 5, (40, 50, 3))
    assert np.abs(preprocess.denoised(noisy) - smooth(40, 50)).mean() < np.abs(noisy - smooth(40, 50)).mean()
    lines = np.full((160, 200, 3), 255.0)
    lines[::16] = lines[1::16] = lines[2::16] = 0
    assert preprocess.tilt(lines) == 0
    turned = preprocess.rotated(lines, 4)
    assert 3 < abs(preprocess.tilt(turned)) < 5 and abs(preprocess.tilt(preprocess.straightened(turned))) < 1
    assert np.allclose(preprocess.scaled(smooth(), 192, 240)[::2, ::2][5:-5, 5:-5], smooth()[5:-5, 5:-5], atol=12)


def test_prepared(spark, folder):
    shown = files.decoded_images(spark, str(folder)).withColumn("o", F.when(F.contains("image.origin", F.lit("smooth")), 6))
    rows = {re.search(r"([^/]+)\.png", r.path)[1]: r for r in preprocess.prepared(shown, ("rotate", "upscale"), orientation="o").collect()}
    assert (rows["smooth"].width, rows["smooth"].height, rows["smooth"].was_rotated) == (96 * 3, 120 * 3, True)
    assert (rows["flat"].width, rows["flat"].was_rotated, rows["flat"].was_enhanced) == (120, False, False)
    data = bytes(rows["flat"].content)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (120, 120)


def test_colors():
    x = np.zeros((40, 50, 3), np.uint8)
    x[:, :30], x[:, 30:] = (10, 20, 200), (250, 240, 0)  # BGR
    assert images.clustered_colors(x.tobytes(), 40, 50, 3) == ["#c8140a", "#00f0fa"]


BLOCKS = [("h1", "Title & <x>"), ("h2", "Head"), ("paragraph", "plain **bold** é \x01" + "long " * 400), ("bullet", "point"), ("code", "a  b\n(c)\\"), ("table", "| a | b |\n| 1 | 2 |"), ("paragraph", "w" * 500)]


def test_word_files():
    data = documents.docx(BLOCKS)
    assert data == documents.docx(BLOCKS)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        import xml.etree.ElementTree as ET

        for name in z.namelist():
            ET.fromstring(z.read(name))
        body = ET.fromstring(z.read("word/document.xml"))
    text = "".join(t.text or "" for t in body.iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"))
    assert "Title & <x>" in text and "bold" in text and "point" in text and "\x01" not in text
    assert documents.docx([]) and documents.pdf([])


def test_pdf_files():
    data = documents.pdf(BLOCKS * 30)
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    for n, at in enumerate(places, 1):
        assert data[at:].startswith(b"%d 0 obj" % n)
    streams = re.findall(rb"/Length (\d+) /Filter /FlateDecode >>\nstream\n", data)
    text = b"".join(zlib.decompress(data[m.end() : m.end() + int(m[1])]) for m in re.finditer(rb"/Length (\d+) /Filter /FlateDecode >>\nstream\n", data))
    assert len(streams) > 3 and b"Title & <x>" in text and b"\\(c\\)\\\\" in text and text.count(b"point") == 30


def test_documents_with_pictures(tmp_path):
    import base64

    from casefile.operators import jpeg

    small, tall = (jpeg.encoded(rng.integers(0, 256, shape)) for shape in ((40, 60, 3), (3000, 20, 3)))
    blocks = [("h1", "Head"), *(("image", base64.b64encode(x).decode()) for x in (small, tall)), ("image", "no picture"), ("image", base64.b64encode(b"GIF89a").decode()), ("paragraph", "end")]
    with zipfile.ZipFile(io.BytesIO(documents.docx(blocks))) as z:
        assert z.read("word/media/image1.jpg") == small and z.read("word/media/image2.jpg") == tall and len(z.namelist()) == 7
        text, links = z.read("word/document.xml").decode(), z.read("word/_rels/document.xml.rels").decode()
        assert text.count("<w:drawing>") == 2 and all(f'r:embed="i{n}"' in text and f'Id="i{n}"' in links for n in (1, 2)) and 'Extension="jpg"' in z.read("[Content_Types].xml").decode()
        import xml.etree.ElementTree as ET

        ET.fromstring(text)
        ET.fromstring(links)
    data = documents.pdf(blocks)
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert all(data[at:].startswith(b"%d 0 obj" % n) for n, at in enumerate(places, 1))
    for n, held in ((1, small), (2, tall)):
        number = int(re.search(rb"/I%d (\d+) 0 R" % n, data)[1])
        body = data[places[number - 1] :]
        assert b"/DCTDecode" in body[:200] and body[body.index(b"stream\n") + 7 :].startswith(held)
    drawn = b"".join(zlib.decompress(data[m.end() : m.end() + int(m[1])]) for m in re.finditer(rb"/Length (\d+) /Filter /FlateDecode >>\nstream\n", data))
    assert b"q 45.00 0 0 30.00 56 " in drawn and drawn.count(b" Do Q") == 2
    assert documents.picture(base64.b64encode(small).decode())[1:] == (60, 40) and documents.picture("") is None


def test_documents_of_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("one", "## Head\ntext **b**\n- x\n```\ncode\n```"), ("two", "| a |\n|---|\n| 1 |")], "id string, md string")
    blocks = documents.blocks_of(records.markdown_blocks(rows, "id", "md"), "id")
    for form, magic in (("docx", b"PK"), ("pdf", b"%PDF")):
        made = documents.rendered(blocks, "id", "blocks", form)
        file_writer.write_files(made, f"file://{tmp_path}/{form}")
        paths = sorted((tmp_path / form).glob("part-*/*"))
        assert [p.name for p in paths] == [f"one.{form}", f"two.{form}"] and all(p.read_bytes().startswith(magic) for p in paths)
    assert documents.rendered(blocks.limit(0), "id", "blocks", "pdf").count() == 0


def test_errors_that_pass():
    def error(text, **fields):
        e = RuntimeError(text)
        e.__dict__.update(fields)
        return e

    assert clients.passing(error("timeout")) and not clients.passing(error("Billing stopped"))
    for code, want in ((429, True), (500, True), (503, True), (400, False), (401, False), (422, False)):
        assert clients.passing(error("invalid_api_key", status_code=code)) is want or not want
        assert bool(clients.passing(error("x", http_status=code))) is want
    assert clients.passing(error("x", status_code=418)) and clients.passing(error("x", status_code="401"))
    assert list(clients.delays(clients.Retry(4, 2, 3, 30, False))) == [2, 6, 18, 30]
    assert all(1 <= d <= 3 for d in clients.delays(clients.Retry(1, 2, 2, 60)))


def test_kept_values():
    now, made, freed = [0.0], [], []
    kept = clients.Kept(60, lambda: now[0])
    make = lambda name: lambda: made.append(name) or name
    assert kept.get("a", make("a"), freed.append) == "a" and kept.get("a", make("a")) == "a" and made == ["a"]
    now[0] = 60
    kept.get("a", make("a"), freed.append)
    kept.get("b", make("b"), freed.append)
    assert made == ["a", "a", "b"] and kept.release() == ["a", "b"] and freed == ["a", "b"] and kept.release() == []


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    stream = files.landed(spark, f"file://{tmp_path}/in").select("name", F.length("content").alias("n"))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    (tmp_path / "in" / "b.png").write_bytes(b"22")
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.png", 1), ("b.png", 2)]
