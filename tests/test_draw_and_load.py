"""Drawing against plain loops, checkpoints of every odd kind, one evaluation of each pattern."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.functions.lexicon import CONTEXT_TAGS, DOCUMENT_TYPES, ENTITY_PATTERNS, THREATS
from casefile.operators import classify, consistency, drawing, entities, incremental, jpeg, recompression
from casefile.plans import postprocess
from casefile.sources import checkpoints

own = random.Random(21)


# --- drawing --------------------------------------------------------------------------------------


def test_boxes_pixel_by_pixel():
    for _ in range(30):
        h, w = own.randint(1, 30), own.randint(1, 30)
        x = np.random.default_rng(own.randint(0, 99)).integers(0, 256, (h, w, 3))
        boxes = [((own.randint(-5, 30), own.randint(-5, 30), own.randint(-5, 40), own.randint(-5, 40)), own.choice("abc")) for _ in range(3)]
        want, colors = x.astype(np.uint8).copy(), {}
        for (l, t, r, b), name in boxes:
            color = colors.setdefault(name, drawing.COLORS[len(colors)])
            for yy in range(h):
                for xx in range(w):
                    if t <= yy <= b and l <= xx <= r and min(yy - t, b - yy, xx - l, r - xx) < 3:
                        want[yy, xx] = color
        assert np.array_equal(drawing.boxed(x, boxes), want)
        (l, t, r, b), _ = boxes[0]
        part = [[x[yy, xx].tolist() for xx in range(w) if l - 10 <= xx < r + 10] for yy in range(h) if t - 10 <= yy < b + 10]
        assert drawing.cropped(x, boxes[0][0]).tolist() == part or not any(part) and drawing.cropped(x, boxes[0][0]).size == 0


def test_heat_and_overlay():
    x = np.array([[0, 51, 102], [153, 204, 255]], float)
    want = [[[0, 0, 255], [0, 102, 102], [51, 204, 0]], [[204, 204, 0], [255, 102, 0], [255, 0, 0]]]
    assert np.abs(drawing.heat_map(x).astype(int) - want).max() <= 1  # fractions are cut off
    assert drawing.heat_map(np.zeros((2, 2))).max() == 0
    assert drawing.blended(np.full((2, 2, 3), 10.0), np.full((1, 1, 3), 21), 0.5).tolist() == [[[15] * 3] * 2] * 2


# --- JPEG -----------------------------------------------------------------------------------------


def test_jpeg_files_are_what_the_kernel_says(spark, tmp_path):
    rng, sent = np.random.default_rng(1), {}
    for n, (h, w) in enumerate([(8, 8), (16, 16), (33, 47), (64, 100), (1, 1), (5, 3), (120, 90)]):
        y, x = np.mgrid[0:h, 0:w]
        kinds = {
            "flat": np.full((h, w, 3), [200, 30, 90.0]), "ramp": np.stack([x * 255 / max(1, w - 1), y * 255 / max(1, h - 1), (x + y) % 256], 2),
            "noise": rng.integers(0, 256, (h, w, 3)), "waves": np.clip(128 + 80 * np.sin(x / 9)[..., None] + rng.normal(0, 5, (h, w, 3)), 0, 255),
        }
        for kind, pixels in kinds.items():
            for quality in (50, 90):
                sent[f"{n}{kind}{quality}.jpg"] = pixels, quality
                (tmp_path / f"{n}{kind}{quality}.jpg").write_bytes(jpeg.encoded(pixels, quality))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == len(sent)
    for r in rows:
        pixels, quality = sent[r.origin.rsplit("/", 1)[1]]
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1].astype(int)
        gap = np.abs(got - recompression.recompressed(pixels, quality))
        assert got.shape == pixels.shape and gap.max() <= 3 and gap.mean() <= (0.2 if min(pixels.shape[:2]) >= 8 else 1), r.origin


def test_codes_have_at_most_sixteen_bits():
    counts = np.zeros(256, int)
    counts[:40] = [2**i for i in range(40)]  # as uneven as can be
    held, codes, sizes = jpeg._code(counts)
    assert sum(held[:16]) == 40 and sizes.max() <= 16
    texts = sorted(f"{codes[s]:0{sizes[s]}b}" for s in range(40))
    assert all(not b.startswith(a) for a, b in zip(texts, texts[1:], strict=False)) and "1" * max(map(len, texts)) not in texts and not any(set(t) == {"1"} for t in texts)
    assert jpeg._code(np.eye(1, 256, 7, dtype=int)[0])[2][7] == 1


# --- checkpoints ----------------------------------------------------------------------------------


def test_checkpoints(spark, tmp_path):
    at = str(tmp_path / "cp")
    none = checkpoints.load(spark, at)
    assert none.error is None and none.entries.count() == none.rejected.count() == 0 and none.header["version"] == 1
    (tmp_path / "cp" / "entries").mkdir(parents=True)
    lines = {
        '{"image_path":"a","status":"completed","success_count":2,"reports":["x"]}': None, '{"image_path":"e","reports":[],"status":null}': None, '{"image_path":"b","success_count":"2"}': "wrong kind: success_count",
        '{"image_path":': "not JSON", "[1]": "no object", '"s"': "no object", '{"status":"x"}': "missing: image_path", '{"image_path":null}': "missing: image_path", '{"image_path":"c","reports":"x"}': "wrong kind: reports",
        '{"image_path":"d","errors":[1]}': "wrong kind: errors", '{"image_path":"f","success_count":1.5}': "wrong kind: success_count", " ": None,
    }
    (tmp_path / "cp" / "entries" / "one.json").write_text("\n".join(lines))
    (tmp_path / "cp" / "entries" / "empty.json").write_text("")
    for text, error in (("[1]", "no JSON object"), ('{"a":', "delimiter"), ("", "Expecting")):
        (tmp_path / "cp" / "header.json").write_text(text)
        broken = checkpoints.load(spark, at)
        assert (error in broken.error or broken.error) and broken.entries.count() == 0
        assert incremental.reset_reason("s", "s", True, broken.error) == "load_error"
    (tmp_path / "cp" / "header.json").write_text(json.dumps({"created_at": "2020", "job_signature": "s"}))
    found = checkpoints.load(spark, at)
    assert found.error is None and found.header == {"version": 1, "job_signature": "s", "job_config": {}, "created_at": "2020", "updated_at": "2020"}
    assert {r.line: r.reason for r in found.rejected.collect()} == {k: v for k, v in lines.items() if v}
    got = {r.image_path: r for r in found.entries.collect()}
    assert set(got) == {"a", "e"} and (got["e"].status, got["e"].success_count, got["e"].reports, got["e"].updated_at) == ("", 0, [], "2020") and got["a"].reports == ["x"]


# --- one evaluation -------------------------------------------------------------------------------


def test_each_pattern_is_evaluated_once(spark):
    rows = spark.createDataFrame([(1, "a", "b", "")], "id long, o string, m string, x string").repartition(1)
    plan = postprocess.process(rows, "id", "o", "m", "x")._jdf.queryExecution().optimizedPlan().toString()
    # thirteen kinds in the first, the second and both texts, and words, numbers and keywords
    assert plan.count("regexp_extract_all(") <= 3 * len(ENTITY_PATTERNS) + 3


def test_one_scan_finds_every_keyword(spark):
    tables = {**DOCUMENT_TYPES, **THREATS, **CONTEXT_TAGS}
    words = sorted({w for ws in tables.values() for w in ws})
    texts = words + ["".join(own.choice(words) + own.choice(["", " ", "x"]) for _ in range(6)) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r for r in classify.classify(rows, "t").collect()}

    def best(labels, low, default):
        n, o, k = max((sum(w in low for w in ws), -i, k) for i, (k, ws) in enumerate(labels.items()))
        return (k if n else default), n

    for i, t in enumerate(texts):
        low = (t or "").lower()
        (kind, a), (threat, b) = best(DOCUMENT_TYPES, low, "indefinido"), best(THREATS, low, "nenhuma")
        tags = [k for k, ws in CONTEXT_TAGS.items() if any(w in low for w in ws)]
        assert (got[i].document_type, got[i].threat_type, got[i].context_tags) == (kind, threat, tags), t
        assert got[i].confidence == pytest.approx(min(1.0, (a + b + len(tags)) / 5))
    assert re.fullmatch(classify._branches(words), "boleto falso")


def test_values_are_those_of_the_entities(spark):
    t = "CPF 529.982.247-25, 11.222.333/0001-81, mail A@B.com, (11) 98765-4321, 10.0.0.1, abc1d23, ag 1234 conta 56789-0, www.x.y"
    rows = spark.createDataFrame([(t,), ("",), (None,), ("1" * 47,)], "t string")
    for r in rows.select(entities.entity_array(F.col("t")).alias("e"), entities.normalized_values(F.col("t")).alias("v")).collect():
        assert (r.e is None and r.v is None) or [e.normalized for e in r.e] == r.v
    odd = spark.createDataFrame([("", "x"), ("[x]", "y"), ("word", ""), ("word", None), (None, "x"), ("a 12", "b"), ("palavra palavra", "palavra")], "a string, b string")
    got = [(r.score, r.inconsistencies, r.verdict) for r in consistency.compare(odd, "a", "b").collect()]
    assert got == [(0.0, [], "nao_avaliado")] * 6 + [(1.0, [], "consistente")]
