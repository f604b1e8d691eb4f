"""Report records, Markdown blocks, template ids and EXIF from bytes."""

import struct

from pyspark.sql import functions as F

from casefile.operators import records
from casefile.sources import exif


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def jpeg_with(ifd0, gps=None):
    """A JPEG head with EXIF: text tags of the main directory, and degrees, minutes, seconds."""
    n = len(ifd0) + (1 if gps else 0)
    head, data = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", n), b""
    base = 8 + 2 + 12 * n + 4
    for tag, value in sorted(ifd0.items()):
        raw = value.encode() + b"\0"
        raw += b"\0" * (-len(raw) % 2 + (0 if len(raw) > 4 else 6 - len(raw)))
        head += struct.pack(">HHII", tag, 2, len(raw), base + len(data))
        data += raw
    if gps:
        head += struct.pack(">HHII", 0x8825, 4, 1, base + len(data))
        at = base + len(data)
        sub, rest, far = struct.pack(">H", 4), b"", at + 2 + 48 + 4
        for tag, value in sorted(gps.items()):
            if isinstance(value, str):
                sub += struct.pack(">HHI4s", tag, 2, 2, value.encode() + b"\0\0\0")
            else:
                sub += struct.pack(">HHII", tag, 5, 3, far + len(rest))
                rest += b"".join(struct.pack(">II", v, 1) for v in value)
        data += sub + b"\0" * 4 + rest
    body = b"Exif\0\0" + head + b"\0" * 4 + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_exif(spark):
    raw = jpeg_with({0x010F: "Canon", 0x0110: "EOS R5", 0x0131: "Adobe Photoshop 25.0"}, {1: "S", 2: (23, 33, 0), 3: "W", 4: (46, 38, 0)})
    tags = exif.parse_exif(raw)
    assert (tags["Make"], tags["Model"], tags["Software"], tags["GPS_Lat"], tags["GPS_Lon"]) == ("Canon", "EOS R5", "Adobe Photoshop 25.0", "-23.550000", "-46.633333")
    assert exif.parse_exif(b"") == {} == exif.parse_exif(b"\xff\xd8\xff\xe1\x00\x08Exif\0\0MM") and exif.parse_exif(raw[:60]) is not None
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, content binary")
    assert {r.id: len(r.exif) for r in exif.exif_tags(df).collect()} == {1: 9, 2: 0}


def test_blocks(spark):
    t = "## Title\ntext one\ntext two\n\nmore\n- a\n* b\n| x | y |\n|---|:-:|\n| 1 | 2 |\n```\n## no\n\ncode\n```\n### Sub\nend"
    got = [(r.kind, r.content) for r in records.markdown_blocks(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("block").collect()]
    assert got == [("h2", "Title"), ("paragraph", "text one text two"), ("paragraph", "more"), ("bullet", "a"), ("bullet", "b"), ("table", "| x | y |\n| 1 | 2 |"), ("code", "## no\n\ncode"), ("h3", "Sub"), ("paragraph", "end")]


def test_template_ids(spark):
    new = spark.createDataFrame([(1, "My Prompt"), (2, "my prompt"), (3, "Other"), (4, "A very long name of a prompt")], "o int, name string")
    taken = spark.createDataFrame([("my_prompt",), ("my_prompt_2",), ("x",)], "id string")
    got = {r.o: r.id for r in records.template_ids(new, "name", taken, order="o").collect()}
    assert got == {1: "my_prompt_1", 2: "my_prompt_3", 3: "other", 4: "a_very_long_name_of_"}


def test_texts(spark):
    gps = F.struct(F.lit(-23.55).alias("lat"), F.lit(-46.6333333).alias("lon"))
    q = one(spark, records.quality_text(F.lit(True), F.lit(150.0), F.lit(0.5), F.lit(0.5), F.lit(0.05), F.array(F.lit("a"), F.lit("b")), F.lit(0), F.array(F.lit("#fff")), gps))
    assert q.split("\n")[:6] == ["Nitidez: Borrada", "Iluminação: Equilibrada", "Avisos: a, b", "Cores dominantes: #fff", "Score de qualidade (0-100): 58", "GPS: -23.550000, -46.633333"]
    assert one(spark, records.detections_text(F.array(F.struct(F.lit("car").alias("name"), F.lit(2).alias("n"))))) == "Objetos detectados pela máquina:\n- 2x car"
    t = F.lit("DADOS FORENSES AUTOMATIZADOS\n Veredicto ELA: x y\nVeredicto EXIF: z\nCopy-Move: w")
    assert one(spark, records.forensic_fields(t)) == {"ela_verdict": "x y", "exif_verdict": "z", "clone_verdict": "w"}
    assert one(spark, records.forensic_fields(F.lit("Veredicto ELA: x"))) == {}
    assert one(spark, records.forensic_context({"A": F.lit("x"), "B": F.lit("")}, records.provenance(F.lit(900), F.lit(600), F.lit(True)))) == "### A (origem: arquivo original, 900x600)\nx"
    assert one(spark, records.exif_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "- a: 1\n- b: 2"
    assert one(spark, records.first_available([("a", F.lit(False)), ("b", F.lit(True))])) == "b" and one(spark, records.model_type(F.lit("gpt-9"), "m")) == "openai"


def test_summary_entries(spark):
    images = spark.createDataFrame([(1, "GPS: 1, 2\nScore de qualidade: 70"), (2, "")], "id int, q string")
    analyses = spark.createDataFrame([(1, 0, False, "x"), (1, 1, True, "y"), (1, 2, True, "z"), (2, 0, False, "w")], "id int, o int, ok boolean, c string")
    got = {r.id: (r.success, r.c, r.gps_lat, r.quality_score) for r in records.summary_entries(images, analyses, "id", "o", "ok", "c", "q").collect()}
    assert got == {1: (True, "y", 1.0, 70.0), 2: (False, None, None, None)}
    assert records.report_rows(images.withColumn("raw", F.lit(b"x")), analyses, "id").columns == ["id", "q", "o", "ok", "c"]
