"""Literal cases with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casefile.functions import checks, numeric, text
from casefile.operators import classify, consistency, entities, exif_rules, timeline


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first()[0]


def found(spark, t, kind=None):
    df = spark.createDataFrame([(1, t)], "id int, t string")
    return [(r.type, r.value, r.normalized, r.valid) for r in entities.extract(df, "id", "t", [kind] if kind else None).orderBy("seq").collect()]


@pytest.mark.parametrize("kind,t,want", [
    ("cpf", "x 111.444.777-35 y", [("111.444.777-35", True)]),
    ("cpf", "111.111.111-11", [("111.111.111-11", False)]),
    ("cnpj", "11.222.333/0001-81", [("11.222.333/0001-81", True)]),
    ("phone", "11144477735", [("1144477735", True)]),
    ("ipv4", "a 10.0.0.256 b 10.1.2.3", [("10.1.2.3", True)]),
    ("ipv6", "fe80::1", [("fe80::", True)]),
    ("ipv6", "::1", []),
    ("boleto", "1" * 47, [("1" * 47, True)]),
    ("plate", "abc1d23 XYZ-1234", [("ABC1D23", True), ("XYZ1234", True)]),
    ("pix_key", "A" * 32, [("a" * 32, True)]),
    ("bank_account", "Ag: 1234-5 Conta: 56789-0", [("1234-5-56789-0", True)]),
    ("bank_account", "Ag 1234 conta corrente 12345-6", []),
    ("rg", "12.345.678-9", [("123456789", True)]),
    ("url", "see https://a.b/c?d) and www.x.y", [("https://a.b/c?d", True), ("www.x.y", True)]),
    ("email", "A.B@C.com", [("a.b@c.com", True)]),
])
def test_entities(spark, kind, t, want):
    assert [(n, v) for _, _, n, v in found(spark, t, kind)] == want


def test_context_and_order(spark):
    t = "é" * 40 + " a@b.co " + "ü" * 40 + " 10.0.0.1"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string")
    rows = entities.extract(df, "id", "t").collect()
    mail = next(r for r in rows if r.type == "email")
    assert mail.start == 41 and mail.context == t[11:77] and {r.id for r in rows} == {1}


def test_offsets_match_python(spark):
    import re

    t = "12 345 aé6 7" * 50
    got = one(spark, text.matches(F.col("t"), r"\d+"), t=t)
    assert [(r.start, r.value) for r in got] == [(m.start(), m[0]) for m in re.finditer(r"\d+", t)]


@pytest.mark.parametrize("t,want", [
    ("", ""), ("[Erro x] \x01", "[Erro x] \x01"), ("Ã£ Ã© Ã", "ã é à"), ("a\xa0​b", "a b"), ("é", "é"), ("a|||b-----c=====d~~~", "ab---c===d"),
    ("a\n***\n--\nb", "a\n--\nb"), ("a\n\n\n\nb \t c", "a\nb c"),
])
def test_normalized(spark, t, want):
    assert one(spark, text.normalized(F.col("t")), t=t) == want


@pytest.mark.parametrize("t,want", [("<think>a\nb</think> c ", "c"), ("<think>a</think>", ""), ("plain", "plain"), ("<think>open", "<think>open")])
def test_think(spark, t, want):
    assert one(spark, text.think_stripped(F.col("t")), t=t) == want


def test_filename(spark):
    assert one(spark, text.sanitized_filename(F.col("t")), t="relatorio<forense>:ocr?.jpg") == "relatorio_forense__ocr_.jpg"
    assert one(spark, text.sanitized_filename(F.col("t")), t="a" * 300 + ".png") == "a" * 195 + ".png"


def test_fields(spark):
    assert one(spark, text.gps_field(F.col("t")), t="x\n GPS: -23.5, -46.6\nGPS: 1, 2")[:] == (-23.5, -46.6)
    assert one(spark, text.gps_field(F.col("t")), t="GPS: none\nGPS: 1, 2") is None
    assert one(spark, text.quality_field(F.col("t")), t="a\nScore de qualidade (x): y: 81.5 ") == 81.5


@pytest.mark.parametrize("t,want", [
    ("nada", ("indefinido", "nenhuma", [], 0.0)),
    ("cnh contrato", ("cnh", "nenhuma", [], 0.2)),
    ("cpf cnpj empresa pix bitcoin placa carro", ("cnpj", "fraude_financeira", ["financeiro", "veicular", "comercial"], 1.0)),
])
def test_classification(spark, t, want):
    c = one(spark, classify.classification(F.col("t")), t=t)
    assert (c.document_type, c.threat_type, c.context_tags, round(c.confidence, 6)) == want


@pytest.mark.parametrize("a,b,want", [
    ("", "x", "nao_avaliado"), ("[Erro]", "x", "nao_avaliado"), ("a de um", "x", "nao_avaliado"), ("palavra", "", "nao_avaliado"),
    ("palavra outra", "palavra outra", "consistente"), ("palavra outra 123 4567", "palavra outra", "parcialmente_consistente"), ("maçã casa", "maçã", "parcialmente_consistente"), ("maçã", "nada", "inconsistente"),
])
def test_consistency(spark, a, b, want):
    assert one(spark, consistency.consistency(F.col("a"), F.col("b")), a=a, b=b).verdict == want


def test_timeline(spark):
    df = spark.createDataFrame([(1, "2024-01-15 14:30:00 then 15/01/2023 10:00 then 25:99 and Jan 5, 2024"), (2, None)], "id int, t string")
    rows = timeline.extract(df, "id", "t").collect()
    by = {r.timestamp: r.parsed for r in rows}
    assert by["2024-01-15 14:30:00"] == dt.datetime(2024, 1, 15, 14, 30) and by["15/01/2023 10:00"] == dt.datetime(2023, 1, 15, 10)
    assert by["14:30:00"] is None and by["Jan 5, 2024"] is None and by["25:99"] is None
    merged = timeline.merged(df.withColumn("o", F.col("t")), "id", "o", "t").orderBy("pos").collect()
    assert [r.timestamp for r in merged][:2] == ["15/01/2023 10:00", "2024-01-15 14:30:00"]
    assert sum(r.timestamp == "2024-01-15 14:30:00" for r in merged) == 2


def test_numbers(spark):
    assert one(spark, numeric.hamming(F.col("a"), F.col("b")), a=-1, b=0) == 64
    assert one(spark, numeric.hamming(F.col("a"), F.col("b").cast("long")), a=1, b=None) == 64
    assert one(spark, numeric.decimal_degrees(F.col("a"), F.lit(33.0), F.lit(0.0), F.lit("S")), a=23.0) == -23.55
    tiers = [one(spark, numeric.memory_tier(F.col("g")), g=g) for g in (3.4, 3.5, 5.5, 7.5, 12.0, 20.0, 28.0)]
    assert tiers == ["", "4gb", "6gb", "8gb", "16gb", "24gb", "32gb"]
    assert [one(spark, numeric.chi_p_value(F.col("c")), c=c) for c in (20.0, 16.27, 7.815, 7.0, 1.0)] == [0.001, 0.01, 0.10, 0.10, 0.5]
    names = [one(spark, text.short_model_name(F.col("n"), {}), n=n) for n in ("qwen3.5:2b", "x")]
    assert names == ["qwen35", "x"]


@pytest.mark.parametrize("status,message,want", [(429, "", True), (503, "", True), (401, "", False), (400, "", False), (None, "Error 401 - Incorrect API key", False), (None, "timeout", True)])
def test_transient(spark, status, message, want):
    assert one(spark, checks.transient(F.col("s").cast("int"), F.col("m")), s=status, m=message) == want


@pytest.mark.parametrize("tags,kinds,verdict", [
    (None, ["no_exif"], "stripado"), ({"Software": "Adobe Photoshop", "Make": "Canon"}, ["editing_software"], "suspeito"), ({"Software": "WhatsApp"}, ["editing_software"], "inconclusivo"),
    ({"Make": "C", "DateTime": "2024:01:15 11:00:00", "DateTimeOriginal": "2024:01:15 10:00:00"}, [], "consistente"),
    ({"Make": "C", "DateTime": "2024:01:15 11:00:01", "DateTimeOriginal": "2024:01:15 10:00:00"}, ["timestamp_mismatch"], "inconclusivo"),
    ({"Make": "C", "DateTime": "2031:01:15 11:00:01"}, ["future_timestamp"], "suspeito"), ({"GPSInfo": "x", "Software": "z"}, ["gps_no_camera"], "inconclusivo"),
    ({"Make": "C", "Orientation": "6"}, ["orientation_flag"], "consistente"), ({"Flash": "1"}, ["missing_basic_fields"], "inconclusivo"),
])
def test_exif(spark, tags, kinds, verdict):
    df = spark.createDataFrame([(tags,)], "exif map<string,string>")
    r = exif_rules.judge(df, "exif", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).first()
    assert ([a.type for a in r.anomalies], r.exif_verdict) == (kinds, verdict)
