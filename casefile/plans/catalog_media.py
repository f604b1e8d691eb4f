"""Registered queries of predicates, model lists, roll-ups and summary texts; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import checks
from casefile.operators import incremental, records, rollup, similarity, summaries
from casefile.operators.numbering import numbered, spread
from casefile.plans.catalog import _SQL_CLASSES, _files, query, table
from casefile.sinks import documents
from casefile.sources.exif import quality_tags


@query("""
SELECT p_partkey, p_type NOT IN ('documentos', 'screenshots') AND CASE p_size % 3 WHEN 0 THEN 'documentos' WHEN 1 THEN 'geral' ELSE 'screenshots' END NOT IN ('documentos', 'screenshots') AS detects,
  (p_size % 2 = 0)::INT + (p_size % 5 = 0)::INT AS n_cars, 1 + (p_size % 2 = 0)::INT AS n_listed FROM part
""")
def detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    mode = F.when(n % 3 == 0, "documentos").when(n % 3 == 1, "geral").otherwise("screenshots")
    found = F.array(*(F.struct(c.alias("class_name")) for c in (F.when(n % 2 == 0, "CAR").otherwise("bus"), F.when(n % 5 == 0, "car").otherwise("dog"), F.lit("Person"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", checks.detects_objects(mode).alias("detects"), F.size(checks.of_class(found, "Car")).alias("n_cars"),
        (F.size(checks.of_classes(found, ["person", "car"])) - (n % 5 == 0).cast("int")).alias("n_listed"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#1'")
def prompts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_category(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category"), "Brand#1").select("p_partkey", "p_name")


@query("SELECT DISTINCT p_brand AS category FROM part")
def prompt_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.categories(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category"))


@query("""
WITH m AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN ':' || p_size ELSE '' END AS model FROM part WHERE p_partkey % 3 = 0),
w AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 3 = 0 THEN ':' || p_size ELSE '' END AS model FROM part)
SELECT model, model IN (SELECT model FROM m) OR (NOT contains(model, ':') AND model IN (SELECT split_part(model, ':', 1) FROM m)) AS installed FROM w
""")
def installed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("p_size"), table(spark, sf_dir, "part")
    name = lambda k: F.concat("p_brand", F.when(n % k == 0, F.concat(F.lit(":"), n.cast("string"))).otherwise("")).alias("model")
    return records.installed(part.select(name(3)).distinct(), part.filter("p_partkey % 3 = 0").select(name(2)).distinct())


@query("SELECT model, source, count(*) AS n FROM (SELECT r_name AS model, 'api' AS source FROM region UNION ALL SELECT n_name, 'tier' FROM nation UNION ALL SELECT n_name, 'vision' FROM nation WHERE n_nationkey < 9 UNION ALL SELECT r_name, 'custom' FROM region) GROUP BY ALL")
def model_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("model"))
    few = table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.col("n_name").alias("model"))
    chosen = records.model_choices(names("region", "r_name"), names("nation", "n_name"), few, names("region", "r_name").unionByName(spark.createDataFrame([("",)], "model string")))
    return chosen.groupBy("model", "source").agg(F.count("*").alias("n"))


@query(f"WITH c AS MATERIALIZED {_SQL_CLASSES} SELECT (SELECT count(*) FROM c WHERE n > 1) AS exact, (SELECT count(*) FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.p, b.p)) <= 8 AND bit_count(xor(a.d, b.d)) <= 8) AS near")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = similarity.image_classes(_files(spark, sf_dir), "id", "p", "d", "m")
    return rollup.duplicate_counts(similarity.image_duplicates(classes))


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS hits, count(*) AS total FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l USING (doc_id)")
def cache_hit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return rollup.cache_hits(incremental.cached_lookup(docs, cache, ["doc_id"], F.col("toxic") == 0))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 7 + o_custkey % 5 END::BIGINT AS total FROM orders")
def map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    counts = F.when(k % 4 != 0, F.create_map(F.lit("cpf"), k % 7, F.lit("email"), c % 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", rollup.map_total(counts).alias("total"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events")
def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], "place", 1).drop("ts")


@query("""
SELECT p_partkey,
  'Veredicto ELA: x' || chr(10) || printf('Erro máximo: %.1f/255', n) || chr(10) || printf('Erro médio: %.2f/255', n / 7) || chr(10) || printf('Desvio padrão: %.2f', n / 17) || chr(10) || printf('Pixels suspeitos: %.2f%%', n / 37) || chr(10)
    || 'Hotspots detectados: ' || p_size || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Observação: par' ELSE '' END AS ela,
  CASE WHEN k = 0 THEN 'JPEG Ghost: v — nenhuma região fantasma detectada.' ELSE 'JPEG Ghost: v' || chr(10) || 'Regiões suspeitas: ' || k || chr(10) || 'Níveis de qualidade testados: [90, 75]' || chr(10)
    || array_to_string(list_transform(range(0, least(k, 5)), lambda i: printf('  Região %d: Q90 em (%d, 0, %d, 32) (diff: %.2f)', i + 1, i, i + 32, n / 3)), chr(10)) END AS ghost,
  CASE WHEN k = 0 THEN 'Copy-Move: Nenhuma região clonada detectada.' ELSE printf('Copy-Move: %d região(ões) suspeita(s) detectada(s).', k) || chr(10) || 'Veredicto: v' || chr(10) || 'Pares analisados: ' || p_size || chr(10)
    || array_to_string(list_transform(range(0, least(k, 5)), lambda i: printf('  Região %d: similaridade 95.00%% entre (%d, 1, %d, 17) e (40, 50, 56, 66)', i + 1, i, i + 16)), chr(10)) || CASE WHEN k > 5 THEN printf(chr(10) || '  ... e mais %d região(ões).', k - 5) ELSE '' END END AS clone,
  'Esteganografia LSB: v' || chr(10) || printf('Entropia LSB: %.4f (esperado: 1.0000)', n / 61) || chr(10) || printf('Chi-square: %.2f (p=%.4f)', n, 0.05) || chr(10) || printf('  Canal R: %.4f', n / 61) AS stego,
  'Análise de Sombras: v' || chr(10) || printf('Direção de luz estimada: %.1f°', n) || chr(10) || 'Regiões de sombra: ' || p_size || chr(10) || printf('Score de inconsistência: %.2f', n / 61) || chr(10) || 'd' AS shadow,
  CASE WHEN k = 0 THEN printf('Duplicatas: Nenhuma duplicata detectada em %d imagem(ns).', p_size) ELSE printf('Duplicatas: %d exata(s), %d near-duplicate(s) em %d imagem(ns).', 1, k - 1, p_size) || chr(10)
    || array_to_string(list_transform(range(0, least(k, 10)), lambda i: printf('  [%s] a%d ↔ b (sim: 97.5%%, pHash dist: %d)', CASE WHEN i = 0 THEN 'EXATA' ELSE 'NEAR' END, i, i)), chr(10)) || CASE WHEN k > 10 THEN printf(chr(10) || '  ... e mais %d par(es).', k - 10) ELSE '' END END AS dups,
  CASE WHEN p_size % 4 = 0 THEN 'EXIF ausente — metadados podem ter sido removidos.' ELSE 'Veredicto EXIF: v' || chr(10) || CASE WHEN p_size % 3 > 0 THEN 'Câmera: ' || p_brand || chr(10) ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'GPS: presente' || chr(10) ELSE '' END
    || 'Anomalias: 1 críticas, 1 avisos' || chr(10) || '  🚨 [a] x' || chr(10) || '  ⚠️ [b] y' || chr(10) || '  ℹ️ [c] z' END AS exif
FROM (SELECT *, p_size::DOUBLE AS n, (p_size % 13)::INT AS k FROM part)
""")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey", each=10_000), F.col("p_size").cast("double")
    k, none, v = (F.col("p_size") % 13).cast("int"), F.lit(""), F.lit("v")
    upto = lambda row: F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), row)).otherwise(F.filter(F.transform(F.array(F.lit(0)), row), lambda _: F.lit(False)))
    ghost = upto(lambda i: F.struct(i.alias("x"), F.lit(0).alias("y"), F.lit(90).alias("quality"), (n / 3).alias("gap")))
    pair = upto(lambda i: F.struct(i.alias("ax"), F.lit(1).alias("ay"), F.lit(40).alias("bx"), F.lit(50).alias("by"), F.lit(0.95).alias("similarity")))
    dup = upto(lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("a"), F.lit("b").alias("b"), (i == 0).alias("same_md5"), F.lit(0.975).alias("similarity"), i.alias("ph_distance")))
    odd = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(d).alias("description")) for t, s, d in (("a", "critical", "x"), ("b", "warning", "y"), ("c", "other", "z"))))
    make = F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))
    return p.select(
        "p_partkey", summaries.error_levels(F.lit("x"), n, n / 7, n / 17, n / 37, F.col("p_size"), F.when(n % 2 == 0, "par")).alias("ela"), summaries.ghosts(v, ghost, [90, 75], none).alias("ghost"),
        summaries.copies(v, pair, F.col("p_size")).alias("clone"), summaries.hidden_data(v, n / 61, n, F.lit(0.05), {"R": n / 61}, none).alias("stego"), summaries.shadows(v, n, F.col("p_size"), n / 61, F.lit("d")).alias("shadow"),
        summaries.duplicates(dup, F.lit(1), k - 1, F.col("p_size")).alias("dups"), summaries.exif(F.col("p_size") % 4 != 0, v, make, none, none, n % 2 == 0, none, odd).alias("exif"),
    )


@query("""
SELECT p_partkey, '---' || chr(10) || chr(10) || '## 🔧 Pós-Processamento Automático' || chr(10) || chr(10)
  || CASE WHEN p_size % 2 = 0 THEN '## 📌 Entidades Extraídas' || chr(10) || chr(10) || '| Tipo | Valor | Válido |' || chr(10) || '|------|-------|--------|' || chr(10) || '| 🪪 CPF | `' || p_partkey || '` | ' || CASE WHEN p_size % 4 = 0 THEN '✅' ELSE '❌' END || ' |' || chr(10) || chr(10) ELSE '' END
  || '## 🏷️ Classificação Automática' || chr(10) || chr(10) || '- **Tipo de documento:** ' || p_type || chr(10) || '- **Tipo de ameaça:** nenhuma' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '- **Contexto:** a, b' || chr(10) ELSE '' END || '- **Confiança:** 50%' || chr(10)
  || CASE WHEN p_size % 5 > 0 THEN chr(10) || '## ✅ Validação OCR vs LLM' || chr(10) || chr(10) || '- **Veredicto:** ⚠️ Parcialmente Consistente' || chr(10) || '- **Score de consistência:** 25%' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '- **Inconsistências detectadas:**' || chr(10) || '  - ⚠️ ' || p_name || chr(10) ELSE '' END ELSE '' END
  || CASE WHEN p_size % 7 = 0 THEN chr(10) || '## 🕐 Linha do Tempo' || chr(10) || chr(10) || array_to_string(list_transform(range(0, 20), lambda i: '- **' || i || '** — seen'), chr(10)) || chr(10) ELSE '' END
  || CASE WHEN p_size % 9 > 0 THEN chr(10) || '### 📝 Texto Normalizado' || chr(10) || '```' || chr(10) || left(repeat(p_name || ' ', 200), 2000) || chr(10) || '```' || chr(10) ELSE '' END AS section FROM part
""")
def post_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    empty = lambda a: F.filter(a, lambda _: F.lit(False))
    entity = F.array(F.struct(F.lit("cpf").alias("type"), F.col("p_partkey").cast("string").alias("normalized"), (n % 4 == 0).alias("valid")))
    kind = F.struct(F.col("p_type").alias("document_type"), F.lit("nenhuma").alias("threat_type"), F.when(n % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("context_tags"), F.lit(0.5).alias("confidence"))
    odd = F.when(n % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    judged = F.struct(F.when(n % 5 > 0, "parcialmente_consistente").otherwise("nao_avaliado").alias("verdict"), F.lit(0.25).alias("score"), odd.alias("inconsistencies"))
    events = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.struct(i.cast("string").alias("timestamp"), F.lit("seen").alias("description")))
    body = summaries.post_processing(F.when(n % 2 == 0, entity).otherwise(empty(entity)), kind, judged, F.when(n % 7 == 0, events).otherwise(empty(events)))
    text = F.repeat(F.concat("p_name", F.lit(" ")), F.lit(200))
    return table(spark, sf_dir, "part").select("p_partkey", summaries.report_section(body, text, F.when(n % 9 == 0, text).otherwise("")).alias("section"))


@query("""
SELECT c_custkey, array_to_string(list_sort(list_concat(['Make=' || c_name, 'Software=x'], CASE WHEN c_custkey % 2 = 0 THEN ['GPS_Coordinates=' || a || ', ' || b, 'GPS_Lat=' || a, 'GPS_Lon=' || b, 'Google_Maps=https://www.google.com/maps?q=' || a || ',' || b,
  'OpenStreetMap=https://www.openstreetmap.org/?mlat=' || a || '&mlon=' || b || '#map=17/' || a || '/' || b] ELSE [] END)), ';') AS tags FROM (SELECT *, printf('%.6f', (c_custkey % 90)::DOUBLE) AS a, printf('%.6f', -(c_custkey % 180)::DOUBLE - 0.25) AS b FROM customer)
""")
def exif_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plain = F.create_map(F.lit("Make"), F.col("c_name"), F.lit("Software"), F.lit("x"), F.lit("ImageDescription"), F.lit("hidden"))
    placed = F.map_concat(plain, F.create_map(F.lit("GPS_Lat"), (k % 90).cast("double").cast("string"), F.lit("GPS_Lon"), (-(k % 180) - F.lit(0.25)).cast("double").cast("string")))
    shown = quality_tags(F.when(k % 2 == 0, placed).otherwise(plain))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("tags"))


@query("""
WITH r AS (SELECT c_name, c_nationkey, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT 0 AS part, 0::BIGINT AS pos, '<!DOCTYPE html><html lang="pt-BR"><head><meta charset="UTF-8"><title>Relatório Consolidado - ' || count(*) || ' análises</title></head><body><h1>Relatório Consolidado</h1><ul>' AS html FROM r
UNION ALL SELECT 1, pos, '<li><a href="#report_' || pos || '">' || c_name || ' (m&amp;)</a></li>' FROM r UNION ALL SELECT 2, 0, '</ul>'
UNION ALL SELECT 3, pos, '<div id="report_' || pos || '" class="report"><h2>' || c_name || '</h2><p>m&amp; geral ' || printf('%.2f', c_nationkey::DOUBLE) || ' s</p><details><summary>OCR (' || length(repeat(c_name, 100)) || ')</summary><pre>' || left(repeat(c_name, 100), 500) || '...</pre></details><div>a<br>b</div></div>' FROM r
UNION ALL SELECT 4, 0, '</body></html>'
""")
def report_consolidated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("m&").alias("model"), F.lit("geral").alias("mode"), F.col("c_nationkey").alias("s"), F.repeat("c_name", F.lit(100)).alias("ocr"), F.lit("a\nb").alias("analysis"))
    return documents.consolidated_html(rows, "c_custkey", "c_name", "model", "mode", "s", "ocr", "analysis")


@query("""
SELECT 0 AS part, 0::BIGINT AS pos, '{"metadata":{"total_reports":' || count(*) || '},"reports":[' AS json FROM customer
UNION ALL SELECT 1, p, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","none":null}' || CASE WHEN p + 1 < (SELECT count(*) FROM customer) THEN ',' ELSE '' END FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer)
UNION ALL SELECT 2, 0, ']}'
""")
def report_consolidated_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.consolidated_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("none")), "c_custkey")
