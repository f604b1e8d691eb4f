"""Texts that sum up what was measured, for prompts and reports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How many regions, pairs, inconsistencies and events are listed, and characters of text shown.
REGIONS, PAIRS, ODD, EVENTS, TEXT = 5, 10, 5, 20, 2000
# Marks of severities, kinds of entities and verdicts.
SEVERITY = {"critical": "🚨", "warning": "⚠️", "info": "ℹ️"}
KINDS = {"cpf": "🪪", "cnpj": "🏢", "rg": "🪪", "phone": "📞", "email": "📧", "ipv4": "🌐", "ipv6": "🌐", "url": "🔗", "plate": "🚗", "pix_key": "🔑", "boleto": "🧾", "bitcoin": "₿", "bank_account": "🏦"}
VERDICTS = {"consistente": "✅", "parcialmente_consistente": "⚠️", "inconsistente": "❌"}


def _lines(*parts: Column) -> Column:
    """The lines that are there; arrays add a line an element."""
    return F.array_join(F.array_compact(F.concat(*parts)), "\n")


def _one(c: Column) -> Column:
    return F.array(c)


def _looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def _detail(detail: Column, prefix: str = "") -> Column:
    return _one(F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(prefix), detail)))



def error_levels(verdict: Column, most: Column, mean: Column, std: Column, percent: Column, hotspots: Column, detail: Column) -> Column:
    shown = F.format_string
    return _lines(
        _one(F.concat(F.lit("Veredicto ELA: "), verdict)), _one(shown("Erro máximo: %.1f/255", most)), _one(shown("Erro médio: %.2f/255", mean)), _one(shown("Desvio padrão: %.2f", std)),
        _one(shown("Pixels suspeitos: %.2f%%", percent)), _one(F.concat(F.lit("Hotspots detectados: "), hotspots.cast("string"))), _detail(detail, "Observação: "),
    )


def ghosts(verdict: Column, regions: Column, qualities: list[int], detail: Column, block: int = 32) -> Column:
    """``regions``: array of (x, y, quality, gap)."""
    def row(g: Column, i: Column) -> Column:
        box = F.concat(F.lit("("), F.concat_ws(", ", g["x"], g["y"], g["x"] + block, g["y"] + block), F.lit(")"))
        return F.format_string("  Região %d: Q%d em %s (diff: %.2f)", i + 1, g["quality"], box, g["gap"])

    none = F.concat(F.lit("JPEG Ghost: "), verdict, F.lit(" — nenhuma região fantasma detectada."))
    some = _lines(
        _one(F.concat(F.lit("JPEG Ghost: "), verdict)), _one(F.concat(F.lit("Regiões suspeitas: "), F.size(regions).cast("string"))),
        _one(F.lit("Níveis de qualidade testados: [" + ", ".join(map(str, qualities)) + "]")), F.transform(F.slice(regions, 1, REGIONS), row), _detail(detail),
    )
    return F.when(F.size(regions) > 0, some).otherwise(none)


def copies(verdict: Column, pairs: Column, analyzed: Column, block: int = 16) -> Column:
    """``pairs``: array of (ax, ay, bx, by, similarity)."""
    box = lambda p, a: F.concat(F.lit("("), F.concat_ws(", ", p[a + "x"], p[a + "y"], p[a + "x"] + block, p[a + "y"] + block), F.lit(")"))
    row = lambda p, i: F.format_string("  Região %d: similaridade %.2f%% entre %s e %s", i + 1, p["similarity"] * 100, box(p, "a"), box(p, "b"))
    more = F.size(pairs) - REGIONS
    some = _lines(
        _one(F.format_string("Copy-Move: %d região(ões) suspeita(s) detectada(s).", F.size(pairs))), _one(F.concat(F.lit("Veredicto: "), verdict)),
        _one(F.concat(F.lit("Pares analisados: "), analyzed.cast("string"))), F.transform(F.slice(pairs, 1, REGIONS), row), _one(F.when(more > 0, F.format_string("  ... e mais %d região(ões).", more))),
    )
    return F.when(F.size(pairs) > 0, some).otherwise("Copy-Move: Nenhuma região clonada detectada.")


def hidden_data(verdict: Column, entropy: Column, chi: Column, p: Column, channels: dict[str, Column], detail: Column) -> Column:
    return _lines(
        _one(F.concat(F.lit("Esteganografia LSB: "), verdict)), _one(F.format_string("Entropia LSB: %.4f (esperado: 1.0000)", entropy)), _one(F.format_string("Chi-square: %.2f (p=%.4f)", chi, p)),
        *(_one(F.format_string(f"  Canal {name}: %.4f", e)) for name, e in channels.items()), _detail(detail),
    )


def shadows(verdict: Column, direction: Column, regions: Column, score: Column, detail: Column) -> Column:
    return _lines(
        _one(F.concat(F.lit("Análise de Sombras: "), verdict)), _one(F.format_string("Direção de luz estimada: %.1f°", direction)), _one(F.concat(F.lit("Regiões de sombra: "), regions.cast("string"))),
        _one(F.format_string("Score de inconsistência: %.2f", score)), _detail(detail),
    )


def exif(present: Column, verdict: Column, make: Column, model: Column, software: Column, gps: Column, taken: Column, anomalies: Column) -> Column:
    """``anomalies``: array of (type, severity, description)."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda s: F.size(F.filter(anomalies, lambda a: a["severity"] == s))
    row = lambda a: F.concat(F.lit("  "), _looked_up(SEVERITY, a["severity"], SEVERITY["info"]), F.lit(" ["), a["type"], F.lit("] "), a["description"])
    some = _lines(
        _one(F.concat(F.lit("Veredicto EXIF: "), verdict)), _one(F.when(given(make) | given(model), F.trim(F.concat(F.lit("Câmera: "), text(make), F.lit(" "), text(model))))),
        _one(F.when(given(software), F.concat(F.lit("Software: "), software))), _one(F.when(gps, "GPS: presente")), _one(F.when(given(taken), F.concat(F.lit("Data original: "), taken))),
        _one(F.when(F.size(anomalies) > 0, F.format_string("Anomalias: %d críticas, %d avisos", number("critical"), number("warning")))), F.transform(anomalies, row),
    )
    return F.when(present, some).otherwise("EXIF ausente — metadados podem ter sido removidos.")


def duplicates(pairs: Column, exact: Column, near: Column, images: Column) -> Column:
    """``pairs``: array of (a, b, same_md5, similarity, ph_distance) in the order to show; a and b are names."""
    row = lambda p: F.format_string("  [%s] %s ↔ %s (sim: %.1f%%, pHash dist: %d)", F.when(p["same_md5"], "EXATA").otherwise("NEAR"), p["a"], p["b"], p["similarity"] * 100, p["ph_distance"])
    more = F.size(pairs) - PAIRS
    some = _lines(
        _one(F.format_string("Duplicatas: %d exata(s), %d near-duplicate(s) em %d imagem(ns).", exact, near, images)), F.transform(F.slice(pairs, 1, PAIRS), row),
        _one(F.when(more > 0, F.format_string("  ... e mais %d par(es).", more))),
    )
    return F.when(F.size(pairs) > 0, some).otherwise(F.format_string("Duplicatas: Nenhuma duplicata detectada em %d imagem(ns).", images))


def post_processing(entities: Column, classification: Column, validation: Column, events: Column) -> Column:
    """A section each for entities (array), classification (struct), validation (struct) and events (array of
    (timestamp, description)); what is empty, null or not judged has none."""
    none = F.array().cast("array<string>")
    entity = lambda e: F.concat(F.lit("| "), _looked_up(KINDS, e["type"], "📎"), F.lit(" "), F.upper(e["type"]), F.lit(" | `"), e["normalized"], F.lit("` | "), F.when(e["valid"], "✅").otherwise("❌"), F.lit(" |"))
    found = F.when(F.size(entities) > 0, F.concat(F.array(*map(F.lit, ("## 📌 Entidades Extraídas", "", "| Tipo | Valor | Válido |", "|------|-------|--------|"))), F.transform(entities, entity), _one(F.lit("")))).otherwise(none)
    tags = classification["context_tags"]
    kind = F.when(classification.isNotNull(), F.array_compact(F.array(
        F.lit("## 🏷️ Classificação Automática"), F.lit(""), F.concat(F.lit("- **Tipo de documento:** "), classification["document_type"]), F.concat(F.lit("- **Tipo de ameaça:** "), classification["threat_type"]),
        F.when(F.size(tags) > 0, F.concat(F.lit("- **Contexto:** "), F.array_join(tags, ", "))), F.format_string("- **Confiança:** %.0f%%", classification["confidence"] * 100), F.lit(""),
    ))).otherwise(none)
    verdict, odd = validation["verdict"], validation["inconsistencies"]
    judged = F.when(validation.isNotNull() & (verdict != "nao_avaliado"), F.concat(
        F.array(F.lit("## ✅ Validação OCR vs LLM"), F.lit(""), F.concat(F.lit("- **Veredicto:** "), _looked_up(VERDICTS, verdict, "❓"), F.lit(" "), F.initcap(F.replace(verdict, F.lit("_"), F.lit(" ")))), F.format_string("- **Score de consistência:** %.0f%%", validation["score"] * 100)),
        F.when(F.size(odd) > 0, F.concat(_one(F.lit("- **Inconsistências detectadas:**")), F.transform(F.slice(odd, 1, ODD), lambda x: F.concat(F.lit("  - ⚠️ "), x)))).otherwise(none), _one(F.lit("")),
    )).otherwise(none)
    event = lambda e: F.concat(F.lit("- **"), e["timestamp"], F.lit("** — "), e["description"])
    timeline = F.when(F.size(events) > 0, F.concat(F.array(F.lit("## 🕐 Linha do Tempo"), F.lit("")), F.transform(F.slice(events, 1, EVENTS), event), _one(F.lit("")))).otherwise(none)
    return F.array_join(F.concat(*(F.coalesce(c, none) for c in (found, kind, judged, timeline))), "\n")


def report_section(summary: Column, normalized: Column, original: Column) -> Column:
    """The summary under its heading, and the first characters of the normalized text where it differs from the original."""
    text = F.array(F.lit("### 📝 Texto Normalizado"), F.lit("```"), F.left(normalized, F.lit(TEXT)), F.lit("```"), F.lit(""))
    differs = (F.coalesce(normalized, F.lit("")) != "") & ~normalized.eqNullSafe(original)
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(*map(F.lit, ("---", "", "## 🔧 Pós-Processamento Automático", ""))), F.when(summary != "", _one(summary)).otherwise(none), F.when(differs, text).otherwise(none)), "\n")
