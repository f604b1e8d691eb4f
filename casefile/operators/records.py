"""Report records: texts built from measurements, flat rows for the sinks, summary entries, model lists, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import numeric, text


def quality_text(blurry: Column, blur: Column, brightness: Column, contrast: Column, sharpness: Column, advice: Column, faces: Column, colors: Column, gps: Column) -> Column:
    """Lines that describe an image's quality; optional ones are left out. ``gps``: struct (lat, lon) or null."""
    light = F.when(brightness < 0.3, "Escura").when(brightness > 0.7, "Clara").otherwise("Equilibrada")
    score = numeric.quality_score(blur, brightness, contrast, sharpness)
    place = F.when(gps.isNotNull(), F.format_string("GPS: %.6f, %.6f", gps["lat"], gps["lon"]))
    shown = F.filter(F.slice(F.coalesce(colors, F.array().cast("array<string>")), 1, 5), lambda c: c != "")
    return F.array_join(F.array_compact(F.array(
        F.concat(F.lit("Nitidez: "), F.when(blurry, "Borrada").otherwise("Nítida")),
        F.concat(F.lit("Iluminação: "), light),
        F.concat(F.lit("Avisos: "), F.when(F.size(advice) > 0, F.array_join(advice, ", ")).otherwise("Nenhum")),
        F.when(faces > 0, F.concat(F.lit("Faces detectadas: "), faces.cast("string"))),
        F.when(F.size(shown) > 0, F.concat(F.lit("Cores dominantes: "), F.array_join(shown, ", "))),
        F.format_string("Score de qualidade (0-100): %.0f", score),
        place, F.when(gps.isNotNull(), F.concat(F.lit("Mapa: "), text.map_link(gps["lat"], gps["lon"]))),
    )), "\n")


def exif_text(tags: Column) -> Column:
    """A line per tag, in order of the names."""
    rows = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(tags) > 0, F.array_join(rows, "\n")).otherwise("Metadados de câmera ou GPS ausentes.")


def detections_text(counts: Column) -> Column:
    """From an array of (name, n) in the order to show; null: the detector did not run."""
    lines = F.transform(counts, lambda c: F.concat(F.lit("- "), c["n"].cast("string"), F.lit("x "), c["name"]))
    some = F.concat(F.lit("Objetos detectados pela máquina:\n"), F.array_join(lines, "\n"))
    return F.when(counts.isNull(), "[YOLO não executado]").when(F.size(counts) == 0, "Nenhum objeto primário detectado pelo YOLO.").otherwise(some)


def forensic_context(sections: dict[str, Column], provenance: Column) -> Column:
    """The sections that have a text, each under its title and the version of the image it was made from."""
    parts = [F.when(body != "", F.concat(F.lit(f"### {title} "), provenance, F.lit("\n"), body)) for title, body in sections.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def provenance(width: Column, height: Column, original: Column, quality: int = 90) -> Column:
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(")"))
    return F.concat(F.when(original, "(origem: arquivo original, ").otherwise(f"(origem: JPEG reduzido q{quality}, "), size)


#: Line prefixes of verdicts in a quality text.
VERDICT_LINES = {"ela_verdict": "Veredicto ELA:", "ghost_verdict": "JPEG Ghost:", "exif_verdict": "Veredicto EXIF:", "clone_verdict": "Copy-Move:", "stego_verdict": "Esteganografia LSB:", "shadow_verdict": "Análise de Sombras:"}


def forensic_fields(quality: Column) -> Column:
    """Map of the verdicts in a quality text; empty without the forensic section or an error-level verdict."""
    lines = F.transform(F.split(quality, "\n"), text.stripped)

    def value(prefix: str) -> Column:
        line = F.try_element_at(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(-1))
        return F.trim(F.substring(line, len(prefix) + 1, 1 << 20))

    entries = F.array_compact(F.array(*(F.when(value(p).isNotNull(), F.struct(F.lit(k).alias("key"), value(p).alias("value"))) for k, p in VERDICT_LINES.items())))
    present = F.contains(quality, F.lit("DADOS FORENSES AUTOMATIZADOS")) & F.contains(quality, F.lit("Veredicto ELA:"))
    return F.when(present, F.map_from_entries(entries)).otherwise(F.create_map().cast("map<string,string>"))


def report_rows(images: DataFrame, analyses: DataFrame, key: str) -> DataFrame:
    """One flat row per image and analysis, for the sinks; binary columns stay out."""
    flat = [c for c, kind in images.dtypes if kind != "binary"]
    return images.select(flat).join(analyses, key)


def summary_entries(images: DataFrame, analyses: DataFrame, key: str, order: str, success: str, content: str, quality: str) -> DataFrame:
    """Per image: its first successful analysis, and place and score from its quality text."""
    first = analyses.filter(success).groupBy(key).agg(F.min_by(content, order).alias(content))
    both = images.join(first.withColumn("success", F.lit(True)), key, "left").withColumn("success", F.coalesce("success", F.lit(False)))
    gps = text.gps_field(F.col(quality))
    return both.withColumn("gps_lat", gps["lat"]).withColumn("gps_lon", gps["lon"]).withColumn("quality_score", text.quality_field(F.col(quality)))


def model_type(name: Column, default: str) -> Column:
    return F.when((name == default) | name.startswith("gpt"), "openai").otherwise("ollama")


def first_available(candidates: Sequence[tuple[str, Column]], none: str = "none") -> Column:
    return F.coalesce(*(F.when(ok, name) for name, ok in candidates), F.lit(none))


def template_ids(new: DataFrame, name: str, taken: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """``new`` with an id from its name: lower-case, ``_`` for spaces, 20 characters, and ``_n`` with the
    first n that is free: among ``taken`` ids and, in order, the other new ones. A base that is free is taken as it is."""
    from pyspark.sql.window import Window

    base = F.left(F.replace(F.lower(F.col(name)), F.lit(" "), F.lit("_")), F.lit(20))
    rows = new.withColumn("_base", base)
    old = taken.select(F.col(id_col).alias("_id")).distinct()
    tail = F.regexp_extract("_id", r"^(.*)_([0-9]+)$", 2).try_cast("int")
    slots = old.select(F.col("_id").alias("_base"), F.lit(0).alias("_n")).unionByName(old.filter(tail > 0).select(F.regexp_extract("_id", r"^(.*)_([0-9]+)$", 1).alias("_base"), tail.alias("_n")))
    used = slots.groupBy("_base").agg(F.collect_set("_n").alias("_used"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_base").orderBy(order or name)))
    both = ranked.join(used, "_base", "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(0), F.col("_r") + F.size("_used")), lambda n: ~F.array_contains(F.col("_used"), n))
    n = F.element_at(free, F.col("_r"))
    return both.withColumn(id_col, F.when(n == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), n.cast("string")))).drop("_base", "_r", "_used")


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, block, kind, content)``: code, table, h2, h3, bullet and paragraph blocks of a Markdown text.

    Lines are numbered, and a block is a run of lines of one kind (gaps and islands); paragraphs and
    bullets' and headings' lines follow the source, table rules and blank lines only separate.
    """
    from pyspark.sql.window import Window

    lines = df.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    own = Window.partitionBy(id_col).orderBy("n")
    s = text.stripped(F.col("line"))
    fence = s.startswith("```")
    fences = F.sum(fence.cast("int")).over(own)
    inside = (fences % 2 == 1) | fence
    kind = (
        F.when(inside, F.when(fence, "fence").otherwise("code")).when(s == "", "blank")
        .when(s.startswith("|"), F.when(s.rlike(r"^\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?$"), "rule").otherwise("table"))
        .when(s.startswith("## "), "h2").when(s.startswith("### "), "h3").when(s.rlike(r"^[*-] "), "bullet").otherwise("paragraph")
    )
    typed = lines.withColumn("kind", kind).withColumn("f", fences)
    typed = typed.filter("kind <> 'rule'")
    alone = F.col("kind").isin("h2", "h3", "bullet", "fence", "blank")
    start = F.when(alone | ~F.col("kind").eqNullSafe(F.lag("kind").over(own)) | (F.col("f") != F.lag("f").over(own)), 1).otherwise(0)
    islands = typed.withColumn("island", F.sum(start).over(own)).filter(~F.col("kind").isin("fence", "blank"))
    body = F.when(F.col("kind") == "code", F.col("line")).when(F.col("kind") == "h2", F.substring(s, 4, 1 << 20)).when(F.col("kind") == "h3", F.substring(s, 5, 1 << 20)).when(F.col("kind") == "bullet", F.substring(s, 3, 1 << 20)).otherwise(s)
    joined = islands.withColumn("body", body).groupBy(id_col, "island", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("rows"))
    glue = F.transform(F.col("rows"), lambda r: r["body"])
    content = F.when(F.col("kind") == "paragraph", F.array_join(glue, " ")).otherwise(F.array_join(glue, "\n"))
    return joined.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("island")) - 1).alias("block"), "kind", content.alias("content"))


def by_category(templates: DataFrame, category: str) -> DataFrame:
    return templates.filter(F.col("category") == category)


def categories(templates: DataFrame) -> DataFrame:
    return templates.select("category").distinct().orderBy("category")


def installed(wanted: DataFrame, models: DataFrame, name: str = "model") -> DataFrame:
    """``wanted`` with ``installed``: a model of that name is there, or one with that base, the part before ``:``."""
    base = F.split_part(F.col(name), F.lit(":"), F.lit(1))
    there = models.select(F.explode(F.array(F.col(name), base)).alias("_k")).distinct().withColumn("_there", F.lit(True))
    keyed = wanted.withColumn("_k", F.when(F.contains(F.col(name), F.lit(":")), F.col(name)).otherwise(base))
    return keyed.join(there, "_k", "left").withColumn("installed", F.coalesce("_there", F.lit(False))).drop("_k", "_there")


def model_choices(api: DataFrame, tier: DataFrame, vision: DataFrame, custom: DataFrame) -> DataFrame:
    """All that can be chosen, ``source`` saying from where; a model may occur several times."""
    sources = {"api": api, "tier": tier, "vision": vision, "custom": custom}
    parts = [df.select("model", F.lit(s).alias("source")) for s, df in sources.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter("model <> ''")


def newest_first(reports: DataFrame, stamp: str = "mtime", name: str = "path") -> DataFrame:
    return reports.orderBy(F.desc(stamp), name)
