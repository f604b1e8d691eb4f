"""Reports as text columns and files: Markdown, JSON, HTML, consolidated, and the batch summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import or_placeholder, sanitized_filename, xml_escaped
from casefile.operators.numbering import numbered

EMPTY = "Não disponível."
MARKDOWN, JSON, HTML = "md", "json", "html"


def markdown(title: Column, sections: dict[str, Column]) -> Column:
    """A title and one section each; empty sections say so."""
    parts = [F.concat(F.lit("# "), title)]
    for name, body in sections.items():
        parts.append(F.concat(F.lit(f"## {name}\n\n"), or_placeholder(body, EMPTY)))
    return F.concat(F.array_join(F.array(*parts), "\n\n"), F.lit("\n"))


def telemetry_table(telemetry: Column) -> Column:
    """Rows of (stage, status, duration_ms, detail) as a Markdown table; bars in details become slashes."""
    row = lambda t: F.format_string("| %s | %s | %.2f | %s |", t["stage"], t["status"], t["duration_ms"], F.replace(t["detail"], F.lit("|"), F.lit("/")))
    return F.array_join(F.concat(F.array(F.lit("| Stage | Status | ms | Detail |"), F.lit("|---|---|---|---|")), F.transform(telemetry, row)), "\n")


def json_payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def html(title: Column, sections: dict[str, Column], color: str = "#1f2937", image: Column | None = None) -> Column:
    """A page with escaped text, and the image inlined as a data URL where there is one."""
    parts = [F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>h1{{color:{color}}}</style><title>'), xml_escaped(title), F.lit("</title></head><body><h1>"), xml_escaped(title), F.lit("</h1>"))]
    if image is not None:
        parts.append(F.coalesce(F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(image), F.lit('">')), F.lit("")))
    parts += [F.concat(F.lit(f"<h2>{name}</h2><pre>"), xml_escaped(or_placeholder(body, EMPTY)), F.lit("</pre>")) for name, body in sections.items()]
    return F.concat(*parts, F.lit("</body></html>"))


def export(df: DataFrame, folder: str, name_col: str, texts: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Write one text file tree per format, from the column named for it. Unknown formats are skipped; a format that
    fails does not stop the others. Returns format to path of those written, and format to error of those that failed."""
    done, failed = {}, {}
    for form, col in texts.items():
        if form not in (MARKDOWN, JSON, HTML):
            continue
        path = f"{folder}/{form}"
        try:
            out = df.select(sanitized_filename(F.col(name_col)).alias("name"), F.col(col).alias("value"))
            out.write.mode("overwrite").partitionBy("name").text(path)
            done[form] = path
        except Exception as error:
            failed[form] = str(error)
    return done, failed


def consolidated(df: DataFrame, group: str, order: str, text: str, most: int = 3000) -> DataFrame:
    """``(group, first, n, pos, section)``, a row for each report: its text, cut to ``most``, under an anchor numbered from 1
    within the group; groups come in the order of ``first``, sections in that of ``pos``. A group is never one row,
    so it may be of any size. ``order`` differs between rows."""
    rows = df.select(F.col(group).alias("group"), F.col(order).alias("order"), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(most)).alias("text"))
    placed = numbered(rows, [F.asc("group"), F.asc("order")], "place")
    groups = placed.groupBy("group").agg(F.min("order").alias("first"), F.count("*").alias("n"), F.min("place").alias("from"))
    pos = F.col("place") - F.col("from") + 1
    both = placed.join(groups.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")))
    return both.select(F.col("group").alias(group), "first", "n", pos.alias("pos"), F.concat(F.lit("### report_"), pos.cast("string"), F.lit("\n"), F.col("text")).alias("section"))


def batch_markdown(counts: DataFrame, tables: dict[str, DataFrame], first: int = 20) -> str:
    """A batch's summary: its counts, and of each table (label, number) the first rows with how many more
    there are. The tables are roll-ups; only the rows shown are collected."""
    c = counts.first()
    out = ["# Batch summary", "", *(f"**{k}:** {v}" for k, v in c.asDict().items())]
    for name, table in tables.items():
        rows, n = table.limit(first).collect(), table.count()
        out += ["", f"## {name}", "", *("- **" + str(r[0]) + ":** " + ", ".join(map(str, r[1:])) for r in rows)]
        if n > first:
            out.append(f"- … {n - first} more")
    return "\n".join(out) + "\n"
