"""Reports as Word and PDF files, made in tasks from Markdown blocks with the standard library alone.

A document is a list of blocks (kind, content), as ``records.markdown_blocks`` gives them: h1, h2, h3,
paragraph, bullet, code, table; and image, whose content is a JPEG file in base 64. Tasks return the files' bytes as rows; ``file_writer`` writes
them into a folder of any file system that Spark knows, one file at a time.
"""

from __future__ import annotations

import base64
import binascii
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import xml_escaped
from casefile.operators.numbering import numbered

Block = tuple[str, str]

# Page size and margin in points, and of each kind font, size and space above.
PAGE, MARGIN = (595, 842), 56
STYLES = {"h1": ("F2", 18, 10), "h2": ("F2", 14, 10), "h3": ("F2", 12, 8), "paragraph": ("F1", 10, 4), "bullet": ("F1", 10, 2), "code": ("F3", 8, 4), "table": ("F3", 8, 4)}
_CELLS = re.compile(r"\s*\|\s*")
_BOLD = re.compile(r"\*\*(.+?)\*\*")


def picture(content: str) -> tuple[bytes, int, int] | None:
    """(file, width, height) of an image block; None if it is no JPEG file in base 64."""
    try:
        data = base64.b64decode(content, validate=True)
    except (binascii.Error, ValueError):
        return None
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if data[at + 1] in (0xC0, 0xC1, 0xC2):  # the frame's header
            return data, int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _fitted(width: int, height: int) -> tuple[float, float]:
    """Points that a picture takes: three for four pixels, and at most the page within its margins."""
    scale = min(0.75, (PAGE[0] - 2 * MARGIN) / width, (PAGE[1] - 2 * MARGIN) / height)
    return width * scale, height * scale


def _cells(line: str) -> list[str]:
    return _CELLS.split(line.strip().strip("|").strip())


def _runs(text: str) -> Iterator[tuple[str, bool]]:
    """Stretches of a line, and whether they are bold."""
    for k, part in enumerate(_BOLD.split(text)):
        if part:
            yield part, k % 2 == 1


def _word_text(text: str, bold: bool) -> str:
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{lines}</w:r>"


def _word_picture(n: int, width: int, height: int) -> str:
    cx, cy = (round(v * 12700) for v in _fitted(width, height))
    size, a, pic = f'cx="{cx}" cy="{cy}"', "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
    shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
    held = f'<pic:pic xmlns:pic="{pic}"><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}.jpg"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="i{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>{shape}</pic:pic>'
    graphic = f'<a:graphic xmlns:a="{a}"><a:graphicData uri="{pic}">{held}</a:graphicData></a:graphic>'
    return f'<w:p><w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{n}" name="image{n}"/>{graphic}</wp:inline></w:drawing></w:r></w:p>'


def _word_block(kind: str, content: str) -> str:
    if kind == "table":
        rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_word_text(c, False)}</w:p></w:tc>" for c in _cells(line)) + "</w:tr>" for line in content.split("\n"))
        rim = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
        return f"<w:tbl><w:tblPr><w:tblBorders>{rim}</w:tblBorders></w:tblPr>{rows}</w:tbl>"
    style = {"h1": "Title", "h2": "Heading1", "h3": "Heading2", "bullet": "ListBullet", "code": "Code"}.get(kind)
    runs = _word_text(content, False) if kind == "code" else "".join(_word_text(t, b) for t, b in _runs(content))
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + runs + "</w:p>"


def _xml_safe(text: str) -> str:
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text)


def docx(blocks: list[Block]) -> bytes:
    """A Word file. Equal blocks give equal bytes; an image block that holds no JPEG is left out."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    sizes = {"Title": 40, "Heading1": 30, "Heading2": 26, "ListBullet": 20, "Code": 16}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{n}"><w:name w:val="{n}"/><w:rPr>{"<w:b/>" * (z > 20)}<w:sz w:val="{z}"/></w:rPr></w:style>' for n, z in sizes.items())
    shown, body = [], ""
    for kind, content in blocks:
        if kind != "image":
            body += _word_block(kind, _xml_safe(content))
        elif found := picture(content):
            shown.append(found[0])
            body += _word_picture(len(shown), *found[1:])
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = "".join(f'<Relationship Id="i{n}" Type="{office}/image" Target="media/image{n}.jpg"/>' for n in range(1, len(shown) + 1))
    kinds = {"jpg": "image/jpeg", "xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml"}
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">' + "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in kinds.items())
        + "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"))) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>{links}</Relationships>',
        "word/styles.xml": f'{head}<w:styles xmlns:w="{w}">{styles}</w:styles>',
        "word/document.xml": f'{head}<w:document xmlns:w="{w}" xmlns:r="{office}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><w:body>{body}<w:sectPr/></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode("utf-8"), zipfile.ZIP_DEFLATED)
        for n, data in enumerate(shown, 1):
            z.writestr(zipfile.ZipInfo(f"word/media/image{n}.jpg", (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED)
    return out.getvalue()


def _wrapped(text: str, size: float, font: str) -> Iterator[str]:
    """Lines that fit the page, by a mean width of the font's characters; long words are cut."""
    most = max(1, int((PAGE[0] - 2 * MARGIN) / (size * (0.6 if font == "F3" else 0.52))))
    for line in text.split("\n"):
        now = ""
        for word in line.split(" ") if font != "F3" else [line]:
            while len(now) + bool(now) + len(word) > most:
                if now:
                    yield now
                    now = ""
                if len(word) > most:
                    yield word[:most]
                    word = word[most:]
            now = f"{now} {word}" if now else word
        yield now


def pdf(blocks: list[Block]) -> bytes:
    """A PDF file with text in the standard fonts (Windows Latin characters; others show as ``?``); an image block that
    holds no JPEG is left out."""
    pages, lines, y, images = [], [], PAGE[1] - MARGIN, []
    for kind, content in blocks:
        if kind == "image":
            if found := picture(content):
                width, height = _fitted(*found[1:])
                if y < MARGIN + height:
                    pages.append(lines)
                    lines, y = [], PAGE[1] - MARGIN
                y -= height
                images.append(found)
                lines.append(b"q %.2f 0 0 %.2f %d %.2f cm /I%d Do Q" % (width, height, MARGIN, y, len(images)))
            continue
        font, size, above = STYLES[kind]
        y -= above
        shown = "  ".join if kind == "table" else None
        text = "\n".join(shown(_cells(r)) for r in content.split("\n")) if shown else ("• " if kind == "bullet" else "") + _BOLD.sub(r"\1", content)
        for line in _wrapped(text, size, font):
            if y < MARGIN + size:
                pages.append(lines)
                lines, y = [], PAGE[1] - MARGIN
            y -= size * 1.3
            raw = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            lines.append(b"BT /%s %d Tf %d %.1f Td (%s) Tj ET" % (font.encode(), size, MARGIN, y, raw))
    pages.append(lines)
    fonts = b" ".join(b"/F%d << /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % (i, n) for i, n in enumerate((b"Helvetica", b"Helvetica-Bold", b"Courier"), 1))
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))
    pictures = b" ".join(b"/I%d %d 0 R" % (n, 2 + 2 * len(pages) + n) for n in range(1, len(images) + 1))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d %d] /Resources << /Font << %s >> /XObject << %s >> >> >>" % (kids, len(pages), *PAGE, fonts, pictures)]
    for i, own in enumerate(pages):
        data = zlib.compress(b"\n".join(own))
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)]
    for data, width, height in images:
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (width, height, len(data), data))
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", []
    chunks = [out]
    at = len(out)
    for n, body in enumerate(objects, 1):
        places.append(at)
        chunks.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
        at += len(chunks[-1])
    chunks.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    chunks.append(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
    return b"".join(chunks)


FORMATS = {"docx": docx, "pdf": pdf}


def rendered(reports: DataFrame, name: str, blocks: str, form: str) -> DataFrame:
    """``(name, content)``: a file per row. ``blocks``: a column of arrays of structs (kind, content); a null
    or empty one gives an empty document."""
    make = FORMATS[form]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in frames:
            made = [make([(b["kind"], b["content"] or "") for b in (own if own is not None else [])]) for own in pdf_["blocks"]]
            yield pd.DataFrame({"name": pdf_["name"] + f".{form}", "content": made})

    rows = reports.select(F.col(name).cast("string").alias("name"), F.col(blocks).alias("blocks"))
    return rows.mapInPandas(each, "name string, content binary")


def blocks_of(rows: DataFrame, id_col: str, block: str = "block") -> DataFrame:
    """``(id, blocks)`` from a row per block: one document's blocks in order."""
    own = F.array_sort(F.collect_list(F.struct(F.col(block).alias("n"), "kind", "content")))
    return rows.groupBy(id_col).agg(F.transform(own, lambda b: F.struct(b["kind"].alias("kind"), b["content"].alias("content"))).alias("blocks"))


def _numbered(reports: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``reports`` with their number from 0 by ``order``, which differs between rows; the reports stay apart from the numbering."""
    return reports.join(numbered(reports.select(order), [F.col(order)], name), order)


def consolidated_html(reports: DataFrame, order: str, name: str, model: str, mode: str, seconds: str, ocr: str, analysis: str) -> DataFrame:
    """``(part, pos, html)``: one page of all reports as lines to be written in order of part and pos: its head, an index
    entry per report that leads to ``report_pos``, the reports, its foot. No text meets another in memory."""
    spark = reports.sparkSession
    placed = _numbered(reports, order)
    shown = lambda c: xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    entry = F.concat(F.lit('<li><a href="#report_'), F.col("pos").cast("string"), F.lit('">'), shown(name), F.lit(" ("), shown(model), F.lit(")</a></li>"))
    card = F.concat(
        F.lit('<div id="report_'), F.col("pos").cast("string"), F.lit('" class="report"><h2>'), shown(name), F.lit("</h2><p>"), shown(model), F.lit(" "), shown(mode), F.lit(" "), F.format_string("%.2f s", F.col(seconds).cast("double")),
        F.lit("</p><details><summary>OCR ("), F.length(F.coalesce(ocr, F.lit(""))).cast("string"), F.lit(")</summary><pre>"), xml_escaped(F.left(F.coalesce(ocr, F.lit("")), F.lit(500))), F.lit("...</pre></details><div>"),
        F.replace(shown(analysis), F.lit("\n"), F.lit("<br>")), F.lit("</div></div>"),
    )
    counted = reports.agg(F.count("*").alias("n"))
    head = counted.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit('<!DOCTYPE html><html lang="pt-BR"><head><meta charset="UTF-8"><title>Relatório Consolidado - '), F.col("n").cast("string"), F.lit(" análises</title></head><body><h1>Relatório Consolidado</h1><ul>")).alias("html"))
    rest = spark.createDataFrame([(2, 0, "</ul>"), (4, 0, "</body></html>")], "part int, pos long, html string")
    return head.unionByName(placed.select(F.lit(1).alias("part"), "pos", entry.alias("html"))).unionByName(placed.select(F.lit(3).alias("part"), "pos", card.alias("html"))).unionByName(rest)


def consolidated_json(reports: DataFrame, order: str) -> DataFrame:
    """``(part, pos, json)``: one JSON document of all reports as lines to be written in order: metadata, a report a line, the end."""
    spark, last = reports.sparkSession, reports.agg((F.count("*") - 1).alias("_last"))
    placed = _numbered(reports, order, "_pos").join(F.broadcast(last), F.lit(True))
    row = F.to_json(F.struct(*(F.col(c) for c in reports.columns)), {"ignoreNullFields": "false"})
    line = placed.select(F.lit(1).alias("part"), F.col("_pos").alias("pos"), F.concat(row, F.when(F.col("_pos") < F.col("_last"), ",").otherwise("")).alias("json"))
    head = reports.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit('{"metadata":{"total_reports":'), F.col("n").cast("string"), F.lit('},"reports":[')).alias("json"))
    return head.unionByName(line).unionByName(spark.createDataFrame([(2, 0, "]}")], "part int, pos long, json string"))
