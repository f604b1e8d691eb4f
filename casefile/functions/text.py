"""Text functions as Column expressions; Unicode classes follow the ``(?U)`` flag."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.functions.lexicon import REPAIRS


def stripped(c: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Matches whose places are summed up in one block: appending copies, so blocks keep a text of many matches linear.
_BLOCK = 128
#: Up to so many matches, each sums up the pieces before it by itself.
_FEW = 8
#: Stands around matches; never a character (U+FFFF).
_MARK = "\uffff"


def bound(c: Column, f) -> Column:
    """``f`` of ``c``, which is evaluated once however often ``f`` uses it. An aggregate over nothing, since taking an
    element of a transformed array works out the array's type, and so walks all of ``f``, in every row."""
    return F.aggregate(F.array().cast("array<int>"), c, lambda s, _: s, f)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all matches, left to right; start counts code points from 0.

    The pieces between matches give the offsets: a match starts after all pieces up to its own and
    all matches before it. Matches are set between marks in one pass, so that pieces and matches alternate; a text that
    has the mark itself (no character of Unicode) is cut by the pattern instead. Null text: null.
    """
    p = "(?U)" + pattern
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["piece"])
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value")))).alias("out"))

    def placed(pairs: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            own = F.slice(pairs, k * _BLOCK + 1, F.lit(_BLOCK))
            return F.aggregate(own, F.struct(s["at"].alias("at"), empty.alias("out")), add, lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("out"))
        return F.flatten(F.aggregate(blocks, state, block, lambda s: s["out"]))

    def cut(t: Column, found: Column) -> Column:
        pieces = F.slice(F.split(t, p, -1), 1, F.size(found))
        return bound(F.zip_with(found, pieces, lambda v, b: F.struct(b.alias("piece"), v.alias("value"))), placed)

    def marked(parts: Column) -> Column:
        n = F.floor(F.size(parts) / 2).cast("int")
        part = lambda k: F.get(parts, k.cast("int"))
        few = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.length(F.array_join(F.slice(parts, F.lit(1), 2 * i + 1), "")).alias("start"), part(2 * i + 1).alias("value")))
        many = bound(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(part(2 * i).alias("piece"), part(2 * i + 1).alias("value"))), placed)
        return F.when(n == 0, empty).when(n <= _FEW, few).otherwise(many)

    def located(t: Column) -> Column:
        by_pattern = bound(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda v: F.when(F.size(v) > 0, cut(t, v)).when(F.size(v) == 0, empty))
        by_mark = bound(F.split(F.regexp_replace(t, p, f"{_MARK}$0{_MARK}"), _MARK, -1), marked)
        return F.when(t == "", empty).when(F.contains(t, F.lit(_MARK)), by_pattern).when(t.isNotNull(), by_mark)

    return bound(text, located)


def context(text: Column, start: Column, size: Column, before: int, after: int) -> Column:
    """Code points around a match, cut at the text's ends."""
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(text, lo + 1, start + size + after - lo)


def think_stripped(c: Column) -> Column:
    """Without closed ``<think>`` blocks; an unclosed one stays."""
    return stripped(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def sanitized_filename(c: Column) -> Column:
    """Nine characters become ``_``, control characters go; beyond 200 the name is cut to 195 and keeps its extension."""
    name = F.regexp_replace(F.translate(c, '<>:"/\\|?*', "_________"), r"[\x00-\x1f\x7f-\x9f]", "")
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    short = F.concat(F.left(base, F.lit(195)), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return stripped(F.when(F.length(name) > 200, short).otherwise(name))


def snippet(c: Column, size: int = 300) -> Column:
    return F.concat(F.replace(F.left(c, F.lit(size)), F.lit("\n"), F.lit(" ")), F.lit("..."))


def xml_escaped(c: Column) -> Column:
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def or_placeholder(c: Column, placeholder: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(placeholder))


def inline_markup(c: Column) -> Column:
    """Bold, italic and code marks of Markdown as tags."""
    c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "<b>$1</b>")
    c = F.regexp_replace(c, r"\*(.+?)\*", "<i>$1</i>")
    return F.regexp_replace(c, r"`(.+?)`", '<font face="Courier">$1</font>')


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def _repaired(c: Column) -> Column:
    """The fixed repairs, in their order: those of two characters, which share the first, then single ones."""
    long, short = [r for r in REPAIRS if len(r[0]) > 1], [r for r in REPAIRS if len(r[0]) == 1]
    mended = c
    for bad, good in long:
        mended = F.replace(mended, F.lit(bad), F.lit(good))
    heads = {bad[0] for bad, _ in long}
    c = F.when(F.greatest(*(F.contains(c, F.lit(h)) for h in heads), F.lit(False)), mended).otherwise(c)
    kept = sorted(short, key=lambda r: r[1] == "")  # translate() deletes what has no counterpart
    return F.translate(c, "".join(bad for bad, _ in kept), "".join(good for _, good in kept))


def normalized(c: Column) -> Column:
    """Recognized text, cleaned: encodings repaired, composed, without junk runs and lines of symbols.

    An empty text and one that starts with ``[`` (a status, not a text) are returned as they are.
    Only texts with characters outside ASCII go through Python, for Unicode composition.
    """
    t = F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7f]"), _repaired(c))), _repaired(c))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    for run, one in ((r"[|]{3,}", ""), (r"-{5,}", "---"), (r"_{5,}", "___"), (r"={5,}", "==="), (r"~{3,}", "")):
        t = F.regexp_replace(t, run, one)
    # a line without letters and digits stays only if it has one or two characters
    worth = lambda line: F.when(line.rlike("[a-zA-Z0-9À-ÿ]"), True).otherwise(F.length(stripped(line)).between(1, 2))
    t = F.array_join(F.filter(F.split(t, "\n", -1), worth), "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.when((c == "") | c.startswith("["), c).otherwise(stripped(t))


def template_filled(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value; a template with an unknown name is returned unfilled."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.forall(names, lambda n: n.isin(*values)), out).otherwise(template)


def template_variables(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def short_model_name(name: Column, known: dict[str, str]) -> Column:
    """From a table; else what stands before ``:``, without dots."""
    other = F.replace(F.split_part(name, F.lit(":"), F.lit(1)), F.lit("."), F.lit(""))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
    return other if table is None else F.coalesce(F.try_element_at(table, name), other)


def quality_field(text: Column) -> Column:
    """Number after the last colon of the first line that names the score, or null."""
    line = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("Score de qualidade")) & F.contains(x, F.lit(":"))), F.lit(1))
    return F.trim(F.regexp_extract(line, ":([^:]*)$", 1)).try_cast("double")


def gps_field(text: Column) -> Column:
    """Struct (lat, lon) of the first line that starts with ``GPS:``; null if it does not parse."""
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x.startswith("GPS:")), F.lit(1))
    parts = F.split(F.substring(line, 5, 1 << 20), ",", 2)
    lat, lon = (F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double") for i in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def map_link(lat: Column, lon: Column) -> Column:
    return F.format_string("https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=17/%.6f/%.6f", lat, lon, lat, lon)
