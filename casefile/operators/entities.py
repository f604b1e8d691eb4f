"""Structured entities: thirteen kinds, each match a row, with normalized value and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import checks, text
from casefile.functions.lexicon import ENTITY_PATTERNS

BEFORE = AFTER = 30


def _form(kind: str, v: Column, d: Column) -> tuple[Column, Column, Column]:
    """(value, normalized, valid) of a match and its digits; a null normalized value drops it."""
    yes = F.lit(True)
    if kind == "cpf":
        shaped = F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
        return v, F.when(F.length(d) == 11, shaped), checks.valid_cpf(d)
    if kind == "cnpj":
        shaped = F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
        return v, F.when(F.length(d) == 14, shaped), checks.valid_cnpj(d)
    if kind == "phone":
        return v, d, checks.valid_phone(v)
    if kind == "email":
        return v, F.lower(v), checks.valid_email(v)
    if kind == "ipv4":
        return v, v, checks.valid_ipv4(v)
    if kind in ("ipv6", "pix_key"):
        return v, F.lower(v), yes
    if kind == "plate":
        bare = F.regexp_replace(F.upper(v), r"(?U)[-\s]", "")
        return F.upper(v), bare, F.length(bare) == 7
    if kind == "rg":
        return v, F.when(F.length(d).between(8, 10), d), yes
    if kind == "boleto":
        return v, F.when(F.length(d) >= 44, d), checks.valid_boleto(d)
    if kind == "bank_account":
        branch, account = (F.regexp_extract(v, "(?U)" + ENTITY_PATTERNS[kind], i) for i in (1, 2))
        found = (branch != "") & (account != "")
        return F.concat(F.lit("Ag: "), branch, F.lit(" Conta: "), account), F.concat(branch, F.lit("-"), account), found
    return v, v, yes


#: Fewest digits that a match of each kind has.
_DIGITS = {"cpf": 11, "phone": 10, "cnpj": 14, "rg": 8, "boleto": 47, "bank_account": 7, "plate": 3, "ipv4": 4}


def entity_array(t: Column, kinds: list[str] | None = None) -> Column:
    """All entities of a text, kinds in order, matches in order; overlapping kinds are all kept. The text is evaluated once."""
    return _over(t, lambda x, n: F.flatten(F.array(*(_entities_of(x, n, kind) for kind in kinds or ENTITY_PATTERNS))))


def normalized_values(t: Column, kinds: list[str] | None = None) -> Column:
    """The normalized values alone, in the order of :func:`entity_array`; places and surroundings are not looked for."""

    def values(x: Column, n: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.when(_may_hold(x, n, kind), x).otherwise(""), F.lit("(?U)" + ENTITY_PATTERNS[kind]), F.lit(0))
        return F.filter(F.transform(found, lambda v: text.bound(checks.digits(v), lambda d: _form(kind, v, d)[1])), lambda v: v.isNotNull())

    return _over(t, lambda x, n: F.flatten(F.array(*(values(x, n, kind) for kind in kinds or ENTITY_PATTERNS))))


def _over(t: Column, f) -> Column:
    """``f`` of the text and its number of digits, each evaluated once. Null text: null."""
    return text.bound(t, lambda x: text.bound(F.struct(x.alias("t"), F.length(F.regexp_replace(x, r"\P{Nd}+", "")).alias("n")), lambda b: f(b["t"], b["n"])))


def _may_hold(t: Column, digits: Column, kind: str) -> Column:
    """Cheap test that a text without it holds no entity of the kind, so most texts skip the full pattern."""
    if kind == "email":
        return F.contains(t, F.lit("@"))
    if kind == "ipv6":
        return F.contains(t, F.lit(":"))
    if kind == "url":
        return F.contains(t, F.lit("http")) | F.contains(t, F.lit("www."))
    if kind == "pix_key":
        return (F.length(t) >= 32) & t.rlike("[0-9a-fA-F]{32}")
    if kind == "bitcoin":
        return (F.length(t) >= 26) & t.rlike("[13][a-zA-HJ-NP-Z0-9]{25}")
    return digits >= _DIGITS[kind]


def _entities_of(t: Column, digits: Column, kind: str) -> Column:
    def row(m: Column) -> Column:
        near = F.lit("") if kind == "ipv6" else text.context(t, m["start"], F.length(m["value"]), BEFORE, AFTER)

        def formed(d: Column) -> Column:
            value, norm, valid = _form(kind, m["value"], d)
            return F.struct(F.lit(kind).alias("type"), value.alias("value"), norm.alias("normalized"), valid.alias("valid"), near.alias("context"), m["start"].alias("start"))

        return text.bound(checks.digits(m["value"]), formed)

    found = F.transform(text.matches(F.when(_may_hold(t, digits, kind), t).otherwise(""), ENTITY_PATTERNS[kind]), row)
    return F.filter(found, lambda e: e["normalized"].isNotNull()) if kind in ("cpf", "cnpj", "rg", "boleto") else found


def extract(df: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """``(id, seq, type, value, normalized, valid, context, start)``; texts without entities give no rows."""
    found = df.select(F.col(id_col), F.posexplode(entity_array(F.col(text_col), kinds)).alias("seq", "e"))
    return found.select(id_col, "seq", "e.*")
