"""Checksums, validators and rule chains as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile.functions.lexicon import CNPJ_WEIGHTS, PERMANENT_MARKERS, PERMANENT_STATUS
from casefile.functions.text import bound


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _checked(c: Column, size: int, weights: Sequence[Sequence[int]]) -> Column:
    """As many digits as told, not all the same, the last two being the check digits of those before them."""

    def check(n: Column, own: Sequence[int]) -> Column:
        table = F.array(*(F.lit(w) for w in own))
        total = F.aggregate(F.zip_with(F.slice(n, 1, F.lit(len(own))), table, lambda x, w: x * w), F.lit(0), lambda s, x: s + x)
        return bound(total % 11, lambda r: F.when(r < 2, 0).otherwise(11 - r)) == n[len(own)]

    def tested(d: Column) -> Column:
        numbers = F.transform(F.split(d, "", size), lambda x: x.cast("int"))
        same = d == F.repeat(F.substring(d, 1, 1), F.lit(size))
        ends = bound(numbers, lambda n: check(n, weights[0]) & check(n, weights[1]))
        return F.when((F.length(d) == size) & ~same, ends).otherwise(F.when(d.isNotNull(), False))

    return bound(digits(c), tested)


def valid_cpf(c: Column) -> Column:
    return _checked(c, 11, (range(10, 1, -1), range(11, 1, -1)))


def valid_cnpj(c: Column) -> Column:
    return _checked(c, 14, CNPJ_WEIGHTS)


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def valid_ipv4(c: Column) -> Column:
    """Four parts; those that are numbers are at most 255."""
    parts = F.split(c, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda p: ~p.rlike("^[0-9]+$") | F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def valid_phone(c: Column) -> Column:
    return F.length(digits(c)).between(10, 13)


def valid_boleto(c: Column) -> Column:
    return F.length(digits(c)).isin(44, 47, 48)


def file_verdict(exists: Column, path: Column, size: Column, suffixes: Sequence[str], most_mb: float = 20.0) -> Column:
    """Name of the first rule that fails, or ``ok``: missing, suffix, too_large."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(~exists, "missing").when(~suffix.isin(*suffixes), "suffix").when(size / (1024 * 1024) > most_mb, "too_large").otherwise("ok")


def dimension_verdict(width: Column, height: Column, least: int = 10, most: int = 10000) -> Column:
    return F.when(F.least(width, height) < least, "too_small").when(F.greatest(width, height) > most, "too_large").otherwise("ok")


def repeatable(status: int | str | None, message: str) -> bool:
    """The rule of :func:`transient` for one error; a status that is no number says nothing."""
    code = status if isinstance(status, int) else 0
    refused = code in PERMANENT_STATUS or any(mark in message.lower() for mark in PERMANENT_MARKERS)
    return code == 429 or code >= 500 or not refused


def transient(status: Column, message: Column) -> Column:
    """Whether a failed call is worth repeating: a busy or broken server always, else unless status or message refuse."""
    text = F.lower(F.coalesce(message, F.lit("")))
    code = F.coalesce(status, F.lit(0))
    refused = code.isin(*PERMANENT_STATUS) | F.exists(F.array(*map(F.lit, PERMANENT_MARKERS)), lambda mark: F.contains(text, mark))
    return (code == 429) | (code >= 500) | ~refused


def run_status(success: Column, failed: Column) -> Column:
    return F.when((success > 0) & (failed == 0), "completed").when(success > 0, "partial").otherwise("failed")


def entry_complete(status: Column, reports: Column, files: Column) -> Column:
    """Completed, with reports, all of which are among ``files``."""
    return (status == "completed") & (F.size(reports) > 0) & F.forall(reports, lambda r: F.array_contains(files, r))


def artifacts_available(stem: Column, formats: Column, files: Column) -> Column:
    return F.forall(formats, lambda f: F.array_contains(files, F.concat(stem, F.lit("."), f)))


def recognition_failed(text: Column) -> Column:
    low = F.lower(text)
    return low.startswith("[erro") | F.contains(low, F.lit("não disponível")) | F.contains(low, F.lit("nao disponivel"))


def problems(rules: Sequence[tuple[Column, str]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(cond, name) for cond, name in rules)))


def vision_model(name: Column, prefixes: Sequence[str]) -> Column:
    base = F.lower(F.split_part(name, F.lit(":"), F.lit(1)))
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.contains(base, p))


#: Modes of analysis in which objects are not detected.
MODES_WITHOUT_OBJECTS = ["documentos", "screenshots"]


def detects_objects(mode: Column) -> Column:
    return ~mode.isin(*MODES_WITHOUT_OBJECTS)


def of_class(detections: Column, name: Column | str) -> Column:
    """The detections, an array of structs, whose ``class_name`` is the name in any case."""
    wanted = F.lower(name if isinstance(name, Column) else F.lit(name))
    return F.filter(detections, lambda d: F.lower(d["class_name"]) == wanted)


def of_classes(detections: Column, names: Sequence[str]) -> Column:
    """The detections of the listed classes in any case; an empty list: all."""
    low = [n.lower() for n in names]
    return F.filter(detections, lambda d: F.lower(d["class_name"]).isin(*low)) if low else detections
