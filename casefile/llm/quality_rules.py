"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when one ratio passes a cutoff. A tenth of the labelled rows, chosen
by a hash of the id, orders all cutoffs of all rules into one path: laxest first, by the share of good
rows they reject there. The other rows are the holdout that certifies. In each stratum the walk along
the path tightens one rule a step, and goes on while the exact (Clopper-Pearson) upper bound on the
share of good holdout rows that the rules so far reject together stays within the allowed risk. The
walk stops at the first failure, so the sequence needs no correction of its own, and as all rules are
counted together, nor do rules; strata are corrected by Bonferroni, the error rate divided in proportion to the
square root of their good rows, which says nothing about what is rejected. Of the certified steps the
first that rejects as many labelled bad rows as the last is used. A stratum with too few labels (219
good ones at four equal strata) certifies nothing, and its documents face the base rules only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.batches import sliced, text_in, tidy, whole
from casefile.llm.store import dropped, written

#: Share of a stratum's good documents, of those that pass the base rules, that the rules together may reject; the error rate.
RISK, DELTA = 0.02, 0.05
#: Of the labelled rows, by hash, the share in percent that orders the path; a step of it may reject so much of their good rows.
ORDER_PERCENT, ORDER_RISK = 10, 0.01
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Word positions inside a window of words that occurs twice or more in the list."""
    n = len(words)
    if n <= window:
        return 0
    code = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    mixed = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - window + 1 + k].astype(np.uint64)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal sums, so none repeats
        return 0
    rank = ids
    for k in range(1, window):  # exact ranks of 2, 3, ... words
        rank = np.unique(rank[:-1] * n + ids[k:], return_inverse=True)[1]
    twice = (np.bincount(rank)[rank] > 1).astype(np.int64)
    cover = np.zeros(n + 1, np.int64)
    cover[: len(twice)] += twice
    cover[window : window + len(twice)] -= twice
    return int((np.cumsum(cover[:n]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS``; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on space and 0x09-0x0D
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = data.translate(None, b" \t\n\x0b\x0c\r")
    return (
        len(words),
        len(solid) - (len(data) - len(text)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - len(data.translate(None, _UPPER)),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carried: bool = False) -> DataFrame:
    """``(id, stratum, counts...)``, one row per row of ``docs``; a null stratum is one of its own. If
    ``carried``, with ``doc``, the row's columns as a struct."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        whole(docs) if carried else F.col(text_col).cast("string").alias("t"),
    )
    at = docs.columns.index(text_col) if carried else None
    kinds = [T.StructField(c, T.LongType()) for c in _COUNTS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols = list(zip(*map(counts, text_in(batch.column(2), at)), strict=True)) or [()] * len(_COUNTS)
            keep = [0, 1, 2] if carried else [0, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(c, pa.int64()) for c in cols)], names=[*(batch.schema.names[i] for i in keep), *_COUNTS])

    return rows.mapInArrow(tidy(each), T.StructType([f for f in rows.schema if f.name != "t"] + kinds))


def _ratio(a: str, b: str):
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: Name, value, and candidate cutoffs from the laxest on; a value above the cutoff rejects.
def _rules():
    share = [round(0.95 - 0.05 * i, 2) for i in range(18)] + [0.08, 0.06, 0.04, 0.03, 0.02]
    return [
        ("symbols", _ratio("n_symbols", "word_chars"), share),
        ("duplicate_lines", _ratio("n_dup_lines", "n_lines"), share),
        ("repeated_words", _ratio("n_repeat_words", "n_words"), share),
        ("capitals", _ratio("n_upper", "word_chars"), share),
        ("long_words", _ratio("word_chars", "n_words"), [100.0, 70.0, 50.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
        ("short_words", -_ratio("word_chars", "n_words"), [-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
    ]


def _upper_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz's way), in constant memory."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _upper_tail(b, a, 1 - x)
    tiny, c, value = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (value if abs(value) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) * out / a


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p with P(at most k of n | p) >= delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if 1 - _upper_tail(k + 1, n - k, p) >= delta else (lo, p)
    return hi


def path_of(good: dict[str, list[int]], bad: dict[str, list[int]], n_good: int) -> list[tuple[str, float]]:
    """(rule, cutoff) in the order of tightening. good, bad: rows of the ordering part that each candidate rejects."""
    steps = []
    for at, (name, _, cut) in enumerate(_rules()):
        before = 0
        for i, c in enumerate(cut):
            if good[name][i] > ORDER_RISK * n_good:
                break
            if bad[name][i] > before:  # a step that rejects no further bad row has nothing to give
                steps.append((good[name][i], at, i, name, float(c)))
                before = bad[name][i]
    return [(name, c) for *_, name, c in sorted(steps)]


def certified_steps(good: list[int], bad: list[int], n_good: int, risk: float, delta: float) -> int:
    """How many steps of the path to take. good, bad: holdout rows that the first 1, 2, ... steps reject together."""
    last = 0
    while last < len(good) and upper_bound(good[last], n_good, delta) <= risk:
        last += 1
    return next(i for i in range(last + 1) if (bad[i - 1] if i else 0) == (bad[last - 1] if last else 0))


def _step_of(path: list[tuple[str, float]]):
    """First step of the path that rejects a row, from 1 on; null if none does."""
    out = []
    for name, value, _ in _rules():
        at = F.lit(None).cast("int")
        for i, (_, c) in reversed([(i, x) for i, x in enumerate(path, 1) if x[0] == name]):
            at = F.when(value > c, F.lit(i)).otherwise(at)
        out.append(at)
    return F.least(*out)


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fitted_cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[tuple]:
    """``(stratum, rule, cutoff)`` certified on ``labels(id, good)``.

    All labelled rows that pass the base rules count, summed before anything is collected: the driver
    gets rules x candidates numbers, then strata x steps, however many rows there are.
    """
    known = features.join(labels, "id").filter(F.col("good").isNotNull() & ~_base_failed())
    part = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(100)) < ORDER_PERCENT
    known = written(known.select("stratum", F.col("good").cast("boolean").alias("good"), part.alias("orders"), *_COUNTS), "labelled")
    rules = _rules()
    passed = [F.array(*(F.sum((v > c).cast("long")) for c in cut)).alias(name) for name, v, cut in rules]
    by = {r.good: r for r in known.filter("orders").groupBy("good").agg(F.count("*").alias("n"), *passed).collect()}
    good, bad = by.get(True), by.get(False)
    path = path_of({n: good[n] for n, *_ in rules}, {n: bad[n] for n, *_ in rules}, good.n) if good and bad else []
    if not path:
        dropped(known)
        return []
    counted = known.filter("not orders").groupBy("stratum", "good", _step_of(path).alias("step")).agg(F.count("*").alias("n")).collect()
    dropped(known)
    strata, out = sorted({r.stratum for r in counted}), []
    n_good = {s: sum(r.n for r in counted if r.stratum == s and r.good) for s in strata}
    part_of = {s: n_good[s] ** 0.5 / max(1.0, sum(n**0.5 for n in n_good.values())) for s in strata}
    for s in strata:
        hit = {g: [sum(r.n for r in counted if r.stratum == s and r.good == g and r.step and r.step <= i) for i in range(1, len(path) + 1)] for g in (True, False)}
        taken = path[: certified_steps(hit[True], hit[False], n_good[s], risk, delta * part_of[s])]
        out += [(s, name, min(c for n, c in taken if n == name)) for name, *_ in rules if any(n == name for n, _ in taken)]
    return out


def judged(features: DataFrame, cutoffs: list[tuple]) -> DataFrame:
    """``features`` with ``base_failed``, ``kept`` and ``reasons`` (the rules that reject, in order)."""
    reasons = []
    for name, value, _ in _rules():
        own = [x for s, r, c in cutoffs if r == name for x in (F.lit(s), F.lit(c))]
        if own:
            reasons.append(F.when(value > F.try_element_at(F.create_map(*own), F.col("stratum")), F.lit(name)))
    found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return features.withColumn("base_failed", _base_failed()).withColumn("reasons", found).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA, carried: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``stratum``, the counts, ``base_failed``, ``reasons``, ``kept``;
    if ``carried``, also ``doc``, the row's columns as a struct.

    ``labels`` holds ``id`` and boolean ``good``; null labels and labels without a document are
    ignored, repeated ones count each time. Null text: empty, hence fails the base rules. No labels
    or an empty table: only the base rules apply. Other columns are not read.
    """
    features = written(measured(docs, id_col, text_col, stratum_col, carried), "features")
    return judged(features, fitted_cutoffs(features, labels, risk, delta))


def kept_docs(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns. Texts are written once beside their
    counts, so that neither a join nor a second measuring follows the fit."""
    return quality_verdicts(docs, labels, carried=True, **columns).filter("kept").select("doc.*")
