"""URL verdicts from host/path rules and a path-template tree, with DataFrame functions only.

Rules decide first. All other URLs are judged by templates learned from labelled ones. Per host, paths become a tree of segments, built a level at a time: a segment
that looks variable (digits, hexadecimal, long) is generalised by its shape; a branch of many
rare children is generalised into a wildcard; sibling branches whose labelled shares do not differ
significantly are merged into one wildcard. A template is rejected if its purity, the smoothed
share of good labels, is below that of all URLs by more than chance allows. Templates and statistics are counted over distinct
host-path pairs, so a hot host is pre-aggregated before anything is shuffled by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.store import dropped, written

#: A branch with so many children, of so few rows each on average, has a variable next segment.
MANY, FEW = 8, 4.0
#: Siblings closer than so many standard errors are merged.
Z = 1.96
#: Labels that the overall share of good ones is worth in each template, and the standard errors by which a
#: rejected template's purity is below that share: one chance in twenty.
PRIOR, Z_BELOW = 3.0, 1.645


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_fit(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. ``rules``: (verdict, host, path
    with its leading slash). A rule fits its host and all subdomains; of rules as long, the later one wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{number}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{2,5}$"), F.concat(F.lit("{number}."), F.lower(F.regexp_extract(segment, r"\.([A-Za-z]+)$", 1))))
        .when(segment.rlike(r"^[0-9a-fA-F-]{12,}$"), "{hex}")
        .when(segment.rlike(r"[0-9]{3,}"), "{mixed}")
        .when(F.length(segment) > 40, "{long}")
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)


def templates(urls: DataFrame) -> DataFrame:
    """``(host, path, template, rows, good, bad, purity, impure)`` for each distinct host and path.

    ``urls`` has ``host``, ``path`` and ``good`` (true, false, or null where no label is known).
    """
    paths = (
        urls.groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .withColumn("parts", _segments(F.col("path"))).withColumn("template", F.lit(""))
    )
    shapes = written(paths.groupBy("host", "parts").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("template", F.lit("")), "shapes")
    tree, level = shapes.withColumn("done", F.size("parts") == 0), 0
    while not tree.filter("not done").isEmpty():  # a level reads the one before twice
        level += 1
        before, tree = tree, written(_grown(tree, level), "tree")
        if level > 1:
            dropped(before)
    leaf = tree.groupBy("host", "template").agg(F.sum("n").alias("rows"), F.sum("good").alias("t_good"), F.sum("bad").alias("t_bad"))
    g, b = shapes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    share, n, p = (g + 1) / (g + b + 2), F.col("t_good") + F.col("t_bad") + PRIOR, F.col("purity")
    leaf = leaf.withColumn("purity", (F.col("t_good") + PRIOR * share) / n)
    # the highest share of good ones that these labels leave likely (Wilson's bound)
    most = (p + Z_BELOW**2 / (2 * n) + Z_BELOW * F.sqrt(p * (1 - p) / n + Z_BELOW**2 / (4 * n * n))) / (1 + Z_BELOW**2 / n)
    leaf = leaf.withColumn("impure", (F.col("t_good") + F.col("t_bad") > 0) & (most < share))
    known = tree.select("host", "parts", "template").join(leaf, ["host", "template"])
    return paths.select("host", "path", "parts").join(known, ["host", "parts"]).select("host", "path", "template", "rows", F.col("t_good").alias("good"), F.col("t_bad").alias("bad"), "purity", "impure")


def _grown(tree: DataFrame, level: int) -> DataFrame:
    """The template of each shape with its segment of this level added, kept or generalised. A shape
    alone in its branch can meet no sibling further down, so it gets all its segments at once."""
    tree = tree.withColumn("s", F.when(~F.col("done"), F.try_element_at("parts", F.lit(level))))
    child = tree.filter("s is not null").groupBy("host", "template", "s").agg(F.count("*").alias("shapes"), F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
    branch = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("shapes").alias("branch_shapes"), F.sum("n").alias("rows"), F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
    both = child.join(branch, ["host", "template"])
    seen, rest = F.col("g") + F.col("b"), F.col("all_g") + F.col("all_b") - F.col("g") - F.col("b")
    pooled = F.try_divide(F.col("all_g"), F.col("all_g") + F.col("all_b"))
    apart = F.abs(F.try_divide(F.col("g"), seen) - F.try_divide(F.col("all_g") - F.col("g"), rest))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), seen) + F.try_divide(F.lit(1.0), rest)))
    rare = (F.col("kids") >= MANY) & (F.col("rows") / F.col("kids") < FEW)
    # alike: labels on both sides, and no significant difference between the child and its siblings
    alike = (seen > 0) & (rest > 0) & (apart <= Z * error)
    name = F.when((F.col("kids") > 1) & (rare | F.coalesce(alike, F.lit(False))), "*").otherwise(F.col("s"))
    names = both.select("host", "template", "s", name.alias("as"), (F.col("branch_shapes") == 1).alias("alone"))
    grown = tree.join(names, ["host", "template", "s"], "left")
    rest = F.array_join(F.slice("parts", level, F.size("parts")), "/")
    longer = F.concat(F.col("template"), F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("as")))
    done = F.col("done") | F.coalesce("alone", F.lit(False)) | (F.size("parts") <= level)
    return grown.withColumns({"template": F.when(F.col("as").isNull(), F.col("template")).otherwise(longer), "done": done}).drop("s", "as", "alone")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id, host, path, rule, verdict, template, purity``.

    ``labels`` holds ``id`` (of pages) and boolean ``good``; a page with several counts as bad if
    one says so, null labels are ignored. Null URLs and those without ``://`` have an empty host and
    path, and are judged like others: by the template of their (empty) path. Templates without labels
    are allowed. Other columns are not read; repeated rows each keep a row.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_fit(F.col("host"), F.col("path"), rules))
    rows = rows.join(labels.groupBy("id").agg(F.bool_and("good").alias("good")), "id", "left")
    rows = written(rows.select("id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), "good"), "urls")
    known = templates(rows.select("host", "path", "good"))
    judged = rows.join(known.select("host", "path", "template", "purity", "impure"), ["host", "path"], "left")
    return judged.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("impure"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
