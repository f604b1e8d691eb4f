"""Registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import checks, numeric, text
from casefile.functions.lexicon import CHI_STEPS, CNPJ_WEIGHTS, CONTEXT_TAGS, DOCUMENT_TYPES, ENTITY_PATTERNS, MEMORY_TIERS, RECORDER_PATTERNS, STOPWORDS, THREATS, TIMESTAMP_PATTERNS, WORD_LETTERS
from casefile.operators import admission, classify, consistency, conversation, entities, exif_rules, images, incremental, records, rollup, similarity, timeline
from casefile.operators.numbering import spread
from casefile.plans import postprocess
from casefile.sinks import reports
from casefile.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- entities -------------------------------------------------------------------------------------

_SQL_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def _sql_mod11(d: str, weights) -> str:
    total = " + ".join(f"try_cast(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


def _sql_checked(d: str, size: int, weights) -> str:
    ends = " AND ".join(f"try_cast(substr({d}, {len(w) + 1}, 1) AS INT) = {_sql_mod11(d, w)}" for w in weights)
    return f"(length({d}) = {size} AND {d} <> repeat(substr({d}, 1, 1), {size}) AND coalesce({ends}, false))"


_SQL_BRANCH = [f"regexp_extract(v, {quoted(ENTITY_PATTERNS['bank_account'])}, {i})" for i in (1, 2)]
_CPF_WEIGHTS = (range(10, 1, -1), range(11, 1, -1))
_SQL_FORMS = {
    "cpf": ("v", f"CASE WHEN length({_SQL_DIGITS}) = 11 THEN regexp_replace({_SQL_DIGITS}, '^(\\d{{3}})(\\d{{3}})(\\d{{3}})(\\d{{2}})$', '\\1.\\2.\\3-\\4') END", _sql_checked(_SQL_DIGITS, 11, _CPF_WEIGHTS)),
    "phone": ("v", _SQL_DIGITS, f"length({_SQL_DIGITS}) BETWEEN 10 AND 13"),
    "email": ("v", "lower(v)", "regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')"),
    "ipv4": ("v", "v", "len(string_split(v, '.')) = 4 AND list_bool_and(list_transform(string_split(v, '.'), lambda x: NOT regexp_matches(x, '^[0-9]+$') OR coalesce(try_cast(x AS INT) <= 255, false)))"),
    "ipv6": ("v", "lower(v)", "true"),
    "url": ("v", "v", "true"),
    "plate": ("upper(v)", "regexp_replace(upper(v), '[-\\s]', '', 'g')", "length(regexp_replace(v, '[-\\s]', '', 'g')) = 7"),
    "cnpj": ("v", f"CASE WHEN length({_SQL_DIGITS}) = 14 THEN regexp_replace({_SQL_DIGITS}, '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5') END", _sql_checked(_SQL_DIGITS, 14, CNPJ_WEIGHTS)),
    "rg": ("v", f"CASE WHEN length({_SQL_DIGITS}) BETWEEN 8 AND 10 THEN {_SQL_DIGITS} END", "true"),
    "pix_key": ("v", "lower(v)", "true"),
    "boleto": ("v", f"CASE WHEN length({_SQL_DIGITS}) >= 44 THEN {_SQL_DIGITS} END", f"length({_SQL_DIGITS}) IN (44, 47, 48)"),
    "bitcoin": ("v", "v", "true"),
    "bank_account": (f"'Ag: ' || {_SQL_BRANCH[0]} || ' Conta: ' || {_SQL_BRANCH[1]}", f"{_SQL_BRANCH[0]} || '-' || {_SQL_BRANCH[1]}", f"{_SQL_BRANCH[0]} <> '' AND {_SQL_BRANCH[1]} <> ''"),
}
_SQL_KINDS = list(_SQL_FORMS)


def _sql_entities(source: str, id_col: str, text_col: str, kinds: list[str]) -> str:
    parts = []
    for k in kinds:
        value, norm, valid = _SQL_FORMS[k]
        found = f"(SELECT {id_col} AS id, unnest(regexp_extract_all({text_col}, {quoted(ENTITY_PATTERNS[k])})) AS v FROM {source})"
        parts.append(f"SELECT id, '{k}' AS type, {value} AS value, {norm} AS normalized, {valid} AS valid FROM {found} WHERE ({norm}) IS NOT NULL")
    return " UNION ALL ".join(parts)


def _sql_places(source: str, patterns: dict[str, str]) -> str:
    """(id, t, k, i, v, start) of every match of ``source`` (id, t): a match starts after the pieces and matches before it."""
    parts = []
    for i, (name, p) in enumerate(patterns.items()):
        cut = f"SELECT id, t, regexp_extract_all(t, {quoted(p)}) AS vs, string_split_regex(t, {quoted(p)}) AS bs FROM {source}"
        parts.append(f"""SELECT id, t, {i} AS k, '{name}' AS kind, i, vs[i] AS v,
          list_sum(list_transform(bs[:i], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(vs[:i - 1], lambda x: length(x))), 0)::INT AS start
          FROM (SELECT id, t, vs, bs, unnest(range(1, len(vs) + 1)) AS i FROM ({cut}))""")
    return " UNION ALL ".join(parts)


def _sql_entity_rows(source: str, kinds: list[str] | None = None) -> str:
    """(id, seq, type, value, normalized, valid, context, start): all entities of ``source`` (id, t), placed."""
    kinds = kinds or list(ENTITY_PATTERNS)
    form = lambda j: "CASE kind " + " ".join(f"WHEN '{k}' THEN {_SQL_FORMS[k][j]}" for k in kinds) + " END"
    near = "CASE WHEN kind = 'ipv6' THEN '' ELSE substr(t, greatest(start - 30, 0) + 1, start + length(v) + 30 - greatest(start - 30, 0)) END"
    placed = _sql_places(source, {k: ENTITY_PATTERNS[k] for k in kinds})
    rows = f"SELECT id, k, i, start, kind AS type, {form(0)} AS value, {form(1)} AS normalized, {form(2)} AS valid, {near} AS context FROM ({placed})"
    return f"SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k, i) - 1)::INT AS seq, type, value, normalized, valid, context, start FROM ({rows}) WHERE normalized IS NOT NULL"


_THREE = ["email", "ipv4", "phone"]
_DOCS = "(SELECT doc_id AS id, text AS t FROM documents)"

#: Texts with what the tables lack: every kind of entity, right and wrong ones, in the manners in which they are written.
_SAMPLES = [
    "CPF 529.982.247-25", "cpf 111.111.111-11", "52998224726", "CNPJ 11.222.333/0001-81", "cnpj 11222333000182", "placa ABC-1234", "placa abc1d23", "RG 12.345.678-9",
    "pix 0123456789abcdef0123456789ABCDEF", "boleto 23790504004188711911234567890123456789012345678", "linha 237905040041.8 87119112345.6 78901234567.8 90123456789.0 1",
    "carteira 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "Agência: 1234-5, conta 12345-6", "ag. 0001 e a conta: 987654-0",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::", "see ::1 here", "10.0.0.255 and 10.0.0.256", "site https://a.example/x?y=(1) or www.b.example.", "Ana.Lima+1@Example.com.br",
    "+55 (11) 98765-4321", "11 3333 4444", "12345678901234567890", "nothing here", "R$ 1.234,56",
]
_SQL_MADE = f"""(SELECT o_orderkey AS id, s[o_orderkey % {len(_SAMPLES)} + 1] || ' e ' || s[(o_orderkey * 7 + o_custkey) % {len(_SAMPLES)} + 1] || chr(10) || s[o_custkey % {len(_SAMPLES)} + 1] || ' n. ' || o_orderkey AS t
  FROM orders, (SELECT [{", ".join(map(quoted, _SAMPLES))}] AS s))"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), len(_SAMPLES)
    samples = F.array(*map(F.lit, _SAMPLES))
    at = lambda i: F.element_at(samples, (i % n + 1).cast("int"))
    # texts cost some tenths of a millisecond each, and their keys few bytes
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", each=20_000)
    return rows.select(k.alias("id"), F.concat(at(k), F.lit(" e "), at(k * 7 + c), F.lit("\n"), at(c), F.lit(" n. "), k.cast("string")).alias("t"))


@query(f"SELECT type, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM ({_sql_entities('documents', 'doc_id', 'text', _THREE)}) GROUP BY type")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.entity_counts(entities.extract(table(spark, sf_dir, "documents"), "doc_id", "text", _THREE))


@query(_sql_entities("documents", "doc_id", "text", _SQL_KINDS).replace("SELECT id,", "SELECT id AS doc_id,"))
def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.extract(table(spark, sf_dir, "documents"), "doc_id", "text", _SQL_KINDS).select("doc_id", "type", "value", "normalized", "valid")


@query(_sql_entity_rows(_DOCS).replace("SELECT id, (row_number", "SELECT id AS doc_id, (row_number"))
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.extract(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_sql_entity_rows(_SQL_MADE))
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen kinds, on texts that hold each of them, valid and not."""
    return entities.extract(_made(spark, sf_dir), "id", "t")


@query(_sql_entities("pages", "page_id", "concat_ws(' ', url, html)", ["url", "email", "ipv4", "rg"]).replace("SELECT id,", "SELECT id AS page_id,"))
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    return entities.extract(pages, "page_id", "t", ["url", "email", "ipv4", "rg"]).select("page_id", "type", "value", "normalized", "valid")


@query(f"""
SELECT type, count(*) AS n, array_to_string((list(value ORDER BY id, start))[:5], ',') || CASE WHEN count(*) > 5 THEN ' e mais ' || (count(*) - 5) ELSE '' END AS shown FROM ({_sql_entity_rows(_SQL_MADE)}) GROUP BY type
""")
def entity_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.top_values(entities.extract(_made(spark, sf_dir), "id", "t"), ["id", "start"])
    return found.select("type", "n", rollup.with_rest(F.col("values"), F.col("n"), ",").alias("shown"))


def _mod11(d: Column, weights) -> Column:
    """The check digit of leading digits, a column of the made texts."""
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


@query(f"""
WITH o AS (SELECT o_orderkey AS id, lpad((o_orderkey * 104729 + o_custkey * 7919)::VARCHAR, 9, '0') AS b FROM orders),
p AS (SELECT id, substr(b, 1, 9) AS b FROM o),
d AS (SELECT id, b || (({_sql_mod11('b', range(10, 1, -1))})::VARCHAR) AS d FROM p)
SELECT id, d || (id % 10)::VARCHAR AS cpf, {_sql_checked("(d || (id % 10)::VARCHAR)", 11, _CPF_WEIGHTS)} AS cpf_valid,
  lpad(b, 14, '1') AS cnpj, {_sql_checked("lpad(b, 14, '1')", 14, CNPJ_WEIGHTS)} AS cnpj_valid FROM d JOIN p USING (id)
""")
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    b = F.substring(F.lpad((F.col("o_orderkey") * 104729 + F.col("o_custkey") * 7919).cast("string"), 9, "0"), 1, 9)
    rows = o.select(F.col("o_orderkey").alias("id"), b.alias("b"))
    rows = rows.withColumn("cpf", F.concat("b", _mod11(F.col("b"), range(10, 1, -1)).cast("string"), (F.col("id") % 10).cast("string"))).withColumn("cnpj", F.lpad("b", 14, "1"))
    return rows.select("id", "cpf", checks.valid_cpf(F.col("cpf")).alias("cpf_valid"), "cnpj", checks.valid_cnpj(F.col("cnpj")).alias("cnpj_valid"))


# --- text -----------------------------------------------------------------------------------------


@query("""
SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '<think>a' || chr(10) || 'b</think> ' || text ELSE '<think>' || text END,
  '<think>.*?</think>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS content FROM conversations
""")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think> "), "text")).otherwise(F.concat(F.lit("<think>"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.think_stripped(t).alias("content"))


def _sql_repaired(c: str) -> str:
    from casefile.functions.lexicon import REPAIRS

    for bad, good in REPAIRS:
        if bad != "\x00":
            c = f"replace({c}, {quoted(bad)}, {quoted(good)})"
    return c


@query(f"""
WITH a AS (SELECT doc_id, text, nfc_normalize({_sql_repaired("replace(text, 'the', '|||the-----')")}) AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '[|]{{3,}}', '', 'g'), '-{{5,}}', '---', 'g'), '_{{5,}}', '___', 'g'), '={{5,}}', '===', 'g'), '~{{3,}}', '', 'g') AS t FROM a),
c AS (SELECT doc_id, text, list_aggregate(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''
  AND NOT regexp_matches(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '^[^a-zA-Z0-9À-ÿ]{{3,}}$')), 'string_agg', chr(10)) AS t FROM b)
SELECT doc_id, CASE WHEN text = '' OR starts_with(text, '[') THEN text ELSE
  regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END AS normalized FROM c
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    noisy = F.replace(F.col("text"), F.lit("the"), F.lit("|||the-----"))
    return docs.select("doc_id", text.normalized(noisy).alias("normalized"))


_SQL_NAME = "regexp_replace(translate(u, '<>:\"/\\|?*', '_________'), '[\\x01-\\x1f\\x7f-\\x{9f}]', '', 'g')"


@query(f"""
SELECT page_id, replace(left(html, 300), chr(10), ' ') || '...' AS snippet,
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#39;') AS escaped,
  regexp_replace(CASE WHEN length(n) > 200 THEN left(regexp_replace(n, '\\.[^.]*$', ''), 195) || CASE WHEN e <> '' THEN '.' || e ELSE '' END ELSE n END, '^\\s+|\\s+$', '', 'g') AS filename
FROM (SELECT *, regexp_extract(n, '\\.([^.]*)$', 1) AS e FROM (SELECT *, {_SQL_NAME} AS n FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN url || repeat('p/', 120) || '.html' ELSE url END AS u FROM pages)))
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("p/" * 120 + ".html"))).otherwise(F.col("url"))
    return p.select("page_id", text.snippet(F.col("html")).alias("snippet"), text.xml_escaped(F.col("html")).alias("escaped"), text.sanitized_filename(name).alias("filename"))


def _sql_hits(words: list[str], low: str = "low") -> str:
    return "(" + " + ".join(f"contains({low}, {quoted(w)})::INT" for w in words) + ")"


def _sql_best(labels: dict[str, list[str]], none: str) -> tuple[str, str]:
    top = "greatest(" + ", ".join(_sql_hits(w) for w in labels.values()) + ")"
    cases = " ".join(f"WHEN {_sql_hits(w)} = {top} THEN {quoted(k)}" for k, w in labels.items())
    return f"CASE WHEN {top} = 0 THEN {quoted(none)} {cases} END", top


def _sql_classified(source: str) -> str:
    (kind, kind_hits), (threat, threat_hits) = _sql_best(DOCUMENT_TYPES, "indefinido"), _sql_best(THREATS, "nenhuma")
    tags = "list_filter([" + ", ".join(f"CASE WHEN {_sql_hits(w)} > 0 THEN {quoted(k)} END" for k, w in CONTEXT_TAGS.items()) + "], lambda x: x IS NOT NULL)"
    return f"SELECT id, {kind} AS document_type, {threat} AS threat_type, array_to_string({tags}, ',') AS tags, least(1.0::DOUBLE, ({kind_hits} + {threat_hits} + len({tags})) / 5.0::DOUBLE) AS confidence FROM (SELECT id, lower(t) AS low FROM ({source}))"


_KEYWORDS = [w for labels in (DOCUMENT_TYPES, THREATS, CONTEXT_TAGS) for words in labels.values() for w in words]
_SQL_WORDY = f"""SELECT l_orderkey * 10 + l_linenumber AS id, 'Um ' || w[l_orderkey % {len(_KEYWORDS)} + 1] || ', ' || w[l_partkey % {len(_KEYWORDS)} + 1] || ' E ' || w[(l_suppkey * 13 + l_linenumber) % {len(_KEYWORDS)} + 1] AS t
  FROM lineitem, (SELECT [{", ".join(map(quoted, _KEYWORDS))}] AS w)"""


def _wordy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, _KEYWORDS))
    at = lambda i: F.element_at(words, (i % len(_KEYWORDS) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("Um "), at(F.col("l_orderkey")), F.lit(", "), at(F.col("l_partkey")), F.lit(" E "), at(F.col("l_suppkey") * 13 + F.col("l_linenumber"))).alias("t"),
    )


@query(f"SELECT id AS doc_id, document_type, threat_type, tags, confidence FROM ({_sql_classified('SELECT doc_id AS id, text AS t FROM documents')})")
def classify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return classify.classify(docs, "t").select(F.col("id").alias("doc_id"), "document_type", "threat_type", F.array_join("context_tags", ",").alias("tags"), "confidence")


@query(_sql_classified(_SQL_WORDY))
def classify_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three keywords each, so that every label is reached, with ties."""
    return classify.classify(_wordy(spark, sf_dir), "t").select("id", "document_type", "threat_type", F.array_join("context_tags", ",").alias("tags"), "confidence")


@query(f"SELECT document_type, count(*) AS n FROM ({_sql_classified(_SQL_WORDY)}) GROUP BY document_type")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.histogram(classify.classify(_wordy(spark, sf_dir), "t"), "document_type")


_TURNS = "SELECT conv_id, turn, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def _sql_consistent(source: str) -> str:
    """(id, score, odd, verdict) of ``source`` (id, question, answer), entities included."""
    skip = "coalesce(question = '' OR starts_with(question, '[') OR answer = '' OR len(ws) = 0, true) OR answer IS NULL"
    return f"""
WITH q AS (SELECT id, question, answer FROM ({source})),
w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), lambda x: regexp_matches(x, '^[{WORD_LETTERS}]{{4,}}$') AND x NOT IN ({", ".join(map(quoted, STOPWORDS))})) AS ws,
  list_distinct(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[0-9]{{3,}}$'))) AS ns FROM q),
e1 AS ({_sql_entity_rows("(SELECT id, question AS t FROM q)")}), e2 AS ({_sql_entity_rows("(SELECT id, answer AS t FROM q)")}),
gone AS (SELECT id, list(DISTINCT 'entity:' || normalized) AS es FROM e1 WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.id = e1.id AND e2.normalized = e1.normalized) GROUP BY id),
s AS (SELECT w.*, len(list_filter(ws, lambda x: contains(lower(answer), x))) / len(ws)::DOUBLE AS share,
  list_sort(list_concat(list_transform(list_filter(ns, lambda x: NOT contains(answer, x)), lambda x: 'number:' || x), coalesce(es, []))) AS odd FROM w LEFT JOIN gone USING (id))
SELECT id, CASE WHEN {skip} THEN 0 ELSE share END AS score, CASE WHEN {skip} THEN '' ELSE array_to_string(odd, ',') END AS odd,
  CASE WHEN {skip} THEN 'nao_avaliado' WHEN share >= 0.7 AND len(odd) <= 1 THEN 'consistente' WHEN share >= 0.4 THEN 'parcialmente_consistente' ELSE 'inconsistente' END AS verdict FROM s"""


_SQL_QUESTIONS = f"SELECT conv_id || '-' || turn AS id, question, answer FROM ({_TURNS}) WHERE role = 'user' AND r = 'assistant'"
#: Accounts of one item: the first names samples that the second leaves out or keeps.
_SQL_ACCOUNTS = f"""SELECT id, 'Relatório sobre veículo ' || t AS question, CASE id % 4 WHEN 0 THEN 'relatório sobre veículo ' || t WHEN 1 THEN 'Relatório: ' || left(t, 20) WHEN 2 THEN 'veículo sobre relatório' ELSE '' END AS answer FROM {_SQL_MADE}"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("id") % 4, F.col("t")
    answer = F.when(k == 0, F.concat(F.lit("relatório sobre veículo "), t)).when(k == 1, F.concat(F.lit("Relatório: "), F.left(t, F.lit(20)))).when(k == 2, "veículo sobre relatório").otherwise("")
    return _made(spark, sf_dir).select("id", F.concat(F.lit("Relatório sobre veículo "), t).alias("question"), answer.alias("answer"))


def _compared(df: DataFrame) -> DataFrame:
    return consistency.compare(df, "question", "answer").select("id", "score", F.array_join("inconsistencies", ",").alias("odd"), "verdict")


@query(_sql_consistent(_SQL_QUESTIONS))
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation.answered(table(spark, sf_dir, "conversations"))
    return _compared(turns.withColumn("id", F.concat_ws("-", "conv_id", "turn")))


@query(_sql_consistent(_SQL_ACCOUNTS))
def consistency_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in which entities of every kind are kept or left out."""
    return _compared(_accounts(spark, sf_dir))


@query("SELECT conv_id, turn, pos, with_image FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) - 1 AS pos, coalesce(role = 'user' AND turn = min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id), false) AS with_image FROM conversations)")
def chat_history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.request_order(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "pos", "with_image")


@query("SELECT conv_id, array_to_string(list(role || '=' || text ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn), chr(10)) AS messages FROM conversations GROUP BY conv_id")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = conversation.history(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["text"])), "\n").alias("messages"))


# --- time -----------------------------------------------------------------------------------------

_STAMPED = "SELECT event_id, 'seen ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' and ' || strftime(ts + INTERVAL 1 DAY, '%d/%m/%Y %H:%M') || ' at ' || strftime(ts, '%H:%M') || ' on ' || strftime(ts, '%Y/%m/%d %H:%M') AS t FROM events"


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", each=20_000)
    at = lambda f, c="ts": F.date_format(c, f)
    line = F.concat(F.lit("seen "), at("yyyy-MM-dd HH:mm:ss"), F.lit(" and "), at("dd/MM/yyyy HH:mm", F.expr("ts + INTERVAL 1 DAY")), F.lit(" at "), at("HH:mm"), F.lit(" on "), at("yyyy/MM/dd HH:mm"))
    return e.select("event_id", line.alias("t"))


@query(f"""
WITH s AS ({_STAMPED}), m AS (
  SELECT event_id, unnest(regexp_extract_all(t, '\\b\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}[\\sT]\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\b')) AS ts, 0 AS p FROM s
  UNION ALL SELECT event_id, unnest(regexp_extract_all(t, '\\b\\d{{2}}/\\d{{2}}/\\d{{4}}\\s+\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\b')), 1 FROM s
  UNION ALL SELECT event_id, unnest(regexp_extract_all(t, '\\b\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\b')), 2 FROM s)
SELECT DISTINCT event_id, ts AS "timestamp", strftime(coalesce(try_strptime(ts, '%Y-%m-%d %H:%M:%S'), try_strptime(ts, '%Y-%m-%d %H:%M'), try_strptime(ts, '%d/%m/%Y %H:%M:%S'), try_strptime(ts, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M:%S') AS parsed FROM m
""")
def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.extract(_stamped(spark, sf_dir), "event_id", "t")
    return found.select("event_id", "timestamp", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def _sql_timeline(source: str, patterns: list[str], name: str, k: int) -> str:
    placed = _sql_places(source, {str(i): p for i, p in enumerate(patterns)})
    spaces = "[\\s\\x0b\\x1c-\\x1f]"
    near = f"regexp_replace(substr(t, greatest(start - 50, 0) + 1, start + length(v) + 100 - greatest(start - 50, 0)), '^{spaces}+|{spaces}+$', '', 'g')"
    at = "coalesce(" + ", ".join(f"try_strptime(v, '{f}')" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M")) + ")"
    return f"""SELECT id, v AS "timestamp", {at} AS parsed, left(regexp_replace({near}, '{spaces}+', ' ', 'g'), 150) AS description, '{name}' AS source, {k} AS which, seq
      FROM (SELECT *, row_number() OVER (PARTITION BY id, v ORDER BY seq) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, i) AS seq FROM ({placed}))) WHERE n = 1"""


@query(f"""
SELECT id AS event_id, "timestamp", strftime(parsed, '%Y-%m-%d %H:%M:%S') AS parsed, description, source, (row_number() OVER (PARTITION BY id ORDER BY parsed NULLS LAST, which, seq) - 1)::INT AS pos FROM (
{_sql_timeline(f"(SELECT event_id AS id, t || chr(10) || chr(10) AS t FROM ({_STAMPED}))", TIMESTAMP_PATTERNS, "text", 0)} UNION ALL
{_sql_timeline(f"(SELECT event_id AS id, t FROM ({_STAMPED}))", RECORDER_PATTERNS, "dvr_timestamp", 1)})
""")
def timeline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stamped(spark, sf_dir).withColumn("nothing", F.lit(""))
    found = postprocess.timelines(rows, "event_id", "t", "nothing", "nothing")
    return found.withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_minute, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = admission.observed(table(spark, sf_dir, "events"), "user_id", "ts", 60, "in_minute")
    return admission.observed(e, "user_id", "ts", 3600, "in_hour").select("event_id", "in_minute", "in_hour")


# one call of each user a round; the state is the list of what was admitted
@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, event_id, n, admitted, past) AS (
  SELECT user_id, event_id, n, true, [t] FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, ok, CASE WHEN ok THEN list_append(past, t) ELSE past END FROM (
    SELECT e.user_id, e.event_id, e.n, e.t, w.past, (len(w.past) = 0 OR e.t - list_max(w.past) >= 30)
      AND len(list_filter(w.past, lambda x: x > e.t - 60)) < 2 AND len(list_filter(w.past, lambda x: x > e.t - 3600)) < 10 AS ok
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, event_id, admitted FROM walk
""")
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admission(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 10, 30.0)


# --- duplicates and neighbours --------------------------------------------------------------------


@query("SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sign_hash(col: str) -> Column:
    bits = [F.when(F.col(col)[i] > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


_SQL_BITS = "list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT"


_SQL_VECTORS = f"SELECT vec_id, {_SQL_BITS} AS h FROM embeddings"
_SQL_TURNED = f"""SELECT vec_id + 1000000, set_bit(h, (vec_id % 60)::INT, 1 - get_bit(h, (vec_id % 60)::INT)) FROM (SELECT vec_id, {_SQL_BITS} AS h FROM embeddings)
  UNION ALL SELECT vec_id + 2000000, {_SQL_BITS} FROM embeddings WHERE vec_id % 10 = 0"""
#: The vectors' hashes, and of each of them one with a bit turned; every tenth one twice.
_SQL_HASHES = f"({_SQL_VECTORS} UNION ALL {_SQL_TURNED})"


def _own_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' hashes, and those made of them; ``own``: the vector itself."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _sign_hash("embedding").alias("h"), F.lit(True).alias("own"))
    made = rows.withColumn("own", F.lit(False))
    turned = made.withColumns({"vec_id": F.col("vec_id") + 1000000, "h": F.col("h").bitwiseXOR(F.expr("shiftleft(1L, cast(vec_id % 60 as int))"))})
    return rows.unionByName(turned).unionByName(made.filter("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 2000000))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_hashes(spark, sf_dir).drop("own")


@query(f"WITH h AS (SELECT h, min(vec_id) AS id, count(*) AS n FROM {_SQL_HASHES} GROUP BY 1) SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON (a.id < b.id OR (a.id = b.id AND a.n > 1)) AND bit_count(xor(a.h, b.h)) <= 12")
def hash_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives, the smallest id of each hash, and with itself one that stands for several:
    its vectors are at distance 0. Membership: :func:`hash_members`."""
    return similarity.representative_pairs(_hashes(spark, sf_dir), "vec_id", "h", 12)


@query(f"SELECT vec_id, min(vec_id) OVER (PARTITION BY h) AS representative FROM {_SQL_HASHES}")
def hash_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.members(_hashes(spark, sf_dir), "vec_id", "h")


#: Files with their hashes: equal MD5, equal hashes; every ninth image lacks the first.
_SQL_FILES = f"(SELECT vec_id AS id, CASE WHEN vec_id % 9 <> 0 THEN h END AS p, h AS d, md5(h::VARCHAR || ':' || (vec_id % 3)) AS m FROM {_SQL_HASHES})"
_SQL_CLASSES = f"(SELECT m, min(id) AS id, arg_min(p, id) FILTER (p IS NOT NULL) AS p, arg_min(d, id) AS d, count(*) AS n FROM {_SQL_FILES} GROUP BY m)"


def _with_hashes(rows: DataFrame) -> DataFrame:
    bits = F.reverse(F.lpad(F.bin("h"), 64, "0"))
    md5 = F.md5(F.concat(bits, F.lit(":"), (F.col("vec_id") % 3).cast("string")).cast("binary"))
    return rows.withColumns({"id": F.col("vec_id"), "p": F.when(F.col("vec_id") % 9 != 0, F.col("h")), "d": F.col("h"), "m": md5})


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hashes(_hashes(spark, sf_dir)).select("id", "p", "d", "m")


def _small_md5(n: int) -> Column:
    """An MD5 that images of different hashes share."""
    return F.md5((F.col("vec_id") % n).cast("string").cast("binary"))


#: The files; the vectors themselves have a second MD5 (``o``), which images of different hashes share.
_SQL_IMAGES = f"""(SELECT vec_id AS id, CASE WHEN vec_id % 9 <> 0 THEN h END AS p, h AS d, md5(h::VARCHAR || ':' || (vec_id % 3)) AS m, o
  FROM (SELECT vec_id, h, md5((vec_id % 97)::VARCHAR) AS o FROM ({_SQL_VECTORS}) UNION ALL SELECT *, NULL FROM ({_SQL_TURNED})))"""


@query(f"""
WITH c AS MATERIALIZED (SELECT p, d, m, o, min(id) AS id, count(*) AS n FROM {_SQL_IMAGES} GROUP BY p, d, m, o)
SELECT a, b, ph AS ph_distance, dh AS dh_distance, CASE WHEN known THEN 1 - ph / 64.0::DOUBLE ELSE 0 END AS similarity, same AS same_md5, n_a, n_b FROM (
  SELECT x.id AS a, y.id AS b, coalesce(bit_count(xor(x.p, y.p)), 64)::INT AS ph, coalesce(bit_count(xor(x.d, y.d)), 64)::INT AS dh, x.p IS NOT NULL AND y.p IS NOT NULL AS known,
    x.m = y.m OR coalesce(x.o = y.o, false) AS same, x.n AS n_a, y.n AS n_b
  FROM c x JOIN c y ON x.id < y.id OR (x.id = y.id AND x.n > 1)) WHERE same OR (ph <= 10 AND dh <= 10)
""")
def image_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates among files: all pairs with an MD5 in common or both hashes near, each file by its own hashes."""
    rows = _with_hashes(_own_hashes(spark, sf_dir).withColumn("o", F.when(F.col("own"), _small_md5(97))))
    return similarity.image_links(rows, "id", "p", "d", ["m", "o"], 10)


_SQL_DISTANCE = "list_sum(list_transform(list_zip(d.embedding, q.embedding), lambda z: ((z[1] - z[2])::DOUBLE) * ((z[1] - z[2])::DOUBLE)))"


@query(f"SELECT d.vec_id AS id, round({_SQL_DISTANCE}, 6) AS distance FROM embeddings d, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_SQL_DISTANCE}, id LIMIT 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 7").select("embedding").first()[0]
    return similarity.nearest(e, q, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"SELECT query_id, rank, id FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SQL_DISTANCE}, d.vec_id) AS rank FROM embeddings d, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return similarity.nearest_batch(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", "embedding").select("query_id", "rank", "id")


@query(f"""
WITH h AS (SELECT vec_id, vec_id % 10 AS image, (vec_id * 37 % 512)::INT AS x, (vec_id * 53 % 512)::INT AS y, h FROM {_SQL_HASHES})
SELECT a.image, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS similarity FROM h a JOIN h b
ON a.image = b.image AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) AND NOT (abs(a.x - b.x) < 32 AND abs(a.y - b.y) < 32) AND bit_count(xor(a.h, b.h)) <= 16
""")
def block_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    rows = _hashes(spark, sf_dir).select((n % 10).alias("image_id"), (n * 37 % 512).cast("int").alias("x"), (n * 53 % 512).cast("int").alias("y"), F.col("h").alias("hash"))
    return similarity.copied_blocks(rows, least=0.75)


@query(f"""
WITH c AS MATERIALIZED (SELECT h, m, min(vec_id) AS id, count(*) AS n FROM (SELECT vec_id, h, md5((vec_id % 7)::VARCHAR) AS m FROM {_SQL_HASHES}) GROUP BY h, m)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.m = b.m AS same_md5, a.n AS n_a, b.n AS n_b
FROM c a JOIN c b ON (a.id < b.id OR (a.id = b.id AND a.n > 1)) AND (a.m = b.m OR bit_count(xor(a.h, b.h)) <= 8)
""")
def image_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of classes of equal images, with the number of images of each, that share an MD5 or are near."""
    rows = _hashes(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("h").alias("p"), F.col("h").alias("d"), _small_md5(7).alias("m"))
    return similarity.image_links(rows, "id", "p", "d", ["m"]).select("a", "b", F.col("ph_distance").alias("distance"), "same_md5", "n_a", "n_b")


@query(f"SELECT id, min(id) OVER (PARTITION BY m) AS representative FROM {_SQL_FILES}")
def image_class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.image_classes(_files(spark, sf_dir), "id", "p", "d", "m")[1]


# --- roll-ups -------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.class_summary(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS successful, count(*) FILTER (quality <> 1) AS failed FROM labels")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_counts(table(spark, sf_dir, "labels").withColumn("success", F.col("quality") == 1))


_YOLO = "SELECT '- ' || p_size || 'x ' || p_type || chr(10) || '- ax bad' || chr(10) || ' - 1x box' AS t FROM part"


@query(f"SELECT name, sum(n) AS n FROM (SELECT try_cast(trim(regexp_extract(trim(l), '^- ([^x]*)x(.*)$', 1)) AS BIGINT) AS n, trim(regexp_extract(trim(l), '^- ([^x]*)x(.*)$', 2)) AS name FROM (SELECT unnest(string_split(t, chr(10))) AS l FROM ({_YOLO}))) WHERE n IS NOT NULL GROUP BY name")
def object_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("- "), F.col("p_size").cast("string"), F.lit("x "), "p_type", F.lit("\n- ax bad\n - 1x box")).alias("t"))
    return rollup.object_totals(rows, "t").withColumn("n", F.col("n").cast("decimal(38,0)"))


@query("SELECT v AS verdict, count(*) AS n FROM (SELECT unnest(['ELA: ' || o_orderstatus, 'Clone: ' || o_orderpriority]) AS v FROM orders) GROUP BY v")
def forensic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("DADOS FORENSES AUTOMATIZADOS\n**Veredicto ELA:** x\nVeredicto ELA: "), "o_orderstatus", F.lit("\n Veredicto Clone: "), "o_orderpriority")
    return rollup.forensic_histogram(table(spark, sf_dir, "orders").select(F.replace(t, F.lit("**Veredicto ELA:** x\n"), F.lit("")).alias("t")), "t")


@query("SELECT c_custkey, (c_custkey % 90) + 0.25::DOUBLE AS lat, -(c_custkey % 180) - 0.5::DOUBLE AS lon FROM customer WHERE c_custkey % 3 <> 0")
def gps_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("a\n GPS: "), (F.col("c_custkey") % 90 + 0.25).cast("string"), F.lit(", "), (-(F.col("c_custkey") % 180) - 0.5).cast("string"))).otherwise("GPS: none, 1\nGPS: 1, 2")
    return rollup.places(table(spark, sf_dir, "customer").select("c_custkey", line.alias("t")), "c_custkey", "t").drop("url")


@query("SELECT round(avg(s), 6) AS avg_score, max(s) AS max_score, min(s) AS min_score, count(s) AS n FROM (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS s FROM part)")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("x\nScore de qualidade (0-100): "), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string")).otherwise("none"))
    return rollup.score_summary(table(spark, sf_dir, "part").select(line.alias("t")), text.quality_field(F.col("t"))).withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT l_returnflag AS model, l_linestatus AS mode, count(*) AS entries, round(sum(l_orderkey) / (1024 * 1024), 6) AS mib, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "model", "l_linestatus": "mode"})
    return rollup.cache_statistics(rows, "model", "mode", "l_orderkey").withColumn("mib", F.round("mib", 6))


@query("SELECT event_type, round(avg(value), 2) AS avg_seconds, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY event_type")
def model_time_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.model_times(table(spark, sf_dir, "events"), "event_type", "value", F.col("event_id") % 4 == 0)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.per_day(table(spark, sf_dir, "events"), "ts")


@query("SELECT count(DISTINCT user_id) AS images, (SELECT string_agg(e, ', ' ORDER BY e) FROM (SELECT DISTINCT event_type AS e FROM events)) AS models FROM events")
def consolidated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.consolidated_names(table(spark, sf_dir, "events"), "user_id", "event_type")


# --- incremental ----------------------------------------------------------------------------------


@query("SELECT n_name AS item, r_name AS model FROM nation, region")
def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.task_grid(table(spark, sf_dir, "nation").select(F.col("n_name").alias("item")), table(spark, sf_dir, "region").select(F.col("r_name").alias("model")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
WITH e AS (SELECT doc_id, quality = 1 AS done, toxic = 0 AS kept FROM labels)
SELECT d.doc_id, CASE WHEN e.done AND e.kept THEN 'skipped' ELSE 'pending' END AS state, coalesce(e.done AND NOT e.kept, false) AS stale FROM documents d LEFT JOIN e USING (doc_id)
""")
def resume_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), F.array(F.when(F.col("toxic") == 0, "a.md").otherwise("gone.md")).alias("reports"))
    items = table(spark, sf_dir, "documents").select("doc_id")
    skipped, pending, stale = incremental.resume(items, entries, "doc_id", F.array(F.lit("a.md")))
    both = skipped.withColumn("state", F.lit("skipped")).unionByName(pending.withColumn("state", F.lit("pending")))
    return both.join(stale.select("doc_id", F.lit(True).alias("stale")), "doc_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS cache_hit FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l USING (doc_id)")
def cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return incremental.cached_lookup(docs, cache, ["doc_id"], F.col("toxic") == 0).select("doc_id", "quality", "cache_hit")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderpriority <> '' GROUP BY o_custkey")
def first_intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.first_intermediate(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest_wins(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def capped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.capped_history(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 1000).select("event_id")


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN d.n_chars % 2 <> l.quality THEN 'update' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2).alias("mtime"))
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("mtime"))
    return incremental.index_diff(new, old).select("id", "action")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'custom' ELSE n_name END AS v FROM nation UNION ALL SELECT 100, 'custom'")
def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    custom = base.filter("k % 5 = 0").select("k").unionByName(spark.range(100, 101).select(F.col("id").cast("int").alias("k"))).withColumn("v", F.lit("custom"))
    return incremental.override(base, custom, "k")


@query("SELECT a.o_custkey, a.o_totalprice AS content_a, b.o_totalprice AS content_b FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.model_pairs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "O", "F", "o_totalprice")


# --- rules and numbers ----------------------------------------------------------------------------

_SQL_TIER = "CASE " + " ".join(f"WHEN g >= {least} THEN {quoted(name)}" for least, name in reversed(MEMORY_TIERS)) + " ELSE '' END"


@query(f"""
SELECT p_partkey, {_SQL_TIER} AS tier,
  CASE WHEN NOT p_partkey % 11 <> 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'suffix' WHEN p_retailprice * 16000 / (1024 * 1024) > 20 THEN 'too_large' ELSE 'ok' END AS file_verdict,
  CASE WHEN least(p_size, p_partkey) < 10 THEN 'too_small' WHEN greatest(p_size, p_partkey) > 10000 THEN 'too_large' ELSE 'ok' END AS dimension_verdict,
  CASE WHEN s = 429 OR s >= 500 THEN true WHEN s IN (400, 401, 403, 404, 405, 422) THEN false ELSE p_partkey % 2 = 0 END AS transient,
  CASE WHEN p_size % 3 > 0 AND p_size % 2 = 0 THEN 'completed' WHEN p_size % 3 > 0 THEN 'partial' ELSE 'failed' END AS status,
  least(2.0::DOUBLE * pow(2.0::DOUBLE, p_size % 8), 60.0::DOUBLE) AS delay
FROM (SELECT *, p_size::DOUBLE AS g, CASE p_size % 4 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 503 END AS s FROM part)
""")
def rule_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, n = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 7 == 0, "a/b.TXT").otherwise("a/b.JPG")
    status = F.when(n % 4 == 0, 429).when(n % 4 == 1, 401).when(n % 4 == 2, 503)
    return p.select(
        k, numeric.memory_tier(n.cast("double")).alias("tier"), checks.file_verdict(k % 11 != 0, path, F.col("p_retailprice") * 16000, [".jpg"]).alias("file_verdict"),
        checks.dimension_verdict(n.cast("long"), k).alias("dimension_verdict"), checks.transient(status, F.when(k % 2 == 0, "timeout").otherwise("Billing stopped")).alias("transient"),
        checks.run_status(n % 3, n % 2).alias("status"), numeric.backoff_delay(n % 8, 2.0, 2.0, 60.0).alias("delay"),
    )


_SQL_PAIRS = "list_transform(range(0, 32), lambda i: (embedding[2 * i + 1] > 0)::INT * 2 + (embedding[2 * i + 2] > 0)::INT)"
_SQL_CHI = " + ".join(f"pow(len(list_filter(pairs, lambda x: x = {v})) - 8.0::DOUBLE, 2)" for v in range(4))
_SQL_P = "CASE " + " ".join(f"WHEN chi > {c} THEN {p}" for c, p in CHI_STEPS) + " ELSE 0.5 END"


@query(f"""
SELECT vec_id, round(CASE WHEN p IN (0, 1) THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 9) AS entropy, round(chi, 9) AS chi, ({_SQL_P})::DOUBLE AS p_value
FROM (SELECT vec_id, p, ({_SQL_CHI}) / 8 AS chi FROM (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) / 64.0::DOUBLE AS p, {_SQL_PAIRS} AS pairs FROM embeddings))
""")
def bit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.element_at("embedding", 2 * i + 1) > 0).cast("int") * 2 + (F.element_at("embedding", 2 * i + 2) > 0).cast("int"))
    counted = e.select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("ones"), pairs.alias("pairs"))
    chi = numeric.chi_square([(32 - F.size(F.array_remove("pairs", v))).cast("double") for v in range(4)])
    return counted.select("vec_id", F.round(numeric.bit_entropy(F.col("ones"), F.lit(64)), 9).alias("entropy"), F.round(chi, 9).alias("chi"), numeric.chi_p_value(chi).alias("p_value"))


@query("""
SELECT c_custkey, round(greatest(0, least(100, least(40, greatest(0, b / 300 * 40)) + least(25, greatest(0, s * 10 * 25)) + greatest(0, 1 - abs(l - 0.5) * 2) * 15 + least(20, greatest(0, c * 20)))), 6) AS score,
  round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (d + 30 / 60.0 + 36 / 3600.0), 9) AS degrees, least(abs(x - y), 360 - abs(x - y)) AS gap
FROM (SELECT c_custkey, abs(c_acctbal) / 20 AS b, (c_custkey % 100) / 100.0::DOUBLE AS l, (c_custkey % 7) / 7.0::DOUBLE AS c, (c_custkey % 13) / 100.0::DOUBLE AS s, c_custkey % 90 AS d, c_custkey % 360 AS x, c_custkey * 7 % 360 AS y FROM customer)
""")
def image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    score = numeric.quality_score(F.abs("c_acctbal") / 20, (k % 100) / F.lit(100.0), (k % 7) / F.lit(7.0), (k % 13) / F.lit(100.0))
    degrees = numeric.decimal_degrees((k % 90).cast("double"), F.lit(30.0), F.lit(36.0), F.when(k % 2 == 0, "S").otherwise("N"))
    return table(spark, sf_dir, "customer").select(k, F.round(score, 6).alias("score"), F.round(degrees, 9).alias("degrees"), numeric.angle_gap(k % 360, k * 7 % 360).alias("gap"))


@query("""
SELECT l_orderkey, l_linenumber, ((a + c) / 2)::INT AS cx, greatest(0, a - 10) AS x1, least(640, c + 10) AS x2, printf('%02dm%02ds', n // 30 // 60, n // 30 % 60) AS stamp FROM (
  SELECT l_orderkey, l_linenumber, (l_partkey % 600 // 2 * 2)::INT AS a, (l_partkey % 600 // 2 * 2 + l_suppkey % 40 // 2 * 2)::INT AS c, l_partkey AS n FROM lineitem)
""")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    a, c, zero = F.col("a"), F.col("c"), F.lit(0)
    rows = table(spark, sf_dir, "lineitem").withColumn("a", even(F.col("l_partkey") % 600)).withColumn("c", F.col("a") + even(F.col("l_suppkey") % 40))
    box = numeric.padded_box(a, zero, c, zero, F.lit(640), F.lit(480))
    return rows.select("l_orderkey", "l_linenumber", numeric.box_center(a, zero, c, zero)["x"].alias("cx"), box["x1"].alias("x1"), box["x2"].alias("x2"), numeric.frame_stamp(F.col("l_partkey"), F.lit(30)).alias("stamp"))


_SQL_EXIF = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS s, o_orderkey % 4 = 0 AS gps, o_orderkey % 7 AS gap FROM orders
"""


@query(f"""
SELECT o_orderkey, CASE WHEN s IS NULL THEN 'no_exif' ELSE array_to_string(list_filter([
    CASE WHEN s < 2 THEN 'editing_software' END, CASE WHEN gap > 1 THEN 'timestamp_mismatch' END, CASE WHEN gps THEN 'gps_no_camera' END, CASE WHEN gap > 1 THEN 'orientation_flag' END,
    CASE WHEN s = 2 THEN 'missing_basic_fields' END], lambda x: x IS NOT NULL), ',') END AS anomalies,
  CASE WHEN s IS NULL THEN 'stripado' WHEN s = 0 THEN 'suspeito' WHEN s = 1 OR gap > 1 OR gps OR s = 2 THEN 'inconclusivo' ELSE 'consistente' END AS exif_verdict
FROM ({_SQL_EXIF})
""")
def exif_rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.map_from_arrays(
        F.array(*map(F.lit, ("Software", "DateTimeOriginal", "DateTime", "Orientation"))),
        F.array(F.when(k % 3 == 0, "Adobe Photoshop 25").when(k % 3 == 1, "WhatsApp").otherwise(""), F.lit("2024:01:15 10:00:00"), F.concat(F.lit("2024:01:15 1"), (k % 7).cast("string"), F.lit(":00:00")), (k % 7).cast("string")),
    )
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 5 != 0, tags).alias("exif"), (k % 4 == 0).alias("gps"))
    out = exif_rules.judge(rows, "exif", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), "gps")
    return out.select("o_orderkey", F.array_join(F.transform("anomalies", lambda a: a["type"]), ",").alias("anomalies"), "exif_verdict")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Analyze ' || p_name || ' by ' || p_brand ELSE 'Look {nothing} ' || '{name}' END AS prompt FROM part")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.col("p_size") > 25, "Analyze {name} by {brand}").otherwise("Look {nothing} {name}")
    return table(spark, sf_dir, "part").select("p_partkey", text.template_filled(template, {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("prompt"))


# --- reports --------------------------------------------------------------------------------------


_SQL_REPORT = """
SELECT doc_id, '# doc ' || doc_id || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || coalesce(nullif(text, ''), 'Não disponível.') || chr(10) || chr(10) || '## Quality' || chr(10) || chr(10) || coalesce(quality::VARCHAR, 'Não disponível.') || chr(10) AS markdown
FROM documents LEFT JOIN labels USING (doc_id)
"""


@query(_SQL_REPORT)
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    body = reports.markdown(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), {"Text": F.col("text"), "Quality": F.col("quality").cast("string")})
    return both.select("doc_id", body.alias("markdown"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS payload FROM customer")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", reports.json_payload(name=F.col("c_name"), nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("payload"))


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#39;')"


@query(f"""
SELECT page_id, '<!DOCTYPE html><html><head><meta charset="utf-8"><style>h1{{color:#1f2937}}</style><title>' || {_sql_escaped("url")} || '</title></head><body><h1>' || {_sql_escaped("url")} || '</h1><h2>Source</h2><pre>'
  || {_sql_escaped("coalesce(nullif(html, ''), 'Não disponível.')")} || '</pre></body></html>' AS page FROM pages
""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", reports.html(F.col("url"), {"Source": F.col("html")}).alias("page"))


@query("""
SELECT o_orderstatus AS "group", min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS first, count(*) OVER (PARTITION BY o_orderstatus) AS n, i AS pos, '### report_' || i || chr(10) || o_orderpriority AS section
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders)
""")
def report_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.consolidated(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderstatus", "group")


_SQL_BOTH = f"(SELECT id, question || chr(10) || answer AS t FROM ({_SQL_ACCOUNTS}))"


@query(f"""
SELECT c.id, d.question AS normalized_text, document_type, threat_type, tags, confidence, score, odd, verdict, coalesce(entities, '') AS entities
FROM ({_SQL_ACCOUNTS}) d JOIN ({_sql_classified(f"SELECT * FROM {_SQL_BOTH}")}) c USING (id) JOIN ({_sql_consistent(_SQL_ACCOUNTS)}) v USING (id)
LEFT JOIN (SELECT id, string_agg(type || '=' || normalized || '@' || start, ',' ORDER BY seq) AS entities FROM ({_sql_entity_rows(_SQL_BOTH)}) GROUP BY id) e USING (id)
""")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.process(_accounts(spark, sf_dir).withColumn("exif", F.lit("")), "id", "question", "answer", "exif")
    found = F.transform("entities", lambda e: F.concat(e["type"], F.lit("="), e["normalized"], F.lit("@"), e["start"].cast("string")))
    return rows.select(
        "id", "normalized_text", "classification.document_type", "classification.threat_type", F.array_join("classification.context_tags", ",").alias("tags"), "classification.confidence",
        "validation.score", F.array_join("validation.inconsistencies", ",").alias("odd"), "validation.verdict", F.array_join(found, ",").alias("entities"),
    )


@query("""
SELECT p_partkey, CASE WHEN n < 5 AND n / 10 < 0.5 THEN 'sem_indicios' WHEN n > 20 OR (n / 10 > 3 AND h >= 2) THEN 'suspeito' WHEN n * 2 > 1.5 * n AND h >= 1 THEN 'suspeito' WHEN n >= 5 THEN 'inconclusivo' ELSE 'indeterminado' END AS ela,
  CASE WHEN p_size % 7 >= 5 THEN 'suspeito' WHEN p_size % 7 >= 1 THEN 'inconclusivo' ELSE 'sem_indicios' END AS ghost,
  CASE WHEN p_size % 5 >= 3 THEN 'suspeito' WHEN p_size % 5 >= 1 THEN 'inconclusivo' ELSE 'sem_indicios' END AS clone,
  array_to_string(list_filter([CASE WHEN n * 4 < 100 THEN 'blurry' END, CASE WHEN n / 50 < 0.3 THEN 'dark' END, CASE WHEN n / 50 > 0.7 THEN 'bright' END, CASE WHEN n / 60 < 0.3 THEN 'flat' END], lambda x: x IS NOT NULL), ',') AS advice
FROM (SELECT *, p_size::DOUBLE AS n, p_size % 4 AS h FROM part)
""")
def forensic_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", images.recompression_verdict(n, n * 2, n / 10, F.col("p_size") % 4).alias("ela"), images.ghost_verdict(F.col("p_size") % 7).alias("ghost"),
        similarity.copy_verdict(F.col("p_size") % 5).alias("clone"), F.array_join(images.quality_advice(n * 4, n / 50, n / 60), ",").alias("advice"),
    )


# --- records and sources --------------------------------------------------------------------------


@query("SELECT 'v_' || printf('%02dm%02ds', f // 100 // 60, f // 100 % 60) || '.jpg' AS name, max(f) AS frame FROM (SELECT o_orderkey AS f FROM orders WHERE o_orderkey % 30 = 0) GROUP BY 1")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.lit(100).alias("fps"), F.lit("v").alias("stem"))
    return files.keyframes(frames, "frame", "fps", "stem")


@query("""
SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'one' ELSE replace(split_part(p_brand || '.5:' || p_size, ':', 1), '.', '') END AS short_name,
  CASE WHEN p_size % 3 = 0 THEN 'openai' ELSE 'ollama' END AS kind, CASE WHEN p_size > 30 THEN 'a' WHEN p_size > 10 THEN 'b' ELSE 'none' END AS engine, p_size % 2 = 0 AS vision FROM part
""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    full = F.when(F.col("p_brand") == "Brand#1", "Brand#1").otherwise(F.concat("p_brand", F.lit(".5:"), n.cast("string")))
    kind = records.model_type(F.when(n % 3 == 0, "gpt-x").otherwise("qwen"), "default")
    engine = records.first_available([("a", n > 30), ("b", n > 10)])
    vision = checks.vision_model(F.when(n % 2 == 0, "My-Qwen3:8b").otherwise("phi:qwen"), ["qwen", "llava"])
    return table(spark, sf_dir, "part").select("p_partkey", text.short_model_name(full, {"Brand#1": "one"}).alias("short_name"), kind.alias("kind"), engine.alias("engine"), vision.alias("vision"))


@query("""
WITH a AS (SELECT s_nationkey, round(s_acctbal)::BIGINT % 360 + 360 AS x FROM supplier), g AS (SELECT a.s_nationkey, least(abs(a.x % 360 - b.x % 360), 360 - abs(a.x % 360 - b.x % 360)) AS gap FROM a JOIN a b USING (s_nationkey)),
n AS (SELECT s_nationkey, max(gap)::DOUBLE AS max_gap FROM g GROUP BY 1), c AS (SELECT s_nationkey, count(*) AS k FROM a GROUP BY 1)
SELECT s_nationkey AS image, max_gap, CASE WHEN k < 2 THEN 'inconclusivo' WHEN max_gap > 50 THEN 'inconsistente' WHEN max_gap > 25 THEN 'inconclusivo' ELSE 'consistente' END AS verdict FROM n JOIN c USING (s_nationkey)
""")
def shadow_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = ((F.round("s_acctbal").cast("long") % 360 + 360) % 360).cast("double")
    return similarity.widest_angle(table(spark, sf_dir, "supplier").select("s_nationkey", angle.alias("angle")), "s_nationkey", "angle")


@query("""
WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS content FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, content, f.o_custkey IS NOT NULL AS success, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 0.5::DOUBLE END AS gps_lat, c_nationkey::DOUBLE AS quality_score FROM customer LEFT JOIN f ON o_custkey = c_custkey
""")
def summary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    gps = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("GPS: "), n.cast("string"), F.lit(".5, 3"))).otherwise("GPS: none")
    quality = F.concat(gps, F.lit("\nScore de qualidade (0-100): "), n.cast("string"))
    items = table(spark, sf_dir, "customer").select("c_custkey", quality.alias("q"))
    analyses = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderpriority").alias("content"))
    out = records.summary_entries(items, analyses, "c_custkey", "o_orderkey", "ok", "content", "q")
    return out.select("c_custkey", "content", "success", "gps_lat", "quality_score")


@query("SELECT n_name || CASE WHEN n_nationkey < 10 THEN '_imported' ELSE '' END AS id, true AS is_custom FROM nation")
def imported_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), "n_nationkey")
    return incremental.imported(names.select("id"), names.filter("n_nationkey < 10").select("id"), "id").select("id", "is_custom")


@query("SELECT c_custkey, 'r/' || c_name || '.md' AS path, CASE WHEN c_custkey % 3 = 0 THEN 'r/' || c_name || '.json' END AS payload_path FROM customer")
def report_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = lambda ext: F.concat(F.lit("r/"), F.col("c_name"), F.lit(ext))
    return incremental.sidecar(c.select("c_custkey", path(".md").alias("path")), c.filter("c_custkey % 3 = 0").select(path(".json").alias("path"))).select("c_custkey", "path", "payload_path")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text || ' {a} {b_1} {a}', '\\{(\\w+)\\}', 1))) AS n FROM documents")
def template_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" {a} {b_1} {a}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.template_variables(t)).alias("n"))


@query("""
SELECT p_partkey, array_to_string(list_filter(['Nitidez: ' || CASE WHEN p_size < 20 THEN 'Borrada' ELSE 'Nítida' END, 'Iluminação: ' || CASE WHEN p_size < 15 THEN 'Escura' WHEN p_size > 35 THEN 'Clara' ELSE 'Equilibrada' END,
  'Avisos: Nenhum', CASE WHEN p_size % 3 > 0 THEN 'Faces detectadas: ' || (p_size % 3) END, CASE WHEN p_size % 2 = 0 THEN 'GPS: ' || printf('%.6f, %.6f', p_size::DOUBLE, -p_size::DOUBLE) END], lambda x: x IS NOT NULL), chr(10)) AS lines FROM part
""")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    gps = F.when(n % 2 == 0, F.struct(n.cast("double").alias("lat"), (-n.cast("double")).alias("lon")))
    none = F.array().cast("array<string>")
    full = records.quality_text(n < 20, n.cast("double"), n / 50.0, F.lit(0.5), F.lit(0.1), none, n % 3, none, gps)
    kept = F.filter(F.split(full, "\n"), lambda x: ~x.startswith("Score") & ~x.startswith("Mapa"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(kept, "\n").alias("lines"))


#: Every kind of block, after a document's own text.
_BLOCKS = "\n## Head\n### Lower\n- one\n* two\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\npara one\npara two\n```\ncode\n\n# not a head\n```\nend"
_SQL_STRIP = "regexp_replace(line, '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g')"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS n FROM (SELECT doc_id, markdown || {quoted(_BLOCKS)} AS t FROM ({_SQL_REPORT}))),
s AS (SELECT *, {_SQL_STRIP} AS s, sum(starts_with({_SQL_STRIP}, '```')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS f FROM l),
k AS (SELECT *, CASE WHEN starts_with(s, '```') THEN 'fence' WHEN f % 2 = 1 THEN 'code' WHEN s = '' THEN 'blank'
  WHEN starts_with(s, '|') THEN CASE WHEN regexp_matches(s, '^\\|?(\\s*:?-+:?\\s*\\|)*\\s*:?-+:?\\s*\\|?$') THEN 'rule' ELSE 'table' END
  WHEN starts_with(s, '## ') THEN 'h2' WHEN starts_with(s, '### ') THEN 'h3' WHEN regexp_matches(s, '^[*-] ') THEN 'bullet' ELSE 'paragraph' END AS kind FROM s),
g AS (SELECT *, CASE WHEN kind IN ('h2', 'h3', 'bullet', 'fence', 'blank') OR kind IS DISTINCT FROM lag(kind) OVER w OR f <> lag(f) OVER w THEN 1 ELSE 0 END AS new FROM k WHERE kind <> 'rule' WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM g),
b AS (SELECT *, CASE kind WHEN 'code' THEN line WHEN 'h2' THEN substr(s, 4) WHEN 'h3' THEN substr(s, 5) WHEN 'bullet' THEN substr(s, 3) ELSE s END AS body FROM i WHERE kind NOT IN ('fence', 'blank')),
j AS (SELECT doc_id, island, kind, CASE kind WHEN 'paragraph' THEN string_agg(body, ' ' ORDER BY n) ELSE string_agg(body, chr(10) ORDER BY n) END AS content FROM b GROUP BY doc_id, island, kind)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS block, kind, content FROM j
""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = report_markdown(spark, sf_dir).withColumn("markdown", F.concat("markdown", F.lit(_BLOCKS)))
    return records.markdown_blocks(made, "doc_id", "markdown")
