"""Scalar text operators on prose made from orders, on pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.functions import text as X
from codicil.functions.chunks import chunked
from codicil.functions.dates import dates, states_date
from codicil.functions.pages import page_text
from codicil.functions.vectors import hashed
from codicil.operators import answers as A
from codicil.operators import requests as R

from .registry import query
from .standins import table, with_tables

_AMOUNT = X.AMOUNT.replace("'", "''")
_FIGURE = X.FIGURE
_DIGITS = "regexp_replace(x, '\\D', '', 'g')"


@query(
    with_tables("regulations")
    + """SELECT id, CASE WHEN trim(coalesce(number, '')) = '' THEN type ELSE concat(type, ' ', trim(number),
      CASE WHEN lower(type) <> 'ley' AND regexp_matches(trim(number), '^[0-9]+$') AND enacted_on IS NOT NULL THEN concat('/', year(enacted_on)) ELSE '' END) END AS name FROM regulations"""
)
def regulation_names(spark, sf_dir):
    return table(spark, sf_dir, "regulations").select("id", X.regulation_name(F.col("type"), F.col("number"), F.col("enacted_on")).alias("name"))


@query(
    with_tables("regulations", "chunks")
    + """SELECT c.id, concat(concat_ws(' · ', r.type, nullif(trim(r.topic), ''), nullif(trim(r.title), ''), nullif(trim(c.label), '')), chr(10), chr(10), c.content) AS input
    FROM chunks c JOIN regulations r ON r.id = c.regulation_id"""
)
def embedding_input(spark, sf_dir):
    c, r = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "regulations").withColumnRenamed("id", "_r")
    rows = c.join(r, c.regulation_id == r._r)
    return rows.select("id", X.embedding_input(F.col("type"), F.col("topic"), F.col("title"), F.col("label"), F.col("content")).alias("input"))


@query(
    with_tables("regulations")
    + """SELECT id, concat_ws(concat(chr(10), chr(10)), CASE WHEN trim(topic) <> '' THEN topic END, concat_ws(' ', type, nullif(number, '')), title, summary) AS text,
      CASE WHEN updated_text_url IS NOT NULL THEN 'updated' WHEN original_text_url IS NOT NULL THEN 'original' END AS source, coalesce(updated_text_url, original_text_url) AS url FROM regulations"""
)
def summaries_and_sources(spark, sf_dir):
    r = table(spark, sf_dir, "regulations")
    source, url = X.picked_source(F.col("updated_text_url"), F.col("original_text_url"))
    return r.select("id", X.summary_text(F.col("type"), F.col("number"), F.col("topic"), F.col("title"), F.col("summary")).alias("text"), source.alias("source"), url.alias("url"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(
    """SELECT doc_id, CASE WHEN length(t) > 220 THEN concat(substr(t, 1, 220), '…') ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)"""
)
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def _normal_form() -> str:
    """The steps one by one; rows of filler need a pattern for each character, as there are no back-references."""
    edge = "[\\t\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
    steps = [("\\x{a0}", " "), ("[\\x00-\\x08\\x0b-\\x1f\\x{7f}-\\x{9f}\\x{fffd}]", ""), ("[ \\t]+", " "), *((f"[{c}]{{5,}}", c.replace("\\", "") * 3) for c in (".", "_", "\\-", "=", "*", "~")), ("(?:\\. ){4,}\\.?", "... ")]
    steps += [(f"(?m)^(?:{edge}*\\|{edge}*)+", ""), (f"(?m)^{edge}+|{edge}+$", ""), ("\\n{3,}", "\n\n"), (f"^(?:{edge}|\\n)+|(?:{edge}|\\n)+$", "")]
    out = "text"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


@query(_normal_form())
def normalized_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalized(F.col("text")).alias("text"))


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@query()
def chunk_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(chunked(F.col("text"))))


@query()
def hashed_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", hashed(F.col("text"), 64).alias("v"))
    return v.select("conv_id", "turn", F.posexplode("v").alias("at", "value")).where("value > 0")


@query(
    f"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(?i){X.SPANISH_MARKS}|\\b(?:{X.SPANISH_WORDS})\\b')) AS INT) AS spanish,
      CAST(len(regexp_extract_all(text, '(?i)\\b(?:{X.ENGLISH_WORDS})\\b')) AS INT) AS english,
      CASE WHEN len(regexp_extract_all(text, '(?i)\\b(?:{X.ENGLISH_WORDS})\\b')) > len(regexp_extract_all(text, '(?i){X.SPANISH_MARKS}|\\b(?:{X.SPANISH_WORDS})\\b')) THEN 'en' ELSE 'es' END AS language FROM conversations"""
)
def language_detect(spark, sf_dir):
    t = F.col("text")
    spanish, english = X.language_counts(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spanish.alias("spanish"), english.alias("english"), X.language(t).alias("language"))


@query(with_tables("prose") + f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '{_AMOUNT}', 1), lambda x: {_DIGITS}), ',') AS amounts, array_to_string(list_transform(regexp_extract_all(text, '{_FIGURE}'), lambda x: {_DIGITS}), ',') AS figures FROM prose")
def amounts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "prose").select("id", F.array_join(X.amounts(t), ",").alias("amounts"), F.array_join(X.figures(t), ",").alias("figures"))


_CITED = f"list_sort(list_distinct(list_transform(string_split(array_to_string(regexp_extract_all(text, '{X.CITATION}', 1), ','), ','), lambda x: CAST(trim(x) AS INT))))"


@query(with_tables("prose") + f"SELECT id, array_to_string(list_filter({_CITED}, lambda x: x BETWEEN 1 AND 4), ',') AS cited, array_to_string(list_filter({_CITED}, lambda x: x > 4), ',') AS unknown FROM prose")
def citation_marks(spark, sf_dir):
    cited, unknown = X.citations(F.col("text"), 4)
    return table(spark, sf_dir, "prose").select("id", F.array_join(cited, ",").alias("cited"), F.array_join(unknown, ",").alias("unknown"))


@query(
    with_tables("prose")
    + """SELECT id, 'Decreto' AS type, regexp_replace(regexp_extract(text, 'Decreto N° ([0-9]+)/', 1), '^0+([0-9])', '\\1') AS number, CAST(regexp_extract(text, 'Decreto N° [0-9]+/([0-9]{4})', 1) AS INT) AS year FROM prose
    UNION ALL SELECT id, 'Ley', replace(regexp_extract(text, 'Ley ([0-9.]+)', 1), '.', ''), NULL FROM prose"""
)
def references(spark, sf_dir):
    return table(spark, sf_dir, "prose").select("id", F.inline(X.references(F.col("text"), 2026)))


@query(
    with_tables("prose")
    + """SELECT id, CAST(regexp_extract(text, ' de ([0-9]{4}),', 1) AS INT) AS year, CASE regexp_extract(text, 'desde el [0-9]+ de ([a-z]+)', 1) WHEN 'enero' THEN 1 WHEN 'junio' THEN 6 ELSE 12 END AS month,
      CAST(regexp_extract(text, 'desde el ([0-9]+) de', 1) AS INT) AS day, CAST(regexp_extract(text, ' de ([0-9]{4}),', 1) AS INT) = 2004 AND regexp_extract(text, 'desde el [0-9]+ de ([a-z]+)', 1) = 'junio' AS asked FROM prose"""
)
def written_dates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "prose").select("id", states_date(t, [(2004, 6, None), (1999, 2, 3)]).alias("asked"), F.inline(dates(t)))


@query(
    with_tables("answers", "answer_sources")
    + """SELECT a.question, a."line", a."at", digits, cited, CASE WHEN digits = '30' THEN '2' ELSE concat_ws(',', CASE WHEN regexp_extract(s1.content, '\\$([0-9]+)', 1) = digits THEN '1' END, CASE WHEN regexp_extract(s2.content, 'Tabla: ([0-9]+)', 1) = digits THEN '2' END) END AS found_in,
      CASE WHEN digits = '30' THEN 'supported' WHEN concat_ws(',', CASE WHEN regexp_extract(s1.content, '\\$([0-9]+)', 1) = digits THEN '1' END, CASE WHEN regexp_extract(s2.content, 'Tabla: ([0-9]+)', 1) = digits THEN '2' END) = '' THEN 'not_found'
        WHEN (cited = '1' AND regexp_extract(s1.content, '\\$([0-9]+)', 1) = digits) OR (cited = '2' AND regexp_extract(s2.content, 'Tabla: ([0-9]+)', 1) = digits) THEN 'supported' ELSE 'other_source' END AS status
    FROM (SELECT question, 0 AS "line", 0 AS "at", regexp_extract(answer, 'paga \\$([0-9]+)', 1) AS digits, CASE WHEN regexp_extract(answer, 'mes \\[([0-9])', 1) = '3' THEN '' ELSE regexp_extract(answer, 'mes \\[([0-9])', 1) END AS cited FROM answers
      UNION ALL SELECT question, 0, 1, '30', '2' FROM answers UNION ALL SELECT question, 1, 0, regexp_extract(answer, 'eran \\$([0-9]+)', 1), '' FROM answers) a
    JOIN answer_sources s1 ON s1.question = a.question AND s1.n = 1 JOIN answer_sources s2 ON s2.question = a.question AND s2.n = 2"""
)
def amount_checks(spark, sf_dir):
    rows = A.check_amounts(table(spark, sf_dir, "answers"), table(spark, sf_dir, "answer_sources"))
    return rows.select("question", "line", "at", "digits", F.array_join("cited", ",").alias("cited"), F.array_join("found_in", ",").alias("found_in"), "status")


@query(
    with_tables("answers", "answer_sources")
    + """SELECT status, count(*) AS n FROM (SELECT 'supported' AS status FROM answers UNION ALL
      SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'supported' ELSE 'other_source' END FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 7 = o_orderkey % 5 THEN 'other_source' ELSE 'not_found' END FROM orders) GROUP BY status"""
)
def amount_status_counts(spark, sf_dir):
    return A.check_amounts(table(spark, sf_dir, "answers"), table(spark, sf_dir, "answer_sources")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# beginnings of answers, cut at every length as they come in; both engines read the statement
_STARTS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN '**"' WHEN 1 THEN ' ¿' ELSE '' END, substr(concat(CASE o_orderkey % 5 WHEN 0 THEN 'Las fuentes no responden la pregunta. Tratan otra cosa: '
  WHEN 1 THEN 'The sources do not answer the question' WHEN 2 THEN 'Las fuentes  dicen que no responden [1]. ' WHEN 3 THEN 'the   SOURCES do not answer' ELSE '' END, o_orderpriority), 1, CAST(o_custkey % 70 AS INT))) AS text FROM orders"""


@query(
    f"""SELECT id, CASE WHEN starts_with(start, 'las fuentes no responden la pregunta') OR starts_with(start, 'the sources do not answer the question') THEN 'not_in_sources'
      WHEN starts_with('las fuentes no responden la pregunta', start) OR starts_with('the sources do not answer the question', start) THEN 'undecided' ELSE 'answer' END AS opening
    FROM (SELECT id, regexp_replace(regexp_replace(lower(text), '^[^\\p{{L}}]+', ''), '\\s+', ' ', 'g') AS start FROM ({_STARTS}))"""
)
def openings(spark, sf_dir):
    return _from_orders(spark, sf_dir, _STARTS).select("id", X.opening(F.col("text")).alias("opening"))


def _from_orders(spark, sf_dir, sql):
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


# what models make of a question
_REWRITTEN = """SELECT o_orderkey AS id, concat('¿', substr(o_orderpriority, 3), ' de ', o_custkey, '?') AS question, CASE o_orderkey % 7 WHEN 0 THEN concat(chr(10), '  «Búsqueda: ', substr(o_orderpriority, 3), '  de  ', o_custkey, '»', chr(10), 'otra')
  WHEN 1 THEN concat('"query : ley ', o_orderkey, '"') WHEN 2 THEN '   ' WHEN 3 THEN concat('* ', o_orderpriority, ' *') WHEN 4 THEN concat(lower(substr(o_orderpriority, 3)), '  de ', o_custkey, ' !')
  WHEN 5 THEN concat('Consulta:', repeat('haber ', CAST(o_custkey % 120 AS INT))) ELSE concat('`', chr(10), chr(9), 'SEARCH:  ', o_custkey, '”', chr(10)) END AS text FROM orders"""


@query(
    f"""SELECT id, query, query <> '' AND trim(regexp_replace(lower(query), '[^\\p{{L}}0-9]+', ' ', 'g')) <> trim(regexp_replace(lower(question), '[^\\p{{L}}0-9]+', ' ', 'g')) AND regexp_matches(query, '[\\p{{L}}0-9]') AS new
    FROM (SELECT id, question, trim(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, wrap, '', 'g'), '^(?i)(?:b[uú]squeda|consulta|search|query)\\s*:\\s*', ''), wrap, '', 'g'), '\\s+', ' ', 'g'), 500)) AS query
      FROM (SELECT *, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9)))), lambda x: x <> '')[1], '') AS line, '^[\\s"''`*«»“”]+|[\\s"''`*«»“”]+$' AS wrap FROM ({_REWRITTEN})))"""
)
def rewrites(spark, sf_dir):
    q = X.search_query(F.col("text"))
    return _from_orders(spark, sf_dir, _REWRITTEN).select("id", q.alias("query"), X.is_new_query(q, F.col("question")).alias("new"))


@query(
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) - INTERVAL 5 YEAR + INTERVAL (day(o_orderdate) - 1) DAY AS DATE) AS since,
      concat(day(o_orderdate), ' de ', list_extract(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], month(o_orderdate)), ' de ', year(o_orderdate)) AS written FROM orders"""
)
def years_before_and_long_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"), X.years_before(day, 5).alias("since"), R.long_date(day).alias("written"))


@query(
    """SELECT c_custkey, c_mktsegment, lower(trim(strip_accents(concat(' ', c_mktsegment, 'Á é Ñ ')))) AS folded FROM customer"""
)
def folded_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", X.folded(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("Á é Ñ "))).alias("folded"))


@query(
    """SELECT event_id, coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), nullif(trim(real), ''), 'unknown') AS client FROM (
      SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(' 10.0.0.', user_id, ' , 10.1.1.1') WHEN event_id % 3 = 1 THEN '' END AS fwd, CASE WHEN event_id % 2 = 0 THEN concat('10.2.0.', user_id) END AS real FROM events)"""
)
def client_identities(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    fwd = F.when(e % 3 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 10.1.1.1"))).when(e % 3 == 1, F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", X.client_of(fwd, F.when(e % 2 == 0, F.concat(F.lit("10.2.0."), u))).alias("client"))


@query(
    """SELECT event_id, CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) OR status = 400 AND contains(message, 'key') THEN 'bad_key' WHEN status IN (503, 529) OR contains(message, 'overloaded') THEN 'overloaded' ELSE 'error' END AS kind FROM (
      SELECT event_id, [400, 401, 403, 429, 500, 503, 529][1 + event_id % 7] AS status, CASE user_id % 4 WHEN 0 THEN 'invalid key of user' WHEN 1 THEN 'server overloaded' WHEN 2 THEN 'no such model' ELSE '' END AS message FROM events)"""
)
def failure_kinds(spark, sf_dir):
    """Every event as a failed call, with a status and a message by its ids."""
    e, u = F.col("event_id"), F.col("user_id")
    status = F.element_at(F.array(*map(F.lit, (400, 401, 403, 429, 500, 503, 529))), (1 + e % 7).cast("int"))
    message = F.when(u % 4 == 0, F.lit("Invalid KEY of user")).when(u % 4 == 1, F.lit("Server Overloaded")).when(u % 4 == 2, F.lit("no such model"))
    return table(spark, sf_dir, "events").select("event_id", A.failure_kind(status, message).alias("kind"))


@query(
    with_tables("answers")
    + """SELECT question, CASE WHEN question % 5 = 0 THEN 'not_in_sources' WHEN question % 5 = 1 THEN 'uncited' ELSE 'answered' END AS outcome FROM answers"""
)
def answer_outcomes(spark, sf_dir):
    q = F.col("question")
    text = F.when(q % 5 == 0, F.concat(F.lit("Las fuentes no responden la pregunta. "), F.col("answer"))).when(q % 5 == 1, F.lit("Sin cita [9].")).otherwise(F.col("answer"))
    return table(spark, sf_dir, "answers").select("question", A.outcome(text, 3, X.opening(text)).alias("outcome"))


# requests, many of them with parameters that are wrong in one way or another
_REQUESTS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN concat('ley ', o_orderkey) WHEN 2 THEN '  x y ' WHEN 3 THEN repeat('impuesto', CAST(o_custkey % 80 AS INT)) END AS q,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', o_custkey % 30, ' ') WHEN 2 THEN concat(o_custkey % 4, '.', o_custkey % 2) ELSE 'ocho' END AS "limit",
  CASE o_orderkey % 3 WHEN 0 THEN concat('Ley', repeat(' , a', CAST(o_custkey % 8 AS INT))) WHEN 1 THEN repeat('Decreto', CAST(o_custkey % 9 AS INT)) END AS "type",
  CASE WHEN o_orderkey % 6 > 0 THEN concat(1790 + o_custkey % 330) ELSE '' END AS "from", CASE o_orderkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE concat(1800 + o_orderkey % 310) END AS "to",
  CASE o_orderkey % 8 WHEN 0 THEN '2' WHEN 1 THEN '-0.1' WHEN 2 THEN '' WHEN 3 THEN 'mucho' ELSE concat('0.', o_custkey % 100) END AS min_similarity,
  CASE o_orderkey % 9 WHEN 0 THEN 'off' WHEN 1 THEN '0' WHEN 2 THEN '1.1' WHEN 3 THEN ' ' WHEN 4 THEN 'on' ELSE concat('0.', 1 + o_custkey % 9) END AS versions FROM orders"""


@query(
    f"""SELECT id, array_to_string(list_filter([
        CASE WHEN length(q) NOT BETWEEN 3 AND 500 THEN 'q' END, CASE WHEN l <> '' AND NOT coalesce(n BETWEEN 1 AND 20 AND n = floor(n), FALSE) THEN 'limit' END,
        CASE WHEN len(types) > 5 OR coalesce(list_max(list_transform(types, lambda t: length(t))), 0) > 40 THEN 'type' END,
        CASE WHEN f <> '' AND NOT coalesce(a BETWEEN 1810 AND 2100 AND a = floor(a), FALSE) THEN 'from' END, CASE WHEN t <> '' AND NOT coalesce(b BETWEEN 1810 AND 2100 AND b = floor(b), FALSE) THEN 'to' END,
        CASE WHEN a > b THEN 'order' END, CASE WHEN s <> '' AND NOT coalesce(TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 1, FALSE) THEN 'min_similarity' END,
        CASE WHEN v NOT IN ('', 'off') AND NOT coalesce(TRY_CAST(v AS DOUBLE) > 0 AND TRY_CAST(v AS DOUBLE) <= 1, FALSE) THEN 'versions' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM (SELECT *, TRY_CAST(l AS DOUBLE) AS n, TRY_CAST(f AS DOUBLE) AS a, TRY_CAST(t AS DOUBLE) AS b FROM (
      SELECT id, trim(coalesce(q, '')) AS q, trim("limit") AS l, list_filter(list_transform(string_split(coalesce("type", ''), ','), lambda x: trim(x)), lambda x: x <> '') AS types, trim("from") AS f, trim(coalesce("to", '')) AS t,
        trim(min_similarity) AS s, trim(versions) AS v FROM ({_REQUESTS})))"""
)
def request_validation(spark, sf_dir):
    rows = _from_orders(spark, sf_dir, _REQUESTS.replace('"', "`"))
    return R.checked_requests(rows).select("id", F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT o_orderkey AS id, a AS year_from, b AS year_to, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 AS INT) AS filters FROM (SELECT o_orderkey, CASE WHEN ok THEN f END AS a, CASE WHEN ok THEN t END AS b FROM (
      SELECT *, coalesce(f <= t, TRUE) AS ok FROM (SELECT o_orderkey, CASE WHEN 1800 + o_orderkey % 400 BETWEEN 1810 AND 2100 THEN CAST(1800 + o_orderkey % 400 AS INT) END AS f, CASE WHEN o_orderkey % 3 > 0 THEN 2000 END AS t FROM orders)))"""
)
def lenient_filters(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("Ley").alias("type"), (1800 + k % 400).cast("string").alias("from"), F.when(k % 3 > 0, "2000").otherwise("no year").alias("to"))
    return R.lenient_filters(rows).select("id", "year_from", "year_to", "filters")


_HEADERS = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('en-US,en;q=0.', o_custkey % 10, ',es;q=0.', o_orderkey % 10) WHEN 1 THEN concat('fr, es-AR; q=0.', o_custkey % 10, ', EN;q=0.', o_orderkey % 7)
  WHEN 2 THEN concat('de;q=0.9, EN-gb;q=', o_custkey % 2, ', *') WHEN 3 THEN '' WHEN 4 THEN concat('en;q=0, ', substr('fr,es,en,', 1 + 3 * CAST(o_custkey % 3 AS INT), 2)) END AS header FROM orders"""


@query(
    f"""WITH h AS ({_HEADERS}), parts AS (SELECT id, unnest(string_split(header, ',')) AS part, generate_subscripts(string_split(header, ','), 1) AS i FROM h),
      wishes AS (SELECT id, i, lower(regexp_extract(part, '^\\s*([A-Za-z*]+)', 1)) AS tag, coalesce(TRY_CAST(regexp_extract(part, ';\\s*q=([0-9.]+)', 1) AS DOUBLE), 1.0) AS q FROM parts),
      best AS (SELECT id, tag FROM wishes WHERE q > 0 AND tag IN ('es', 'en') QUALIFY row_number() OVER (PARTITION BY id ORDER BY q DESC, i) = 1)
    SELECT h.id, coalesce(best.tag, 'es') AS locale FROM h LEFT JOIN best ON h.id = best.id"""
)
def locales(spark, sf_dir):
    return _from_orders(spark, sf_dir, _HEADERS).select("id", R.locale_of(F.col("header")).alias("locale"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '1 norma' ELSE concat(l_linenumber, ' normas') END AS counted, concat('Hay ', l_linenumber, ' de ', l_orderkey) AS line FROM lineitem")
def filled_templates(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.plural(n, "1 norma", "{n} normas").alias("counted"), R.filled(F.lit("Hay {n} de {all}"), {"n": n, "all": F.col("l_orderkey")}).alias("line"))


_STREAM = "concat('event: sources', chr(13), chr(10), 'data: ', conv_id, chr(13), chr(10), chr(13), chr(10), ': ping', chr(10), chr(10), 'event: text', chr(10), 'data: a', chr(10), 'data: b', turn, chr(10), chr(10), 'event: odd', chr(10), 'data: x', chr(10), chr(10), 'event: done', chr(10), 'data: {}')"


@query("SELECT conv_id, turn, 'sources' AS event, concat('', conv_id) AS data FROM conversations UNION ALL SELECT conv_id, turn, 'text', concat('a', chr(10), 'b', turn) FROM conversations UNION ALL SELECT conv_id, turn, 'done', '{}' FROM conversations")
def parsed_events(spark, sf_dir):
    streams = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_STREAM).alias("text"))
    return A.parsed_events(streams).select("conv_id", "turn", "event", "data")


@query("SELECT conv_id, turn, concat('event: text', chr(10), 'data: ', replace(text, chr(10), concat(chr(10), 'data: ')), chr(10), chr(10)) AS event FROM conversations")
def formatted_events(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.formatted_event(F.lit("text"), F.col("text")).alias("event"))


@query(with_tables("answers") + "SELECT question, CAST(0 AS INT) AS block, 'paragraph' AS kind, split_part(answer, chr(10), 1) AS content FROM answers UNION ALL SELECT question, 1, 'item', split_part(answer, chr(10), 2) FROM answers")
def answer_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "answers").withColumn("answer", F.replace("answer", F.lit("\n"), F.lit("\n\n - ")))
    return A.answer_blocks(rows)


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (
      SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE n <= 3"""
)
def keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return A.keep_last(rows, "user_id", "event_type", "event_id", 3)


@query(
    """SELECT conv_id AS question, CAST(max(turn) AS VARCHAR) AS sources, string_agg(concat(turn, ';'), '' ORDER BY turn) AS text, CAST(NULL AS VARCHAR) AS rewritten, count(*) AS skipped,
      CASE WHEN conv_id % 3 = 0 THEN 'failed' WHEN conv_id % 3 = 1 THEN 'done' ELSE 'writing' END AS state FROM conversations GROUP BY conv_id"""
)
def answer_views(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), "turn")
    event = lambda kind, shift, data: t.select("question", (F.col("turn") * 10 + shift).alias("at"), F.lit(kind).alias("event"), data.alias("data"))
    turn = F.col("turn").cast("string")
    events = event("sources", 0, turn).unionByName(event("skipped", 1, turn)).unionByName(event("text", 2, F.concat(turn, F.lit(";"))))
    for rest, kind in ((0, "error"), (1, "done")):
        events = events.unionByName(event(kind, 3, turn).where(F.col("question") % 3 == rest))
    return A.answer_views(events)


@query(
    """SELECT o_custkey AS question, n, title, subject, CAST(least(6, o_orderkey % 9) AS INT) AS earlier, CAST(greatest(0, o_orderkey % 9 - 6) AS INT) AS earlier_omitted FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n, concat('Ley ', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' · Artículo 1' ELSE '' END) AS title,
      CASE WHEN o_orderkey % 3 = 0 THEN 'tema / norma' WHEN o_orderkey % 3 = 1 THEN 'tema' END AS subject FROM orders) WHERE n <= 8"""
)
def numbered_sources(spark, sf_dir):
    k = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("question"), k.alias("place"), F.concat(F.lit("Ley "), k.cast("string")).alias("name"), F.when(k % 2 == 0, "Artículo 1").alias("label"), F.when(k % 3 < 2, "tema").alias("topic"),
        F.when(k % 3 == 0, "norma").alias("title"), F.array_repeat(k, (k % 9).cast("int")).alias("earlier_versions"),
    )
    out = A.numbered_sources(hits)
    return out.select("question", "n", F.col("source_title").alias("title"), "subject", F.size("earlier").alias("earlier"), "earlier_omitted")
