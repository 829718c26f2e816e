"""Tables of the corpus made from the tables at hand. Each is one statement that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGULATIONS = """
SELECT o_orderkey AS id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Ley' WHEN '2' THEN 'Decreto' WHEN '3' THEN 'Decreto/Ley' WHEN '4' THEN 'Resolución' ELSE 'Disposición' END AS type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'S/N' WHEN o_orderkey % 19 = 0 THEN '  ' ELSE CONCAT('', o_orderkey % 500) END AS number,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS enacted_on,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) END AS gazette_date,
  CASE WHEN o_orderkey % 5 = 0 THEN '   ' ELSE o_orderpriority END AS topic,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CONCAT('Norma ', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('Resumen de ', o_custkey) END AS summary,
  CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('http://example.org/o/', o_orderkey) END AS original_text_url,
  CASE WHEN o_orderkey % 6 = 0 THEN CONCAT('http://example.org/u/', o_orderkey) END AS updated_text_url,
  CAST(o_orderkey % 9 AS INT) AS amended_by_count
FROM orders"""

#: A chunk for each vector. In ``series`` regulations have several chunks: ten labels stand for their numbers, thirty regulations share each number.
CHUNKS = """
SELECT vec_id AS id, vec_id AS regulation_id, vec_id AS ordinal, CASE WHEN vec_id % 3 = 0 THEN 'article' ELSE 'preamble' END AS section,
  CASE WHEN vec_id % 3 = 0 THEN CONCAT('Artículo ', vec_id) END AS label, CONCAT('Texto ', vec_id) AS content, embedding,
  CASE WHEN vec_id % 10 = 9 THEN 'old' ELSE 'new' END AS embedding_model
FROM embeddings"""
SERIES = CHUNKS.replace("vec_id AS regulation_id", "CAST(label + 1 + 500 * (vec_id % 30) AS BIGINT) AS regulation_id")

REGULATION_TEXTS = "SELECT o_orderkey AS regulation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'original' ELSE 'summary' END AS source, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('http://example.org/', o_orderkey) END AS source_url FROM orders WHERE o_orderstatus = 'F'"

#: Prose with citations, money, dates, marks.
PROSE = """
SELECT o_orderkey AS id, CONCAT('Según el Decreto N° ', o_orderkey % 1000, '/', 1990 + o_orderkey % 36, ' y la Ley 27.', 100 + o_orderkey % 900, ', vigente desde el ', 1 + o_orderkey % 28,
  ' de ', CASE o_orderkey % 3 WHEN 0 THEN 'enero' WHEN 1 THEN 'junio' ELSE 'diciembre' END, ' de ', 2000 + o_orderkey % 25, ', se fija $ ', CAST(floor(o_totalprice) AS BIGINT), ' [1] y U$S 1.', 100 + o_orderkey % 900,
  ',50 [2, ', 1 + o_orderkey % 9, '].', CASE WHEN o_orderkey % 2 = 0 THEN ' The rate of the act is USD 30 [3].' ELSE '' END) AS text
FROM orders"""

#: Answers of two lines, and the sources they were written from.
ANSWERS = """
SELECT o_orderkey AS question, CONCAT('Se paga $', CAST(floor(o_totalprice) AS BIGINT), ' por mes [', 1 + o_orderkey % 3, '] y U$S 30 [2].', chr(10), 'Antes eran $', 1000 + o_orderkey % 7, ' sin cita.') AS answer FROM orders"""
ANSWER_SOURCES = """
SELECT o_orderkey AS question, 1 AS n, CONCAT('El monto es de $', CAST(floor(o_totalprice) AS BIGINT), ' y de 30 días.') AS content FROM orders
UNION ALL SELECT o_orderkey, 2, CONCAT('Tabla: ', 1000 + o_orderkey % 5, ' pesos; U$S 30 por mes.') FROM orders"""

#: Raw records, one in a few of them wrong.
RECORDS = """
SELECT o_orderkey + 1 AS line, CASE WHEN o_orderkey % 50 = 0 THEN 'abc' WHEN o_orderkey % 51 = 0 THEN '0' ELSE CONCAT('', o_orderkey + 1) END AS id_norma,
  CASE WHEN o_orderkey % 53 = 0 THEN '  ' WHEN o_orderkey % 4 = 0 THEN ' Ley ' WHEN o_orderkey % 4 = 1 THEN 'Decreto' WHEN o_orderkey % 4 = 2 THEN 'DECRETO/LEY' ELSE 'Resolución' END AS tipo_norma,
  CONCAT('', o_orderkey % 500) AS numero_norma, '' AS clase_norma, 'Poder Ejecutivo' AS organismo_origen,
  CASE WHEN o_orderkey % 57 = 0 THEN '26/08/2019' WHEN o_orderkey % 58 = 0 THEN '2023-06-31' WHEN o_orderkey % 10 = 0 THEN '' ELSE CONCAT('', CAST(o_orderdate AS DATE)) END AS fecha_sancion,
  CASE WHEN o_orderkey % 61 = 0 THEN 'treinta' ELSE '12.0' END AS numero_boletin,
  CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE CONCAT('', CAST(o_orderdate AS DATE)) END AS fecha_boletin, '' AS pagina_boletin,
  CONCAT('Norma ', o_orderkey) AS titulo_resumido, o_orderpriority AS titulo_sumario, '' AS texto_resumido, '' AS observaciones,
  CASE WHEN o_orderkey % 67 = 0 THEN 'norma.htm' WHEN o_orderkey % 71 = 0 THEN 'javascript:alert(1)' WHEN o_orderkey % 2 = 0 THEN CONCAT('http://example.org/', o_orderkey) ELSE '' END AS texto_original,
  '' AS texto_actualizado, CASE WHEN o_orderkey % 73 = 0 THEN '-1' ELSE '' END AS modificada_por, '3' AS modifica_a
FROM orders"""

#: What the dataset says now: a tenth new, some fields of others changed.
CURRENT = """
SELECT id, CASE WHEN id % 23 = 0 THEN 'Decreto' ELSE type END AS type, number, enacted_on, gazette_date, topic, CASE WHEN id % 29 = 0 THEN 'Otra' ELSE title END AS title,
  CASE WHEN id % 31 = 0 THEN 'Nuevo' ELSE summary END AS summary, original_text_url, CASE WHEN id % 37 = 0 THEN NULL ELSE updated_text_url END AS updated_text_url, amended_by_count
FROM regulations"""
STORED = "SELECT * FROM regulations WHERE id % 10 <> 3"

RUNS = "SELECT ts AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, event_id FROM events"

_NAMES = {
    "regulations": REGULATIONS, "chunks": CHUNKS, "series": SERIES, "regulation_texts": REGULATION_TEXTS, "prose": PROSE, "answers": ANSWERS, "answer_sources": ANSWER_SOURCES, "records": RECORDS,
    "runs": RUNS, "current_regulations": CURRENT, "stored_regulations": STORED,
}
_BASE = ("orders", "embeddings", "events", "regulations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or a stand-in."""
    if name not in _NAMES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _NAMES[name]
    used = {b: table(spark, sf_dir, b) for b in _BASE if f"FROM {b}" in sql}
    for b in used:
        sql = sql.replace(f"FROM {b}", f"FROM {{{b}}}")
    return spark.sql(sql, **used)


def with_tables(*names: str) -> str:
    """The WITH clause that makes stand-ins for DuckDB."""
    need: list[str] = []
    for n in names:
        if n in ("current_regulations", "stored_regulations") and "regulations" not in need:
            need.append("regulations")
        if n not in need:
            need.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({_NAMES[n]})" for n in need) + "\n"
