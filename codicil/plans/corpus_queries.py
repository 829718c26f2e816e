"""Ingestion, change detection, stored tables and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.functions.text import blank_to_null
from codicil.operators import changes as C
from codicil.operators import ingest as I
from codicil.operators.answers import not_yet_known
from codicil.operators.ingest import Subset
from codicil.sources import store
from codicil.streaming import limits

from .registry import query
from .standins import table, with_tables

_SUBSETS = (Subset(("ley", "Decreto/Ley")), Subset(("DECRETO",), "1998-01-01"))

_CLASSIFIED = (
    with_tables("records")
    + """, reasons AS (SELECT line, unnest(list_filter([CASE WHEN id_norma = 'abc' OR id_norma = '0' THEN 'id_norma: expected a whole number above 0' END, CASE WHEN trim(tipo_norma) = '' THEN 'tipo_norma: expected a text' END,
      CASE WHEN fecha_sancion LIKE '%/%' THEN 'fecha_sancion: expected YYYY-MM-DD' END, CASE WHEN fecha_sancion = '2023-06-31' THEN 'fecha_sancion: not a calendar date' END,
      CASE WHEN numero_boletin = 'treinta' THEN 'numero_boletin: expected a whole number from 0' END, CASE WHEN texto_original <> '' AND NOT texto_original LIKE 'http://%' THEN 'texto_original: expected an http or https URL' END,
      CASE WHEN modificada_por = '-1' THEN 'modificada_por: expected a whole number from 0' END], lambda x: x IS NOT NULL)) AS reason FROM records),
  dated AS (SELECT *, trim(tipo_norma) AS type, coalesce(try_cast(nullif(fecha_sancion, '') AS DATE), try_cast(nullif(fecha_boletin, '') AS DATE)) AS day FROM records),
  classified AS (SELECT *, CASE WHEN line IN (SELECT line FROM reasons) THEN 'rejected' WHEN lower(type) IN ('ley', 'decreto/ley') OR lower(type) = 'decreto' AND coalesce(day >= DATE '1998-01-01', FALSE) THEN 'selected' ELSE 'filtered_out' END AS status FROM dated)
"""
)


def _classified(spark, sf_dir):
    return I.classified(table(spark, sf_dir, "records"), _SUBSETS)


@query(_CLASSIFIED + "SELECT count(*) AS read, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'filtered_out') AS filtered_out, count(*) FILTER (status = 'selected') AS selected FROM classified")
def ingest_report(spark, sf_dir):
    return I.report(_classified(spark, sf_dir))


@query(_CLASSIFIED + "SELECT type, count(*) AS n FROM classified WHERE status = 'selected' GROUP BY type")
def ingest_report_by_type(spark, sf_dir):
    return I.selected_by_type(_classified(spark, sf_dir))


@query(_CLASSIFIED + "SELECT coalesce(strftime(day, '%Y'), 'unknown') AS year, count(*) AS n FROM classified WHERE status = 'selected' GROUP BY 1")
def ingest_report_by_year(spark, sf_dir):
    return I.selected_by_year(_classified(spark, sf_dir))


@query(_CLASSIFIED + "SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def ingest_report_reasons(spark, sf_dir):
    return I.rejection_reasons(_classified(spark, sf_dir))


@query(_CLASSIFIED + "SELECT c.line, id_norma AS id, (SELECT count(*) FROM reasons r WHERE r.line = c.line) AS reasons FROM classified c WHERE status = 'rejected' ORDER BY c.line LIMIT 10")
def rejected_examples(spark, sf_dir):
    return I.rejected_examples(_classified(spark, sf_dir)).select("line", "id", F.size("reasons").cast("long").alias("reasons"))


@query(_CLASSIFIED + "SELECT line, type FROM classified WHERE status = 'selected' ORDER BY line LIMIT 25")
def first_selected(spark, sf_dir):
    return I.first_selected(_classified(spark, sf_dir), 25).select("line", "type")


@query(
    _CLASSIFIED
    + """SELECT CAST(id_norma AS INT) AS id, type, numero_norma AS number, day AS effective_date, CAST(12 AS INT) AS gazette_number, nullif(texto_original, '') AS original_text_url, CAST(0 AS INT) AS amended_by_count, CAST(3 AS INT) AS amends_count
    FROM classified WHERE status = 'selected'"""
)
def parsed_records(spark, sf_dir):
    rows = _classified(spark, sf_dir).where("status = 'selected'")
    return rows.select("id", "type", "number", I.effective_date(F.col("enacted_on"), F.col("gazette_date")).alias("effective_date"), "gazette_number", "original_text_url", "amended_by_count", "amends_count")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 6 THEN NULL WHEN 5 THEN 0 WHEN 4 THEN -o_orderkey - 0.5 WHEN 3 THEN o_orderkey * 1000 ELSE o_orderkey END::DOUBLE AS number FROM orders")
def number_coercion(spark, sf_dir):
    """Keys of all orders written plainly, with a point, in blanks, with an exponent, below zero, as nothing, with a unit and in base 16, and read again."""
    k = F.col("o_orderkey").cast("long")
    forms = [k.cast("string"), F.concat(k, F.lit(".0")), F.concat(F.lit(" "), k, F.lit("\t")), F.concat(k, F.lit("e3")), F.concat(F.lit("-"), k, F.lit(".5")), F.lit(" "), F.concat(k, F.lit("d")), F.concat(F.lit("0x"), F.hex(k))]
    written = F.coalesce(*(F.when(k % 8 == i, f) for i, f in enumerate(forms)))
    return table(spark, sf_dir, "orders").select(k.alias("id"), I.number(written).alias("number"))


@query(with_tables("regulations") + "SELECT id, nullif(trim(number), '') AS number, nullif(trim(topic), '') AS topic FROM regulations")
def blank_to_null_columns(spark, sf_dir):
    return table(spark, sf_dir, "regulations").select("id", blank_to_null(F.col("number")).alias("number"), blank_to_null(F.col("topic")).alias("topic"))


@query(with_tables("regulations") + "SELECT id, type, coalesce(enacted_on, gazette_date) AS day FROM regulations WHERE lower(strip_accents(type)) IN ('resolucion', 'disposicion') AND coalesce(enacted_on, gazette_date) >= DATE '1997-05-01'")
def subset_filter(spark, sf_dir):
    day = I.effective_date(F.col("enacted_on"), F.col("gazette_date"))
    rows = table(spark, sf_dir, "regulations").where(I.in_subset(Subset(("RESOLUCION", " Disposición "), "1997-05-01"), F.col("type"), day))
    return rows.select("id", "type", day.alias("day"))


_CHANGES = (
    with_tables("stored_regulations", "current_regulations")
    + """, compared AS (SELECT c.id, s.id IS NOT NULL AS there, c.updated_text_url IS DISTINCT FROM s.updated_text_url AS u, c.original_text_url IS DISTINCT FROM s.original_text_url AS o, c.amended_by_count IS DISTINCT FROM s.amended_by_count AS a,
      c.summary IS DISTINCT FROM s.summary AS m, c.type IS DISTINCT FROM s.type AS t, c.number IS DISTINCT FROM s.number AS n, c.enacted_on IS DISTINCT FROM s.enacted_on AS e, c.topic IS DISTINCT FROM s.topic AS p, c.title IS DISTINCT FROM s.title AS i
      FROM current_regulations c LEFT JOIN stored_regulations s ON c.id = s.id),
    changes AS (SELECT id, CASE WHEN NOT there THEN 'added' WHEN u OR o OR a OR m OR t OR n OR e OR p OR i THEN 'changed' ELSE 'unchanged' END AS label, CASE WHEN there THEN concat_ws(',', CASE WHEN u THEN 'updated_text_url' END, CASE WHEN o THEN 'original_text_url' END,
      CASE WHEN a THEN 'amended_by_count' END, CASE WHEN m THEN 'summary' END, CASE WHEN t THEN 'type' END, CASE WHEN n THEN 'number' END, CASE WHEN e THEN 'enacted_on' END, CASE WHEN p THEN 'topic' END, CASE WHEN i THEN 'title' END) ELSE '' END AS fields,
      there AND (u OR o OR a OR m) AS text, there AND (t OR n OR e OR p OR i) AS context FROM compared)
"""
)


def _changes(spark, sf_dir):
    return C.changes(table(spark, sf_dir, "stored_regulations"), table(spark, sf_dir, "current_regulations"))


@query(_CHANGES + "SELECT id, label, fields, text, context FROM changes")
def change_detection(spark, sf_dir):
    return _changes(spark, sf_dir).select("id", "label", F.array_join("fields", ",").alias("fields"), "text", "context")


@query(_CHANGES + "SELECT count(*) AS in_subset, count(*) FILTER (label = 'added') AS added, count(*) FILTER (label = 'changed') AS changed, count(*) FILTER (label = 'unchanged') AS unchanged FROM changes")
def change_report(spark, sf_dir):
    return C.change_report(_changes(spark, sf_dir))


@query(
    _CHANGES
    + """SELECT 'refetch' AS kind, id FROM changes WHERE label = 'changed' AND text UNION SELECT 'rechunk', id FROM changes WHERE label = 'changed' AND context AND NOT text UNION SELECT 'revector', id FROM changes WHERE label = 'changed' AND context
    UNION SELECT 'refetch', id FROM stored_regulations WHERE id % 97 = 0"""
)
def work_routing(spark, sf_dir):
    resumed = table(spark, sf_dir, "stored_regulations").where("id % 97 = 0").select(F.lit("refetch").alias("kind"), "id")
    return C.work_of(_changes(spark, sf_dir), resumed)


@query(
    with_tables("stored_regulations", "current_regulations")
    + """SELECT coalesce(c.id, s.id) AS id, CASE WHEN c.id IS NOT NULL THEN c.type ELSE s.type END AS type, CASE WHEN c.id IS NOT NULL THEN c.title ELSE s.title END AS title,
      CASE WHEN s.id IS NOT NULL THEN DATE '2020-01-01' ELSE DATE '2026-01-01' END AS created_at, CASE WHEN c.id IS NOT NULL THEN DATE '2026-01-01' ELSE DATE '2020-01-01' END AS updated_at
    FROM (SELECT * FROM current_regulations WHERE id % 2 = 0) c FULL JOIN stored_regulations s ON c.id = s.id"""
)
def upsert(spark, sf_dir):
    day = lambda s: F.lit(s).cast("date")
    old = table(spark, sf_dir, "stored_regulations").select("id", "type", "title", day("2020-01-01").alias("created_at"), day("2020-01-01").alias("updated_at"))
    new = table(spark, sf_dir, "current_regulations").where("id % 2 = 0").select("id", "type", "title")
    new = new.unionByName(new.where("id % 100 = 0"))  # twice in a batch
    import datetime

    return store.upsert(old, new, "id", now=datetime.date(2026, 1, 1))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 0 THEN 'changed' WHEN o_orderkey % 103 = 0 THEN 'replaced' ELSE o_orderstatus END AS status, part FROM orders,
      (SELECT unnest([1, 2]) AS part) WHERE o_orderkey % 101 <> 0 AND (part = 1 OR o_orderkey % 103 = 0 AND o_orderkey % 100 <> 0)
    UNION ALL SELECT DISTINCT -o_custkey, 'new', 1 FROM orders WHERE o_orderkey % 100 = 0"""
)
def bucketed_changes(spark, sf_dir):
    """A bucketed table of all orders after replacing some keys, an upsert of one in a hundred and new keys, deletes, and compaction."""
    from codicil.sources.bucketed import BucketedTable
    from codicil.sources.temporary import shared_folder

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("part"), "o_custkey")
    kept = BucketedTable(spark, f"{shared_folder(spark)}/orders", "id long, status string, part int", "id")
    kept.append(orders.drop("o_custkey"))
    some = orders.where("id % 103 = 0")
    kept.replace(some.select("id", F.lit("replaced").alias("status"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part")), some.select("id"))
    changed = orders.where("id % 100 = 0")
    kept.upsert(changed.select("id", F.lit("changed").alias("status"), "part").unionByName(changed.select((-F.col("o_custkey")).cast("long").alias("id"), F.lit("new").alias("status"), "part")))
    kept.delete(orders.where("id % 101 = 0").select("id"))
    kept.compact()
    return kept.read()


@query("SELECT doc_id, lang, length(text) AS n, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def csv_records(spark, sf_dir):
    """All documents written as CSV, line breaks in quotes, and read again in splits."""
    from codicil.sources.splits import CSV, records
    from codicil.sources.temporary import shared_folder

    path = f"{shared_folder(spark)}/documents"
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", "lang", "text")
    docs.write.options(header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = records(spark, path).where("number > 1").select(F.from_csv("raw", "doc_id string, lang string, text string", CSV).alias("r"))
    text = F.coalesce("r.text", F.lit(""))
    return rows.select(F.col("r.doc_id").cast("long").alias("doc_id"), "r.lang", F.length(text).cast("long").alias("n"), F.sha2(text, 256).alias("text_sha256"))


@query(with_tables("series") + "SELECT regulation_id, ordinal, content FROM series WHERE regulation_id NOT IN (2, 5) UNION ALL SELECT regulation_id, 0, 'nuevo' FROM (SELECT DISTINCT regulation_id FROM series WHERE regulation_id = 2)")
def replace_children(spark, sf_dir):
    old = table(spark, sf_dir, "series").select("regulation_id", "ordinal", "content")
    new = old.where("regulation_id = 2").select("regulation_id").distinct().select("regulation_id", F.lit(0).cast("long").alias("ordinal"), F.lit("nuevo").alias("content"))
    return store.replace_children(old, new, "regulation_id", old.where("regulation_id in (2, 5)"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cascade_delete(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return store.cascade(table(spark, sf_dir, "lineitem"), parents, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query(with_tables("series") + "SELECT id, CASE WHEN regulation_id NOT IN (3, 4) THEN embedding_model END AS embedding_model, regulation_id NOT IN (3, 4) AS has_vector, (SELECT count(*) FROM series WHERE regulation_id IN (3, 4)) AS forgotten FROM series")
def forget_vectors(spark, sf_dir):
    chunks = table(spark, sf_dir, "series")
    rows, count = store.forget_vectors(chunks, chunks.where("regulation_id in (3, 4)").select("regulation_id"))
    return rows.crossJoin(F.broadcast(count)).select("id", "embedding_model", F.col("embedding").isNotNull().alias("has_vector"), "forgotten")  # one row


@query("SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'new' END AS embedding_model, CASE WHEN vec_id % 4 = 0 THEN round(CAST(CAST(embedding[1] * 2 AS FLOAT) AS DOUBLE), 5) END AS first FROM embeddings")
def save_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("old").alias("embedding_model"))
    fresh = e.where("id % 4 = 0").select("id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"))
    return store.save_vectors(store.reset_vectors(e), fresh, "new").select("id", "embedding_model", F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 5).alias("first"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def without_text(spark, sf_dir):
    regs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return C.without_text(regs, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("regulation_id")).distinct())


@query("SELECT doc_id AS regulation_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS unchanged FROM documents")
def unchanged_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("regulation_id"), F.sha2("text", 256).alias("content_hash"))
    k = F.col("regulation_id")
    stored = d.where(k % 3 != 0).withColumn("content_hash", F.when(k % 4 == 0, "stale").otherwise(F.col("content_hash")))
    return C.unchanged_texts(stored, d).select("regulation_id", "unchanged")


@query(with_tables("runs") + "SELECT (SELECT event_id FROM runs ORDER BY finished_at DESC LIMIT 1) AS last_attempt, (SELECT event_id FROM runs WHERE outcome = 'ok' ORDER BY finished_at DESC LIMIT 1) AS last_success")
def latest_runs(spark, sf_dir):
    return C.latest_runs(table(spark, sf_dir, "runs")).select(F.col("last_attempt.event_id").alias("last_attempt"), F.col("last_success.event_id").alias("last_success"))


@query(
    with_tables("runs")
    + """SELECT CAST(d AS INT) AS days_since, CAST(a AS INT) AS days_since_attempt, d >= 7 AS due, CAST(greatest(0, 7 - d) AS INT) AS due_in_days, CASE WHEN o = 'failed' THEN 'failed' WHEN d > 14 THEN 'overdue' END AS warning FROM (
      SELECT floor(epoch(TIMESTAMP '2030-01-01' - max(finished_at) FILTER (outcome = 'ok')) / 86400) AS d, floor(epoch(TIMESTAMP '2030-01-01' - max(finished_at)) / 86400) AS a, arg_max(outcome, finished_at) AS o FROM runs)"""
)
def update_status(spark, sf_dir):
    return C.update_status(table(spark, sf_dir, "runs"), F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query(
    """SELECT event_id, client, ms, CAST(count(*) OVER (PARTITION BY client ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) <= 3 AS admitted FROM (
      SELECT event_id, CAST(user_id AS VARCHAR) AS client, CAST(event_id AS BIGINT) AS ms FROM events)""",
    name="rate_limit_first_requests",
)
def rate_limit_first_requests(spark, sf_dir):
    """All requests of a client lie within one window here, so the first three of each pass."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.col("event_id").alias("ms"))
    return limits.client_admissions(rows, 3, window=1 << 40).select(F.col("id").alias("event_id"), "client", "ms", "admitted")


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"))


@query(
    """WITH RECURSIVE asked AS (SELECT event_id AS id, concat('c', user_id % 20) AS client, epoch_us(ts) // 1000 AS ms FROM events),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms, id) AS i FROM asked),
  walk AS (SELECT id, client, ms, i, CAST(NULL AS BIGINT) AS before, ms AS latest, CAST(0 AS BIGINT) AS wait FROM numbered WHERE i = 1
    UNION ALL SELECT n.id, n.client, n.ms, n.i, CASE WHEN w.before > n.ms - 3600000 THEN w.before ELSE w.latest END, CASE WHEN w.before > n.ms - 3600000 THEN w.latest ELSE n.ms END,
      CASE WHEN w.before > n.ms - 3600000 THEN w.before + 3600000 - n.ms ELSE 0 END FROM walk w JOIN numbered n ON n.client = w.client AND n.i = w.i + 1)
  SELECT id, client, ms, wait = 0 AS admitted, wait AS retry_after_ms FROM walk"""
)
def rate_limit_clients(spark, sf_dir):
    return limits.client_admissions(_requests(spark, sf_dir), 2, window=3_600_000)


@query(
    """WITH RECURSIVE asked AS (SELECT event_id AS id, concat('c', user_id % 20) AS client, epoch_us(ts) // 1000 AS ms FROM events),
  numbered AS (SELECT *, row_number() OVER (ORDER BY ms, id) AS i FROM asked),
  walk AS (SELECT id, client, ms, i, CAST(NULL AS VARCHAR) AS reached, CAST(0 AS BIGINT) AS wait, [{'ms': ms, 'client': client}] AS log FROM numbered WHERE i = 1
    UNION ALL SELECT id, client, ms, i, reached, wait, CASE WHEN wait = 0 THEN list_append(live, {'ms': ms, 'client': client}) ELSE live END FROM (
      SELECT *, CASE WHEN len(own) >= 2 THEN 'client' WHEN len(live) >= 5 THEN 'total' END AS reached, CASE WHEN len(own) >= 2 THEN own[-2].ms + 3600000 - ms WHEN len(live) >= 5 THEN live[-5].ms + 3600000 - ms ELSE 0 END AS wait FROM (
        SELECT *, list_filter(live, lambda x: x.client = client) AS own FROM (SELECT n.*, list_filter(w.log, lambda x: x.ms > n.ms - 3600000) AS live FROM walk w JOIN numbered n ON n.i = w.i + 1))))
  SELECT id, client, ms, wait = 0 AS admitted, reached AS "limit", wait AS retry_after_ms FROM walk"""
)
def rate_limit_admission(spark, sf_dir):
    return limits.admissions(_requests(spark, sf_dir), 2, 5, window=3_600_000)


@query("SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 20 EXCEPT SELECT DISTINCT p_brand, p_size FROM part WHERE p_type LIKE '%A%'")
def newly_found(spark, sf_dir):
    """What a second search finds that the first didn't."""
    p = table(spark, sf_dir, "part")
    return not_yet_known(p.where("p_size > 20").select("p_brand", "p_size").distinct(), p.where("p_type LIKE '%A%'"), ["p_brand", "p_size"])
