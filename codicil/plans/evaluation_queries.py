"""Measures of retrieval and answers: labels of vectors stand for relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.operators import evaluate as E
from codicil.operators.search import nearest_of_many

from .registry import query
from .search_queries import groups_sql
from .standins import table

_RESULTS = """WITH near AS (SELECT q.vec_id AS question, q.label AS kind, c.vec_id AS id, c.label AS label, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
  results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, id) AS place FROM near) WHERE place <= 20),
  ranked AS (SELECT question, any_value(kind) AS kind, min(place) FILTER (label = kind) AS rank, arg_min(similarity, place) FILTER (label = kind) AS sim FROM results GROUP BY question)
"""
_METRICS = ", ".join(["count(*) AS questions", *(f"coalesce(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 0) AS recall_{k}" for k in E.KS), "coalesce(avg(coalesce(1.0 / rank, 0)), 0) AS mrr"])


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0")
    near = nearest_of_many(e.withColumnRenamed("vec_id", "id"), q.select(F.col("vec_id").alias("question"), "embedding"), 21)
    rows = near.where("question <> chunk_id").select("question", F.col("chunk_id").alias("id"), F.round("similarity", 6).alias("similarity"))
    from pyspark.sql import Window

    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("similarity"), "id"))).where("place <= 20")
    kinds = q.select(F.col("vec_id").alias("question"), F.col("label").alias("kind"))
    expected = kinds.join(e.select(F.col("vec_id").alias("id"), "label"), F.col("kind") == F.col("label")).select("question", "id")
    return rows, expected, kinds


@query(_RESULTS + "SELECT question, CAST(rank AS INT) AS rank FROM ranked")
def first_ranks(spark, sf_dir):
    rows, expected, _ = _results(spark, sf_dir)
    return E.ranks(rows, expected)


@query(_RESULTS + f"SELECT questions, {', '.join(f'round({c}, 9) AS {c}' for c in [*(f'recall_{k}' for k in E.KS), 'mrr'])} FROM (SELECT {_METRICS} FROM ranked)")
def recall_mrr(spark, sf_dir):
    rows, expected, _ = _results(spark, sf_dir)
    return _rounded(E.metrics(E.ranks(rows, expected)))


@query(_RESULTS + f"SELECT kind, questions, {', '.join(f'round({c}, 9) AS {c}' for c in [*(f'recall_{k}' for k in E.KS), 'mrr'])} FROM (SELECT kind, {_METRICS} FROM ranked GROUP BY kind)")
def recall_by_kind(spark, sf_dir):
    rows, expected, kinds = _results(spark, sf_dir)
    return _rounded(E.metrics(E.ranks(rows, expected).join(kinds, "question"), ["kind"]))


@query(_RESULTS + "SELECT count(*) AS questions, count(*) FILTER (n = 0) AS rejected FROM (SELECT question, count(*) FILTER (similarity >= 0.33) AS n FROM results GROUP BY question)")
def rejection(spark, sf_dir):
    rows, _, _ = _results(spark, sf_dir)
    return E.rejection(rows.groupBy("question").agg(F.count_if(F.col("similarity") >= 0.33).alias("returned")))


@query(
    _RESULTS
    + """SELECT floor, count(*) AS questions, round(avg(CASE WHEN sim >= floor AND rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_5, round(avg(CASE WHEN sim >= floor THEN 1.0 / rank ELSE 0 END), 9) AS mrr
    FROM ranked, (VALUES (CAST(0.2 AS DOUBLE)), (0.25), (0.3), (0.35)) f(floor) GROUP BY floor"""
)
def floor_sweep(spark, sf_dir):
    rows, expected, _ = _results(spark, sf_dir)
    return _rounded(E.floor_sweep(rows, expected, (0.2, 0.25, 0.3, 0.35)))


def _sweep_sql(linkage: str) -> str:
    return f"""WITH RECURSIVE near AS (SELECT q.vec_id AS k, c.vec_id AS id, c.vec_id % 97 AS regulation_id, CAST(NULL AS VARCHAR) AS enacted_on, c.embedding, c.label = q.label AS hit,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, c.vec_id) AS pos FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0),
  pool AS MATERIALIZED (SELECT * FROM near WHERE pos <= 30), grid AS (SELECT unnest([0.25, 0.3, 0.35]) AS least), {groups_sql(linkage)},
  leaders AS (SELECT k, least, arg_min(hit, pos) AS hit, home FROM groups JOIN pool USING (k, pos) GROUP BY k, least, home),
  ranked AS (SELECT k, least, min(place) FILTER (hit) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY k, least ORDER BY home) AS place FROM leaders) GROUP BY k, least)
  SELECT '{linkage}' AS linkage, CAST(least AS DOUBLE) AS similarity, count(*) AS questions, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM ranked GROUP BY least"""


@query(f"SELECT * FROM ({_sweep_sql('best')}) UNION ALL SELECT * FROM ({_sweep_sql('chain')})")
def versions_sweep(spark, sf_dir):
    """Thresholds of grouping, over the 30 nearest of each question."""
    e = table(spark, sf_dir, "embeddings")
    _, expected, _ = _results(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), "embedding")
    near = nearest_of_many(e.withColumnRenamed("vec_id", "id"), q, 30)
    c = e.select(F.col("vec_id").alias("_id"), "embedding", (F.col("vec_id") % 97).alias("regulation_id"), F.lit(None).cast("string").alias("enacted_on"))
    rows = near.join(c, near.chunk_id == c._id).withColumn("asked", F.lit(False)).drop("_id", "rank")
    return _rounded(E.versions_sweep(rows, expected, (0.25, 0.3, 0.35)))


@query("SELECT DISTINCT item_id AS question, item_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) OR item_id + 1 IN (SELECT vec_id FROM embeddings) AS eligible FROM benchmark")
def eligible_questions(spark, sf_dir):
    """Questions of whose expected regulations one has an embedded chunk."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.explode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("id"))
    return E.eligible(q, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("regulation_id"), "embedding"))


# events of answers, from orders: every sort of outcome, of places of the expected regulation and of faults
def _answers(spark, sf_dir):
    k = F.col("o_orderkey")
    own, under = F.lit(7).cast("long"), F.lit(8).cast("long")
    source = lambda n, reg, earlier: F.struct(F.lit(n).alias("n"), reg.alias("regulation_id"), earlier.alias("earlier"))
    none = F.array().cast("array<long>")
    given = F.when(k % 3 == 0, F.array(source(1, F.lit(1).cast("long"), none), source(2, own, none))).when(k % 3 == 1, F.array(source(1, under, F.array(own)), source(2, own, none))).otherwise(F.array(source(1, under, none)))
    return table(spark, sf_dir, "orders").select(
        k.alias("question"), F.when(k % 10 == 0, none).otherwise(F.array(own)).alias("expected"), given.alias("given"),
        F.when(k % 7 == 0, "no_sources").when(k % 7 == 1, "not_in_sources").when(k % 7 == 2, "uncited").when(k % 7 > 2, "answered").alias("outcome"), F.when(k % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2))).alias("cited"),
        F.when(k % 13 == 0, "overloaded").alias("failure"), F.lit("es").alias("language"), F.when(k % 11 == 0, "en").otherwise("es").alias("written"), (k % 5 == 0).cast("int").alias("amounts_missing"), F.lit(0).alias("amounts_other"),
        F.lit(0).alias("unknown_citations"), F.when(k % 2 == 0, "a").otherwise("b").alias("model"), k.alias("total_ms"),
    )


_SCORES = """WITH a AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k, k % 10 = 0 AS absent, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 'source' WHEN k % 3 = 1 THEN 'earlier' ELSE 'missing' END AS retrieval,
    CASE k % 7 WHEN 0 THEN 'no_sources' WHEN 1 THEN 'not_in_sources' WHEN 2 THEN 'uncited' ELSE 'answered' END AS outcome, k % 7 > 2 AND k % 10 <> 0 AND k % 3 < 2 AND k % 2 = 1 AS cites_expected, k % 13 = 0 AS failed FROM a),
  scored AS (SELECT k AS question, retrieval, outcome, cites_expected, CAST(failed::INT + (absent AND outcome IN ('answered', 'uncited'))::INT + (NOT absent AND NOT failed AND outcome <> 'answered')::INT
    + (NOT absent AND NOT failed AND outcome = 'answered' AND NOT cites_expected)::INT + (NOT absent AND NOT failed AND k % 11 = 0)::INT + (NOT absent AND NOT failed AND k % 5 = 0)::INT AS INT) AS problems FROM s)
"""


@query(_SCORES + "SELECT * FROM scored")
def answer_scores(spark, sf_dir):
    return E.scored_answers(_answers(spark, sf_dir)).select("question", "retrieval", "outcome", "cites_expected", F.size("problems").alias("problems"))


@query(_SCORES + "SELECT count(*) AS questions, count(*) FILTER (problems = 0) AS passed, CAST(0 AS BIGINT) AS unanswered, CAST(sum(question) AS BIGINT) AS total_ms, count(*) FILTER (question % 2 = 0) AS a, count(*) FILTER (question % 2 = 1) AS b FROM scored")
def answer_summary(spark, sf_dir):
    s = E.answer_summary(E.scored_answers(_answers(spark, sf_dir)))
    return s.select("questions", "passed", "unanswered", "total_ms", F.col("writers")["a"].alias("a"), F.col("writers")["b"].alias("b"))
