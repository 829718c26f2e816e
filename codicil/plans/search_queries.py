"""Search: scoring, floors, filters, citations, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.functions.vectors import cosine, similarity_to
from codicil.operators import many as M
from codicil.operators import search as S
from codicil.operators import versions as V
from codicil.operators.changes import pending
from codicil.operators.search import Options, Reference

from .registry import query
from .standins import table, with_tables

_COSINE = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_VEC0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SIM = f"round({_COSINE.format(a='embedding', b=_VEC0)}, 6)"


def _vector0(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def _rounded(c="similarity"):
    return F.round(c, 6).alias("similarity")


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), _rounded(similarity_to(F.col("embedding").cast("array<double>"), _vector0(spark, sf_dir))))


@query(f"SELECT vec_id AS chunk_id, {_SIM} AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 8")
def semantic_topk(spark, sf_dir):
    return _scores(spark, sf_dir).orderBy(*S.by_relevance()).limit(8)


@query(f"SELECT * FROM (SELECT vec_id AS chunk_id, {_SIM} AS similarity FROM embeddings) WHERE similarity >= 0.2")
def semantic_floor(spark, sf_dir):
    return _scores(spark, sf_dir).where(F.col("similarity") >= 0.2)


@query(f"SELECT a.vec_id AS id, CASE WHEN a.vec_id % 10 = 0 THEN 0 ELSE round({_COSINE.format(a='a.embedding', b='b.embedding')}, 6) END AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_cases(spark, sf_dir):
    """The cosine in plain expressions of every vector with the next one; every tenth is made a zero vector first."""
    e = table(spark, sf_dir, "embeddings")
    left = e.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("x"))
    pairs = left.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select(F.col("vec_id").alias("id"), F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


_FILTERED = f"""c.regulation_id = r.id WHERE c.embedding IS NOT NULL AND c.embedding_model = 'new' AND lower(r.type) IN ('ley', 'decreto') AND r.enacted_on BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""


@query(
    with_tables("regulations", "chunks", "regulation_texts")
    + f"""SELECT c.id AS chunk_id, round({_COSINE.format(a='c.embedding', b=_VEC0)}, 6) AS similarity, r.type, t.source AS text_source,
      coalesce(t.source_url, concat('https://servicios.infoleg.gob.ar/infolegInternet/verNorma.do?id=', r.id)) AS url
    FROM chunks c JOIN regulations r ON c.regulation_id = r.id LEFT JOIN regulation_texts t ON t.regulation_id = r.id
    WHERE c.embedding IS NOT NULL AND c.embedding_model = 'new' AND lower(r.type) IN ('ley', 'decreto') AND r.enacted_on BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
    ORDER BY 2 DESC, 1 LIMIT 20"""
)
def search_filtered(spark, sf_dir):
    chunks, regs, texts = (table(spark, sf_dir, n) for n in ("chunks", "regulations", "regulation_texts"))
    o = Options(types=(" Ley ", "DECRETO"), year_from=1996, year_to=2000)
    rows = S.scored(chunks, regs, "new", _vector0(spark, sf_dir), o).select("chunk_id", _rounded()).orderBy(*S.by_relevance()).limit(20)
    return rows.join(S.describe(chunks, regs, texts), "chunk_id").select("chunk_id", "similarity", "type", "text_source", "url")


_REFERENCES = (Reference("Decreto", "7", 1997), Reference("Ley", "8"), Reference("Resolución", "30"))
_CITED = """cited AS (SELECT id AS regulation_id, min(citation * 10 + place) AS o FROM (
    SELECT r.id, w.citation, row_number() OVER (PARTITION BY w.citation ORDER BY r.enacted_on DESC NULLS LAST, r.id) AS place
    FROM regulations r JOIN (VALUES (0, 'Decreto', '7', 1997), (1, 'Ley', '8', NULL), (2, 'Resolución', '30', NULL)) w(citation, type, number, year)
      ON r.type = w.type AND r.number = w.number AND (w.year IS NULL OR year(r.enacted_on) = w.year)) WHERE place <= 3 GROUP BY id)"""


@query(with_tables("regulations") + f", {_CITED} SELECT regulation_id, CAST(o // 10 AS INT) AS citation, CAST(o % 10 AS INT) AS place FROM cited")
def reference_lookup_top3(spark, sf_dir):
    return S.cited_regulations(table(spark, sf_dir, "regulations"), Options(references=_REFERENCES))


# regulations whose type follows from their id, cited by their numbers, and chunks spread over those of ten numbers
_BY_NUMBER = (Reference("Ley", "1"), Reference("Decreto", "2"), Reference("Ley", "3"))
_SERIES_REGS = """series_regulations AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Decreto' ELSE 'Ley' END AS type, number, enacted_on, topic, title FROM regulations)"""
_SCORED = f"""scored AS (SELECT c.id AS chunk_id, c.regulation_id, c.section, c.ordinal, {_COSINE.format(a='c.embedding', b=_VEC0)} AS similarity
    FROM series c JOIN series_regulations r ON c.regulation_id = r.id WHERE c.embedding_model = 'new')"""
_OPENING = """asked AS (SELECT id, min(citation * 10 + place) AS o FROM (SELECT r.id, w.citation, row_number() OVER (PARTITION BY w.citation ORDER BY r.enacted_on DESC NULLS LAST, r.id) AS place
    FROM series_regulations r JOIN (VALUES (0, 'Ley', '1'), (1, 'Decreto', '2'), (2, 'Ley', '3')) w(citation, type, number) ON r.type = w.type AND r.number = w.number) WHERE place <= 3 GROUP BY id),
  own AS (SELECT s.*, a.o FROM scored s JOIN asked a ON s.regulation_id = a.id),
  closest AS (SELECT * FROM own ORDER BY similarity DESC, chunk_id LIMIT 4),
  opening AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY regulation_id ORDER BY (section = 'article') DESC, ordinal, chunk_id) AS turn FROM own) WHERE turn <= 2 ORDER BY turn, o LIMIT 2),
  rest AS (SELECT * FROM closest WHERE chunk_id NOT IN (SELECT chunk_id FROM opening) ORDER BY similarity DESC, chunk_id LIMIT 2),
  cited AS (SELECT chunk_id, similarity FROM rest UNION ALL SELECT chunk_id, similarity FROM opening)"""


def _series(spark, sf_dir):
    chunks = table(spark, sf_dir, "series")
    regs = table(spark, sf_dir, "regulations").withColumn("type", F.when(F.col("id") % 2 == 0, "Decreto").otherwise("Ley"))
    return chunks, regs


@query(with_tables("regulations", "series") + f", {_SERIES_REGS}, {_SCORED}, {_OPENING} SELECT chunk_id, round(similarity, 6) AS similarity FROM cited")
def cited_openings(spark, sf_dir):
    chunks, regs = _series(spark, sf_dir)
    o = Options(references=_BY_NUMBER)
    rows = S.scored(chunks, regs, "new", _vector0(spark, sf_dir), o)
    return S.cited_chunks(rows, S.cited_regulations(regs, o), o.limit).select("chunk_id", _rounded())


@query(
    with_tables("regulations", "series")
    + f""", {_SERIES_REGS}, {_SCORED}, {_OPENING},
  close AS (SELECT * FROM (SELECT chunk_id, similarity FROM scored ORDER BY similarity DESC, chunk_id LIMIT 8) WHERE similarity >= 0.1 AND chunk_id NOT IN (SELECT chunk_id FROM cited)),
  every AS (SELECT 0 AS bucket, 'reference' AS match, chunk_id, similarity FROM cited UNION ALL SELECT 1, 'semantic', chunk_id, similarity FROM close)
  SELECT CAST(row_number() OVER (ORDER BY bucket, similarity DESC, chunk_id) AS INT) AS place, match, chunk_id, round(similarity, 6) AS similarity FROM every ORDER BY 1 LIMIT 8"""
)
def cited_then_semantic(spark, sf_dir):
    chunks, regs = _series(spark, sf_dir)
    o = Options(references=_BY_NUMBER, min_similarity=0.1, version_similarity=None)
    found = S.search_by_vector(chunks, regs, table(spark, sf_dir, "regulation_texts"), "new", _vector0(spark, sf_dir), o)
    return found.select("place", "match", "chunk_id", _rounded())


# every vector whose id is divisible by 100 asks, and cites two numbers
_ASKING = """asking AS (SELECT vec_id AS question, embedding AS asking_embedding FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
  citing AS (SELECT question, 0 AS citation, 'Ley' AS type, CAST(1 + question // 100 % 10 AS VARCHAR) AS number FROM asking UNION ALL SELECT question, 1, 'Decreto', CAST(1 + (question // 100 + 3) % 10 AS VARCHAR) FROM asking WHERE question % 300 > 0)"""


def _asking(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0 and embedding is not null").withColumnRenamed("vec_id", "question")
    n = F.floor(F.col("question") / 100)
    cite = lambda kind, number: F.struct(F.lit(kind).alias("type"), number.cast("string").alias("number"), F.lit(None).cast("int").alias("year"))
    two = F.array(cite("Ley", 1 + n % 10), cite("Decreto", 1 + (n + 3) % 10))
    day = F.array(F.struct(F.lit(2000).alias("year"), F.lit(1).alias("month"), F.lit(None).cast("int").alias("day")))
    return q.select("question", "embedding", F.when(F.col("question") % 300 > 0, two).otherwise(F.slice(two, 1, 1)).alias("references"), day.alias("dates"))


@query(
    with_tables("regulations", "series")
    + f""", {_SERIES_REGS}, {_ASKING},
  scored AS (SELECT question, c.id AS chunk_id, c.regulation_id, c.section, c.ordinal, {_COSINE.format(a='c.embedding', b='asking_embedding')} AS similarity FROM asking, series c JOIN series_regulations r ON c.regulation_id = r.id WHERE c.embedding_model = 'new'),
  cited_regs AS (SELECT question, id, min(citation * 10 + place) AS o FROM (SELECT question, r.id, citation, row_number() OVER (PARTITION BY question, citation ORDER BY r.enacted_on DESC NULLS LAST, r.id) AS place
    FROM series_regulations r JOIN citing w ON r.type = w.type AND r.number = w.number) WHERE place <= 3 GROUP BY question, id),
  own AS (SELECT s.*, a.o, row_number() OVER (PARTITION BY s.question ORDER BY similarity DESC, chunk_id) AS near, row_number() OVER (PARTITION BY s.question, s.regulation_id ORDER BY (section = 'article') DESC, ordinal, chunk_id) AS turn
    FROM scored s JOIN cited_regs a ON s.regulation_id = a.id AND s.question = a.question),
  opening AS (SELECT question, chunk_id, similarity FROM own WHERE turn <= 2 QUALIFY row_number() OVER (PARTITION BY question ORDER BY turn, o) <= 2),
  counted AS (SELECT question, count(*) AS n FROM opening GROUP BY question),
  rest AS (SELECT question, chunk_id, similarity FROM (SELECT o.*, n, row_number() OVER (PARTITION BY o.question ORDER BY o.near) AS nth FROM own o JOIN counted USING (question) WHERE near <= 4 AND (o.question, o.chunk_id) NOT IN (SELECT (question, chunk_id) FROM opening)) WHERE nth <= 4 - n),
  cited AS (SELECT * FROM rest UNION ALL SELECT * FROM opening),
  close AS (SELECT question, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, chunk_id) AS p FROM scored) WHERE p <= 8 AND similarity >= 0.1 AND (question, chunk_id) NOT IN (SELECT (question, chunk_id) FROM cited)),
  every AS (SELECT 0 AS bucket, 'reference' AS match, * FROM cited UNION ALL SELECT 1, 'semantic', * FROM close)
  SELECT question, CAST(place AS INT) AS place, match, chunk_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY bucket, similarity DESC, chunk_id) AS place FROM every) WHERE place <= 8"""
)
def search_questions(spark, sf_dir):
    """The combined search for many questions in one plan."""
    chunks, regs = _series(spark, sf_dir)
    found = M.search_many(chunks, regs, table(spark, sf_dir, "regulation_texts"), "new", _asking(spark, sf_dir), Options(min_similarity=0.1, version_similarity=None))
    return found.select("question", "place", "match", "chunk_id", _rounded())


@query()
def search_questions_grouped(spark, sf_dir):
    """The same with version groups and dates."""
    chunks, regs = _series(spark, sf_dir)
    found = M.search_many(chunks, regs, table(spark, sf_dir, "regulation_texts"), "new", _asking(spark, sf_dir), Options(min_similarity=0.05, version_similarity=0.3))
    return found.select("question", "place", "match", "chunk_id", _rounded(), "name", F.size("earlier_versions").alias("earlier"))


_POOL = f"""pool AS (SELECT row_number() OVER (ORDER BY sim DESC, id) AS pos, * FROM (
    SELECT c.id, c.id % 40 AS regulation_id, r.enacted_on, c.embedding, {_COSINE.format(a='c.embedding', b=_VEC0)} AS sim FROM chunks c JOIN regulations r ON r.id = c.regulation_id ORDER BY sim DESC, c.id LIMIT 100))"""


def _pool(spark, sf_dir):
    chunks, regs = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "regulations").select(F.col("id").alias("_r"), "enacted_on")
    rows = chunks.join(regs, chunks.regulation_id == regs._r).select(chunks.id, (F.col("id") % 40).alias("regulation_id"), "enacted_on", "embedding", similarity_to(F.col("embedding").cast("array<double>"), _vector0(spark, sf_dir)).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "id").limit(100)


@query(
    with_tables("regulations", "chunks")
    + f""", {_POOL} SELECT a.id AS a, b.id AS b, round({_COSINE.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM pool a JOIN pool b ON a.pos < b.pos AND a.regulation_id <> b.regulation_id
    AND (a.enacted_on IS NULL OR b.enacted_on IS NULL OR a.enacted_on <> b.enacted_on) WHERE {_COSINE.format(a='a.embedding', b='b.embedding')} >= 0.3"""
)
def version_pairs(spark, sf_dir):
    from pyspark.sql import Window

    rows = _pool(spark, sf_dir)
    pool = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    ids = pool.select("pos", "id")
    pairs = V.version_pairs(pool, 0.3)
    return pairs.join(ids.withColumnsRenamed({"pos": "a", "id": "ia"}), "a").join(ids.withColumnsRenamed({"pos": "b", "id": "ib"}), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), _rounded())


def groups_sql(linkage: str) -> str:
    """CTEs that end in groups (k, least, pos, home): the groups of each pool (k, pos, id, regulation_id, enacted_on, embedding) for each threshold of grid (least), ``home``
    being the first member of a group. One candidate (best) or one link (chain) is taken a step."""
    pairs = f"""pairs AS MATERIALIZED (SELECT a.k, a.pos AS a, b.pos AS b, {_COSINE.format(a='a.embedding', b='b.embedding')} AS s,
    a.regulation_id <> b.regulation_id AND (a.enacted_on IS NULL OR b.enacted_on IS NULL OR a.enacted_on <> b.enacted_on) AS another FROM pool a JOIN pool b ON a.k = b.k AND a.pos < b.pos)"""
    if linkage == "best":
        steps = """steps AS MATERIALIZED (SELECT p.k, g.least, p.pos, coalesce(list(a) FILTER (s >= g.least), CAST([] AS BIGINT[])) AS near, coalesce(list(a) FILTER (NOT another), CAST([] AS BIGINT[])) AS barred
    FROM grid g CROSS JOIN pool p LEFT JOIN pairs ON pairs.k = p.k AND pairs.b = p.pos GROUP BY ALL),
  placed AS (SELECT DISTINCT k, least, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS homes FROM steps UNION ALL
    SELECT p.k, p.least, p.n + 1, list_append(homes, coalesce(list_min(list_filter(near, lambda g: homes[g] = g AND NOT list_contains(list_transform(barred, lambda j: homes[j]), g))), p.n + 1))
    FROM placed p JOIN steps s ON s.k = p.k AND s.least = p.least AND s.pos = p.n + 1)"""
    else:
        steps = """links AS MATERIALIZED (SELECT k, least, a, b, row_number() OVER (PARTITION BY k, least ORDER BY s DESC, a, b) AS n FROM grid CROSS JOIN pairs WHERE another AND s >= least),
  bars AS MATERIALIZED (SELECT k, coalesce(list([a, b]) FILTER (NOT another), CAST([] AS BIGINT[][])) AS bars FROM pool LEFT JOIN pairs USING (k) GROUP BY k),
  placed AS (SELECT k, least, CAST(0 AS BIGINT) AS n, list(pos ORDER BY pos) AS homes FROM grid CROSS JOIN pool GROUP BY k, least UNION ALL
    SELECT k, least, n, CASE WHEN x = y OR len(list_filter(bars, lambda p: least(homes[p[1]], homes[p[2]]) = x AND greatest(homes[p[1]], homes[p[2]]) = y)) > 0 THEN homes ELSE list_transform(homes, lambda h: CASE WHEN h = y THEN x ELSE h END) END
    FROM (SELECT p.k, p.least, p.n + 1 AS n, homes, bars, least(homes[a], homes[b]) AS x, greatest(homes[a], homes[b]) AS y FROM placed p JOIN links l ON l.k = p.k AND l.least = p.least AND l.n = p.n + 1 JOIN bars ON bars.k = p.k))"""
    return pairs + ",\n  " + steps + """,
  groups AS (SELECT k, least, unnest(homes) AS home, generate_subscripts(homes, 1) AS pos FROM (SELECT k, least, arg_max(homes, n) AS homes FROM placed GROUP BY k, least))"""


def _groups_sql(linkage: str) -> str:
    return (
        with_tables("regulations", "chunks").replace("WITH", "WITH RECURSIVE", 1)
        + f""", {_POOL.replace("AS pos, *", "AS pos, 0 AS k, *")}, grid AS (SELECT 0.3 AS least), {groups_sql(linkage)},
  led AS (SELECT *, dense_rank() OVER (ORDER BY home) - 1 AS place, first_value(id) OVER g AS under, first_value(embedding) OVER g AS leader, row_number() OVER g AS n FROM groups JOIN pool USING (k, pos)
    WINDOW g AS (PARTITION BY home ORDER BY coalesce(CAST(enacted_on AS VARCHAR), '') DESC, pos))
  SELECT CAST(0 AS BIGINT) AS question, CAST(place AS INT) AS place, id AS chunk_id, CASE WHEN n > 1 THEN under END AS under, CASE WHEN n > 1 THEN CAST(n - 2 AS INT) END AS nested,
    CASE WHEN n > 1 THEN round({_COSINE.format(a='leader', b='embedding')}, 6) END AS text_similarity FROM led"""
    )


def _grouped(spark, sf_dir, linkage):
    rows = _pool(spark, sf_dir).select(F.lit(0).cast("long").alias("question"), F.col("id").alias("chunk_id"), "similarity", "regulation_id", "enacted_on", "embedding", F.lit(False).alias("asked"))
    return V.group_versions(rows, 0.3, linkage).withColumn("text_similarity", F.round("text_similarity", 6))


@query(_groups_sql("best"))
def version_groups_best(spark, sf_dir):
    return _grouped(spark, sf_dir, "best")


@query(_groups_sql("chain"))
def version_groups_chain(spark, sf_dir):
    return _grouped(spark, sf_dir, "chain")


@query()
def search_grouped(spark, sf_dir):
    """The whole search with version groups, citations and dates."""
    chunks, regs = _series(spark, sf_dir)
    o = Options(references=_BY_NUMBER, min_similarity=0.05, version_similarity=0.3, dates=((2000, 1, None),))
    found = S.search_by_vector(chunks, regs, table(spark, sf_dir, "regulation_texts"), "new", _vector0(spark, sf_dir), o)
    return found.select("place", "match", "chunk_id", _rounded(), "name", F.size("earlier_versions").alias("earlier"))


@query(
    f"""SELECT question, chunk_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS question, c.vec_id AS chunk_id, {_COSINE.format(a='c.embedding', b='q.embedding')} AS sim,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format(a='c.embedding', b='q.embedding')} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5"""
)
def nearest_of_many(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "embedding")
    return S.nearest_of_many(e.withColumnRenamed("vec_id", "id"), q, 5).select("question", "chunk_id", _rounded(), "rank")


@query(with_tables("chunks") + "SELECT id, regulation_id FROM chunks WHERE embedding IS NULL OR embedding_model <> 'new'")
def pending_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where(pending(F.col("embedding"), F.col("embedding_model"), "new")).select("id", "regulation_id")


@query(with_tables("chunks") + "SELECT count(*) AS n FROM chunks WHERE embedding IS NULL OR embedding_model <> 'new'")
def count_pending(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where(pending(F.col("embedding"), F.col("embedding_model"), "new")).agg(F.count(F.lit(1)).alias("n"))


def _coded(spark, sf_dir):
    """An index of the vectors of the folder, and those whose id is divisible by 100 as questions."""
    from codicil.operators.codes import CodeIndex
    from codicil.sources.temporary import shared_folder

    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return CodeIndex.build(e, shared_folder(spark)), e.where("id % 100 = 0 and embedding is not null").select(F.col("id").alias("question"), "embedding")


@query()
def ann_search(spark, sf_dir):
    """The 10 nearest by codes of every vector whose id is divisible by 100, among all."""
    index, q = _coded(spark, sf_dir)
    return index.measured(10, 0.97).nearest_of_many(q, 10).select("question", "id", _rounded(), "rank")


@query(
    f"""SELECT question, id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS question, c.vec_id AS id, {_COSINE.format(a='c.embedding', b='q.embedding')} AS sim,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format(a='c.embedding', b='q.embedding')} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""
)
def ann_exact(spark, sf_dir):
    """The same by codes and the bounds of their errors, which leave nothing out."""
    index, q = _coded(spark, sf_dir)
    return index.exact_of_many(q, 10).select("question", "id", _rounded(), "rank")
