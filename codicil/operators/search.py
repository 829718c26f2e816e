"""Search: chunks of regulations that a question cites by number, and the chunks closest to it in meaning."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.dates import states_date, written_dates
from codicil.functions.text import references, regulation_name
from codicil.functions.vectors import Embedder, checked, matrix, similarity_to

from .codes import CodeIndex
from .nearest import Best, block_for, block_of, by_blocks, slices
from .versions import LINKAGE, POOL, SIMILARITY, group_versions

DEFAULT_LIMIT, MAX_LIMIT, MIN_SIMILARITY, EF_SEARCH, MAX_EF_SEARCH, PER_REFERENCE = 8, 20, 0.55, 100, 1000, 3
RECORD_URL = "https://servicios.infoleg.gob.ar/infolegInternet/verNorma.do?id="  # fixed value: where records are published


@dataclass(frozen=True)
class Reference:
    type: str
    number: str
    year: int | None = None


@dataclass(frozen=True)
class Options:
    limit: int = DEFAULT_LIMIT
    exact: bool = True
    ef_search: int = EF_SEARCH
    min_similarity: float = MIN_SIMILARITY
    version_similarity: float | None = SIMILARITY
    version_linkage: str = LINKAGE
    references: tuple[Reference, ...] = ()
    dates: tuple[tuple[int, int, int | None], ...] = ()
    types: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None

    def checked(self) -> Options:
        """With the limit cut to MAX_LIMIT; values out of range are an error."""
        if not 0 <= self.min_similarity <= 1:
            raise ValueError(f"min_similarity must be between 0 and 1, got {self.min_similarity}")
        if self.version_similarity is not None and not 0 < self.version_similarity <= 1:
            raise ValueError(f"version_similarity must be above 0 and at most 1, got {self.version_similarity}")
        if not isinstance(self.ef_search, int) or not 1 <= self.ef_search <= MAX_EF_SEARCH:
            raise ValueError(f"ef_search must be a whole number between 1 and {MAX_EF_SEARCH}, got {self.ef_search}")
        return replace(self, limit=min(self.limit, MAX_LIMIT))

    @property
    def pool(self) -> int:
        return self.limit if self.version_similarity is None else max(self.limit, POOL)


class QueryEmbeddingError(RuntimeError):
    """The question could not be turned into a vector."""


def filters(o: Options, kind: Column, enacted_on: Column) -> Column:
    out = F.lit(True)
    if o.types:
        out = out & F.lower(kind).isin([t.strip().lower() for t in o.types])
    if o.year_from is not None:
        out = out & (enacted_on >= F.lit(f"{o.year_from:04d}-01-01").cast("date"))
    if o.year_to is not None:
        out = out & (enacted_on <= F.lit(f"{o.year_to:04d}-12-31").cast("date"))
    return out


def embedded(chunks: DataFrame, model: str) -> DataFrame:
    """Vectors of another model live in another space: they are never compared."""
    return chunks.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model))


def by_relevance() -> list[Column]:
    return [F.col("similarity").desc(), F.col("chunk_id").asc()]


def cited_regulations(regulations: DataFrame, o: Options) -> DataFrame:
    """regulation_id, citation (its number), place: the PER_REFERENCE most recent of each citation. A regulation that two citations find stands under the first."""
    rows = regulations.where(filters(o, F.col("type"), F.col("enacted_on"))).select("id", "type", "number", "enacted_on")
    asked = [(i, r.type, r.number, r.year) for i, r in enumerate(o.references)]
    wanted = rows.sparkSession.createDataFrame(asked, "citation int, r_type string, r_number string, r_year int")  # MAX_REFERENCES rows at most, by findings in one question
    found = rows.join(F.broadcast(wanted), (rows.type == wanted.r_type) & (rows.number == wanted.r_number) & (wanted.r_year.isNull() | (F.year("enacted_on") == wanted.r_year)))
    first = Window.partitionBy("citation").orderBy(F.col("enacted_on").desc_nulls_last(), "id")
    ranked = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PER_REFERENCE)
    return ranked.groupBy(F.col("id").alias("regulation_id")).agg(F.min(F.struct("citation", "place")).alias("_o")).select("regulation_id", "_o.citation", "_o.place")


def scored(chunks: DataFrame, regulations: DataFrame, model: str, vector: Sequence[float], o: Options) -> DataFrame:
    """chunk_id, regulation_id, section, ordinal, enacted_on, similarity of the chunks that pass the filters. Contents and texts stay out of this scan."""
    r = regulations.where(filters(o, F.col("type"), F.col("enacted_on"))).select(F.col("id").alias("_id"), "enacted_on")
    c = embedded(chunks, model)
    return c.join(r, c.regulation_id == r._id).select(c.id.alias("chunk_id"), "regulation_id", "section", "ordinal", "enacted_on", similarity_to(F.col("embedding"), vector).alias("similarity"))


def cited_chunks(rows: DataFrame, cited: DataFrame, limit: int) -> DataFrame:
    """Half of the limit for cited regulations; half of that for how each of them opens, one opening of each before the second of any."""
    share = math.ceil(limit / 2)
    openings = share // 2
    own = rows.join(cited, "regulation_id")
    nearest = own.orderBy(*by_relevance()).limit(share)
    if openings:
        first = Window.partitionBy("regulation_id").orderBy((F.col("section") == "article").desc(), "ordinal", "chunk_id")
        opening = own.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= openings)
        opening = opening.orderBy("turn", "citation", "place").limit(openings).drop("turn")
        rest = nearest.join(opening.select("chunk_id"), "chunk_id", "left_anti")
        count = opening.agg(F.count(F.lit(1)).alias("_n"))
        ranked = rest.withColumn("_r", F.row_number().over(Window.orderBy(*by_relevance()))).crossJoin(F.broadcast(count))  # at most ``share`` rows
        nearest = ranked.where(F.col("_r") <= share - F.col("_n")).select(*opening.columns).unionByName(opening)
    return nearest.drop("citation", "place")


def index_chunks(chunks: DataFrame, regulations: DataFrame, model: str, path: str, cells: int = 64, recall: float = 0.95) -> CodeIndex:
    """Product-quantised codes of the vectors of a model, with what searches filter by. A search ranks as many candidates exactly at least as find ``recall`` of the 10
    closest of a sample of its vectors."""
    r = regulations.select(F.col("id").alias("_id"), "type", "enacted_on")
    c = embedded(chunks, model).select("id", "regulation_id", "embedding")
    return CodeIndex.build(c.join(r, c.regulation_id == r._id).drop("_id"), path, cells).measured(10, recall)


def closest(rows: DataFrame, vector: Sequence[float], o: Options, index: CodeIndex | None) -> DataFrame:
    """chunk_id, similarity, regulation_id, enacted_on of the pool: the closest of ``rows`` (all that pass the filters), or, unless the search is to be exact,
    of what an index takes for the nearest; ef_search is how many candidates are ranked exactly, beyond what the index takes anyway."""
    if o.exact or index is None:
        return rows.orderBy(*by_relevance()).limit(o.pool).select("chunk_id", "similarity", "regulation_id", "enacted_on")
    found = index.search(vector, o.pool, o.ef_search, filters(o, F.col("type"), F.col("enacted_on")), ("regulation_id", "enacted_on"))
    return found.withColumnRenamed("id", "chunk_id").select("chunk_id", "similarity", "regulation_id", "enacted_on")


def search_by_vector(
    chunks: DataFrame, regulations: DataFrame, texts: DataFrame, model: str, vector: Sequence[float], options: Options | None = None, index: CodeIndex | None = None
) -> DataFrame:
    """The results in order: place, match, chunk_id, similarity, section, label, content, earlier_versions, and of the regulation its id, type, number,
    name, title, topic, enacted_on, text_source, url. Over all chunks that pass, or with ``index`` (see index_chunks) and without ``exact`` over an index's candidates;
    what a question cites is looked up in all chunks in any case."""
    o = (options or Options()).checked()
    rows = scored(chunks, regulations, model, vector, o)
    cited = cited_chunks(rows, cited_regulations(regulations, o), o.limit) if o.references else rows.limit(0)
    pool = closest(rows, vector, o, index)
    close = pool.where(F.col("similarity") >= o.min_similarity).join(cited.select("chunk_id"), "chunk_id", "left_anti")
    front = cited.select(F.lit(0).alias("bucket"), F.lit("reference").alias("match"), F.row_number().over(Window.orderBy(*by_relevance())).alias("place"), "chunk_id", "similarity")
    if o.version_similarity is None:
        back = close.select(F.lit(1).alias("bucket"), F.lit("semantic").alias("match"), F.row_number().over(Window.orderBy(*by_relevance())).alias("place"), "chunk_id", "similarity")
        earlier = None
    else:
        wanted = close.select("chunk_id", "similarity", "regulation_id", "enacted_on")
        c = chunks.select(F.col("id").alias("_id"), "content", "embedding")
        full = wanted.join(c, wanted.chunk_id == c._id).withColumn("asked", states_date(F.col("content"), list(o.dates))).withColumn("question", F.lit(0).cast("long"))
        grouped = group_versions(full, o.version_similarity, o.version_linkage).drop("question")
        with_similarity = grouped.join(wanted.select("chunk_id", "similarity"), "chunk_id")
        back = with_similarity.where("under is null").select(F.lit(1).alias("bucket"), F.lit("semantic").alias("match"), "place", "chunk_id", "similarity")
        earlier = with_similarity.where("under is not null")
    chosen = front.unionByName(back).orderBy("bucket", "place").limit(o.limit)
    described = describe(chunks, regulations, texts)
    out = chosen.join(described, "chunk_id")
    if earlier is None:
        nested = out.withColumn("earlier_versions", F.array().cast("array<struct<nested:int,chunk_id:bigint,regulation_id:bigint,name:string,enacted_on:date,url:string,similarity:double,text_similarity:double>>"))
    else:
        e = earlier.join(described.select("chunk_id", "regulation_id", "name", "enacted_on", "url"), "chunk_id")
        item = F.struct("nested", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("regulation_id").cast("long").alias("regulation_id"), "name", "enacted_on", "url", "similarity", "text_similarity")
        lists = e.groupBy(F.col("under").alias("_under")).agg(F.array_sort(F.collect_list(item)).alias("earlier_versions"))  # of a pool
        nested = out.join(lists, out.chunk_id == lists._under, "left").withColumn("earlier_versions", F.coalesce("earlier_versions", F.array())).drop("_under")
    return nested.withColumn("place", F.row_number().over(Window.orderBy("bucket", "place")).cast("int")).drop("bucket").orderBy("place")


def describe(chunks: DataFrame, regulations: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks with their regulation and where its text comes from."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("regulation_id").alias("_reg"), "section", "label", "content")
    r = regulations.select(F.col("id").alias("regulation_id"), "type", "number", "title", "topic", "enacted_on")
    t = texts.select(F.col("regulation_id").alias("_text"), F.col("source").alias("text_source"), "source_url")
    rows = c.join(r, c._reg == r.regulation_id).join(t, r.regulation_id == t._text, "left")
    name = regulation_name(F.col("type"), F.col("number"), F.col("enacted_on"))
    url = F.coalesce("source_url", F.concat(F.lit(RECORD_URL), F.col("regulation_id").cast("string")))
    return rows.select("chunk_id", "section", "label", "content", "regulation_id", "type", "number", name.alias("name"), "title", "topic", "enacted_on", "text_source", url.alias("url"))


def search(chunks: DataFrame, regulations: DataFrame, texts: DataFrame, embedder: Embedder, question: str, options: Options | None = None, today: datetime.date | None = None, index: CodeIndex | None = None) -> DataFrame:
    """Embeds the question, reads citations and dates out of it unless they are given, and searches."""
    o = options or Options()
    try:
        found = embedder.embed([question])
        vector = checked(found, [question], getattr(embedder, "dimensions", len(found[0]) if found else 0))[0]
    except Exception as e:
        raise QueryEmbeddingError(f'could not embed the question with "{embedder.model}"') from e
    if not o.references:
        row = chunks.sparkSession.range(1).select(references(F.lit(question), (today or datetime.date.today()).year).alias("r")).first()
        o = replace(o, references=tuple(Reference(r["type"], r["number"], r["year"]) for r in row.r))
    if not o.dates:
        o = replace(o, dates=tuple(written_dates(question)))
    return search_by_vector(chunks, regulations, texts, embedder.model, vector, o, index)


def nearest_of_many(chunks: DataFrame, questions: DataFrame, k: int, block: int = 0) -> DataFrame:
    """question, chunk_id, similarity, rank: the k closest chunks (id, embedding) of each question (question, embedding), by one scan of the chunks for each block of
    questions (see nearest.py)."""
    out = by_blocks(questions, block or block_for(k), lambda asked: _block_nearest(chunks, asked, k))
    best = Window.partitionBy("question").orderBy(*by_relevance())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block_nearest(chunks: DataFrame, asked: list, k: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(block_of(asked))

    def run(batches):
        names, q = shared.value
        best = Best(len(names), k)
        for b in slices(batches, len(names)):
            best.scan(np.asarray(b.column("id")), matrix(b.column("embedding")), q)
        yield from best.rows(names, ("question", "chunk_id", "similarity"))

    return chunks.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "question long, chunk_id long, similarity double")
