"""The combined search for a table of questions: one plan answers all of them.

Every step of a search is a join or a window by question: what each cites by number, the openings of that, the closest chunks, the floor, the groups of
issues and the cut. Options hold for all questions; what a question cites and which days it names stand in its row.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.dates import dates
from codicil.functions.text import references
from codicil.functions.vectors import Embedder, matrix

from .embed import embed_chunks
from .search import PER_REFERENCE, Options, QueryEmbeddingError, by_relevance, describe, embedded, filters, nearest_of_many
from .versions import group_versions

REFERENCES, DATES = "array<struct<type:string,number:string,year:int>>", "array<struct<year:int,month:int,day:int>>"
_EARLIER = "array<struct<nested:int,chunk_id:bigint,regulation_id:bigint,name:string,enacted_on:date,url:string,similarity:double,text_similarity:double>>"


def asked(questions: DataFrame, embedder: Callable[[], Embedder], dimensions: int, today: datetime.date | None = None) -> DataFrame:
    """question, embedding, references, dates of questions (question, text): their vectors, and what they cite and name. A question that can't be embedded is an error."""
    vectors = embed_chunks(questions.select(F.col("question").cast("long").alias("id"), F.col("text").alias("input")), embedder, dimensions)
    failed = F.raise_error(F.concat(F.lit(f"{QueryEmbeddingError.__name__}: could not embed question "), F.col("id").cast("string"), F.lit(": "), F.coalesce("error", F.lit("no reason given"))))
    vector = F.when(F.col("embedding").isNull(), failed.cast("array<float>")).otherwise(F.col("embedding"))
    read = questions.select(F.col("question").cast("long").alias("question"), references(F.col("text"), (today or datetime.date.today()).year).alias("references"), dates(F.col("text")).alias("dates"))
    return read.join(vectors.select(F.col("id").alias("question"), vector.alias("embedding")), "question")


def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row by row; 0 where a norm is 0."""
    x, y = matrix(a), matrix(b)
    norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    dots = np.einsum("ij,ij->i", x, y)
    return pa.array(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0))


def cited_by(questions: DataFrame, regulations: DataFrame, o: Options) -> DataFrame:
    """question, regulation_id, citation, place: of each citation of a question (question, references) the PER_REFERENCE most recent regulations; one that
    two citations of a question find stands under the first."""
    wanted = questions.select("question", F.posexplode("references").alias("citation", "_r")).select("question", "citation", F.col("_r.type").alias("_type"), F.col("_r.number").alias("_number"), F.col("_r.year").alias("_year"))
    rows = regulations.where(filters(o, F.col("type"), F.col("enacted_on"))).select("id", "type", "number", "enacted_on")
    found = rows.join(wanted, (rows.type == wanted["_type"]) & (rows.number == wanted["_number"]) & (wanted["_year"].isNull() | (F.year("enacted_on") == wanted["_year"])))
    first = Window.partitionBy("question", "citation").orderBy(F.col("enacted_on").desc_nulls_last(), "id")
    ranked = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PER_REFERENCE)
    least = F.min(F.struct("citation", "place")).alias("_o")
    return ranked.groupBy("question", F.col("id").alias("regulation_id")).agg(least).select("question", "regulation_id", "_o.citation", "_o.place")


def cited_chunks_of(own: DataFrame, limit: int) -> DataFrame:
    """question, chunk_id, similarity: of the chunks of what questions cite (question, chunk_id, regulation_id, section, ordinal, similarity, citation, place)
    half of the limit for each question; half of that for openings, one of each regulation before the second of any."""
    share = math.ceil(limit / 2)
    openings = share // 2
    by, near = Window.partitionBy("question"), Window.partitionBy("question").orderBy(*by_relevance())
    start = Window.partitionBy("question", "regulation_id").orderBy((F.col("section") == "article").desc(), "ordinal", "chunk_id")
    rows = own.withColumn("_turn", F.row_number().over(start)).withColumn("_near", F.row_number().over(near))
    rows = rows.withColumn("_open", F.row_number().over(by.orderBy("_turn", "citation", "place")))
    rows = rows.withColumn("_opens", (F.col("_turn") <= openings) & (F.col("_open") <= openings)).where(F.col("_opens") | (F.col("_near") <= share))
    rest = F.sum((~F.col("_opens")).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_rest", rest).withColumn("_n", F.sum(F.col("_opens").cast("int")).over(by))
    return rows.where(F.col("_opens") | (F.col("_rest") <= share - F.col("_n"))).select("question", "chunk_id", "similarity")


def states_any(found: Column, wanted: Column) -> Column:
    """Whether one of the dates found is one of those wanted; one wanted without a day is met by any day of its month."""
    same = lambda x, w: (x["year"] == w["year"]) & (x["month"] == w["month"]) & (w["day"].isNull() | F.coalesce(x["day"] == w["day"], F.lit(False)))
    return F.coalesce(F.exists(found, lambda x: F.exists(wanted, lambda w: same(x, w))), F.lit(False))


def search_many(chunks: DataFrame, regulations: DataFrame, texts: DataFrame, model: str, questions: DataFrame, options: Options | None = None) -> DataFrame:
    """The results of each question (question, embedding, references, dates; see asked()): question, and what search_by_vector returns. Exact. The references and
    dates of ``options`` are not read."""
    o = (options or Options()).checked()
    q = questions.select(F.col("question").cast("long").alias("question"), F.col("embedding").cast("array<double>").alias("_q"), F.col("references").cast(REFERENCES).alias("references"), F.col("dates").cast(DATES).alias("dates"))
    r = regulations.where(filters(o, F.col("type"), F.col("enacted_on"))).select(F.col("id").alias("_id"), "enacted_on")
    c = embedded(chunks, model)
    passing = c.join(r, c.regulation_id == r._id).drop("_id")

    cited = cited_by(q, regulations, o).join(q.select("question", "_q"), "question")
    own = passing.select(F.col("id").alias("chunk_id"), "regulation_id", "section", "ordinal", F.col("embedding").cast("array<double>").alias("_e")).hint("merge").join(cited, "regulation_id")
    front = cited_chunks_of(own.withColumn("similarity", F.arrow_udf(_cosine, "double")("_e", "_q")).drop("_e", "_q"), o.limit)
    pool = nearest_of_many(passing.select("id", "embedding"), q.select("question", F.col("_q").alias("embedding")), o.pool).drop("rank")
    close = pool.where(F.col("similarity") >= o.min_similarity).join(front.select("question", "chunk_id"), ["question", "chunk_id"], "left_anti")
    ranked = F.row_number().over(Window.partitionBy("question").orderBy(*by_relevance()))
    columns = lambda bucket, match, place: ["question", F.lit(bucket).alias("bucket"), F.lit(match).alias("match"), place.alias("place"), "chunk_id", "similarity"]
    if o.version_similarity is None:
        back, earlier = close.select(*columns(1, "semantic", ranked)), None
    else:
        content = passing.select(F.col("id").alias("chunk_id"), "regulation_id", "enacted_on", "content", "embedding")
        full = close.join(content.hint("merge"), "chunk_id").join(q.select("question", "dates"), "question")
        # a text is only read where the question names a day
        full = full.withColumn("asked", states_any(dates(F.when(F.size("dates") > 0, F.col("content"))), F.col("dates")))
        grouped = group_versions(full, o.version_similarity, o.version_linkage).join(close, ["question", "chunk_id"])
        back, earlier = grouped.where("under is null").select(*columns(1, "semantic", F.col("place"))), grouped.where("under is not null")
    every = front.select(*columns(0, "reference", ranked)).unionByName(back)
    every = every.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("bucket", "place")).cast("int")).where(F.col("place") <= o.limit).drop("bucket")
    described = describe(chunks, regulations, texts)
    out = every.join(described, "chunk_id")
    if earlier is None:
        return out.withColumn("earlier_versions", F.array().cast(_EARLIER))
    e = earlier.drop("place").join(described.select("chunk_id", "regulation_id", "name", "enacted_on", "url"), "chunk_id")
    item = F.struct("nested", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("regulation_id").cast("long").alias("regulation_id"), "name", "enacted_on", "url", "similarity", "text_similarity")
    lists = e.groupBy("question", F.col("under").alias("chunk_id")).agg(F.array_sort(F.collect_list(item)).alias("earlier_versions"))  # of a pool
    return out.join(lists, ["question", "chunk_id"], "left").withColumn("earlier_versions", F.coalesce("earlier_versions", F.array().cast(_EARLIER)))
