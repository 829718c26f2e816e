"""Measures of retrieval and of answers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
#: The kinds of questions, and the floors that a sweep compares.
KINDS = ("topic", "reference", "english", "earlier", "absent")
FLOORS = (0, 0.5, 0.52, 0.53, 0.54, 0.55, 0.56, 0.57, 0.58, 0.6, 0.62, 0.65)


@dataclass(frozen=True)
class GoldQuestion:
    """A question and the regulations that answer it; none for one of kind absent."""

    question: str
    kind: str
    expected: tuple[int, ...]


def read_gold(lines: Sequence[str]) -> list[GoldQuestion]:
    """Questions written as JSON objects, one a line (question, kind, expected); an error names the line that is wrong."""
    out, seen = [], set()
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        row = json.loads(line)
        text, kind, expected = str(row.get("question") or "").strip(), row.get("kind"), row.get("expected") or []
        for wrong, why in (
            (not text, "no question"), (text in seen, "the question stands twice"), (kind not in KINDS, f"kind must be one of {', '.join(KINDS)}"),
            (not all(type(x) is int and x > 0 for x in expected), "expected must be a list of ids"),
            (kind in KINDS and (kind == "absent") != (not expected), "only absent questions have no expected regulation"),
        ):
            if wrong:
                raise ValueError(f"line {n}: {why}")
        seen.add(text)
        out.append(GoldQuestion(text, kind, tuple(expected)))
    return out


def first_rank(retrieved: Column, expected: Column) -> Column:
    """1-based place of the first retrieved id that is expected; null for none."""
    hits = F.transform(retrieved, lambda x: F.array_contains(expected, x))
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")


def first_nested_rank(nested: Column, expected: Column) -> Column:
    """The same for results that list others under them (array of arrays)."""
    hits = F.transform(nested, lambda ids: F.arrays_overlap(ids, expected))
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")


def under_newer(rank: Column, nested: Column) -> Column:
    return nested.isNotNull() & (rank.isNull() | (nested < rank))


def ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """question, rank: results (question, id, place) against expected (question, id). Questions without a hit have a null rank."""
    questions = expected.select("question").distinct()
    hits = results.join(expected, ["question", "id"]).groupBy("question").agg(F.min("place").alias("rank"))
    return questions.join(hits, "question", "left")


def recall_at(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0))


def metrics(rows: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = KS) -> DataFrame:
    """questions, recall_<k>, mrr of rows with ``rank``."""
    rank = F.col("rank")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *(recall_at(rank, k).alias(f"recall_{k}") for k in ks), reciprocal(rank).alias("mrr"))


def rejection(returned: DataFrame) -> DataFrame:
    """questions, rejected: of questions without an answer (question, returned: how many results) those that got none."""
    return returned.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("returned") == 0).alias("rejected"))


def floor_sweep(results: DataFrame, expected: DataFrame, floors: Sequence[float], k: int = 5) -> DataFrame:
    """For each floor: recall at k and mrr of what is left above it. results: question, id, similarity, place.

    Results keep their order when a floor cuts off the end, so a question's rank stays and only counts while its similarity reaches the floor."""
    questions = expected.select("question").distinct()
    first = results.join(expected, ["question", "id"]).groupBy("question").agg(F.min_by(F.struct("place", "similarity"), "place").alias("_f"))
    rows = questions.join(first, "question", "left")
    grid = F.explode(F.array(*(F.lit(float(x)) for x in floors)))
    rows = rows.select("question", "_f", grid.alias("floor")).withColumn("rank", F.when(F.col("_f.similarity") >= F.col("floor"), F.col("_f.place")))
    return metrics(rows, ["floor"], (k,))


def rejection_sweep(best: DataFrame, floors: Sequence[float]) -> DataFrame:
    """floor, absent, rejected: of questions without an answer (question, best: the highest similarity found, null for none) those that a floor leaves without results."""
    grid = best.select("best", F.explode(F.array(*(F.lit(float(x)) for x in floors))).alias("floor"))
    return grid.groupBy("floor").agg(F.count(F.lit(1)).alias("absent"), F.count_if(F.col("best").isNull() | (F.col("best") < F.col("floor"))).alias("rejected"))


def versions_sweep(candidates: DataFrame, expected: DataFrame, similarities: Sequence[float], linkages: Sequence[str] = ("best", "chain"), k: int = 5) -> DataFrame:
    """linkage, similarity, questions, recall_<k>, mrr for each way of grouping candidates (see operators.versions); an expected chunk counts where it leads
    its group. One plan for each point of the grid: a grid is a handful of points."""
    from .versions import group_versions

    out = None
    for linkage in linkages:
        for least in similarities:
            led = group_versions(candidates, least, linkage).where("under is null").select("question", F.col("chunk_id").alias("id"), (F.col("place") + 1).alias("place"))
            # a group of an issue asked for takes one place of its own, so places are counted anew
            led = led.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("place")))
            point = metrics(ranks(led, expected), (), (k,)).select(F.lit(linkage).alias("linkage"), F.lit(float(least)).alias("similarity"), "*")
            out = point if out is None else out.unionByName(point)
    return out


def eligible(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """question, eligible: whether a regulation that is expected (question, id) has a chunk (regulation_id, embedding) with a vector."""
    have = chunks.where("embedding is not null").select(F.col("regulation_id").alias("id")).distinct()
    hits = expected.join(have, "id", "left_semi").select("question").distinct().withColumn("eligible", F.lit(True))
    return expected.select("question").distinct().join(hits, "question", "left").select("question", F.coalesce("eligible", F.lit(False)).alias("eligible"))


def mean_ms(timings: DataFrame) -> DataFrame:
    """questions, ms: the mean time of a question; timings: question, ms, warm_up (whether the row only warmed the search up). 0 for none."""
    return timings.where(~F.col("warm_up")).agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.round(F.avg("ms"), 3), F.lit(0.0)).alias("ms"))


def probe_sweep(index, questions: DataFrame, k: int, probes: Sequence[int]) -> DataFrame:
    """probes, found, recall: how many of the k closest (found by probing all cells) each number of cells finds. index: operators.ann.IvfIndex."""
    exact = index.nearest_of_many(questions, k, len(index.centres)).select("question", "id")
    out = None
    for n in probes:
        hits = exact.join(index.nearest_of_many(questions, k, n).select("question", "id", F.lit(1).alias("hit")), ["question", "id"], "left")
        point = hits.agg(F.lit(n).alias("probes"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("recall"))
        out = point if out is None else out.unionByName(point)
    return out


class RecallTooLow(AssertionError):
    """The gate of an evaluation run."""


def require_recall(measured: DataFrame, least: float, k: int = 5) -> float:
    value = measured.first()[f"recall_{k}"]
    if value < least:
        raise RecallTooLow(f"recall@{k} is {value:.3f}, below {least:.3f}")
    return value


def scored_answers(rows: DataFrame) -> DataFrame:
    """rows with retrieval (source, earlier, missing; null for absent questions) and problems (array<string>, empty: passed).

    rows: expected array<long>, given array<struct<n, regulation_id, earlier array<long>>>, outcome (null: error), cited array<int>, failure,
    language, written, amounts_other, amounts_missing, unknown_citations."""
    expected = F.col("expected")
    absent = F.size(expected) == 0
    own = first_rank(F.transform("given", lambda s: s["regulation_id"]), expected)
    nested = first_nested_rank(F.transform("given", lambda s: s["earlier"]), expected)
    retrieval = F.when(absent, F.lit(None)).when(under_newer(own, nested), "earlier").when(own.isNull(), "missing").otherwise("source")
    outcome = F.when(F.col("failure").isNotNull(), F.coalesce("outcome", F.lit("error"))).otherwise(F.coalesce("outcome", F.lit("error")))
    cites = (outcome == "answered") & F.exists("given", lambda s: F.array_contains("cited", s["n"]) & F.array_contains(expected, s["regulation_id"]))
    where = F.when(retrieval == "source", "it was among the sources").when(retrieval == "earlier", "it was only named under a newer one").otherwise("the search did not find it")
    judged = ~absent & F.col("failure").isNull()
    says = lambda cond, *text: F.when(cond, F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)))
    problems = F.array_compact(F.array(
        says(F.col("failure").isNotNull(), "no model finished an answer: ", F.col("failure")),
        says(absent & outcome.isin("answered", "uncited"), "an answer was written for a subject the corpus does not cover"),
        says(judged & (outcome == "no_sources"), "the search found nothing to answer with"),
        says(judged & (outcome == "uncited"), "the answer cites no source"),
        says(judged & (outcome == "not_in_sources"), "says the sources do not answer; the expected regulation: ", where),
        says(judged & (outcome == "answered") & ~cites, "does not cite the expected regulation: ", where),
        says(judged & (F.col("written") != F.col("language")), 'written in "', F.col("written"), '", expected "', F.col("language"), '"'),
        says(judged & (F.col("amounts_missing") > 0), F.col("amounts_missing"), " amount(s) not in any source"),
        says(judged & (F.col("amounts_other") > 0), F.col("amounts_other"), " amount(s) not in the source cited for them"),
        says(judged & (F.col("unknown_citations") > 0), F.col("unknown_citations"), " citation(s) of a source that does not exist"),
    ))
    return rows.withColumns({"retrieval": retrieval, "cites_expected": cites, "problems": problems, "outcome": outcome})


def answer_summary(scores: DataFrame) -> DataFrame:
    """questions, passed, unanswered, total_ms, writers (map of model to answers): one row."""
    totals = scores.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.size("problems") == 0).alias("passed"), F.count_if(F.col("outcome") == "error").alias("unanswered"), F.coalesce(F.sum("total_ms"), F.lit(0)).alias("total_ms"))
    writers = scores.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("writers"))
    return totals.crossJoin(writers)
