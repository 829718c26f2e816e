"""What changed between what is stored and what the dataset lists now, and the work that follows from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.sources.store import work_counts

# Fields whose change means another text, and those that stand in the heading of chunks.
TEXT_FIELDS = ("updated_text_url", "original_text_url", "amended_by_count", "summary")
CONTEXT_FIELDS = ("type", "number", "enacted_on", "topic", "title")


def changes(stored: DataFrame, current: DataFrame, key: str = "id", text: tuple[str, ...] = TEXT_FIELDS, context: tuple[str, ...] = CONTEXT_FIELDS) -> DataFrame:
    """current with label (added, changed, unchanged), fields (names of what changed, text fields first), text and context
    (whether such fields changed). What is only stored is left alone: nothing is ever deleted."""
    before = stored.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in (*text, *context)), F.lit(True).alias("_there"))
    both = current.join(before, current[key] == before["_k"], "left")
    names = lambda fs: [F.when(~current[f].eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fs]
    there = F.coalesce("_there", F.lit(False))
    fields = F.when(there, F.array_compact(F.array(*names(text), *names(context)))).otherwise(F.array().cast("array<string>"))
    marked = both.select(*(current[c] for c in current.columns), there.alias("_was"), fields.alias("fields"))
    any_of = lambda fs: F.exists("fields", lambda x: x.isin(*fs))
    label = F.when(~F.col("_was"), "added").when(F.size("fields") > 0, "changed").otherwise("unchanged")
    return marked.select(*current.columns, label.alias("label"), "fields", any_of(text).alias("text"), any_of(context).alias("context"))


def change_report(found: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("label") == s).alias(s)
    return found.agg(F.count(F.lit(1)).alias("in_subset"), count("added"), count("changed"), count("unchanged"))


def work_of(found: DataFrame, resumed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(kind, id), each once: refetch where the text may differ, rechunk where only the heading does, revector where the heading does;
    together with the work that a stopped run left (kind, id)."""
    kinds = F.array_compact(F.array(
        F.when(F.col("text"), F.lit("refetch")), F.when(F.col("context") & ~F.col("text"), F.lit("rechunk")), F.when(F.col("context"), F.lit("revector")),
    ))
    fresh = found.where("label = 'changed'").select(F.explode(kinds).alias("kind"), F.col(key).alias("id"))
    return (fresh.unionByName(resumed) if resumed is not None else fresh).distinct()


def without_text(regulations: DataFrame, texts: DataFrame, key: str = "id", foreign: str = "regulation_id") -> DataFrame:
    return regulations.join(texts.select(F.col(foreign).alias(key)), key, "left_anti")


def unchanged_texts(stored: DataFrame, made: DataFrame) -> DataFrame:
    """made (regulation_id, content_hash) with ``unchanged``: the stored text has the same hash."""
    s = stored.select("regulation_id", F.col("content_hash").alias("_hash"))
    return made.join(s, "regulation_id", "left").withColumn("unchanged", F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))).drop("_hash")


def pending(embedding: Column, model: Column, wanted: str) -> Column:
    """Chunks to embed: without a vector, or with one of another model (a null model is neither equal nor different)."""
    return embedding.isNull() | (model != wanted)


class UpdateIncomplete(RuntimeError):
    """The site refused: the work stays written down for the next run."""


@dataclass
class UpdateSteps:
    """What an update is made of; each step is idempotent, so a stopped run is simply run again. The work is rows throughout: a journal (kind, id), and ids (id) that
    steps join with."""

    load_unfinished: Callable[[], DataFrame]
    save_unfinished: Callable[[DataFrame | None], None]  # None: nothing is left
    found: Callable[[], DataFrame | None]  # changes(), or None if the dataset is the same
    upsert: Callable[[DataFrame], None]
    without_text: Callable[[], DataFrame]
    texts: Callable[[DataFrame, bool], dict]  # (ids, refetch) -> report, with "aborted"
    forget_vectors: Callable[[DataFrame], int]
    embed: Callable[[], dict]
    commit: Callable[[], None]


def run_update(steps: UpdateSteps, check: bool = False) -> dict:
    """Brings the corpus up to date. What a stopped run left and what this one finds are written down together before anything is touched; steps read
    their part of that journal, and the driver only sees counts."""
    resumed = steps.load_unfinished()
    found = steps.found()
    report: dict = {"resumed": work_counts(resumed), "dataset": change_report(found).first().asDict() if found is not None else None}
    if check:
        return report
    if found is not None:
        steps.save_unfinished(work_of(found, resumed))
    todo = steps.load_unfinished()
    many = work_counts(todo)
    ids = lambda kind: todo.where(F.col("kind") == kind).select("id").distinct()
    if found is not None:
        steps.upsert(found.where("label != 'unchanged'"))

    def texts(wanted: DataFrame, refetch: bool) -> dict:
        done = steps.texts(wanted, refetch)
        if done.get("aborted"):
            raise UpdateIncomplete(done["aborted"])
        return done

    new = steps.without_text()
    report["new_texts"] = None if new.isEmpty() else texts(new, False)
    report["refetched"] = texts(ids("refetch"), True) if many["refetch"] else None
    report["rechunked"] = texts(ids("rechunk"), False) if many["rechunk"] else None
    report["vectors_forgotten"] = steps.forget_vectors(ids("revector")) if many["revector"] else 0
    report["embedded"] = steps.embed()
    steps.save_unfinished(None)
    if found is not None:
        steps.commit()
    return report


UPDATE_EVERY_DAYS, OVERDUE_AFTER_DAYS = 7, 14


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row: the last run and the last that ended well (finished_at, outcome, ...), as structs; null where there is none."""
    row = F.struct(*(F.col(c) for c in runs.columns))
    ok = F.col("outcome") == "ok"
    return runs.agg(F.max_by(row, "finished_at").alias("last_attempt"), F.max_by(F.when(ok, row), F.when(ok, F.col("finished_at"))).alias("last_success"))


def update_status(runs: DataFrame, now: Column, every: int = UPDATE_EVERY_DAYS, overdue: int = OVERDUE_AFTER_DAYS) -> DataFrame:
    """days_since, days_since_attempt, due, due_in_days, warning (failed before never before overdue)."""
    last = latest_runs(runs)
    days = lambda at: F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)).cast("int")
    success, attempt = F.col("last_success.finished_at"), F.col("last_attempt.finished_at")
    since = F.when(success.isNotNull(), days(success))
    return last.select(
        since.alias("days_since"),
        F.when(attempt.isNotNull(), days(attempt)).alias("days_since_attempt"),
        (since.isNull() | (since >= every)).alias("due"),
        F.when(since.isNull(), 0).otherwise(F.greatest(F.lit(0), every - since)).alias("due_in_days"),
        F.when(F.col("last_attempt.outcome") == "failed", "failed").when(since.isNull(), "never").when(since > overdue, "overdue").alias("warning"),
    )


def described(status: DataFrame, last: DataFrame) -> DataFrame:
    """The status as text, a sentence a line; last: latest_runs()."""
    both = status.crossJoin(last)  # one row each
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    many = lambda n: F.when(n == 1, "1 day").otherwise(F.concat(n.cast("string"), F.lit(" days")))
    s, a = F.col("last_success"), F.col("last_attempt")
    what = F.when(s["dataset_changed"], F.concat(s["added"].cast("string"), F.lit(" new, "), s["changed"].cast("string"), F.lit(" changed"))).otherwise("the dataset had not changed")
    ago = F.when(F.col("days_since") == 0, "today").otherwise(F.concat(many(F.col("days_since")), F.lit(" ago")))
    first = F.when(F.col("days_since").isNull(), "No update has finished yet.").otherwise(F.concat(F.lit("Last update: "), at(s["finished_at"]), F.lit(" UTC ("), ago, F.lit("): "), what, F.lit(".")))
    failed = F.when(a["outcome"] == "failed", F.concat(F.lit("The last attempt, "), at(a["finished_at"]), F.lit(" UTC, failed: "), F.coalesce(a["error"], F.lit("no reason recorded"))))
    due = F.when(F.col("due"), "An update is due now.").otherwise(F.concat(F.lit("The next one is due in "), many(F.col("due_in_days")), F.lit(".")))
    late = F.when(F.col("warning") == "overdue", F.lit(f"Warning: more than {OVERDUE_AFTER_DAYS} days without an update."))
    return both.select(F.concat_ws("\n", first, failed, due, late).alias("description"))
