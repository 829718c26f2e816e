"""Commands over a folder of versioned tables: ingest, texts, embed, update, search, answer, evaluate, status, maintain.

python -m codicil COMMAND --store FOLDER ...; each prints JSON lines."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGULATIONS = (
    "id int, type string, number string, class string, issuing_body string, enacted_on date, gazette_number int, gazette_date date, gazette_page int, title string, topic string, summary string, notes string, "
    "original_text_url string, updated_text_url string, amended_by_count int, amends_count int, created_at timestamp, updated_at timestamp"
)
TEXTS = "regulation_id int, source string, source_url string, content string, content_hash string"
CHUNKS = "id long, regulation_id int, ordinal int, section string, label string, content string, embedding array<float>, embedding_model string"
UNFINISHED = "kind string, id int"
RUNS = "finished_at timestamp, outcome string, dataset_changed boolean, added int, changed int, error string"


def say(rows: DataFrame) -> None:
    for line in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        print(line[0])


def stores(spark: SparkSession, folder: str):
    from codicil.sources.bucketed import BucketedTable
    from codicil.sources.store import VersionedTable

    keyed = (("regulations", REGULATIONS, "id"), ("texts", TEXTS, "regulation_id"), ("chunks", CHUNKS, "regulation_id"))
    return [*(BucketedTable(spark, f"{folder}/{name}", schema, key) for name, schema, key in keyed), VersionedTable(spark, f"{folder}/runs", RUNS)]


def records_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The records of a CSV file or an archive, which is unpacked in the store's folder: executors read it too."""
    from codicil.sources.records import read_records, resolve_csv

    return read_records(spark, resolve_csv(a.records, f"{a.store}/incoming"))


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    from codicil.operators import ingest as I
    from codicil.operators.changes import change_report, changes

    regulations, _, _, runs = stores(spark, a.store)
    subset = I.Subset(tuple(a.type or ()), a.since)
    rows = I.classified(records_of(spark, a), (subset,))
    say(I.report(rows))
    for part in (I.selected_by_type(rows), I.rejection_reasons(rows), I.rejected_examples(rows)):
        say(part)
    chosen = rows.where("status = 'selected'")
    now = (I.first_selected(rows, a.limit) if a.limit else chosen).select("line", *I.STORED)
    counts = change_report(changes(regulations.read(), now.drop("line"))).first()
    if not a.dry_run:
        regulations.upsert(now, "line", "created_at", "updated_at")
        run = (datetime.datetime.now(), "ok", True, counts.added, counts.changed, None)
        runs.append(spark.createDataFrame([run], RUNS))
    print(json.dumps(counts.asDict()))


def texts(spark: SparkSession, a: argparse.Namespace) -> None:
    from codicil.operators import texts as T

    regulations = stores(spark, a.store)[0]
    rows = save_texts(spark, a, regulations.read(), a.force)
    say(T.text_report(rows))
    say(T.failure_reasons(rows))


def save_texts(spark: SparkSession, a: argparse.Namespace, regulations: DataFrame, force: bool) -> DataFrame:
    """Texts and chunks of regulations, from the page cache; what became of each."""
    from pyspark.sql import Window

    from codicil.operators import texts as T
    from codicil.sources.records import read_page_cache

    _, stored, chunks, _ = stores(spark, a.store)
    pages = read_page_cache(spark, a.pages).select("id", "source", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"), "body", F.lit(None).cast("string").alias("content_type"))
    rows = settled(T.process_texts(regulations, pages, stored.read(), force, a.max_chars))
    saved = rows.where("status = 'saved'").select("regulation_id", "source", "source_url", "content", "content_hash")
    number = F.row_number().over(Window.partitionBy("regulation_id").orderBy("ordinal")) + F.shiftleft(F.col("regulation_id").cast("long"), 32)
    none = [F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model")]
    new = T.chunk_rows(rows).select(number.alias("id"), "regulation_id", "ordinal", "section", "label", "content", *none)
    chunks.replace(new, saved.select("regulation_id"))
    stored.replace(saved, saved.select("regulation_id"))
    return rows


def settled(rows: DataFrame) -> DataFrame:
    """rows written and read again: they no longer hang on the tables they come from, whose old versions go."""
    from codicil.sources.temporary import shared_folder

    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(embed_pending(spark, a)))


def embed_pending(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Vectors for the chunks that lack one of this model."""
    from codicil.functions.text import embedding_input, regulation_name
    from codicil.operators.changes import pending
    from codicil.operators.embed import embed_and_save
    from codicil.sources.models import embedder_of
    from codicil.sources.store import save_vectors

    regulations, _, chunks, _ = stores(spark, a.store)
    embedder = embedder_of(os.environ, a.dimensions)
    wanted = chunks.read().where(pending(F.col("embedding"), F.col("embedding_model"), embedder.model))
    r = regulations.read().select(F.col("id").alias("_r"), "type", "number", "enacted_on", "topic", "title")
    rows = wanted.join(r, wanted.regulation_id == r._r)
    name = regulation_name(F.col("type"), F.col("number"), F.col("enacted_on"))
    inputs = rows.select("id", embedding_input(name, F.col("topic"), F.col("title"), F.col("label"), F.col("content")).alias("input"))

    def save(done: DataFrame) -> None:
        keys = settled(wanted.select("id", "regulation_id").join(done, "id", "left_semi").select("regulation_id").distinct())
        chunks.replace(save_vectors(chunks.of_keys(keys), done, embedder.model), keys)

    embed_and_save(inputs, lambda: embedder, a.dimensions, save)
    return {"embedded": chunks.read().where("embedding is not null").count()}


def update(spark: SparkSession, a: argparse.Namespace) -> int:
    """Brings the store up to date with a file of records and the page cache. Every run is recorded, a failed one with its reason; what it left
    undone is done by the next. 0: done, or nothing was due; 1: failed."""
    from codicil.functions.vectors import checked
    from codicil.operators import changes as C
    from codicil.operators import ingest as I
    from codicil.operators import texts as T
    from codicil.sources import records as R
    from codicil.sources import store as S
    from codicil.sources.models import embedder_of

    regulations, stored, chunks, runs = stores(spark, a.store)
    if a.if_due and not C.update_status(runs.read(), F.current_timestamp()).first().due:
        print(json.dumps({"due": False}))
        return 0
    journal, state = S.VersionedTable(spark, f"{a.store}/unfinished", UNFINISHED), f"{a.store}/dataset.json"
    before = R.read_state(state)
    now: list[R.DatasetState] = []

    def found() -> DataFrame | None:
        now.append(R.DatasetState(R.sha256_of(a.records), datetime.datetime.now().isoformat(timespec="seconds")))
        if before and before.sha256 == now[0].sha256:
            return None
        rows = I.classified(records_of(spark, a), (I.Subset(tuple(a.type or ()), a.since),))
        return settled(C.changes(regulations.read(), rows.where("status = 'selected'").select("line", *I.STORED)))

    def texts(wanted: DataFrame, refetch: bool) -> dict:
        rows = save_texts(spark, a, regulations.read().join(wanted, "id", "left_semi"), True)
        return json.loads(rows.transform(T.text_report).toJSON().first())

    def forget(wanted: DataFrame) -> int:
        keys = wanted.select(F.col("id").alias("regulation_id"))
        kept, count = S.forget_vectors(chunks.of_keys(keys), keys)
        n = count.first().forgotten
        chunks.replace(kept, keys)
        return n

    def save_unfinished(work: DataFrame | None) -> None:
        at = max(journal.versions(), default=0)
        journal.write(work.select("kind", F.col("id").cast("int").alias("id")) if work is not None else spark.createDataFrame([], UNFINISHED), at)

    steps = C.UpdateSteps(
        load_unfinished=journal.read, save_unfinished=save_unfinished, found=found,
        upsert=lambda rows: regulations.upsert(rows.select("line", *I.STORED), "line", "created_at", "updated_at"),
        without_text=lambda: C.without_text(regulations.read(), stored.read()).select("id"),
        texts=texts, forget_vectors=forget, embed=lambda: embed_pending(spark, a), commit=lambda: R.save_state(state, now[0]),
    )
    try:
        os.makedirs(a.store, exist_ok=True)
        embedder = embedder_of(os.environ, a.dimensions)
        checked(embedder.embed(["probe"]), ["probe"], a.dimensions)  # before anything is touched
        report = C.run_update(steps, a.check)
    except Exception as e:  # noqa: BLE001  whatever it was, the next run has to know
        if not a.check:
            runs.append(spark.createDataFrame([(datetime.datetime.now(), "failed", None, 0, 0, f"{type(e).__name__}: {e}"[:500])], RUNS))
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    if not a.check:
        d = report["dataset"] or {"added": 0, "changed": 0}
        runs.append(spark.createDataFrame([(datetime.datetime.now(), "ok", report["dataset"] is not None, d["added"], d["changed"], None)], RUNS))
    print(json.dumps(report))
    return 0


def maintain(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rewrites the buckets that have gathered many changes, and drops what only versions before the last --keep hold."""
    from codicil.sources.store import VersionedTable

    *keyed, runs = stores(spark, a.store)
    for t in keyed:
        written = t.compact(a.most)
        print(json.dumps({"table": t.path.rpartition("/")[2], "version": written.number, "buckets": len(written.touched), "folders_dropped": t.vacuum(a.keep)}))
    for t in (runs, VersionedTable(spark, f"{a.store}/unfinished", UNFINISHED)):
        print(json.dumps({"table": t.path.rpartition("/")[2], "version": max(t.versions(), default=0), "folders_dropped": t.vacuum(a.keep)}))


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    from urllib.parse import urlencode

    from codicil.operators.requests import parse_search
    from codicil.operators.search import search as run
    from codicil.sources.models import embedder_of

    asked = {"q": a.question, "limit": a.limit, "type": ",".join(a.type or ()), "from": a.year_from, "to": a.year_to, "min_similarity": a.min_similarity, "versions": a.versions}
    found, issues = parse_search(urlencode({k: v for k, v in asked.items() if v not in (None, "")}))
    if issues:
        print(json.dumps({"issues": issues}), file=sys.stderr)
        return 2
    regulations, stored, chunks, _ = stores(spark, a.store)
    say(run(chunks.read(), regulations.read(), stored.read(), embedder_of(os.environ, a.dimensions), found[0], found[1]))
    return 0


def answer(spark: SparkSession, a: argparse.Namespace) -> int:
    """The answer to a question as events, written by the models that settings name from what the search finds. 0: done, 1: no model wrote, 2: there is no model."""
    from dataclasses import replace

    from codicil.functions import text as X
    from codicil.functions.dates import written_dates
    from codicil.operators import answers as A
    from codicil.operators import search as S
    from codicil.sources.models import chat_models, embedder_of

    models = chat_models(os.environ)
    if not models:
        print(json.dumps({"error": "no chat model is configured"}), file=sys.stderr)
        return 2
    regulations, stored, chunks, _ = (t.read() for t in stores(spark, a.store))
    embedder = embedder_of(os.environ, a.dimensions)
    asked = spark.range(1).select(X.language(F.lit(a.question)).alias("language"), X.references(F.lit(a.question), datetime.date.today().year).alias("r")).first()
    # what the question cites holds for a second search in other words too
    o = S.Options(limit=A.MAX_SOURCES, min_similarity=a.min_similarity)
    o = replace(o, references=tuple(S.Reference(r["type"], r["number"], r["year"]) for r in asked.r), dates=tuple(written_dates(a.question)))

    def find(query: str) -> list[A.Source]:
        hits = S.search(chunks, regulations, stored, embedder, query, o).withColumn("question", F.lit(0))
        rows = A.numbered_sources(hits).orderBy("n").collect()  # MAX_SOURCES rows
        return [A.Source(r.n, r.chunk_id, r.regulation_id, r.source_title, r.subject, r.content, r.enacted_on and r.enacted_on.isoformat(), r.url, tuple(e["name"] for e in r.earlier), r.earlier_omitted) for r in rows]

    def amounts(text: str, sources: list[A.Source]) -> list[dict]:
        answers = spark.createDataFrame([(0, text)], "question int, answer string")
        given = spark.createDataFrame([(0, s.n, s.content) for s in sources], "question int, n int, content string")
        return [r.asDict() for r in A.check_amounts(answers, given).drop("question").orderBy("line", "at").collect()]  # those of one answer

    written = A.Fallback(models)
    last = {}
    for last in A.answer_question(A.AnswerSteps(find, written, written, amounts), a.question, asked.language):
        print(A.event_line(last), end="", flush=True)
    return 0 if last.get("type") == "done" else 1


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Measures of the search over a file of questions with known answers, in order: overall, by kind, questions without an answer, mean time, and with --floors
    the same above each floor; with --versions how many find their regulation only under a newer one. All questions are searched by one plan. Questions none of whose regulations has a vector are left out. 0: done, 1: recall@5 is below --min-recall, 2: nothing to ask."""
    import time

    from codicil.operators import evaluate as E
    from codicil.operators import many as M
    from codicil.operators import search as S
    from codicil.sources.models import embedder_of

    with open(a.questions, encoding="utf-8") as f:
        gold = E.read_gold(f.readlines())
    regulations, stored, chunks, _ = (t.read() for t in stores(spark, a.store))
    asked = spark.createDataFrame([(n, i) for n, q in enumerate(gold) for i in q.expected], "question int, id int")
    usable = {r.question for r in E.eligible(asked, chunks).where("eligible").collect()}  # questions written by hand
    chosen = [(n, q) for n, q in enumerate(gold) if n in usable or not q.expected]
    if not any(q.expected for _, q in chosen):
        print(json.dumps({"error": "no expected regulation has chunks with vectors"}), file=sys.stderr)
        return 2
    embedder = embedder_of(os.environ, a.dimensions)
    o = S.Options(limit=S.MAX_LIMIT, min_similarity=0.0 if a.floors else a.min_similarity, version_similarity=a.versions).checked()
    rows = spark.createDataFrame([(n, q.question) for n, q in chosen], "question long, text string")
    questions = settled(M.asked(rows, lambda: embedder, a.dimensions))
    found = settled(M.search_many(chunks, regulations, stored, embedder.model, questions, o).select("question", "place", "match", "similarity", "regulation_id", F.col("earlier_versions.regulation_id").alias("earlier")))
    # what is cited by number passes any floor
    results = found.select("question", "place", F.col("regulation_id").alias("id"), F.when(F.col("match") == "reference", 1.0).otherwise(F.col("similarity")).alias("similarity"))
    expected = spark.createDataFrame([(n, i) for n, q in chosen for i in q.expected], "question int, id int")
    kinds = spark.createDataFrame([(n, q.kind) for n, q in chosen], "question int, kind string")
    ranked = E.ranks(results, expected)
    best = kinds.where("kind = 'absent'").join(results, "question", "left").groupBy("question").agg(F.count("id").alias("returned"), F.max("similarity").alias("best"))
    overall = E.metrics(ranked)
    print(json.dumps({"model": embedder.model, "skipped": len(gold) - len(chosen)}))
    if a.floors:
        say(E.floor_sweep(results, expected, E.FLOORS).join(E.rejection_sweep(best, E.FLOORS), "floor", "left").orderBy("floor"))
    else:
        say(overall)
        say(E.metrics(ranked.join(kinds, "question"), ["kind"]).orderBy("kind"))
        say(E.rejection(best).withColumnRenamed("questions", "absent"))
    if a.versions is not None:
        nested = E.ranks(found.select("question", "place", F.explode("earlier").alias("id")), expected).withColumnRenamed("rank", "nested")
        say(ranked.join(nested, "question").agg(F.count_if(E.under_newer(F.col("rank"), F.col("nested"))).alias("under_newer")))
    if a.timings:  # a search for each question, as a user asks
        timings = []
        for n, q in chosen:
            for warm_up in (True, False):
                since = time.monotonic()
                S.search(chunks, regulations, stored, embedder, q.question, o).select("place", "regulation_id").collect()  # MAX_LIMIT rows
                timings.append((n, (time.monotonic() - since) * 1000, warm_up))
        say(E.mean_ms(spark.createDataFrame(timings, "question int, ms double, warm_up boolean")))
    try:
        E.require_recall(overall, a.min_recall)
    except E.RecallTooLow as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    from codicil.operators.changes import described, latest_runs, update_status

    runs = stores(spark, a.store)[3].read()
    print(described(update_status(runs, F.current_timestamp()), latest_runs(runs)).first().description)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="codicil")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple) -> None:
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        c.add_argument("--store", required=True)
        for names, kind in options:
            c.add_argument(*names, **kind)

    kinds = (["--type"], {"action": "append"})
    dimensions = (["--dimensions"], {"type": int, "default": 1024})
    command(ingest, (["records"], {}), kinds, (["--since"], {}), (["--limit"], {"type": int}), (["--dry-run"], {"action": "store_true"}))
    command(texts, (["--pages"], {"required": True}), (["--force"], {"action": "store_true"}), (["--max-chars"], {"type": int, "default": 1800}))
    command(embed, dimensions)
    pages, most = (["--pages"], {"required": True}), (["--max-chars"], {"type": int, "default": 1800})
    command(update, (["records"], {}), kinds, (["--since"], {}), pages, most, (["--check"], {"action": "store_true"}), (["--if-due"], {"action": "store_true"}), dimensions)
    command(search, (["question"], {}), kinds, (["--limit"], {"type": int}), (["--from"], {"dest": "year_from"}), (["--to"], {"dest": "year_to"}), (["--min-similarity"], {}), (["--versions"], {}), dimensions)
    floor = (["--min-similarity"], {"type": float, "default": 0.55})
    command(answer, (["question"], {}), floor, dimensions)
    command(evaluate, (["questions"], {}), (["--floors"], {"action": "store_true"}), (["--timings"], {"action": "store_true"}), (["--versions"], {"type": float}), floor, (["--min-recall"], {"type": float, "default": 0.0}), dimensions)
    command(status)
    command(maintain, (["--most"], {"type": int, "default": 4}), (["--keep"], {"type": int, "default": 3}))
    a = p.parse_args(argv)
    own = spark or SparkSession.builder.appName(f"codicil-{a.command}").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", os.environ.get("CODICIL_UI", "false")).getOrCreate()
    return a.run(own, a) or 0


if __name__ == "__main__":
    sys.exit(main())
