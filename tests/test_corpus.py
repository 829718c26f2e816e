import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from codicil.operators import changes as C
from codicil.operators import ingest as I
from codicil.operators import texts as T
from codicil.operators.requests import corpus_subsets
from codicil.sources import records as R
from codicil.sources import store
from codicil.sources.numbered import Conflict

GOOD = dict.fromkeys(R.COLUMNS, "") | {"id_norma": "7", "tipo_norma": " Ley ", "numero_norma": "31.406", "fecha_sancion": "2019-08-26", "numero_boletin": "12.0", "texto_original": "https://x.org/a", "modifica_a": "2"}


def raw(spark, *changes):
    rows = [GOOD | c for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in R.COLUMNS) for r in rows], ", ".join(f"{c} string" for c in R.COLUMNS)).withColumn("line", F.monotonically_increasing_id())


@pytest.mark.parametrize(
    "change,columns",
    [
        ({"id_norma": "abc"}, ["id_norma"]), ({"id_norma": "0"}, ["id_norma"]), ({"tipo_norma": "  "}, ["tipo_norma"]), ({"fecha_sancion": "26/08/2019"}, ["fecha_sancion"]), ({"fecha_sancion": "2023-06-31"}, ["fecha_sancion"]), ({"fecha_sancion": "2026"}, ["fecha_sancion"]),
        ({"numero_boletin": "treinta"}, ["numero_boletin"]), ({"texto_original": "norma.htm"}, ["texto_original"]), ({"texto_original": "javascript:alert(1)"}, ["texto_original"]), ({"modifica_a": "-1", "id_norma": "1.5"}, ["id_norma", "modifica_a"]), ({}, []), ({"id_norma": "0x10"}, []),
    ],
)
def test_rows(spark, change, columns):
    r = I.parsed(raw(spark, change)).first()
    assert [x.split(":")[0] for x in r.reasons] == columns
    if not change:
        assert (r.id, r.type, r.number, r.enacted_on, r.gazette_number, r.amended_by_count, r.amends_count, r.topic) == (7, "Ley", "31.406", datetime.date(2019, 8, 26), 12, 0, 2, None)


def test_subsets(spark):
    df = I.classified(raw(spark, {}, {"tipo_norma": "Decreto", "fecha_sancion": ""}, {"tipo_norma": "DECRETO"}, {"tipo_norma": "Leyes"}), (I.Subset(("léy",)), I.Subset(("decreto",), "2019-08-26")))
    assert [r.status for r in df.orderBy("line").collect()] == ["selected", "filtered_out", "selected", "filtered_out"]
    laws, decrees = corpus_subsets(datetime.date(2024, 2, 29))
    assert laws.since is None and decrees.since == "2019-03-01"


def test_csv_and_archive(spark, tmp_path):
    head = ",".join(R.COLUMNS)
    row = ",".join(f'"{v}"' for v in (GOOD | {"titulo_resumido": 'dice ""sí"",\ny sigue'}).values())
    (tmp_path / "a.csv").write_text(f"{chr(0xFEFF)}{head}\n{row}\n\n{row}\n", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.csv", "../../evil/base.csv")
    path = R.resolve_csv(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert path == str(tmp_path / "out" / "base.csv")
    rows = R.read_records(spark, path).orderBy("line").collect()
    assert [r.line for r in rows] == [2, 3] and rows[0].titulo_resumido == 'dice "sí",\ny sigue' and rows[0].id_norma == "7"
    (tmp_path / "b.csv").write_text("id_norma,x\n1,2\n")
    with pytest.raises(ValueError, match="tipo_norma"):
        R.read_records(spark, str(tmp_path / "b.csv"))


def test_conditional_download(tmp_path):
    answers = [R.Response(200, b"one", {"ETag": "e1"}), R.Response(304), R.Response(200, b"one", {"ETag": "e2"}), R.Response(200, b"two"), R.Response(500)]
    asked = []
    get = lambda url, headers: (asked.append(headers), answers.pop(0))[1]
    to, state = str(tmp_path / "d.csv"), None
    seen = []
    for _ in range(4):
        what, state = R.download_if_changed(get, "u", to, state, "now")
        seen.append(what)
    assert seen == ["changed", "not_modified", "same_content", "changed"] and asked[1] == {"If-None-Match": "e1"}
    with pytest.raises(OSError):
        R.download_if_changed(get, "u", to, state, "now")
    R.save_state(str(tmp_path / "s.json"), state)
    assert R.read_state(str(tmp_path / "s.json")) == state and R.read_state(str(tmp_path / "none")) is None


def test_polite_fetcher():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = {"a": [R.Response(503), R.Response(429), R.Response(200, b"x", {"Content-Type": "text/html"})], "b": [R.Response(404)], "c": [R.Response(500)] * 3}
    fetch = R.polite_fetcher(lambda u, h: answers[u].pop(0), sleep=sleep, clock=lambda: now[0])
    assert fetch("a").body == b"x" and fetch("b").status == 404 and not answers["b"] and fetch("c").status == 500 and not answers["c"]
    assert min(slept) > 0 and 2.0 in slept


def test_refusals_stop_the_run(spark):
    wanted = spark.createDataFrame([(i, "original", f"u{i}") for i in range(10)], "id long, source string, url string")
    out = R.fetch_pages(wanted, lambda: lambda u: R.Page(False, "HTTP 403", 403), 3).orderBy("id").collect()
    assert [r.reason for r in out] == ["HTTP 403"] * 3 + ["aborted"] * 7


def test_changes_and_update(spark):
    cols = "id long, type string, number string, enacted_on date, topic string, title string, summary string, original_text_url string, updated_text_url string, amended_by_count int"
    day = datetime.date(2020, 1, 1)
    row = lambda i, **k: tuple({"id": i, "type": "Ley", "number": None, "enacted_on": day, "topic": None, "title": "t", "summary": None, "original_text_url": None, "updated_text_url": None, "amended_by_count": 0, **k}.values())
    stored = spark.createDataFrame([row(1), row(2), row(3), row(9)], cols)
    now = spark.createDataFrame([row(1), row(2, title="u"), row(3, summary="s", number="5"), row(4)], cols)
    found = C.changes(stored, now)
    assert {r.id: (r.label, r.fields, r.text, r.context) for r in found.collect()} == {1: ("unchanged", [], False, False), 2: ("changed", ["title"], False, True), 3: ("changed", ["summary", "number"], True, True), 4: ("added", [], False, False)}
    log, journal = [], [spark.createDataFrame([("refetch", 8), ("refetch", 3)], "kind string, id long")]
    ids = lambda df: sorted(r.id for r in df.collect())
    none = journal[0].where("false")

    def save(work):
        rows = sorted(map(tuple, work.collect())) if work is not None else []
        log.append(("journal", rows))
        journal.append(spark.createDataFrame(rows, "kind string, id long"))

    steps = C.UpdateSteps(lambda: journal[-1], save, lambda: found, lambda rows: log.append(("upsert", ids(rows))), lambda: now.where("id = 4").select("id"), lambda i, again: log.append(("texts", ids(i), again)) or {},
                          lambda i: log.append(("forget", ids(i))) or i.count(), lambda: {"embedded": 1}, lambda: log.append("commit"))
    report = C.run_update(steps)
    work = [("rechunk", 2), ("refetch", 3), ("refetch", 8), ("revector", 2), ("revector", 3)]
    assert log == [("journal", work), ("upsert", [2, 3, 4]), ("texts", [4], False), ("texts", [3, 8], True), ("texts", [2], False), ("forget", [2, 3]), ("journal", []), "commit"]
    assert report["resumed"] == {"refetch": 2, "rechunk": 0, "revector": 0} and report["dataset"]["added"] == 1 and report["vectors_forgotten"] == 2
    log.clear()
    assert "new_texts" not in C.run_update(steps, check=True) and not log
    whole, steps.texts = steps.texts, lambda i, again: {"aborted": "refused"}
    with pytest.raises(C.UpdateIncomplete):
        C.run_update(steps)
    assert "commit" not in log and len(log) == 2
    # the next run finds the dataset as it is and goes on with what is written down
    log.clear()
    steps.texts, steps.found, steps.without_text = whole, lambda: None, lambda: none.select("id")
    report = C.run_update(steps)
    assert log == [("texts", [3], True), ("texts", [2], False), ("forget", [2, 3]), ("journal", [])] and report["resumed"] == {"refetch": 1, "rechunk": 1, "revector": 2}
    log.clear()
    assert C.run_update(steps)["refetched"] is None and log == [("journal", [])]


def test_versioned_tables(spark, tmp_path):
    t = store.VersionedTable(spark, f"{tmp_path}/t", "id long, name string")
    assert t.read().count() == 0
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    t.write(store.upsert(t.read(), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id long, name string"), "id", created=None, updated=None))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "e")]
    t.append(spark.createDataFrame([(4, "f")], "id long, name string"))
    t.compact(1)
    assert t.read().count() == 4
    last = max(t.versions())
    assert t.read(1).count() == 2  # older versions can be read until they are dropped
    with pytest.raises(Conflict):
        t.write(t.read(), last - 1)
    assert t.vacuum(2) == 3 and t.versions() == [last - 1, last] and t.read().count() == 4
    assert store.work_counts(spark.createDataFrame([("refetch", 1)], "kind string, id int")) == {"refetch": 1, "rechunk": 0, "revector": 0}


def test_process_texts(spark):
    regs = spark.createDataFrame([(1, "Ley", "1", "t", None, "s", "http://a", None), (2, "Ley", "2", "t", "x", None, None, None), (3, "Ley", "3", None, None, None, None, "http://b"), (4, "", "", None, None, None, None, None), (5, "Ley", "5", None, None, None, "http://c", None)],
                                 "id long, type string, number string, title string, topic string, summary string, original_text_url string, updated_text_url string")
    page = ("<p>ARTÍCULO 1°.- " + "palabra " * 30 + "</p>").encode("latin-1")
    pages = spark.createDataFrame([(1, "original", True, None, page, None), (3, "updated", True, None, b"<p>short", None)], "id long, source string, ok boolean, reason string, body binary, content_type string")
    none = spark.createDataFrame([], "regulation_id long, content_hash string")
    out = {r.regulation_id: r for r in T.process_texts(regs, pages, none).collect()}
    assert [out[i].status for i in (1, 2, 3, 4, 5)] == ["saved", "saved", "failed", "failed", "failed"]
    assert out[1].chunks[0].label == "Artículo 1" and out[2].chunks[0].section == "summary" and out[2].content == "x\n\nLey 2\n\nt"
    assert [out[i].reason for i in (3, 4, 5)] == ["page has no text", "no text and no summary", "not in cache"]
    stored = spark.createDataFrame([(1, out[1].content_hash)], "regulation_id long, content_hash string")
    again = T.process_texts(regs, pages, stored)
    assert {r.regulation_id: r.status for r in again.collect()}[1] == "unchanged"
    report = T.text_report(again).first()
    assert (report.processed, report.summaries, report.unchanged, report.saved, report.failed, report.chunks) == (5, 1, 1, 1, 3, 1)
    assert T.process_texts(regs, pages, stored, force=True).where("status = 'saved'").count() == 2


def test_status(spark):
    cols = "finished_at timestamp, outcome string, dataset_changed boolean, added int, changed int, error string"
    now = F.lit("2026-10-20 12:00:00").cast("timestamp")
    at = lambda d: datetime.datetime(2026, 10, d, 13)
    status = lambda *rows: C.update_status(spark.createDataFrame(list(rows), cols), now).first()
    assert status().warning == "never" and status().due and status().due_in_days == 0
    s = status((at(1), "ok", True, 1, 2, None), (at(18), "ok", False, 0, 0, None))
    assert (s.days_since, s.due, s.due_in_days, s.warning) == (1, False, 6, None)
    assert status((at(1), "ok", True, 1, 2, None)).warning == "overdue"
    bad = spark.createDataFrame([(at(18), "ok", True, 3, 1, None), (at(19), "failed", None, 0, 0, "boom")], cols)
    assert C.update_status(bad, now).first().warning == "failed"
    lines = C.described(C.update_status(bad, now), C.latest_runs(bad)).first().description.split("\n")
    assert lines[0] == "Last update: 2026-10-18 13:00 UTC (1 day ago): 3 new, 1 changed." and lines[1].endswith("failed: boom") and lines[2] == "The next one is due in 6 days."
