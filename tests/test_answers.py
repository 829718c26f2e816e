import time

import pytest
from pyspark.sql import functions as F

from codicil.operators import answers as A
from codicil.operators import evaluate as E
from codicil.operators import requests as R
from codicil.streaming import limits
from codicil.streaming.limits import Log, TwoLevels, admissions, admitted_stream, client_admissions, limited_stream


class Model:
    def __init__(self, *turns, provider="p", model="m"):
        self.turns, self.provider, self.model = list(turns), provider, model

    def stream(self, instructions, prompt):
        turn = self.turns.pop(0)
        if isinstance(turn, Exception):
            raise turn
        for piece in turn:
            if isinstance(piece, Exception):
                raise piece
            yield piece


def source(n, chunk=None):
    return A.Source(n, chunk or n, n, f"Ley {n}", None, f"texto {n} $ 1.500")


def run(models, search=None, rewriter=None, language="es"):
    steps = A.AnswerSteps(search or (lambda q: [source(1), source(2)]), A.Fallback(models), rewriter and A.Fallback([rewriter]), clock=lambda: 0.0)
    return list(A.answer_question(steps, "¿cuánto?", language))


def test_an_answer():
    events = run([Model(["Son $ 1.", "500 [1][3]."])])
    assert [e["type"] for e in events] == ["sources", "asking", "text", "text", "done"]
    assert events[-1]["outcome"] == "answered" and events[-1]["cited"] == [1] and events[-1]["unknown_citations"] == [3]
    assert run([Model(["Nada citado."])])[-1]["outcome"] == "uncited"
    assert [e["type"] for e in run([], search=lambda q: [])] == ["sources", "done"]


def test_fallback():
    events = run([Model(A.ModelError("busy", 503), model="a"), Model(["ok [1]"], model="b")])
    assert [e["type"] for e in events] == ["sources", "asking", "skipped", "asking", "text", "done"] and events[-1]["model"] == "b"
    assert run([Model(A.ModelError("x", 500))])[-1]["type"] == "error"
    assert run([Model(["half", A.ModelError("cut")]), Model(["never"])])[-1]["type"] == "error"  # text had come already
    assert run([Model([]), Model(["late [2]"])])[-1]["cited"] == [2]  # no text is a failure
    now = [0.0]
    f = A.Fallback([Model(A.ModelError("no", 401), provider="x"), Model(["b"], ["b"], provider="x", model="same"), Model(["c"], ["c"], provider="y", model="last")], clock=lambda: now[0])
    said = lambda: [(k, w if k == "text" else getattr(w, "model", None)) for k, w in f.stream("", "")]
    assert said()[-1] == ("text", "c")  # a bad key rules the provider out
    now[0] = 10
    assert ("text", "b") in said()  # the first still rests, its provider is asked again


def test_second_search():
    found = iter([[source(1)], [source(1), source(2, 77)]])
    events = run([Model(["Las fuentes no responden la pregunta. Tratan X."], ["Sí [2]."])], search=lambda q: next(found), rewriter=Model(["Búsqueda: «haber mínimo»"]))
    assert [e["type"] for e in events] == ["sources", "asking", "rewritten", "sources", "asking", "text", "done"] and events[2]["query"] == "haber mínimo" and events[2]["found"] == 2 and events[-1]["outcome"] == "answered"
    events = run([Model(["Las fuentes no responden la pregunta."])], rewriter=Model(["otra cosa"]))  # nothing new is found
    assert events[-1]["outcome"] == "not_in_sources" and events[-2]["type"] == "text" and events[-3] == {"type": "rewritten", "query": "otra cosa", "found": 0, "ms": 0}


def test_first_text_in_time():
    slow = iter(lambda: time.sleep(0.05) or "", "end")
    with pytest.raises(TimeoutError, match="no text in 0.2 seconds"):
        list(A.timed(slow, 0.2))
    assert list(A.timed(["", "a", "", "b"], 5)) == ["a", "b"]
    with pytest.raises(A.ModelError):
        list(A.timed([""], 5))
    with pytest.raises(KeyError):
        list(A.timed(({}[k] for k in "x"), 5))


def test_chain_of_providers():
    make = lambda settings: Model(["ok"], provider=settings["KEY"])
    known = [A.Provider("home", (), lambda s: Model([], provider="home"), local=True), A.Provider("one", ("KEY",), make), A.Provider("two", ("KEY", "URL"), make)]
    models = A.provider_chain({"KEY": " k ", "URL": " "}, known)
    assert [(m.provider, m.seconds) for m in models] == [("k", A.FIRST_TEXT), ("home", A.FIRST_TEXT_LOCAL)]
    assert [x for x in A.Fallback(models).stream("", "")][-1] == ("text", "ok")
    # by name: in that order, and what can't be used says so
    models = A.provider_chain({"KEY": "k"}, known, ["home", "two", "three", "one"])
    assert [m.provider for m in models] == ["home", "two", "three", "k"] and models[0].seconds == A.FIRST_TEXT_LOCAL
    events = list(A.Fallback(models).stream("", ""))
    assert [(m.provider, why) for kind, (m, why) in (e for e in events if e[0] == "skipped")] == [("home", "error"), ("two", "not_configured"), ("three", "not_configured")]
    with pytest.raises(A.ModelError, match="two: URL missing"):
        list(A.Fallback(A.provider_chain({"KEY": "k"}, known, ["two"])).stream("", ""))
    several = [A.Provider("many", ("KEY",), lambda s: [Model([], provider="many"), Model(["b"], provider="many")])]
    assert [x for x in A.Fallback(A.provider_chain({"KEY": "k"}, several)).stream("", "")][-1] == ("text", "b")


def test_openings_and_rewrites():
    assert A.read_opening('**"The sources do not answer the question" x') == "not_in_sources" and A.read_opening("Las fuentes") == "undecided" and A.read_opening("Hola") == "answer"
    assert A.read_rewrite("\n search: a  b \nc") == "a b" and not A.is_new("¿A, b?", "a b") and not A.is_new("?", "x")


@pytest.mark.parametrize(
    "answer,want",
    [
        ("Paga $1.598.124 [1].", [("$1.598.124", [1], [1], "supported")]), ("Paga $ 1,598,124 [2].", [("$ 1,598,124", [2], [1], "other_source")]), ("Son U$S 30 [1]", [("U$S 30", [1], [2], "other_source")]), ("Son $ 77 [1]", [("$ 77", [1], [], "not_found")]),
        ("$30 y $1598124 [2][1, 9]", [("$30", [2, 1], [2], "supported"), ("$1598124", [2, 1], [1], "supported")]), ("$30\n[2]", [("$30", [], [2], "other_source")]), ("nada", []),
    ],
)
def test_amounts(spark, answer, want):
    a = spark.createDataFrame([(1, answer)], "question long, answer string")
    s = spark.createDataFrame([(1, 1, "monto 1.598.124 en 30 días"), (1, 2, "vale U$S 30")], "question long, n int, content string")
    assert [(r.amount, r.cited, r.found_in, r.status) for r in A.check_amounts(a, s).orderBy("line", "at").collect()] == want


def test_measures(spark):
    rows = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "question long, rank int")
    m = E.metrics(rows).first()
    assert (m.recall_1, m.recall_3, m.recall_5) == (pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3)) and m.mrr == pytest.approx((1 + 0.25) / 3)
    assert E.metrics(rows.limit(0)).first().mrr == 0
    with pytest.raises(E.RecallTooLow):
        E.require_recall(E.metrics(rows), 0.9)
    df = spark.createDataFrame([([5, 6, 7], [[7], [1]], [7])], "r array<long>, n array<array<long>>, e array<long>")
    a, b = E.first_rank(F.col("r"), F.col("e")), E.first_nested_rank(F.col("n"), F.col("e"))
    assert df.select(a, b, E.under_newer(a, b)).first()[:] == (3, 1, True)


def test_rate_limits(spark):
    log = Log(2, 1000)
    assert log.wait(0) == 0
    log.take(0)
    log.take(10)
    assert log.wait(500) == 500 and log.wait(1000) == 0 and Log(0).wait(5) == 0
    with pytest.raises(ValueError):
        Log(-1)
    rows = [(i, "ab"[i % 2], i * 100) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, client string, ms long")
    own = {r.id: r.admitted for r in client_admissions(df, 2, 500).collect()}
    # each client asks every 200 ms and may twice in 500: two pass, the third waits
    assert [i for i in range(12) if own[i]] == [0, 1, 2, 3, 6, 7, 8, 9]
    both = {r.id: (r.admitted, r.limit) for r in admissions(df, 2, 3, 500).collect()}
    assert both[0][0] and both[1][0] and both[2][0] and both[3] == (False, "total")


def test_limits_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 100) for i in range(12)], "id long, client string, ms long")
    df.where("id < 6").coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (None, df.where("id >= 6")):  # the log is kept between runs
            if part is not None:
                part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = limited_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 2, 500, expire=False)
            q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
            assert q.awaitTermination(90)
    finally:
        spark.conf.set(name, old)
    got = {r.id: (r.admitted, r.retry_after_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: (r.admitted, r.retry_after_ms) for r in client_admissions(df, 2, 500).collect()}


def test_one_client_in_many_batches(spark):
    """A client's log is carried from one batch of its requests to the next, and so is that of everyone."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS client", "id * 7 AS ms").repartition(5)
        rows = sorted(client_admissions(df, 3, 1000).collect(), key=lambda r: r.id)
        both = sorted(admissions(df, 3, 4, 1000).collect(), key=lambda r: r.id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    logs, levels = {c: Log(3, 1000) for c in "ab"}, TwoLevels(3, 4, 1000)
    for r, t in zip(rows, both):
        wait = logs[r.client].wait(r.ms)
        if not wait:
            logs[r.client].take(r.ms)
        assert (r.admitted, r.retry_after_ms) == (wait == 0, wait)
        assert (t.admitted, t.limit, t.retry_after_ms) == levels.decide(t.client, t.ms)
    levels.sweep(10**9)
    assert not levels.clients


def test_both_limits_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 3], i * 100) for i in range(18)], "id long, client string, ms long")
    df.where("id < 7").coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (None, df.where("id >= 7")):  # both logs are kept between runs
            if part is not None:
                part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = admitted_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 1, 2, 500)
            q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
            assert q.awaitTermination(90)
    finally:
        spark.conf.set(name, old)
    got = {r.id: (r.admitted, r.limit, r.retry_after_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: (r.admitted, r.limit, r.retry_after_ms) for r in admissions(df, 1, 2, 500).collect()} and {x[1] for x in got.values()} == {None, "client", "total"}


def test_small_matters(spark):
    assert R.pick_locale("en-GB,es;q=0.5") == "en" and R.pick_locale("fr") == "es" and R.response_of([], False, 1500, True) == (429, {"Retry-After": "2"}) and R.health(True, False)["http"] == 503
    assert R.settings({"A": "1, 2", "N": "5"}, {"A": (list, []), "N": (int, 1), "M": (int, 3)}) == {"A": ["1", "2"], "N": 5, "M": 3}
    with pytest.raises(R.SettingsError, match="N: expected int.*K: missing"):
        R.settings({"N": "x"}, {"N": (int, 1), "K": (str, ...)})
    assert A.event_line({"type": "text", "text": "á"}) == 'event: text\ndata: {"text": "á"}\n\n'


def test_questions_of_a_task(spark, monkeypatch):
    """Tasks that check amounts get no larger as questions come in; an amount that another source happens to have is no missing one."""
    monkeypatch.setattr(A, "QUESTIONS", 10)
    answers = spark.range(200).selectExpr("id AS question", "concat('Eran $', 1000 + id, ' [1].') AS answer")
    sources = spark.range(200).selectExpr("id AS question", "1 AS n", "'Tabla: 7000' AS content").union(spark.range(200).selectExpr("id", "2", "concat('El monto es de $', 1000 + id - id % 2)"))
    rows = A.check_amounts(answers, sources)
    assert rows.rdd.getNumPartitions() == 20
    assert {r.question: r.status for r in rows.collect()} == {i: "not_found" if i % 2 else "other_source" for i in range(200)}


@pytest.mark.parametrize("per_client,total", [(2, 5), (3, 0), (0, 4), (1, 700)])
def test_requests_in_runs(spark, monkeypatch, per_client, total):
    """Tasks that decide on requests get no larger as these come in, and logs go on from run to run: of everyone, and of a client that fills several."""
    monkeypatch.setattr(limits, "RUN", 500)
    client = "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 3 = 0 THEN concat('c', id % 40) WHEN id % 1000 = 1 THEN 'z' ELSE 'hot' END"
    df = spark.range(3000).selectExpr("id", f"{client} AS client", "(id * 7919 % 3000) DIV 10 * 13 + CASE WHEN id * 7919 % 3000 > 2000 THEN 900 ELSE 0 END - 500 AS ms").repartition(3)
    rows, alone = admissions(df, per_client, total, 400), client_admissions(df, per_client, 400)
    for got in (rows, alone):
        counts = [len(p) for p in got.rdd.glom().collect()]
        assert len(counts) == 6 and max(counts) < 1000
    levels, logs = TwoLevels(per_client, total, 400), TwoLevels(per_client, 0, 400)
    asked = sorted(df.collect(), key=lambda r: (r.ms, r.id))
    assert {r.id: (r.admitted, r.limit, r.retry_after_ms) for r in rows.collect()} == {r.id: levels.decide(r.client, r.ms) for r in asked}
    want = {r.id: logs.decide(r.client, r.ms) for r in asked}
    assert {r.id: (r.admitted, r.retry_after_ms) for r in alone.collect()} == {i: (x[0], x[2]) for i, x in want.items()}
