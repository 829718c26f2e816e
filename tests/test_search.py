import collections
import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.functions.vectors import HashingEmbedder
from codicil.operators import search as S
from codicil.operators.ann import IvfIndex
from codicil.operators.embed import TooManyFailures, embed_and_save, embed_chunks
from codicil.operators.requests import parse_search
from codicil.operators.search import Options

DIM = 128


@pytest.fixture(scope="module")
def corpus(spark):
    d = datetime.date
    regs = [(1, "Ley", "24013", d(2026, 2, 9), "Acuerdo", "Malta"), (2, "Decreto", "112", d(2025, 3, 17), "Captura", None), (3, "Decreto", "205", d(2025, 9, 2), "Captura", None), (4, "Decreto", "671", d(2026, 7, 6), "Captura", None), (5, "Ley", "1", None, None, None)]
    same = "cupo anual de captura para buques costeros del litoral"
    chunks = [
        (10, 1, 0, "preamble", None, "Ley de acuerdo"), (11, 1, 1, "article", "Artículo 1", "Apruébase el acuerdo de transporte aéreo con Malta"), (12, 1, 2, "article", "Artículo 2", "Regístrese y archívese"),
        (20, 2, 0, "article", "Artículo 1", same + " desde febrero de 2025"), (30, 3, 0, "article", "Artículo 1", same + " desde octubre de 2025"), (40, 4, 0, "article", "Artículo 1", same + " desde julio de 2026"), (50, 5, 0, "article", None, "régimen de pesca marítima"),
    ]
    e = HashingEmbedder(dimensions=DIM)
    rows = [(*c, [float(x) for x in e.embed([c[5]])[0]], "hashing") for c in chunks] + [(60, 5, 1, "article", None, "vector de otro modelo", [1.0] * DIM, "other"), (61, 5, 2, "article", None, "sin vector", None, None)]
    c = spark.createDataFrame(rows, "id long, regulation_id long, ordinal int, section string, label string, content string, embedding array<double>, embedding_model string")
    r = spark.createDataFrame(regs, "id long, type string, number string, enacted_on date, title string, topic string")
    t = spark.createDataFrame([(1, "original", "http://x.org/1")], "regulation_id long, source string, source_url string")
    return c, r, t, e


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_similar_issues_are_grouped(corpus):
    c, r, t, e = corpus
    out = S.search(c, r, t, e, "cupo anual de captura para buques costeros", Options(version_similarity=0.8, min_similarity=0.3)).collect()
    assert out[0].chunk_id == 40 and [x.chunk_id for x in out[0].earlier_versions] == [30, 20] and out[0].name == "Decreto 671/2026" and out[0].url.endswith("id=4")
    apart = S.search(c, r, t, e, "cupo anual de captura para buques costeros desde octubre de 2025", Options(version_similarity=0.8, min_similarity=0.3)).collect()
    assert [x.chunk_id for x in apart][:2] == [30, 40] and [x.chunk_id for x in apart[1].earlier_versions] == [20]


def test_citations_come_first(corpus):
    c, r, t, e = corpus
    out = S.search(c, r, t, e, "¿De qué trata la Ley 24.013?", Options(min_similarity=1.0)).collect()
    assert {x.chunk_id for x in out} == {10, 11, 12} and all(x.match == "reference" for x in out) and out[0].text_source == "original" and out[0].url == "http://x.org/1"
    assert [x.similarity for x in out] == sorted((x.similarity for x in out), reverse=True)


def test_filters_floor_and_limit(corpus):
    c, r, t, e = corpus
    q = e.embed(["captura acuerdo pesca"])[0]
    plain = Options(min_similarity=0, version_similarity=None)
    found = lambda **k: ids(S.search_by_vector(c, r, t, "hashing", q, Options(**{**plain.__dict__, **k})))
    assert 60 not in found() and 61 not in found() and len(found(limit=2)) == 2
    assert set(found(types=("ley",))) <= {10, 11, 12, 50} and 50 not in found(year_from=1900) and set(found(year_to=2025)) == {20, 30}
    with pytest.raises(ValueError):
        Options(min_similarity=2).checked()
    with pytest.raises(ValueError):
        Options(ef_search=0).checked()
    assert Options(limit=99).checked().limit == 20


def test_requests():
    ok, issues = parse_search("q=ley+24013&type=Ley,Decreto&from=2000&to=2020&versions=off&limit=5")
    assert not issues and ok[0] == "ley 24013" and ok[1].types == ("Ley", "Decreto") and ok[1].version_similarity is None and ok[1].limit == 5
    none, issues = parse_search("q=a&limit=99&from=2020&to=2000&min_similarity=2&versions=0")
    assert none is None and [i["field"] for i in issues] == ["q", "limit", "from", "min_similarity", "versions"]


def test_inverted_file(spark, tmp_path):
    r = np.random.RandomState(3)
    centres = r.randn(12, 24)
    x = np.concatenate([centres[i % 12] + 0.4 * r.randn(1, 24) for i in range(900)])
    df = spark.createDataFrame([(i, v.tolist(), "rare" if i % 75 == 0 else "common") for i, v in enumerate(x)], "id long, embedding array<double>, kind string")
    index = IvfIndex.build(df, f"{tmp_path}/ivf", cells=12)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 100):  # every id divisible by 100, against all rows
        want = set(np.lexsort((np.arange(900), -(unit @ unit[q])))[:10].tolist())
        hits += len(want & {row.id for row in index.search(x[q].tolist(), 10, probes=3).collect()})
    assert hits >= 0.9 * 90
    rare = [row.id for row in index.search(x[1].tolist(), 8, probes=1, where=F.col("kind") == "rare").collect()]
    assert len(rare) == 8 and all(i % 75 == 0 for i in rare)  # more cells are probed until the answer is full


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_inverted_file(spark, sf):
    from codicil.plans import registry

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([list(r.embedding) for r in rows], np.float64), np.array([r.vec_id for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in registry.queries()["ann_search"](spark, folder).collect():
        got[r.question].add(r.id)
    asked = np.flatnonzero(ids % 100 == 0)
    want = {int(ids[q]): set(ids[np.lexsort((ids, -(unit @ unit[q])))[:10]].tolist()) for q in asked}
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = sum(len(got[q] & w) for q, w in want.items()) / (10 * len(want))
    print(f"recall@10 {sf}: {recall:.3f} of {len(want)} questions")
    assert recall >= 0.9


class Flaky:
    def __init__(self, bad):
        self.bad = bad

    model = "flaky"

    def embed(self, texts):
        if any(t in self.bad for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0] for _ in texts]


def test_embedding_reports_what_fails(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, input string").coalesce(1)
    out = {r.id: r for r in embed_chunks(df, lambda: Flaky({"t7"}), 2).collect()}
    assert out[7].error == "no" and out[7].embedding is None and sum(r.embedding is not None for r in out.values()) == 39
    with pytest.raises(Exception, match="in a row failed|TooManyFailures"):
        embed_chunks(df, lambda: Flaky({f"t{i}" for i in range(10)}), 2).collect()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        embed_chunks(df, lambda: Flaky(set()), 3).collect()
    assert issubclass(TooManyFailures, RuntimeError)


class Counted:
    """Writes down each call; fails for ids from ``dead`` on."""

    model = "counted"

    def __init__(self, folder, dead):
        self.folder, self.dead = folder, dead

    def embed(self, texts):
        import time
        import uuid

        time.sleep(0.02)
        (self.folder / uuid.uuid4().hex).touch()
        if any(int(t) >= self.dead for t in texts):
            raise RuntimeError("the model is down")
        return [[1.0, 2.0] for _ in texts]


def test_a_dead_model_stops_the_whole_run(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "cast(id as string) as input").repartition(400)
    (tmp_path / "dead").mkdir()
    saved = []
    with pytest.raises(TooManyFailures, match="5 texts in a row failed: the model is down"):
        embed_and_save(df, lambda: Counted(tmp_path / "dead", 0), 2, saved.append)
    # each task would make 6 calls before it gives up; few of the 400 get that far
    assert len(list((tmp_path / "dead").iterdir())) < 600 and not saved


def test_embedding_saves_part_by_part(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "cast(id as string) as input").coalesce(1)
    (tmp_path / "well").mkdir()
    saved = []
    keep = lambda rows: saved.append(sorted(r.id for r in rows.collect()))
    assert embed_and_save(df, lambda: Counted(tmp_path / "well", 59), 2, keep, part=20) == {"embedded": 59, "failed": 1}
    assert len(saved) == 3 and sorted(i for part in saved for i in part) == list(range(59))
    # a model that dies on the way: the parts before stay, and so does what the last task had until then
    saved.clear()
    with pytest.raises(TooManyFailures):
        embed_and_save(df, lambda: Counted(tmp_path / "well", 30), 2, keep, batch=1, part=60)
    assert [i for part in saved for i in part] in ([], list(range(30)))
    assert embed_and_save(df.where("id < 0"), lambda: Counted(tmp_path / "well", 0), 2, keep) == {"embedded": 0, "failed": 0}


def test_search_with_an_index(corpus, tmp_path):
    c, r, t, e = corpus
    index = S.index_chunks(c, r, e.model, str(tmp_path / "index"), cells=3)
    v = [float(x) for x in e.embed(["cupo de captura para buques"])[0]]
    o = Options(min_similarity=0.1, version_similarity=None)
    near = Options(exact=False, ef_search=1, min_similarity=0.1, version_similarity=None)
    exact = ids(S.search_by_vector(c, r, t, e.model, v, o))
    assert exact and ids(S.search_by_vector(c, r, t, e.model, v, near, index)) == exact
    # a filter that leaves one regulation makes it probe on; a citation is looked up in all chunks
    only = Options(exact=False, ef_search=1, min_similarity=0.0, version_similarity=None, types=("ley",), year_from=2026, references=(S.Reference("Ley", "24013", 2026),))
    assert set(ids(S.search_by_vector(c, r, t, e.model, v, only, index))) == {10, 11, 12}


def test_codes_against_a_scan(spark, tmp_path):
    """Exact search by codes gives what a scan gives, ties and zero vectors included; filters still fill the answer; recall as measured."""
    from codicil.operators.codes import CodeIndex

    r = np.random.RandomState(3)
    x = r.randn(600, 24)
    x[5], x[6], x[7] = 0, x[8], 2 * x[8]
    rows = [(i, [float(v) for v in x[i]], i % 50) for i in range(600)] + [(600, None, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, kind int").repartition(3)
    index = CodeIndex.build(df, f"{tmp_path}/codes", cells=5, parts=6)
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    near = np.round(unit @ unit.T, 9)
    want = {(q, int(i), n + 1) for q in range(0, 600, 60) for n, i in enumerate(np.lexsort((np.arange(600), -near[q]))[:7])}
    asked = df.where("id % 60 = 0").select(F.col("id").alias("question"), "embedding")
    exact = index.exact_of_many(asked, 7).withColumn("s", F.round("similarity", 9)).collect()
    assert {(a.question, a.id) for a in exact} == {w[:2] for w in want}
    assert index.measured(7, 0.95, sample=100).least < 600
    found = {(a.question, a.id) for a in index.nearest_of_many(asked, 7).collect()}
    assert len(found & {w[:2] for w in want}) >= 0.9 * len(want)
    some = index.search(x[3].tolist(), 12, where=F.col("kind") == 3, columns=("kind",)).collect()
    assert len(some) == 12 and {a.kind for a in some} == {3} and some[0].id == 3
    none = CodeIndex.build(df.limit(0), f"{tmp_path}/none")
    assert none.exact_of_many(df.limit(0).select(F.col("id").alias("question"), "embedding"), 3).count() == 0
    assert none.exact_of_many(asked, 3).count() == none.nearest_of_many(asked, 3).count() == 0 and none.search([1.0, 2.0], 3).count() == 0
    with pytest.raises(ValueError, match="24 dimensions"):
        index.search([1.0], 3)


def test_many_questions_at_once(spark, corpus):
    """All questions in one plan give the rows that each gives alone, groups of issues, citations and days included."""
    from codicil.operators import many as M

    c, r, t, e = corpus
    texts = [
        "cupo anual de captura para buques costeros", "cupo anual de captura para buques costeros desde octubre de 2025", "¿De qué trata la Ley 24.013?", "Decreto 205/2025 y Ley 24.013: captura", "",
    ]
    rows = spark.createDataFrame([(7 * n, x) for n, x in enumerate(texts)], "question long, text string")
    today = datetime.date(2026, 8, 1)
    questions = M.asked(rows, lambda: HashingEmbedder(dimensions=DIM), DIM, today)
    plain = lambda x: [x[f] for f in ("place", "match", "chunk_id", "name", "url")] + [round(x.similarity, 9), [(v.nested, v.chunk_id, v.name, round(v.text_similarity, 9)) for v in x.earlier_versions]]
    for o in (Options(version_similarity=0.8, min_similarity=0.3), Options(version_similarity=0.8, version_linkage="best", min_similarity=0.1, limit=3)):
        got: dict = {}
        for x in sorted(M.search_many(c, r, t, "hashing", questions, o).collect(), key=lambda x: (x.question, x.place)):
            got.setdefault(x.question, []).append(plain(x))
        alone = {7 * n: [plain(x) for x in S.search(c, r, t, e, text, o, today).collect()] for n, text in enumerate(texts)}
        assert got == {n: x for n, x in alone.items() if x} and got
    some = M.search_many(c, r, t, "hashing", questions, Options(version_similarity=None, min_similarity=0, types=("decreto",))).collect()
    assert {x.chunk_id for x in some} == {20, 30, 40} and {x.question for x in some} == {7 * n for n in range(len(texts))}
    none = M.search_many(c, r, t, "hashing", questions.limit(0), Options())
    assert none.collect() == []


def test_a_question_that_cannot_be_embedded(spark, corpus):
    from codicil.operators import many as M

    class Refuses:
        model = "refuses"

        def embed(self, texts):
            raise ValueError("no such model")

    rows = spark.createDataFrame([(1, "a")], "question long, text string")
    with pytest.raises(Exception, match="QueryEmbeddingError.*question 1.*no such model"):
        M.asked(rows, Refuses, DIM).collect()


def test_memory_of_a_scan():
    """What a worker holds doesn't grow with the rows of a batch."""
    import tracemalloc

    import pyarrow as pa

    from codicil.functions.vectors import matrix
    from codicil.operators.nearest import Best, slices

    r = np.random.RandomState(5)
    q, x = r.randn(512, 8), r.randn(20_000, 8)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist())], ["id", "embedding"])
    best = Best(len(q), 21)
    tracemalloc.start()
    for b in slices(iter([batch]), len(q)):
        best.scan(np.asarray(b.column("id")), matrix(b.column("embedding")), q)
    got = pa.Table.from_batches(list(best.rows(np.arange(len(q)), ("question", "id", "similarity")))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all pairs of the batch are 82 MB a matrix
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ q[7]
    assert got[got.question == 7].sort_values("similarity", ascending=False).id.tolist() == np.argsort(-near)[:21].tolist()


def test_blocks_of_questions_leave_the_driver(spark, tmp_path, monkeypatch):
    """Questions of many blocks: the answers are those of a scan, ties by id, and the plan doesn't grow with the blocks."""
    from codicil.operators import nearest
    from codicil.operators.codes import CodeIndex

    r = np.random.RandomState(4)
    x = np.tile(r.randn(40, 16), (5, 1))  # every vector five times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("question"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i), n + 1) for q in range(0, 200, 20) for n, i in enumerate(np.lexsort((np.arange(200), -np.round(unit @ unit[q], 9)))[:7])}
    index = CodeIndex.build(df, f"{tmp_path}/codes", cells=5, parts=4)
    monkeypatch.setattr(nearest, "BLOCK", 3)
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(sum(a.nbytes for a in v) if isinstance(v, tuple) else 0) or broadcast(v))
    for found in (index.exact_of_many(asked, 7), S.nearest_of_many(df, asked, 7).withColumnRenamed("chunk_id", "id")):
        assert {(a.question, a.id, a["rank"]) for a in found.collect()} == want
        assert "Union" not in found._jdf.queryExecution().toString()
    assert 0 < max(sent) <= 3 * 17 * 8  # names and vectors of a block
    assert {(a.question, a.id) for a in index.nearest_of_many(asked, 7, 200).collect()} == {w[:2] for w in want}


def test_vectors_are_not_broadcast(spark, tmp_path):
    """Copies compress so well that the vectors look small enough; they still don't go through the driver."""
    from codicil.operators.codes import CodeIndex

    df = spark.range(2000).select("id", F.array(*((F.col("id") % (3 + i)).cast("double") for i in range(8))).alias("embedding"))
    index = CodeIndex.build(df, f"{tmp_path}/codes", cells=4, parts=4)
    found = index.nearest_of_many(df.where("id % 500 = 0").withColumnRenamed("id", "question"), 3, 6)
    assert len(found.collect()) == 12
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
