"""Every operator on odd rows and on an empty table: a defined result, one row for each row."""

import pytest
from pyspark.sql import functions as F


def _ops():
    import public_tokenizers as P

    from codicil.llm import byte_bpe, chosen_path, decontaminate, jaccard_join, language, line_templates, merkle, personal_data, quality_rules, suffix_dedup, toxicity

    def bench(docs):
        return docs.sparkSession.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None), (None, "x y"), (3, "")], "item_id long, text string")

    def labels(docs):
        return docs.sparkSession.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1), (7, None), (3, 0)], "doc_id long, toxic int")

    return {
        "line": lambda d: line_templates.drop_lines(d, min_docs=2),
        "personal": personal_data.find_personal_data,
        "suffix": suffix_dedup.drop_repeats,
        "jaccard": jaccard_join.jaccard_groups,
        "path": chosen_path.near_duplicates,
        "merkle": merkle.audited,
        "language": language.predict_held_out,
        "quality": quality_rules.quality,
        "toxicity": lambda d: toxicity.score_held_out(d, labels(d)),
        "bpe": lambda d: byte_bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "leaks": lambda d: decontaminate.find_leaks(d, bench(d)),
    }


NAMES = ["line", "personal", "suffix", "jaccard", "path", "merkle", "language", "quality", "toxicity", "bpe", "leaks"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, name):
    out = _ops()[name](odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r.doc_id for r in odd.select("doc_id").collect()), key=key)
    twice = [r for r in rows if r.doc_id == 1]
    if name == "merkle":  # two leaves next to each other: each is in the other's proof
        twice = [r.asDict() | {"rank": 0, "proof": "", "proof_sha256": ""} for r in twice]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, name):
    assert _ops()[name](empty).count() == 0


def test_defined_results(odd):
    ops = _ops()
    leaks = {r.doc_id: r for r in ops["leaks"](odd).collect()}
    assert leaks[1].contaminated and leaks[1].n_hit == 10 and leaks[1].items == [1]
    assert not leaks[2].contaminated and leaks[2].n_words == 0
    groups = {r.doc_id: r for r in ops["jaccard"](odd).collect()}
    assert groups[3].n_shingles == 0 and groups[3].component_id == 3 and groups[None].component_id is None
    pii = {r.doc_id: r for r in ops["personal"](odd).collect()}[9]
    assert (pii.n_email, pii.n_ip, pii.n_card, pii.n_phone) == (1, 1, 1, 1)
    lang = {r.doc_id: r for r in ops["language"](odd).collect()}
    assert lang[2].lang_pred == "und" and lang[4].lang_pred == "und"
    cut = {r.doc_id: r for r in ops["suffix"](odd).collect()}
    assert cut[6].n_removed == 5000 - 100 + 99 and cut[6].n_spans == 1  # all but the first byte
    quality = {r.doc_id: r for r in ops["quality"](odd).collect()}
    assert not quality[2].kept and quality[8].n_dup_lines == 1


#: Names that the operators use inside, as columns of the table.
INSIDE = "n_words n_hit n_items spans items longest contaminated kept gone doc line template bad_doc bad_th th host bucket kind key data node copy component_id n_lines n_dropped own_text hit_doc ids n_tokens kept_0 back_0 block".split()


def _stages(spark):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_keep_columns(odd, spark, tmp_path, kind):
    """Each stage on nulls, repeats, clashing names and ids of another type: the same columns, clean documents stay."""
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "lang", "source", "n_chars").withColumns({c: F.lit(f"own {c}") for c in INSIDE})
    for name, stage in _stages(spark).items():
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "byte-level BPE":
            assert len(rows) == docs.count()
            continue
        assert out.dtypes == docs.dtypes and all(r[c] == f"own {c}" for r in rows for c in INSIDE)
        found = sorted(int(r.doc_id) for r in rows if r.doc_id is not None)
        # 1 is a leak twice over and too short; 2, 3, 4 have no words; 5 is long and clean
        assert 5 in found and (1 in found) == (name in ("line dedup", "n-gram Jaccard join"))
        if name == "n-gram Jaccard join":
            assert found == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]  # rows of one id are one document


def test_stages_of_an_empty_table(empty, spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in _stages(spark).values():
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_ids_that_are_no_numbers(spark):
    """Numbers written as text are read; anything else stops the job instead of losing its row's links."""
    from codicil.llm import chosen_path, decontaminate, jaccard_join, merkle, personal_data, quality_rules

    docs = spark.createDataFrame([("11", "one two"), ("7", "mail a@b.org"), (None, "x")], "doc_id string, text string").withColumn("source", F.lit("s"))
    assert sorted((r.doc_id or 0, r.n_email) for r in personal_data.find_personal_data(docs).collect()) == [(0, 0), (7, 1), (11, 0)]
    odd = docs.union(docs.limit(1).withColumn("doc_id", F.lit("a-1")))
    items = spark.createDataFrame([("q-1", "one two")], "item_id string, text string")
    for run in (lambda: personal_data.find_personal_data(odd), lambda: quality_rules.keep_good(odd), lambda: jaccard_join.jaccard_groups(odd), lambda: chosen_path.near_duplicates(odd), lambda: decontaminate.find_leaks(docs, items), lambda: decontaminate.drop_leaks(docs, items)):
        with pytest.raises(Exception, match="must be a whole number"):
            run().collect()
    with pytest.raises(TypeError, match="doc_id is string"):
        merkle.manifest(docs.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)}))


def test_ties(spark):
    """Equal texts: the smallest id is the one that stays, languages that fit alike go by name."""
    from codicil.llm import language, line_templates

    docs = spark.createDataFrame([(i, f"this notice stands on all pages\nown {chr(97 + i)}") for i in (5, 3, 9)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_lines(docs, min_docs=3).collect()} == {3: 0, 5: 1, 9: 1}
    same = {"xx": b"abc def ghi " * 9, "aa": b"abc def ghi " * 9}
    got = language.classify(spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string"), same).first()
    assert got.lang_pred == "aa" and got.rejected and got.margin == 0
    many = spark.createDataFrame([(i, f"text of {i} ab cd ef gh", f"l{i:03}") for i in range(260)], "doc_id long, text string, lang string")
    assert sorted(language.learn(many)) == [f"l{i:03}" for i in range(200)]


def test_pages(spark):
    from codicil.llm.page_text import main_text

    rows = [(1, "http://a.x/1", "<p>Hi"), (1, "http://a.x/1", "<p>Hi"), (2, None, None), (None, "http://a.x/2", ""), (3, "::bad[", "<!-- never closed <b>text"), (4, "http://a.x/3", "<div>" * 2000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("lines", F.lit(1))
    out = main_text(df).collect()
    assert len(out) == 6
    by = {(r.page_id, r.url): r.text for r in out}
    assert by[1, "http://a.x/1"] == "Hi" and by[2, None] == "" and by[4, "http://a.x/3"] == "deep"
    assert main_text(df.limit(0)).count() == 0


def test_join_of_hot_keys(spark):
    """What a plain join gives, for hot keys with and without a match; rows of hot keys pass one join only."""
    from pyspark.sql import functions as F

    from codicil.llm.common import settled, spread_join

    rows = settled(spark.range(4000).select(F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 2).when(F.col("id") == 2, None).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("node")))
    table = settled(spark.range(3000).where("id != 2").select(F.col("id").alias("key"), (F.col("id") * 7).alias("x")))
    for how in ("inner", "left"):
        out = spread_join(rows, table, "key", how)
        assert out.columns == ["key", "node", "x"]
        assert sorted(map(str, out.collect())) == sorted(map(str, rows.join(table, "key", how).collect()))
        assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
