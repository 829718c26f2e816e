import json

from codicil.__main__ import main
from codicil.sources.records import COLUMNS


def test_commands(spark, tmp_path, capsys):
    row = dict.fromkeys(COLUMNS, "") | {"tipo_norma": "Decreto", "titulo_sumario": "Combustibles", "fecha_sancion": "2026-05-01"}
    rows = [row | {"id_norma": "1", "numero_norma": "829", "texto_original": "http://x.org/1"}, row | {"id_norma": "2", "numero_norma": "7", "texto_resumido": "régimen de pesca"}, row | {"id_norma": "x"}]
    (tmp_path / "r.csv").write_text(",".join(COLUMNS) + "\n" + "\n".join(",".join(f'"{r[c]}"' for c in COLUMNS) for r in rows), encoding="utf-8")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.original.htm").write_bytes(("<p>ARTÍCULO 1°.- Impuesto sobre los combustibles líquidos " + "y gaseosos " * 10 + "</p>").encode("latin-1"))
    store = ["--store", f"{tmp_path}/store"]
    run = lambda *a: (main([*a[:1], *store, *a[1:]], spark), capsys.readouterr().out.strip().split("\n"))[1]
    out = run("ingest", str(tmp_path / "r.csv"), "--type", "decreto")
    assert json.loads(out[0]) == {"read": 3, "rejected": 1, "filtered_out": 0, "selected": 2} and json.loads(out[-1])["added"] == 2
    assert json.loads(run("texts", "--pages", str(tmp_path / "pages"))[0])["saved"] == 2
    assert json.loads(run("texts", "--pages", str(tmp_path / "pages"))[0])["unchanged"] == 2
    assert json.loads(run("embed", "--dimensions", "64")[0]) == {"embedded": 2}
    found = [json.loads(x) for x in run("search", "¿Qué dice el Decreto 829/2026?", "--dimensions", "64", "--min-similarity", "1")]
    assert [x["name"] for x in found] == ["Decreto 829/2026"] and found[0]["match"] == "reference" and found[0]["url"] == "http://x.org/1"
    assert main(["search", *store, "a"], spark) == 2
    gold = [{"question": "Decreto 829/2026", "kind": "reference", "expected": [1]}, {"question": "régimen de pesca", "kind": "topic", "expected": [2, 99]}, {"question": "ajena", "kind": "topic", "expected": [77]}, {"question": "zzz", "kind": "absent"}]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, gold)), encoding="utf-8")
    ask = ("evaluate", str(tmp_path / "gold.jsonl"), "--dimensions", "64", "--min-similarity", "0.2")
    out = [json.loads(x) for x in run(*ask)]
    assert out[0]["skipped"] == 1 and out[1]["questions"] == 2 and out[1]["recall_5"] == 1 and [x["kind"] for x in out[2:4]] == ["reference", "topic"] and out[4] == {"absent": 1, "rejected": 1}
    out = [json.loads(x) for x in run(*ask, "--floors")][1:]
    assert [x["floor"] for x in out] == sorted(x["floor"] for x in out) and len(out) == 12 and out[-1]["recall_5"] >= 0.5 and out[-1]["rejected"] == 1
    out = [json.loads(x) for x in run(*ask, "--versions", "0.9", "--timings")]
    assert out[1]["recall_5"] == 1 and out[5] == {"under_newer": 0} and out[6]["questions"] == 3 and out[6]["ms"] > 0
    (tmp_path / "gold.jsonl").write_text(json.dumps(gold[2]), encoding="utf-8")
    assert main([ask[0], *store, *ask[1:]], spark) == 2
    row |= {"titulo_sumario": "Pesca"}
    rows += [row | {"id_norma": "4", "numero_norma": "9", "texto_resumido": "faros"}]
    rows[1] = rows[1] | {"titulo_sumario": "Pesca"}
    (tmp_path / "s.csv").write_text(",".join(COLUMNS) + "\n" + "\n".join(",".join(f'"{r[c]}"' for c in COLUMNS) for r in rows), encoding="utf-8")
    update = ("update", str(tmp_path / "s.csv"), "--type", "decreto", "--pages", str(tmp_path / "pages"), "--dimensions", "64")
    report = json.loads(run(*update, "--check")[0])
    assert report["dataset"] == {"in_subset": 3, "added": 1, "changed": 1, "unchanged": 1} and "new_texts" not in report
    assert json.loads(run(*update, "--if-due")[0]) == {"due": False}
    report = json.loads(run(*update)[0])
    assert report["new_texts"]["saved"] == 1 and report["rechunked"]["saved"] == 1 and report["refetched"] is None and report["embedded"] == {"embedded": 3}
    again = json.loads(run(*update)[0])
    assert again["dataset"] is None and again["new_texts"] is None
    assert main(["update", *store, str(tmp_path / "none.csv"), "--pages", str(tmp_path / "pages")], spark) == 1
    assert "failed: FileNotFoundError" in run("status")[1]
    assert run("status")[0].startswith("Last update: ")


def test_gold_questions():
    import pytest

    from codicil.operators.evaluate import GoldQuestion, read_gold

    assert read_gold(["", '{"question": " a ", "kind": "topic", "expected": [3]}', '{"question": "b", "kind": "absent"}']) == [GoldQuestion("a", "topic", (3,)), GoldQuestion("b", "absent", ())]
    for line, why in (('{"kind": "topic", "expected": [3]}', "no question"), ('{"question": "a", "kind": "odd", "expected": [3]}', "kind must be"), ('{"question": "a", "kind": "topic"}', "only absent"), ('{"question": "a", "kind": "topic", "expected": ["3"]}', "expected must be a list of ids")):
        with pytest.raises(ValueError, match=f"line 1: {why}"):
            read_gold([line])
    with pytest.raises(ValueError, match="line 2: the question stands twice"):
        read_gold(['{"question": "a", "kind": "topic", "expected": [3]}'] * 2)


def test_maintain(spark, tmp_path, capsys):
    from codicil.__main__ import TEXTS, stores

    texts = stores(spark, str(tmp_path))[1]
    row = spark.createDataFrame([(1, "summary", None, "one", "h1"), (2, "summary", None, "two", "h2")], TEXTS)
    texts.append(row)
    texts.replace(row.where("regulation_id = 1").withColumn("content", row.content_hash), row.where("regulation_id = 1").select("regulation_id"))
    assert main(["maintain", "--store", str(tmp_path), "--most", "1", "--keep", "1"], spark) == 0
    said = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert [x["table"] for x in said] == ["regulations", "texts", "chunks", "runs", "unfinished"] and said[1]["folders_dropped"] > 0 and said[0]["version"] == 0
    assert sorted((r.regulation_id, r.content) for r in texts.read().collect()) == [(1, "h1"), (2, "two")]
