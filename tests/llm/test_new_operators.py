"""Collocations, the chosen-path join and the Merkle manifest against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest


def plain_collocations(rows, least, within, top):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if " " not in p)
        kept = {p: a for p, a in c.items() if " " in p and a >= least}
        found = []
        for p, a in kept.items():
            w = p.split(" ")
            longer = [b for q, b in kept.items() if q.count(" ") == 2 and len(w) == 2 and p in (" ".join(q.split(" ")[:2]), " ".join(q.split(" ")[1:]))]
            if longer and 100 * max(longer) >= within * a:
                continue
            cuts = [(1_000_000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((score, a, p, c[" ".join(w[:k])], c[" ".join(w[k:])]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n, s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    from codicil.llm import collocations as C

    monkeypatch.setattr(C, "RUN", 50)
    monkeypatch.setattr(C, "SHARD", 300)
    r = random.Random(2)
    pool = ["a", "b", "New", "york", "city", "é", "日本", "\x1c", "ﬁ", "z" * 40, "\x00"]
    rows = [(r.choice(["en", None, "de", "und"]), "".join(r.choice(pool) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r", ";"]) for _ in range(r.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("xx", "one two three"), ("en", "new york city " * 400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, within, top in ((3, 50, 40), (2, 90, 2000)):
        got = sorted(tuple(x) for x in C.collocations(df, least, within, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain_collocations(rows, least, within, top)
    assert C.collocations(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS phrase", "2 AS n", "'x' AS part", "3 AS salt", "4 AS rank")
    assert C.collocations(clash).count() == C.collocations(df).count()


def test_bitmaps_cross_no_piece():
    from codicil.llm.collocations import Shard

    s = Shard("en", [b"a b a b. a b", b"b a"])
    _, owner, word, bits = s.extended(*s.entries)
    n = collections.Counter()
    for x, y, z in zip(owner.tolist(), word.tolist(), np.bitwise_count(bits).tolist()):
        n[s.names[x].as_py() + s.names[y].as_py()] += z
    assert n == {"ab": 3, "ba": 2}


def plain_components(texts, k, percent):
    def cut(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: cut(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [48, 3])
def test_chosen_path(spark, monkeypatch, small):
    """A chain of copies, a crowd around one text, exact copies, short texts; with small groups, most are large ones that are dealt in chunks."""
    from codicil.llm import chosen_path as C

    monkeypatch.setattr(C, "SMALL", small)
    monkeypatch.setattr(C, "CHUNK", 16)
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts, chain = [], list(base)
    for i in range(60):
        texts.append(" ".join(chain))
        chain = list(chain)
        chain[r.randrange(120)] = f"c{i}"
    for i in range(120):
        w = list(base)
        for j in range(r.randrange(0, 6)):
            w[r.randrange(120)] = f"y{i}-{j}"
        texts.append(" ".join(w).upper() if i % 2 else " ".join(w))
    texts += [" ".join(base)] * 30 + ["one", "One", "one two", "", None, "  ", "a b c d e", "a b c d e f"] + [" ".join(f"q{r.randrange(300)}" for _ in range(30)) for _ in range(80)]
    rows = list(enumerate(texts))
    want = plain_components(rows, 5, 85)
    got = {x.doc_id: x for x in C.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.component_id == i) for i, x in got.items())


def test_chances_of_the_trees():
    from codicil.llm import chosen_path as C

    assert C.recall(0.85, 85) > 0.9999 and C.recall(0.5, 85, depth=4, trees=1) < 0.2 and C.recall(1.0, 85) == 1
    r = np.random.RandomState(1)
    met = 0
    for t in range(300):  # sketches that agree in 85 of 100 tokens, on average
        a = r.randint(0, 1 << 32, C.WIDTH, dtype=np.uint32)
        b = np.where(r.rand(C.WIDTH) < 0.85, a, a + 1)
        paths = [{int(p)} for p in (C.root_path(t), C.root_path(t))]
        for depth in range(3):
            paths = [{int(x) for p in own for x in C.branches(np.array([p], np.uint64), tokens[None, :], 85, depth == 0)[1]} for own, tokens in zip(paths, (a, b))]
        met += bool(paths[0] & paths[1])
    assert abs(met / 300 - C.recall(0.85, 85, depth=3, trees=1)) < 0.1


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows, fanout):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: H("".join(map(part, (d, s, g, n, t))))

    def tree(nodes):
        """The root, and for each node its siblings left and right by level."""
        beside, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, x in enumerate(at):
                a = x // fanout * fanout
                beside[i].append(("".join(nodes[a:x]), "".join(nodes[x + 1 : a + fanout])))
            nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
            at = [x // fanout for x in at]
        return nodes[0], beside

    by = collections.defaultdict(list)
    for d, s, g, n, t in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        own = leaf(d, s, g, n, t)
        by[g].append(((d is not None, d or 0), own, leaf(d, s, g, n + 1, t) if hit else own, d))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(by[g], key=lambda x: x[:2]),) for g in langs}
    trees = {g: (x, *tree([y[1] for y in x])) for g, (x,) in trees.items()}
    root, above = tree([trees[g][1] for g in langs])
    out = []
    for i, g in enumerate(langs):
        own, sub, beside = trees[g]
        for (_, one, other, d), b in zip(own, beside):
            b = b + above[i]
            h = other
            for x, y in b:
                h = H(x + h + y)
            out.append((d, one, sub, root, H("".join(x + y for x, y in b)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, monkeypatch, fanout):
    from codicil.llm import merkle as M

    monkeypatch.setattr(M, "MOST", 4)
    monkeypatch.setattr(M, "LEAVES", 9)
    r = random.Random(fanout)
    rows = [(r.choice([i, i * 1000003, -i, i << 40]), r.choice(["s", None, "é"]), r.choice(["en", "de", None, "日", "", "eñ"]), r.choice([None, 5, -1]), r.choice(["t", None, "", "x:y", "日本"])) for i in range(160)]
    rows += [(7, "s", "en", 1, "same")] * 25 + [(9, "s", "en", i, "one id") for i in range(20)] + [(None, None, None, None, None)] * 3 + [(1, "s", "alone", 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    df = df.selectExpr("*", "1 AS rank", "2 AS key", "3 AS g", "4 AS leaf", "5 AS m")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((tuple(x[c] for c in columns) for x in M.audited(df, fanout).select(*columns).collect()), key=str)
    assert got == plain_manifest(rows, fanout)
    whole = M.folded(M.manifest(df, fanout))
    assert whole.where("verified").count() == len(rows)
    assert M.audited(df.limit(0)).count() == 0


def test_ranks(spark, monkeypatch, tmp_path):
    from codicil.llm import merkle as M

    monkeypatch.setattr(M, "MOST", 3)
    r = random.Random(1)
    rows = {(g, M_key, r.randrange(1, 4)) for g in "ab" for M_key in {f"{r.choice([r.randrange(40), r.randrange(1 << 48)]):016X}" for _ in range(120)}}
    spark.createDataFrame(list(rows), "g string, key string, m long").write.parquet(f"{tmp_path}/r")
    got = {(x.g, x.key): (x["rank"], x.total) for x in M.radix_ranks(spark.read.parquet(f"{tmp_path}/r")).collect()}
    for g in "ab":
        before = 0
        own = sorted((k, m) for h, k, m in rows if h == g)
        for k, m in own:
            assert got[g, k] == (before, sum(m for _, m in own))
            before += m
