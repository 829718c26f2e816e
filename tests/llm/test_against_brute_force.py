"""Each operator against a plain version of what it should return."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Random prose with exact copies, near copies, a very common line and shared passages."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    common, passage = prose(14), prose(60)
    out = []
    for i in range(160):
        lines = [prose(r.randrange(3, 60)) for _ in range(r.randrange(1, 4))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), common)
        if i % 11 == 0:
            lines.append(passage)
        out.append("\n".join(lines))
    for _ in range(40):
        out.append(out[7])
    base = prose(150)
    for i in range(90):
        w = base.split()
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += ["ab " * 300, "z" * 700, "z" * 300, "", "one", "one two"]
    r.shuffle(out)
    return out


def test_suffix_dedup(spark, corpus):
    from codicil.llm.suffix_dedup import drop_repeats

    seen, want = set(), {}
    for i, t in enumerate(corpus):
        b = t.encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(s)
        want[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(frame(spark, corpus)).collect()}
    assert got == want


def test_suffix_dedup_with_frequent_triggers(spark, corpus, monkeypatch):
    """The way for triggers too frequent to bring together gives the same."""
    from codicil.llm import suffix_dedup

    want = {r.doc_id: r.kept_sha256 for r in suffix_dedup.drop_repeats(frame(spark, corpus)).collect()}
    found = suffix_dedup.repeated_triggers

    def all_frequent(docs):
        h = np.unique(np.concatenate([suffix_dedup.Parsed([(0, 0, t.encode())]).h.astype(np.uint64) for t in corpus if len(t) >= 100]))
        return found(docs)[0], h

    monkeypatch.setattr(suffix_dedup, "repeated_triggers", all_frequent)
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.drop_repeats(frame(spark, corpus)).collect()} == want


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 70)])
def test_jaccard(spark, corpus, k, percent):
    from codicil.llm.jaccard_join import jaccard_groups

    sets = []
    for t in corpus:
        w = re.findall("[^\x20\x09-\x0d]+", t.lower())
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(frame(spark, corpus), k, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_links_strays_with_connected_members(spark):
    from codicil.llm.jaccard_join import jaccard_groups, node_of, shingles

    r, n = random.Random(4), 20_000
    base = [f"w{r.randrange(10**9)}" for _ in range(n)]

    def edited(words, at):
        return [f"x{r.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]

    def similarity(a, b):
        a, b = (set(zip(x, x[1:], x[2:])) for x in (a, b))
        return len(a & b) / len(a | b)

    def node(words):
        return node_of(shingles(" ".join(words), 3))

    copies = sorted((edited(base, {i}) for i in range(1, 37, 3)), key=node)  # the first has the smallest node
    spots = r.sample(range(0, n, 4), int(0.034 * n))  # an edit changes three shingles
    f = v = []
    while not f or min(node(f), node(v)) < node(copies[0]):
        f = edited(copies[0], set(spots[::2]))
        v = edited(f, set(spots[1::2]))
    assert similarity(f, copies[0]) > 0.9 < similarity(f, v) and all(similarity(v, c) < 0.85 for c in copies)
    docs = [" ".join(x) for x in (*copies, f, v, edited(base, set(range(0, n, 2))))]
    got = {x.doc_id: x.component_id for x in jaccard_groups(frame(spark, docs), 3, 90).collect()}
    assert got == {i: 0 for i in range(14)} | {14: 14}


def test_signature_tree_prunes_nothing_that_links():
    from codicil.llm.jaccard_join import links

    r = np.random.RandomState(1)
    base = [np.unique(r.randint(0, 1 << 62, 80).astype(np.uint64)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = r.rand(len(b)) > 0.06
            sets.append(np.unique(np.r_[b[keep], r.randint(0, 1 << 62, 2).astype(np.uint64)]))
    parent = list(range(len(sets)))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            x = len(np.intersect1d(sets[i], sets[j]))
            if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    got = list(range(len(sets)))
    for i, j in links(sets, 85):
        a, b = find(got, i), find(got, j)
        got[max(a, b)] = min(a, b)
    assert [find(got, i) for i in range(len(sets))] == [find(parent, i) for i in range(len(sets))]


def test_components(spark):
    from codicil.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100, 400: 400, 500: 400} | {1000 + i: 1000 for i in range(60)}
    assert got == want


def test_line_templates(spark):
    from codicil.llm.line_templates import CONSTANT, DEPTH, drop_lines

    r = random.Random(2)
    vocab = [f"t{chr(97 + i)}" for i in range(20)]
    docs = []
    for i in range(120):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 9))) for _ in range(3)]
        if i % 4 == 0:
            lines.append(f"page {i} of the report was printed for user{i} on monday")
        if i % 5 == 0:
            lines.append("all rights reserved by the makers of " + r.choice(["alpha", "beta", f"x{chr(97 + i % 26)}"]))
        docs.append("\n".join(lines + [""]))
    min_docs = 6
    mask = lambda t: "\0" if re.search("[0-9]", t) else t
    parsed = [[tuple(map(mask, x.split())) for x in d.split("\n")] for d in docs]
    at = collections.defaultdict(set)
    for i, lines in enumerate(parsed):
        for t in filter(None, lines):
            for p, w in enumerate(t):
                at[len(t), t[:DEPTH], p, w].add(i)

    def template(t):
        return tuple(w if p < DEPTH or len(at[len(t), t[:DEPTH], p, w]) >= min_docs else None for p, w in enumerate(t))

    held = collections.defaultdict(set)
    for i, lines in enumerate(parsed):
        for t in filter(None, lines):
            x = template(t)
            if sum(v is not None for v in x) >= CONSTANT * len(x):
                held[x].add(i)
    want = {}
    for i, (d, lines) in enumerate(zip(docs, parsed)):
        kept = [raw for raw, t in zip(d.split("\n"), lines) if not t or len(held[template(t)]) < min_docs or min(held[template(t)]) == i]
        want[i] = (sum(map(bool, lines)), len(lines) - len(kept), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in drop_lines(frame(spark, docs), min_docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 30


def test_fields_of_templates_at_every_size(spark):
    from codicil.llm.line_templates import drop_lines

    letters = "abcdefghij"
    names, towns = ([f"{x}{a}{b}" for a in letters for b in letters] for x in ("n", "t"))
    for n in (100, 1_000, 20_000):
        r = random.Random(n)
        docs = [f"report was filed by {r.choice(names)} at the office of {r.choice(towns)} in due time\nreport was seen by all and closed" for _ in range(n)]
        docs += [f"report was filed by {x} on a day when all stood empty here" for x in names[:9]]  # same leaf, too few
        got = [(x.doc_id, x.n_dropped) for x in drop_lines(frame(spark, docs)).select("doc_id", "n_dropped").collect()]
        assert dict(got) == {i: 2 if 0 < i < n else 0 for i in range(n + 9)}


def test_byte_bpe(spark, corpus):
    import base64

    import public_tokenizers as P
    import tiktoken

    from codicil.llm.byte_bpe import encode_documents, load

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = corpus[:60] + ["<|endoftext|> don't  stop\n\n\n x", "日本語 🙂🙂 ñandú", "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, "\r\n\t\x00\x07", "12345678901234567890", "!?!?!?----====", " " * 300, "supercalifragilisticexpialidocious" * 5]
    got = {r.doc_id: r for r in encode_documents(frame(spark, texts), path, P.PATTERN, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == reference.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(np.array(got[i].ids, "<u4").tobytes()).hexdigest()
    enc = load(path)
    data = "internationalisation".encode()
    last = enc.last_tokens(data)
    assert enc.walk(enc.append(data[:7], last[:7], data[7:])) == enc.merged(data) == enc.walk(last)
    for n in range(1, len(data) + 1):
        assert enc.walk(last[:n]) == enc.merged(data[:n])
    edited, table = enc.edit(data, last, 5, 8, b"XYZ")
    assert enc.walk(table) == enc.merged(edited) and enc.decode(enc.walk(table)) == edited


def _leaks(docs, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[j : j + window])].add(i)
    out = {}
    for d, t in enumerate(docs):
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[j : j + n])):
                    found |= ids
                    hit[j : j + n] = [1] * n
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, corpus, block):
    from codicil.llm.decontaminate import find_leaks

    r = random.Random(4)
    items = [(100 + i, " ".join(t.split()[3 : 3 + r.randrange(1, 25)]).upper()) for i, t in enumerate(corpus[:25])] + [(7, "never in any text at all, not once in a thousand"), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in find_leaks(frame(spark, corpus), bench, block_bytes=block).collect()}
    assert got == _leaks(corpus, items)


def test_longest_match(spark):
    from codicil.llm.decontaminate import find_leaks

    item = " ".join(f"w{i}" for i in range(30))
    docs = ["a b " + " ".join(f"w{i}" for i in range(4, 27)) + " c", "x " + " ".join(f"w{i}" for i in range(12)), "none of it"]
    got = {r.doc_id: r.longest for r in find_leaks(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: 23, 1: 12, 2: 0}


def test_windows_that_items_share(spark):
    """Spans, items and longest matches of random short words, and a prompt in all items, which is searched for once."""
    import time

    from codicil.llm.decontaminate import Block, _find

    def plainly(items, words, window):
        hit, ids, most = set(), set(), 0
        for name, s in items:
            n = min(window, len(s))
            for j in range(max(1, len(s) - n + 1)):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == s[j : j + n]:
                        k = n
                        while n == window and p + k < len(words) and j + k < len(s) and words[p + k] == s[j + k]:
                            k += 1
                        hit, ids, most = hit | set(range(p, p + n)), ids | {name}, max(most, k)
        return hit, ids, most

    r = random.Random(12)
    for _ in range(150):
        names, window = [b"%d" % i for i in range(r.choice([2, 3, 6]))], r.choice([2, 3, 5])
        items = [(r.randrange(9), [r.choice(names) for _ in range(r.randrange(1, 14))]) for _ in range(r.randrange(1, 8))]
        docs = [[r.choice([*names, b"x"]) for _ in range(r.randrange(0, 30))] for _ in range(r.randrange(1, 5))] + [items[0][1] + items[-1][1]]
        got = [({x for a, b in spans for x in range(a, b)}, ids, most) for spans, ids, most in _find(Block(items, window), docs)]
        assert got == [plainly(items, d, window) for d in docs]
    prompt, took = [b"p%d" % i for i in range(20)], []
    for n in (1000, 4000):
        block = Block([(i, [*prompt, *(b"w%d_%d" % (i, j) for j in range(10))]) for i in range(n)], 10)
        since = time.monotonic()
        found = _find(block, [(prompt + [b"z"]) * 400 for _ in range(20)])
        took.append(time.monotonic() - since)
        assert all(len(spans) == 400 and len(ids) == n and most == 20 for spans, ids, most in found)
    assert took[1] < 2 * took[0] + 0.5


def test_language_of_long_texts_only(spark):
    """A language all of whose texts are long is learned like the others; rows that repeat count once."""
    from codicil.llm import language

    r = random.Random(3)
    long_words, short_words = (["".join(r.choice(c) for _ in range(6)) for _ in range(300)] for c in ("aeiou", "klmnp"))
    rows = [(i, " ".join(r.choices(long_words, k=9000)), "long") for i in range(3)] + [(10 + i, " ".join(r.choices(short_words, k=60)), "short") for i in range(20)] * 2
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(learned) == ["long", "short"] and all(len(v) > 1000 for v in learned.values())
    asked = spark.createDataFrame([(1, " ".join(r.choices(long_words, k=50))), (2, " ".join(r.choices(short_words, k=50)))], "doc_id long, text string")
    assert [x.lang_pred for x in language.classify(asked, learned).orderBy("doc_id").collect()] == ["long", "short"]


def test_quality(spark):
    from codicil.llm.quality_rules import quality, text_counts

    texts = ["a b c d e f g h i a b c d e f g h", "x\nx\ny\n\n \n", "#$%& <b> |", "é ñ " * 30]
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = [0] * len(w)
        for j in range(len(w) - 7):
            if seen[tuple(w[j : j + 8])] > 1:
                hit[j : j + 8] = [1] * 8
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert text_counts(t) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))
    menu = " ".join(f"menu{i}" for i in range(40))
    rows = [(i, menu + f"\nown words of page {i}", "h") for i in range(60)] + [(100 + i, " ".join(f"p{i}q{j}" for j in range(50)), "h") for i in range(40)] + [(500, menu + "\n" + " ".join(f"z{j}" for j in range(60)), "other")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[i].n_removed_words == 40 for i in range(60))
    assert all(got[100 + i].kept for i in range(40)) and got[500].kept


def test_personal_data_base():
    from codicil.llm.personal_data import KINDS, PATTERNS, base_spans, valid

    r = random.Random(9)
    parts = ["a.b@c.de", "@", "x@y", "x@y.z@w.com", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "+12 3", "12-34-56", "a+b_%@host-1.org.", "é@b.com", "word", " ", "\n", "..", "4111111111111111 42", "+49 30 1234567 +49 30 1234567"]
    for _ in range(600):
        t = "".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randrange(1, 8)))
        assert base_spans(t) == {k: [m.span() for m in PATTERNS[k].finditer(t) if valid(k, m.group())] for k in KINDS}, t


def test_field_decodes_best_paths():
    """Cutting chains at words that are surely outside doesn't change the best path."""
    from codicil.llm.personal_data import LABELS, Decoder, labelled_table, train

    field = train(labelled_table())
    d = Decoder(field)
    table = labelled_table(60, seed=77)
    wrong = total = 0
    for (ws, ls), got in zip(table, d.labels([w for w, _ in table])):
        em = np.array([field.word(w)[0] for w in ws])
        look = [field.word(w)[1] for w in ws]
        em[1:] += field.before[look[:-1]]
        em[:-1] += field.after[look[1:]]
        em[0] += field.before[0]
        em[-1] += field.after[0]
        score, back = em[0] + field.step[0], []
        for e in em[1:]:
            through = score[:, None] + field.step
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + e
        y = [int((score + field.step[:, 0]).argmax())]
        for b in back[::-1]:
            y.append(int(b[y[-1]]))
        y = y[::-1]
        got = got.tolist() if len(got) else [0] * len(ws)
        assert got == y
        wrong += sum(LABELS[a] != b for a, b in zip(got, ls))
        total += len(ls)
    assert wrong <= 0.02 * total


def test_nearest_examples_are_exact():
    from codicil.llm.toxicity import BlockMaxIndex

    r = np.random.RandomState(0)
    v = np.where(r.rand(700, 40) > 0.85, r.rand(700, 40), 0).astype(np.float32)
    v[3] = v[4]
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    index = BlockMaxIndex(v)
    for i in range(60):
        q = v[i]
        terms = np.flatnonzero(q)
        got, cosine = index.nearest(terms, q[terms], 15)
        full = v[:, terms].astype(float) @ q[terms].astype(float)
        want = np.sort(full[full > 0])[::-1][:15]
        assert np.allclose(np.sort(cosine)[::-1], want, atol=1e-5)


def test_language_held_out(spark):
    from codicil.llm.language import predict_held_out

    r = random.Random(1)
    kinds = {"xx": ["foo", "bar", "bazi", "quxo", "lin"], "yy": ["mur", "tep", "zul", "ka", "oro"]}
    rows = [(i, " ".join("".join(r.choice(p) for _ in range(2)) for _ in range(40)), k) for i in range(150) for k, p in [sorted(kinds.items())[i % 2]]] + [(999, "123 !!", "xx")]
    got = predict_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {i: k for i, _, k in rows}
    held = [x for x in got if x.held_out and x.doc_id != 999]
    assert held and sum(x.lang_pred == by[x.doc_id] for x in held) >= 0.95 * len(held)
    assert {x.doc_id: x for x in got}[999].lang_pred == "und" and all(0 <= x.score <= 1 for x in got)


def test_toxicity_held_out(spark):
    from codicil.llm.toxicity import score_held_out

    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [r.choice(vocab) for _ in range(60)]
        for _ in range(3 if bad else 0):
            w[r.randrange(60)] = r.choice(["rotter", "scoundrel", "villain"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    got = score_held_out(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)


def test_page_differencing(spark):
    from codicil.llm.page_text import common_lines, main_text

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randrange(0, 14))] for _ in range(2))
        pairs = common_lines(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><div>Site of things</div><ul class='menu'><li>Home</ul>{}<div>All about us</div></body>"
    rows = [(i, f"http://h.example/{i // 10}/{i}", page.format(f"<p>Story number {i} begins<br>and &amp; ends {i * 7}.</p><p>Second   part {i}</p>")) for i in range(150)]
    rows.append((900, "http://other.example/x", "<nav>Menu</nav><article><h1>T</h1><p>Own&nbsp;text <b>bold<p>more</article><div class='comments'><p>nice!</div><footer>f"))
    got = {x.page_id: x for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(150):
        assert got[i].text == f"Story number {i} begins\nand & ends {i * 7}.\nSecond part {i}"
    assert got[900].text == "T\nOwn text bold\nmore" and got[900].n_chars == len(got[900].text)


def test_page_differencing_of_mostly_boilerplate(spark):
    from codicil.llm.page_text import main_text

    template = "".join(f"<div>Template line {i}</div>" for i in range(10))
    menu = "<nav>" + "".join(f"<p>Item {i}</p>" for i in range(40)) + "</nav>"
    own = lambda i: f"<p>Own text {i}</p><p>and more of {i}</p>"
    rows = [(i, f"http://a.example/{i:03}", template + own(i)) for i in range(150)]
    rows += [(1000 + i, f"http://b.example/{i:03}", menu + template + own(i)) for i in range(9)]
    rows += [(2000 + 2 * i + j, f"http://c.example/{i:03}{'/print' * j}", (template if not j else "") + own(i)) for i in range(9) for j in range(2)]
    rows += [(3000 + i, f"http://d.example/{i:03}", template + own(i // 100)) for i in range(200)]  # two pages under 100 URLs each
    rows += [(4000 + i, f"http://e.example/{i:03}", own(i // 100)) for i in range(80)]  # nothing but copies
    # pages that hold nothing but lines of the last one: its pair is the first, further off than the first reach
    rows += [(5000 + i, f"http://f.example/{i:03}", template.replace("Template", "Print") + own(i) if i == 0 else f"<div>Print line {i % 10}</div><div>Print line {(i + 3) % 10}</div>" if i < 39 else "".join(f"<div>Print line {x % 10}</div>" for x in range(30)) + own(9)) for i in range(40)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Own text {i}\nand more of {i}"
    for i in range(150):
        assert got[i] == text(i)
    for i in range(8):  # the last of c is next to a print page that shares nothing with it
        assert got[1000 + i] == got[2000 + 2 * i] == got[2001 + 2 * i] == text(i)
    for i in range(200):
        assert got[3000 + i] == text(i // 100)
    for i in range(80):
        assert got[4000 + i] == text(0)
    assert got[5039].split("\n")[-2:] == text(9).split("\n") and len(got[5039].split("\n")) == 22  # ten of its lines are shared with the first


def test_components_in_rounds(spark, monkeypatch):
    from codicil.llm import graph

    monkeypatch.setattr(graph, "ONE_TASK", 0)
    test_components(spark)


def test_many_pieces_at_once():
    import public_tokenizers as P

    from codicil.llm.byte_bpe import load

    r = random.Random(3)
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        enc = load(P.path(name))
        pieces = [bytes(r.choice(b"ab ein the 12 \xc3\xa9\xe6\x97") for _ in range(r.randrange(1, 60))) for _ in range(300)] + [b"a" * 250, b" " * 130, b"=" * 99]
        for p, ids in zip(pieces, enc.many.encode(pieces)):
            assert np.frombuffer(ids, "<u4").tolist() == enc.merged(p) == enc.walk(enc.last_tokens(p))


def test_personal_data_query(spark):
    """The counts, the digest and the spans of the whole query."""
    from codicil.llm.personal_data import KINDS, PATTERNS, find_personal_data, valid

    r = random.Random(10)
    parts = ["a.b@c.de", "x@y", "x@y.z@w.com", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "(555) 123-4567", "12-34-56", "é@b.com", "wort", "word,", "so", "Is", "4111111111111111 42", "9" * 30]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(150)] + ["", "x" * 267 + "@mail.example.com ok", "7" * 1_000_000, "1." * 300_000 + "1", "1" * 5000 + ".2.3.4"]
    rows = {x.doc_id: x for x in find_personal_data(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = {k: [m.span() for m in PATTERNS[k].finditer(t) if valid(k, m.group())] if len(t) < 10_000 else None for k in KINDS}
        got = rows[i]
        if base["ip"] is None:
            assert (got.n_email, got.n_card, got.n_phone) == (0, 0, 0) and got.n_ip == (75_000 if "." in t else 0)
            continue
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [len(base[k]) for k in KINDS]
        names = [f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]]
        assert got.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        every = got.spans.split(",") if got.spans else []
        assert [x for x in every if x in set(names)] == names and len(every) == len(names) + got.n_added
        for x in set(every) - set(names):  # added ones touch no base span of their kind
            k, a, b = x.split(":")
            assert all(int(b) <= c or d <= int(a) for c, d in base[k])
    assert sum(x.n_added for x in rows.values()) > 0


def test_quality_query(spark):
    """Line frequency over whole documents, held against a plain version."""
    from codicil.llm.quality_rules import quality, text_counts

    r = random.Random(21)
    notices = ["Read  our\tNOTICE of terms", "subscribe to the weekly letter of this house", "é all rights"]
    rows = []
    for i in range(400):
        host = r.choice(["a", "a", "a", "b", None])
        lines = [" ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(0, 4))]
        lines += [r.choice([n, n.upper(), f"  {n} "]) for n in notices if r.random() < 0.4]
        rows.append((i, "\n".join(lines) if r.random() > 0.02 else None, host))
    flat = lambda t: [x for x in (re.sub("[ \t\v\f\r]+", " ", y.lower()).strip(" ") for y in (t or "").split("\n")) if x]
    held, hosts = collections.Counter(), collections.Counter(h for _, _, h in rows)
    for _, t, h in rows:
        held.update({(h, x) for x in flat(t)})
    got = {x.doc_id: x for x in quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_docs=5, line_share=0.2).collect()}
    gone = 0
    for i, t, h in rows:
        removed = sum(len(x.split(" ")) for x in flat(t) if held[h, x] > max(5, 0.2 * hosts[h]))
        words, _, _, _, repeat = text_counts(t or "")
        failed = words < 20 or 100 * repeat > 30 * words
        assert (got[i].n_removed_words, got[i].base_failed, got[i].kept) == (removed, failed, not failed and words - removed >= 0.3 * words)
        gone += removed
    assert gone > 0


def test_leaks_of_repeated_ids_in_many_blocks(spark):
    """The number of blocks changes nothing, not for repeated ids either."""
    from codicil.llm.decontaminate import find_leaks

    item = " ".join(f"w{i}" for i in range(10))
    other = " ".join(f"v{i}" for i in range(10))
    docs = spark.createDataFrame([(1, item), (1, other), (1, item), (2, None), (None, item), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"u{i}x{j}" for j in range(10))) for i in range(40)] + [(99, item)], "item_id long, text string")
    found = [sorted(map(str, find_leaks(docs, bench, block_bytes=b).collect())) for b in (8 << 20, 200)]
    assert found[0] == found[1] and sum("n_hit=10" in x for x in found[0]) == 3


def test_hints_inside_articles(spark):
    """Differencing decides on lines of an article whose element only hints at being something else."""
    from codicil.llm.page_text import lines_of, main_text

    page = "<article><p>Story {0} begins.</p><div class='legal'><p>{1}</p></div><div class='share-box'>Tell your friends</div><div class='ad'>Buy {0}</div><p>Common closing words.</p></article>"
    rows = [(i, f"http://h.example/a/{i:02}", page.format(i, f"The court found {i}.")) for i in range(20)]
    got = {x.page_id: x for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):  # own legal text stays, shared buttons go, plain lines of the article stay though all have them
        assert got[i].text == f"Story {i} begins.\nThe court found {i}.\nCommon closing words." and got[i].n_deleted == 1
    for t in ("</b>" * 250_000, '<a "' * 250_000, "<!-- >" * 160_000, "<div>" * 100_000 + "</p>" * 100_000, "<article>" * 100_000):
        lines_of(t)  # a megabyte each; takes hours unless each is read once


def test_joins_of_hot_keys(spark):
    from codicil.llm.common import settled, spread_join

    rows = settled(spark.createDataFrame([(i, None if i % 50 == 0 else 7 if i % 3 else i) for i in range(2000)], "id long, key long"))
    table = settled(spark.createDataFrame([(k, k * 2) for k in range(7, 2000, 4)], "key long, twice long"))
    for how in ("inner", "left"):
        want = rows.join(table, "key", how)
        got = spread_join(rows, table, "key", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # a key that the table lacks
    less = table.where("key != 7")
    assert spread_join(rows, less, "key", "left").where("twice is null").count() == rows.join(less, "key", "left").where("twice is null").count()
    assert spread_join(rows.limit(0), table, "key").count() == 0


def test_one_fingerprint_of_several_triggers():
    import numpy as np

    from codicil.llm.suffix_dedup import in_order, later

    w, h = np.array([5, 9, 5, 5, 9, 5], np.uint64), np.array([1, 3, 2, 1, 3, 2], np.uint64)
    order, same = in_order(w, h)
    assert order.tolist() == [0, 3, 2, 5, 1, 4] and same.tolist() == [False, True] * 3
    head, again = later(w, np.arange(6), np.zeros(6, np.int64), h)
    assert sorted(head.tolist()) == [0, 1, 2] and sorted(again.tolist()) == [3, 4, 5]


#: Names of wrappers that say how a page is laid out, or name a region that can't be one where it holds the article.
WRAPPERS = "no-sidebar has-sidebar header-fixed menu-open with-ads comments-closed hidden-xs share-page search-results legal page-header-image content sidebar menu".split()


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='text'>{}</div>"])
def test_wrappers_around_the_main_text(inner):
    from codicil.llm.page_text import kept_lines, lines_of

    story = "".join(f"<p>Paragraph {i} of the story, with some words in it.</p>" for i in range(8))
    around = "<nav><p>Home</p><p>News</p></nav><div class='sidebar'><p>Short note</p></div>{}<div class='ad-box'>Buy now</div><div class='comments'><p>nice one</p></div><footer>About us</footer>"
    want = [f"Paragraph {i} of the story, with some words in it." for i in range(8)]
    for wrapper in [f"<div class='{x}'>{{}}</div>" for x in WRAPPERS] + ["<form action='/'>{}</form>", "<form><div id='has-sidebar'><div class='menu-open'>{}</div></div></form>", "<div hidden>{}</div>", "<div role='search'>{}</div>"]:
        for page in (around.format(wrapper.format(inner.format(story))), wrapper.format(around.format(inner.format(story)))):
            lines = lines_of(f"<html><body>{page}</body></html>")
            assert [x for (x, _), k in zip(lines, kept_lines(lines)) if k] == want, (wrapper, page)


def test_regions_stay_out():
    from codicil.llm.page_text import kept_lines, lines_of

    story = "<p>The story has a few words.</p>"
    for region in ["<div class='comments'>{}</div>", "<div class='comment-list'><article class='comment'>{}</article></div>", "<div class='sidebar'><article>{}</article></div>", "<aside>{}</aside>", "<form>{}</form>", "<div id='cookie-bar'>{}</div>"]:
        page = f"<article>{story * 3}</article>" + region.format("<p>Words that are no part of it.</p>")
        lines = lines_of(page)
        assert [x for (x, _), k in zip(lines, kept_lines(lines)) if k] == ["The story has a few words."] * 3, region
    lines = lines_of("<div><p>Short text.</p></div><div class='comments'>" + "<p>a very long comment on it</p>" * 9 + "</div>")
    assert [x for (x, _), k in zip(lines, kept_lines(lines)) if k] == ["Short text."]


def test_jaccard_never_gathers_unlike_texts_by_their_size(spark):
    """Sets at the low end of a class, which are the smaller ones of the pairs of the next class, all met in one cluster."""
    from codicil.llm.common import settled
    from codicil.llm.jaccard_join import Classes, clusters, jaccard_groups, nodes_and_edges, signatures

    r, of = np.random.default_rng(5), Classes(80)
    for n in (300, 500, 720, 1120, 1750, 2730, 4300):  # a little over 0.8 of the least size of a class
        for _ in range(10):
            found, kind = signatures(np.sort(r.integers(0, 2**64 - 1, n, np.uint64)), of)
            assert (kind != 255).all() and len(found) < 0.75 * n
    long = [f"l{x}" for x in range(2174)]
    docs = [" ".join(f"{i}.{x}" for x in range(1750 + i)) for i in range(40)] + [" ".join(long), " ".join(long[:1744])]  # 1740 of 2170 shingles
    docs = frame(spark, docs)
    assert clusters(settled(nodes_and_edges(docs, 5, 80)), 80).count() == 2
    got = {x.doc_id: x.component_id for x in jaccard_groups(docs, 5, 80).collect()}
    assert got == {i: min(i, 40) for i in range(42)}


def test_settled_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from codicil.llm.common import settled

    def files():
        return set(re.findall(r"shuffle_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before = files()
    assert len(settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    until = time.time() + 10  # they go in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
