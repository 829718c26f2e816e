"""Page text, normal form and chunks of whole tables against second, plain implementations."""

import html
import itertools
import os
import re

import pytest

from codicil.functions import chunks as K
from codicil.functions import pages as P
from codicil.plans import registry

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
EDGE = "".join(map(chr, [0x09, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
TOKEN = re.compile(r"<!--.*?-->|<!(?!--)[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)[^>]*>|([^<]+|<)", re.S | re.I)


def plain_normal(s):
    s = "".join(" " if c == "\xa0" else c for c in s)
    s = "".join(c for c in s if c in "\t\n" or not (ord(c) < 32 or 0x7F <= ord(c) <= 0x9F or c == chr(0xFFFD)))
    s = "".join(" " if k else "".join(g) for k, g in itertools.groupby(s, lambda c: c in " \t"))
    runs = ((c, len(list(g))) for c, g in itertools.groupby(s))
    s = "".join(c * (3 if n >= 5 and c in "._-=*~" else n) for c, n in runs)
    while (at := s.find(". " * 4)) >= 0:
        end = at
        while s.startswith(". ", end):
            end += 2
        end += s.startswith(".", end)
        s = s[:at] + "...\0" + s[end:]  # the mark keeps the new blank out of the search
    s = s.replace("\0", " ")
    lines = [x.lstrip(EDGE + "|").rstrip(EDGE) for x in s.split("\n")]
    out = []
    for blank, group in itertools.groupby(lines, lambda x: not x):
        group = list(group)
        out += group[:1] if blank else group
    return "\n".join(out).strip(EDGE + "\n")


def plain_page(page):
    """The tags as events, then paragraphs closed where HTML closes them, then what is hidden left out, then text."""
    events, last = [], 0
    for m in TOKEN.finditer(page):
        assert m.start() == last
        last = m.end()
        if m[4]:
            events.append(("data", m[4]))
        elif m[3]:
            events.append(("end" if m[2] else "start", m[3].lower()))
    text, depth, open_p = [], 0, False
    ends = P.LINE_ENDING | {"hr", "address", "article", "aside", "footer", "form", "main", "nav", "section", "pre", "dl", "fieldset"}
    for kind, what in events:
        shown = depth == 0
        if kind == "data":
            text += [re.sub(r"\s+", " ", html.unescape(what))] if shown else []
            continue
        if what in P.CHROME:
            depth = depth + 1 if kind == "start" else max(0, depth - 1)
            continue
        if open_p and (kind == "start" and what in ends or kind == "end" and what in P.LINE_ENDING and what != "p"):
            text += ["\n"] if shown else []
            open_p = False
        elif kind == "end" and what == "p" and not open_p:
            text += ["\n"] if shown else []
        if what == "p":
            open_p = kind == "start" and (shown or open_p)
        if shown and (what in P.LINE_ENDING or what == ("br" if kind == "start" else "tr")):
            text.append("\n")
        if shown and kind == "start" and what in ("td", "th"):
            text.append(" | ")
    return plain_normal("".join(text))


def plain_chunks(text, most=K.MAX_CHARS):
    size = lambda s: len(s.encode("utf-16-le")) // 2

    def pack(parts, joiner):
        held = parts[0]
        for p in parts[1:]:
            if held == "":
                held = p
            elif size(held + joiner + p) <= most:
                held += joiner + p
            else:
                yield held
                held = p
        if held:
            yield held

    def fit(s, how):
        if size(s) <= most:
            return [s]
        if not how:
            return ["".join(s[i : i + most]) for i in range(0, len(s), most)]
        split, joiner = how[0]
        return [y for x in pack(re.split(split, s), joiner) for y in fit(x, how[1:])]

    out, section, label, held, published = [], "preamble", None, [], False

    def close():
        for content in pack(held, "\n\n") if held else ():
            out.append((len(out), section, label, content))
        held.clear()

    for p in (x.strip() for x in re.split("\n\n+", text)):
        if not p:
            continue
        article = K.ARTICLE.match(p)
        if size(p) <= 120 and K.ANNEX.match(p):
            close()
            published, section, label = True, "annex", p.partition("\n")[0]
        elif article:
            close()
            number = "único" if article[1].strip("0123456789") else article[1]
            section, label = "annex" if published else "article", f"Artículo {number}" + (f" {article[2].lower()}" if article[2] else "")
        elif K.PUBLICATION.match(p) or (not published and K.CLOSING.match(p)):
            close()
            published, section, label = published or bool(K.PUBLICATION.match(p)), "closing", None
        elif published and section == "closing" and not K.NOTE.match(p):
            close()
            section, label = "annex", None
        held += fit(p, [("\n", "\n"), (r"(?<=[.;:])\s+", " "), (r"\s+", " ")])
    close()
    return out


def same(spark, name, table, key, text, plain, read):
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key, text).collect()
    want = {r[0]: plain(r[1]) for r in rows if r[1] is not None}
    got = read(registry.queries()[name](spark, FOLDER).collect())
    assert len(want) > 100 and {k for k in want if got.get(k, []) != want[k]} == set()
    assert not {k for k, v in got.items() if v} - set(want)


def test_page_text(spark):
    assert plain_page("<p>a<div>b</div></p><td>c<script>x</script><header><p>no</header>&amp;<br>d") == "a\n\nb\n\nc&\nd"
    same(spark, "html_to_text", "pages", "page_id", "html", plain_page, lambda rows: {r.page_id: r.text for r in rows})


def test_normal_form(spark):
    assert plain_normal(" a \t b\n\n\n\n| | c ..... d . . . . . e\x07") == "a b\n\nc ... d ... e"
    same(spark, "normalized_documents", "documents", "doc_id", "text", plain_normal, lambda rows: {r.doc_id: r.text for r in rows})


def test_chunks(spark):
    def read(rows):
        found = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.ordinal)):
            found.setdefault(r.doc_id, []).append((r.ordinal, r.section, r.label, r.content))
        return found

    same(spark, "chunk_documents", "documents", "doc_id", "text", plain_chunks, read)


def test_chunks_of_structured_texts():
    word = "palabra " * 300
    texts = [
        f"VISTO\n\nARTÍCULO 1°.- {word}\n\nsigue\n\nArt. 2 bis.- dos\n\nANEXO I\n\nARTÍCULO 3 - tres\n\nfin", f"{word}\n{word}; {word}", "x" * 4000, "DADA EN LA SALA DE SESIONES\n\nNota: n\n\notro",
        "e. 5/8/2022 N° 1\n\n(Nota a)\n\nanexa\n\nARTÍCULO ÚNICO.- u", "", "\n\n\n",
    ]
    for t in texts:
        assert [(c["ordinal"], c["section"], c["label"], c["content"]) for c in K.chunks(t)] == plain_chunks(t), t[:40]
