"""Cutting the text of a regulation along its structure. A pure function, spread over Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 1800

# How articles, publication lines, annexes, closings and notes begin.
ARTICLE = re.compile(r"(?:ART[IÍ]CULO|Art[ií]culo|ART\.|Art\.)\s*(\d+|[ÚU]NICO|[Úú]nico)\s*[°ºo]?(?:\s+(bis|ter|qu[aá]ter))?(?=$|[\s.\-–—:)])", re.A)
PUBLICATION = re.compile(r"e\.\s*\d{1,2}/\d{1,2}/\d{4}\s+N\s*[°º]", re.A)
ANNEX = re.compile(r"ANEXO(?:\s+(?:[IVXLCDM]+|\d+))?\b", re.A)
CLOSING = re.compile(r"DADA EN LA SALA DE SESIONES", re.I | re.A)
NOTE = re.compile(r"\(?\s*Nota\b", re.I | re.A)

CHUNK_TYPE = "array<struct<ordinal:int,section:string,label:string,content:string>>"
_ARROW = pa.list_(pa.struct([("ordinal", pa.int32()), ("section", pa.string()), ("label", pa.string()), ("content", pa.string())]))


def units(s: str) -> int:
    """UTF-16 code units, in which the limit counts."""
    return len(s) if s.isascii() else len(s) + sum(ord(c) > 0xFFFF for c in s)


def _packed(parts: list[str], joiner: str, most: int) -> list[str]:
    """Neighbouring parts put together while they fit."""
    out: list[list[str]] = []
    size = 0
    for p in parts:
        grown = size + len(joiner) + units(p)
        if out and (size == 0 or grown <= most):
            if size == 0:
                out[-1] = [p]
                size = units(p)
            else:
                out[-1].append(p)
                size = grown
        else:
            out.append([p])
            size = units(p)
    return [t for t in (joiner.join(x) for x in out) if t]


_SENTENCE, _GAP = re.compile(r"(?<=[.;:])\s+"), re.compile(r"\s+")


def _cut(s: str, most: int) -> list[str]:
    """Hard cuts by code units."""
    if s.isascii():
        return [s[i : i + most] for i in range(0, len(s), most)]
    raw = s.encode("utf-16-le", "surrogatepass")
    return [raw[i : i + 2 * most].decode("utf-16-le", "surrogatepass") for i in range(0, len(raw), 2 * most)]


def _pieces(paragraph: str, most: int) -> list[str]:
    """An oversize paragraph by line, then sentence, then word, then cut hard."""
    pieces = [paragraph]
    for split, joiner in ((lambda s: s.split("\n"), "\n"), (_SENTENCE.split, " "), (_GAP.split, " ")):
        pieces = [y for x in pieces for y in ([x] if units(x) <= most else _packed(split(x), joiner, most))]
    return [y for x in pieces for y in ([x] if units(x) <= most else _cut(x, most))]


def _parts(paragraphs: list[str]) -> list[tuple[str, str | None, list[str]]]:
    """(section, label, paragraphs) of the logical parts, in order."""
    out: list[tuple[str, str | None, list[str]]] = [("preamble", None, [])]
    published = False
    for p in paragraphs:
        begins: tuple[str, str | None] | None = None
        if units(p) <= 120 and ANNEX.match(p):
            published, begins = True, ("annex", p.split("\n")[0])
        elif m := ARTICLE.match(p):
            number = m[1] if m[1].isascii() and m[1].isdigit() else "único"
            begins = ("annex" if published else "article", f"Artículo {number}" + (f" {m[2].lower()}" if m[2] else ""))
        elif PUBLICATION.match(p):
            published, begins = True, ("closing", None)
        elif not published:
            begins = ("closing", None) if CLOSING.match(p) else None
        elif out[-1][0] == "closing" and not NOTE.match(p):
            begins = ("annex", None)
        if begins:
            out.append((*begins, []))
        out[-1][2].append(p)
    return [x for x in out if x[2]]


def chunks(text: str, most: int = MAX_CHARS) -> list[dict]:
    """The chunks of a text: ordinal, section, label, content."""
    paragraphs = [q for p in re.split(r"\n{2,}", text) if (q := p.strip())]
    out: list[dict] = []
    for section, label, body in _parts(paragraphs):
        for content in _packed([y for x in body for y in _pieces(x, most)], "\n\n", most):
            out.append({"ordinal": len(out), "section": section, "label": label, "content": content})
    return out


def chunked(text: Column, most: int = MAX_CHARS) -> Column:
    @F.arrow_udf(CHUNK_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunks(t, most) for t in texts.to_pylist()], _ARROW)

    return run(text)
