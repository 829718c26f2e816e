"""Web pages as text. The scanner is a plain function; Spark spreads it over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without regulation text, and elements that end a line.
CHROME = frozenset(["head", "script", "style", "header", "map", "noscript"])
LINE_ENDING = frozenset("div p table ul ol li h1 h2 h3 h4 h5 h6 blockquote center".split())
#: Pages that are Python strings at once in a worker.
SLICE = 64
_SPACES = re.compile(r"\s+")
_CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)
_PARAGRAPH_ENDING = LINE_ENDING | {"hr", "address", "article", "aside", "footer", "form", "main", "nav", "section", "pre", "dl", "fieldset"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.in_paragraph = False

    def _end_paragraph(self) -> None:
        if self.in_paragraph:
            self.in_paragraph = False
            if not self.hidden:
                self.out.append("\n")

    def handle_starttag(self, tag, attrs):
        if tag in _PARAGRAPH_ENDING:
            self._end_paragraph()
        if tag in CHROME:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "br" or tag in LINE_ENDING:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        self.in_paragraph |= tag == "p"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in CHROME:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in CHROME:
            self.hidden = max(0, self.hidden - 1)
            return
        if tag == "p":
            if not self.in_paragraph and not self.hidden:
                self.out.append("\n")
            self.in_paragraph = False
        elif tag in LINE_ENDING:
            self._end_paragraph()
        if not self.hidden and (tag in LINE_ENDING or tag == "tr"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(_SPACES.sub(" ", data))


def raw_text(page: str) -> str:
    """A page's text with its line breaks, before it is brought into normal form."""
    scanner = _Text()
    scanner.feed(page)
    scanner.close()
    return "".join(scanner.out)


def decoded(data: bytes, content_type: str | None = None) -> str:
    """By the declared character set (of the header, else of the first 4096 bytes), else ISO-8859-1."""
    found = _CHARSET.search(content_type or "") or _CHARSET.search(data[:4096].decode("latin-1"))
    try:
        return data.decode(found[1] if found else "latin-1", "replace")
    except LookupError:
        return data.decode("latin-1")


def _raw_text(pages: pa.Array) -> pa.Array:
    parts = [pa.array([None if p is None else raw_text(p) for p in pages.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(pages), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _decoded(data: pa.Array, types: pa.Array) -> pa.Array:
    return pa.array([None if d is None else decoded(d, t) for d, t in zip(data.to_pylist(), types.to_pylist())], pa.string())


def page_text(page: Column) -> Column:
    from .text import normalized

    return normalized(F.arrow_udf(_raw_text, "string")(page))


def decode_page(data: Column, content_type: Column | None = None) -> Column:
    return F.arrow_udf(_decoded, "string")(data, content_type if content_type is not None else F.lit(None).cast("string"))
