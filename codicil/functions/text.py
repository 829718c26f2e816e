"""Scalar text functions as Column expressions; everything here runs inside the JVM.

White space, word boundaries and case follow ECMAScript, which the stored texts were written with:
``SPACE`` is its ``\\s`` and ``EDGE`` its ASCII ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = f"[{SPACE_CHARS}]"
_WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


def collapsed(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


_ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"


def unaccented(c: Column) -> Column:
    """Without the accents of Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}+", "")


def folded(c: Column) -> Column:
    """For comparing names of types: without accents, trimmed, lower case."""
    return F.lower(trimmed(unaccented(c)))


def joined_parts(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor blank, trimmed."""
    return F.concat_ws(separator, *(blank_to_null(p) for p in parts))


# ---- names and inputs ------------------------------------------------------------------------------------------


def regulation_name(kind: Column, number: Column, enacted_on: Column) -> Column:
    """"Decreto 282/2026", "Ley 27817", "Decreto S/N"; laws are never given a year."""
    n = blank_to_null(number)
    yearly = (F.lower(kind) != "ley") & n.rlike(r"^\d+$") & enacted_on.isNotNull()
    year = F.date_format(enacted_on, "yyyy")
    return F.when(n.isNull(), kind).otherwise(F.concat(kind, F.lit(" "), n, F.when(yearly, F.concat(F.lit("/"), year)).otherwise("")))


def embedding_input(name: Column, topic: Column, title: Column, label: Column, content: Column) -> Column:
    return F.concat(joined_parts(" · ", name, topic, title, label), F.lit("\n\n"), content)


def summary_text(kind: Column, number: Column, topic: Column, title: Column, summary: Column) -> Column:
    """What stands for a regulation without a published text; parts are kept as written, blank ones skipped."""
    keep = lambda c: F.when(trimmed(c) != "", c)
    heading = F.concat_ws(" ", F.when(kind != "", kind), F.when(number != "", number))
    return F.concat_ws("\n\n", keep(topic), keep(heading), keep(title), keep(summary))


def picked_source(updated_url: Column, original_url: Column) -> tuple[Column, Column]:
    """(source, url): the consolidated text, else the original; null for neither."""
    has = lambda c: c.isNotNull() & (c != "")
    source = F.when(has(updated_url), F.lit("updated")).when(has(original_url), F.lit("original"))
    return source, F.when(has(updated_url), updated_url).when(has(original_url), original_url)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def snippet(c: Column, length: int = 220) -> Column:
    flat = trimmed(collapsed(c))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("…"))).otherwise(flat)


# ---- normal form -----------------------------------------------------------------------------------------------


def normalized(c: Column) -> Column:
    """Lines trimmed and folded, junk dropped, rows of filler shortened, blank lines reduced to one."""
    t = F.regexp_replace(c, r"\x{a0}", " ")
    t = F.regexp_replace(t, r"[\x{0}-\x{8}\x0b-\x1f\x{7f}-\x{9f}\x{fffd}]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"([._\-=*~])\1{4,}", "$1$1$1")
    t = F.regexp_replace(t, r"(?:\. ){4,}\.?", "... ")
    edge = r"[\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    t = F.regexp_replace(t, rf"(?m)^(?:{edge}*\|{edge}*)+", "")
    t = F.regexp_replace(t, rf"(?m)^{edge}+|{edge}+$", "")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# ---- money, citations, references --------------------------------------------------------------------------------

# How amounts, figures and citations are written.
AMOUNT = r"(?:U\$S|US\$|USD|\$)\s*(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?)"
FIGURE = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?"
CITATION = r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"
NEXT_CITATIONS = r"(?:\[\d{1,3}(?:\s*,\s*\d{1,3})*\]\s*)+"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def amounts(c: Column) -> Column:
    """array<string>: the figures of amounts of money, digits only."""
    return F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(1)), digits_of)


def figures(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(FIGURE), F.lit(0)), digits_of)


def cited_numbers(c: Column) -> Column:
    """array<int>: numbers in citation marks, distinct, ascending."""
    groups = F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x).cast("int"))
    return F.array_sort(F.array_distinct(numbers))


def citations(c: Column, sources: Column | int) -> tuple[Column, Column]:
    """(cited, unknown): the numbers among 1..sources, and the others."""
    n = F.lit(sources) if isinstance(sources, int) else sources
    found = cited_numbers(c)
    return F.filter(found, lambda x: (x >= 1) & (x <= n)), F.filter(found, lambda x: (x < 1) | (x > n))


# How kinds of regulations are written, in order of precedence, and their names.
REFERENCE_TYPES = (
    (r"decreto[\s/-]*ley", "Decreto/Ley"),
    (r"ley", "Ley"),
    (r"decreto\s+de\s+necesidad\s+y\s+urgencia", "Decreto"),
    (r"decreto", "Decreto"),
    (r"dnu", "Decreto"),
    (r"dto\.?", "Decreto"),
    (r"decisi[oó]n\s+administrativa", "Decisión Administrativa"),
    (r"resoluci[oó]n", "Resolución"),
    (r"disposici[oó]n", "Disposición"),
)
NUMBER_SIGN = r"(?:n(?:ro|o|[uú]m(?:ero)?)?\.?\s*[°º]?\s*)?"
NUMBER = r"(\d{1,3}(?:\.\d{3})+|\d+)"
YEAR = r"(?:\s*/\s*(\d{4}|\d{2})(?![\d/])|\s+del?\s+(?:a[ñn]o\s+)?(\d{4})(?!\d))?"
MAX_REFERENCES = 3


def reference_pattern() -> str:
    kinds = "|".join(p for p, _ in REFERENCE_TYPES)
    return rf"(?iu)(?<![\p{{L}}\d])({kinds})\s*{NUMBER_SIGN}{NUMBER}(?![\d.]*\d){YEAR}".replace(r"\s", SPACE)


def references(c: Column, this_year: int) -> Column:
    """array<struct<type, number, year>>: the first three different regulations that a text cites by number."""
    pattern = reference_pattern()
    part = lambda i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(part(1).alias("kind"), part(2).alias("number"), part(3).alias("slash"), part(4).alias("worded"))

    def one(r: Column) -> Column:
        kind = F.lit(None).cast("string")
        for p, name in reversed(REFERENCE_TYPES):
            kind = F.when(r["kind"].rlike("(?iu)^(?:" + p.replace(r"\s", SPACE) + ")$"), F.lit(name)).otherwise(kind)
        written = F.coalesce(F.nullif(r["slash"], F.lit("")), F.nullif(r["worded"], F.lit("")))
        short = written.cast("int")
        century = this_year // 100 * 100
        year = F.when(F.length(written) == 4, short).when(short <= this_year % 100, short + century).otherwise(short + century - 100)
        number = F.regexp_replace(F.replace(r["number"], F.lit("."), F.lit("")), r"^0+(?=\d)", "")
        return F.struct(kind.alias("type"), number.alias("number"), F.when(kind != "Ley", year).alias("year"))

    return F.slice(F.array_distinct(F.transform(rows, one)), 1, MAX_REFERENCES)


# ---- language, openings, rewrites --------------------------------------------------------------------------------

# Words that tell the two languages apart.
SPANISH_WORDS = (
    "el|la|los|las|un|una|unos|unas|del|al|que|qué|cuál|cuáles|cómo|cuándo|dónde|quién|por|para|con|sin|sobre|entre|desde|hasta|es|son|está|están|hay|tiene|tienen|"
    "se|su|sus|lo|y|o|en|de|dice|establece|dispone|rige|norma|normas|artículo"
)
ENGLISH_WORDS = (
    "the|an|of|to|in|on|for|with|without|about|from|by|and|or|is|are|was|were|does|do|did|what|which|who|when|where|how|why|that|this|there|has|have|say|says|law|laws|"
    "act|article|regulation|regulations"
)
SPANISH_MARKS = "[¿¡ñáéíóú]"


def language_counts(c: Column) -> tuple[Column, Column]:
    spanish = rf"(?iu){SPANISH_MARKS}|{EDGE}(?:{SPANISH_WORDS}){EDGE}"
    english = rf"(?iu){EDGE}(?:{ENGLISH_WORDS}){EDGE}"
    return F.regexp_count(c, F.lit(spanish)), F.regexp_count(c, F.lit(english))


def language(c: Column) -> Column:
    """"en" if more English words stand in a text than Spanish ones, else "es"."""
    spanish, english = language_counts(c)
    return F.when(english > spanish, F.lit("en")).otherwise(F.lit("es"))


# The sentences that say that the sources don't answer.
NOT_IN_SOURCES = {"es": "Las fuentes no responden la pregunta.", "en": "The sources do not answer the question."}


def opening(c: Column) -> Column:
    """"not_in_sources", "undecided" (too short to tell) or "answer"."""
    start = collapsed(F.regexp_replace(F.lower(c), r"^[^\p{L}]+", ""))
    sentences = [s.lower().rstrip(".") for s in NOT_IN_SOURCES.values()]
    says = F.lit(False)
    may = F.lit(False)
    for s in sentences:
        says = says | start.startswith(s)
        may = may | F.lit(s).startswith(start)
    return F.when(says, F.lit("not_in_sources")).when(may, F.lit("undecided")).otherwise(F.lit("answer"))


def search_query(c: Column, longest: int = 500) -> Column:
    """A rewrite's first line that isn't blank, without quotes around it or a label before it."""
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    wrap = rf"[{SPACE_CHARS}\"'`*«»“”]+"
    unwrapped = lambda x: F.regexp_replace(x, f"^{wrap}|{wrap}$", "")
    bare = F.regexp_replace(unwrapped(line), rf"(?iu)^(?:b[uú]squeda|consulta|search|query){SPACE}*:{SPACE}*", "")
    return trimmed(F.substring(collapsed(unwrapped(bare)), 1, longest))


def comparable(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\d]+", " "))


def is_new_query(query: Column, question: Column) -> Column:
    q = comparable(query)
    return (F.length(q) > 0) & (q != comparable(question))


# ---- dates -------------------------------------------------------------------------------------------------------


def years_before(today: Column, years: int) -> Column:
    """The same day of the month ``years`` earlier; a 29 February without one becomes 1 March."""
    month = F.add_months(F.trunc(today, "MM"), -12 * years)
    return F.date_add(month, F.dayofmonth(today) - 1)


def real_date(c: Column) -> Column:
    """The date of a text that is one of the calendar, written YYYY-MM-DD; else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def client_of(forwarded: Column, real_ip: Column) -> Column:
    """The first forwarded address, the real one, or "unknown"."""
    return F.coalesce(blank_to_null(F.split(forwarded, ",")[0]), blank_to_null(real_ip), F.lit("unknown"))
