"""Dates as texts write them, in Spanish, in English and in figures (day first).

Columns are read in the JVM: one pattern of the three forms gives all matches in the order of the text (no match of one form can overlap one of another: a year has four
digits and no digit beside it, a day one or two and no letter or digit before it, and no month has a name in both languages), and the parts are read out of each match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and ways of writing dates.
SPANISH = "enero febrero marzo abril mayo junio julio agosto sep?tiembre octubre noviembre diciembre".split()
ENGLISH = "january february march april may june july august september october november december".split()
_SPANISH = rf"(?:([0-9]{{1,2}})\s*(?:[°º]|ro|ero|er)?\s+de\s+)?({'|'.join(SPANISH)})(?:\s+del?)?\s+([0-9]{{4}})(?![0-9])"
_ENGLISH = rf"(?:([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?)?({'|'.join(ENGLISH)})(?:\s+([0-9]{{1,2}})(?:st|nd|rd|th)?)?,?\s+(?:of\s+)?([0-9]{{4}})(?![0-9])"
_FIGURES = r"(?<![0-9/.-])([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?![0-9/-])"
_FORMS = ((re.compile(rf"(?<![^\W_]){_SPANISH}", re.I), SPANISH, (1, 2, 3)), (re.compile(rf"(?<![^\W_]){_ENGLISH}", re.I), ENGLISH, (1, 2, 4)), (re.compile(_FIGURES), None, (1, 2, 3)))
#: \s is all of Unicode's white space, as in the patterns above, and letters match in either case; a date has neither letter nor digit before it.
_ANY = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{_SPANISH}|{_ENGLISH})|{_FIGURES}".replace(r"\s", r"[\s\p{Z}\x1c-\x1f\x85]")


def written_dates(text: str) -> list[tuple[int, int, int | None]]:
    """(year, month, day or None) of each different date, in the order of the text: for one text on the driver (a question); columns take dates()."""
    found = []
    for order, (form, names, (d, m, y)) in enumerate(_FORMS):
        for x in form.finditer(text):
            month = int(x[m]) if names is None else next(i for i, n in enumerate(names, 1) if re.fullmatch(n, x[m], re.I))
            day = x[d] or (x[3] if names is ENGLISH else None)
            found.append((x.start(), order, (int(x[y]), month, int(day) if day else None)))
    good = (v for _, _, v in sorted(found, key=lambda f: f[:2]) if 1800 <= v[0] <= 2100 and 1 <= v[1] <= 12 and (v[2] is None or 1 <= v[2] <= 31))
    return list(dict.fromkeys(good))


def dates(text: Column) -> Column:
    """array<struct<year, month, day>> of each different date, in the order of the text; day is null where none is written, the array where the text is."""
    part = lambda x, pattern, group=1: F.regexp_extract(x, pattern, group)
    number = lambda s: F.when(s != "", s.cast("int"))

    def month_of(x: Column) -> Column:
        out = F.when(part(x, "^[0-9]+[/.-]", 0) != "", number(part(x, "^[0-9]+[/.-]([0-9]+)")))
        for i, (s, e) in enumerate(zip(SPANISH, ENGLISH), 1):
            out = out.when(x.rlike(f"(?iu){s}|{e}(?!o)"), F.lit(i))  # may, but not mayo
        return out

    def read(x: Column) -> Column:
        leading, behind = part(x, "^([0-9]{1,2})"), part(x, r"(?ius)[a-z]\P{L}+?([0-9]{1,2})(?:st|nd|rd|th)?(?![0-9]).*[0-9]{4}$")
        english = x.rlike(f"(?iu){'|'.join(f'{e}(?!o)' for e in ENGLISH)}")
        return F.struct(part(x, "([0-9]{4})$").cast("int").alias("year"), month_of(x).alias("month"), F.when(leading != "", leading.cast("int")).when(english, number(behind)).alias("day"))

    found = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), read)
    good = lambda d: d["year"].between(1800, 2100) & d["month"].between(1, 12) & (d["day"].isNull() | d["day"].between(1, 31))
    return F.array_distinct(F.filter(found, good))


def states_date(text: Column, asked: list[tuple[int, int, int | None]]) -> Column:
    """Whether a text states one of the dates asked for; a date without a day is stated by any day of its month. Nothing asked: the text isn't read."""
    if not asked:
        return F.lit(False)
    found = dates(text)

    def hit(x: Column) -> Column:
        out = F.lit(False)
        for y, m, d in asked:
            out = out | (x["year"] == y) & (x["month"] == m) & (F.lit(True) if d is None else F.coalesce(x["day"] == d, F.lit(False)))
        return out

    return F.coalesce(F.exists(found, hit), F.lit(False))
