"""Requests: validation of their parameters, of settings, and small matters of presentation."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import trimmed

from .search import DEFAULT_LIMIT, MAX_LIMIT, Options

# Limits of a request.
MIN_QUERY, MAX_QUERY, MIN_YEAR, MAX_YEAR, MAX_TYPES, MAX_TYPE = 3, 500, 1810, 2100, 5, 40
LOCALES, DEFAULT_LOCALE = ("es", "en"), "es"


def _number(s: str) -> float | None:
    try:
        return float(int(s, 0)) if s[:2].lower() in ("0x", "0o", "0b") else float(s) if "_" not in s else None
    except ValueError:
        return None


def parse_search(query_string: str) -> tuple[tuple[str, Options] | None, list[dict]]:
    """((query, options), []) or (None, issues): all that is wrong with a search request, each with its field. Empty values are absent."""
    params = parse_qs(query_string, keep_blank_values=True)
    one = lambda name: (params.get(name, [""])[0].strip() or None)
    issues: list[dict] = []

    def bad(name: str, message: str) -> None:
        issues.append({"field": name, "message": message})

    def number(name: str, low: float, high: float, whole: bool, above: bool = False) -> float | int | None:
        if (s := one(name)) is None:
            return None
        n = _number(s)
        if n is None or n != n or whole and n != int(n) or not (low < n if above else low <= n) or n > high:
            bad(name, f"expected a {'whole ' if whole else ''}number {'above' if above else 'from'} {low} to {high}")
            return None
        return int(n) if whole else n

    q = (params.get("q", [""])[0]).strip()
    if not MIN_QUERY <= len(q) <= MAX_QUERY:
        bad("q", f"expected {MIN_QUERY} to {MAX_QUERY} characters")
    limit = number("limit", 1, MAX_LIMIT, True)
    types = [t.strip() for v in params.get("type", []) for t in v.split(",") if t.strip()]
    if len(types) > MAX_TYPES:
        bad("type", f"at most {MAX_TYPES}")
    if any(len(t) > MAX_TYPE for t in types):
        bad("type", f"at most {MAX_TYPE} characters")
    start, end = number("from", MIN_YEAR, MAX_YEAR, True), number("to", MIN_YEAR, MAX_YEAR, True)
    if start is not None and end is not None and start > end:
        bad("from", "`from` must not be later than `to`")
    least = number("min_similarity", 0, 1, False)
    off = one("versions") == "off"
    versions = None if off else number("versions", 0, 1, False, above=True)
    if issues:
        return None, issues
    o = Options(limit=limit or DEFAULT_LIMIT, types=tuple(types), year_from=start, year_to=end)
    if least is not None:
        o = Options(**{**o.__dict__, "min_similarity": least})
    if off or versions is not None:
        o = Options(**{**o.__dict__, "version_similarity": versions})
    return (q, o), []


def checked_requests(rows: DataFrame) -> DataFrame:
    """The same for a table of requests (q, limit, type, from, to, min_similarity, versions: strings): ``issues`` as an array of "field: message"."""
    text = {c: F.nullif(trimmed(F.coalesce(F.col(f"`{c}`"), F.lit(""))), F.lit("")) for c in ("q", "limit", "type", "from", "to", "min_similarity", "versions")}
    num = {c: text[c].try_cast("double") for c in ("limit", "from", "to", "min_similarity", "versions")}

    def out_of(c: str, low: float, high: float, whole: bool, above: bool = False) -> Column:
        n = num[c]
        good = ((n > low) if above else (n >= low)) & (n <= high) & ((n == F.floor(n)) if whole else F.lit(True))
        return text[c].isNotNull() & ~F.coalesce(good, F.lit(False))

    types = F.filter(F.transform(F.split(F.coalesce(text["type"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    length = F.length(F.coalesce(text["q"], F.lit("")))
    rules = (
        ("q", (length < MIN_QUERY) | (length > MAX_QUERY)),
        ("limit", out_of("limit", 1, MAX_LIMIT, True)),
        ("type", (F.size(types) > MAX_TYPES) | F.exists(types, lambda t: F.length(t) > MAX_TYPE)),
        ("from", out_of("from", MIN_YEAR, MAX_YEAR, True)),
        ("to", out_of("to", MIN_YEAR, MAX_YEAR, True)),
        ("order", F.coalesce(num["from"] > num["to"], F.lit(False))),
        ("min_similarity", out_of("min_similarity", 0, 1, False)),
        ("versions", (F.coalesce(text["versions"], F.lit("")) != "off") & out_of("versions", 0, 1, False, above=True)),
    )
    return rows.withColumn("issues", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules))))


def lenient_filters(rows: DataFrame) -> DataFrame:
    """The filters of an address as far as they are valid; what isn't is dropped: limit, year_from, year_to, filters (how many are set)."""
    year = lambda c: F.when(F.col(f"`{c}`").try_cast("int").between(MIN_YEAR, MAX_YEAR), F.col(f"`{c}`").try_cast("int"))
    a, b = year("from"), year("to")
    straight = F.coalesce(a <= b, F.lit(True))
    start, end = F.when(straight, a), F.when(straight, b)
    kind = F.nullif(F.trim(F.coalesce(F.col("type"), F.lit(""))), F.lit(""))
    count = sum((x.isNotNull().cast("int") for x in (kind, start, end)), F.lit(0))
    return rows.withColumns({"kind": kind, "year_from": start, "year_to": end, "filters": count})


def response_of(issues: Sequence[dict], admitted: bool, retry_after_ms: int, reachable: bool) -> tuple[int, dict]:
    """Status and headers of an answer: 400, 429 (with Retry-After in whole seconds), 503 or 200."""
    if issues:
        return 400, {}
    if not admitted:
        return 429, {"Retry-After": str(-(-retry_after_ms // 1000))}
    return (200, {}) if reachable else (503, {})


def health(database: bool, vectors: bool) -> dict:
    ok = database and vectors
    return {"status": "ok" if ok else "unavailable", "database": database, "vectors": vectors, "http": 200 if ok else 503}


def pick_locale(header: str | None) -> str:
    """The best of LOCALES that an Accept-Language header names, by weight, then by position."""
    wishes = []
    for i, part in enumerate((header or "").split(",")):
        tag, *rest = part.strip().split(";")
        q = next((_number(r.strip()[2:]) for r in rest if r.strip().startswith("q=")), 1.0)
        if tag and q:
            wishes.append((-q, i, tag.split("-")[0].strip().lower()))
    return next((t for _, _, t in sorted(wishes) if t in LOCALES), DEFAULT_LOCALE)


def locale_of(header: Column) -> Column:
    """pick_locale as an expression."""
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p, i: F.struct(
        (-F.coalesce(F.regexp_extract(p, r";\s*q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0))).alias("w"), i.alias("i"), F.lower(F.regexp_extract(p, r"^\s*([A-Za-z*]+)", 1)).alias("t"),
    ))
    good = F.array_sort(F.filter(parts, lambda x: x["t"].isin(*LOCALES) & (x["w"] < 0)))
    return F.coalesce(F.try_element_at(F.transform(good, lambda x: x["t"]), F.lit(1)), F.lit(DEFAULT_LOCALE))


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with its {names} replaced."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def plural(n: Column, one: str, many: str) -> Column:
    return filled(F.when(n == 1, F.lit(one)).otherwise(F.lit(many)), {"n": n})


def seconds(ms: Column) -> Column:
    """Tenths of a second below ten, else whole ones."""
    s = ms / 1000.0
    return F.when(s < 10, F.format_string("%.1f", s)).otherwise(F.format_string("%.0f", s))


# Names of months.
MONTHS = {"es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), "en": "January February March April May June July August September October November December".split()}


def long_date(day: Column, locale: str = DEFAULT_LOCALE) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS[locale])), F.month(day))
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return F.concat(d, F.lit(" de "), month, F.lit(" de "), y) if locale == "es" else F.concat(month, F.lit(" "), d, F.lit(", "), y)


class SettingsError(ValueError):
    """All that is wrong with the settings, in one message."""


def settings(env: Mapping[str, str], spec: Mapping[str, tuple[type, object]]) -> dict:
    """Typed settings: name -> (type, default); a default of ... is required, lists are parted by commas."""
    out, wrong = {}, []
    for name, (kind, default) in spec.items():
        raw = (env.get(name) or "").strip()
        if not raw:
            if default is ...:
                wrong.append(f"{name}: missing")
            out[name] = default
            continue
        try:
            out[name] = [x.strip() for x in raw.split(",") if x.strip()] if kind is list else kind(raw)
        except ValueError:
            wrong.append(f"{name}: expected {kind.__name__}, got {raw!r}")
    if wrong:
        raise SettingsError("; ".join(wrong))
    return out


def corpus_subsets(today: datetime.date):
    """What the corpus holds: laws and decree-laws of any day, decrees of the last five years."""
    from .ingest import Subset

    first = today.replace(day=1)
    since = first.replace(year=first.year - 5) + datetime.timedelta(days=today.day - 1)
    return (Subset(("Ley", "Decreto/Ley")), Subset(("Decreto",), since.isoformat()))
