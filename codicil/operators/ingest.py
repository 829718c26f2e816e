"""Validation of raw records, the corpus filter and the reports of a load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import blank_to_null, folded, real_date, trimmed

# The columns of the dataset and the names they are stored under.
TEXTS = {"numero_norma": "number", "clase_norma": "class", "organismo_origen": "issuing_body", "titulo_resumido": "title", "titulo_sumario": "topic", "texto_resumido": "summary", "observaciones": "notes"}
DATES = {"fecha_sancion": "enacted_on", "fecha_boletin": "gazette_date"}
WHOLE = {"numero_boletin": "gazette_number", "pagina_boletin": "gazette_page"}
URLS = {"texto_original": "original_text_url", "texto_actualizado": "updated_text_url"}
COUNTS = {"modificada_por": "amended_by_count", "modifica_a": "amends_count"}
STORED = ("id", "type", "number", "class", "issuing_body", "enacted_on", "gazette_number", "gazette_date", "gazette_page", "title", "topic", "summary", "notes", "original_text_url", "updated_text_url", "amended_by_count", "amends_count")


def number(c: Column) -> Column:
    """A text as a number the way ECMAScript reads it: decimal, exponent, or 0x/0o/0b; '' is 0; anything else null."""
    t = trimmed(c)
    decimal = t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    prefixed = F.lower(F.substring(t, 1, 2))
    rest = F.substring(t, 3, 64)
    out = F.when(t == "", F.lit(0.0)).when(decimal, F.expr("double(0)") + t.try_cast("double"))
    for prefix, base, digits in (("0x", 16, "[0-9a-fA-F]+"), ("0o", 8, "[0-7]+"), ("0b", 2, "[01]+")):
        out = out.when((prefixed == prefix) & rest.rlike(f"^{digits}$"), F.conv(rest, base, 10).try_cast("double"))
    return out


def whole(c: Column) -> Column:
    """The number if it is a whole one, else null."""
    n = number(c)
    return F.when(n == F.floor(n), n).try_cast("int")


def parsed(raw: DataFrame) -> DataFrame:
    """raw with the columns of STORED and ``reasons``: what each column that fails is reported with ("column: message"), empty if none does.
    Nothing is thrown; the values of failing columns are null."""
    col = {c: F.col(c).cast("string") for c in ("id_norma", "tipo_norma", *TEXTS, *DATES, *WHOLE, *URLS, *COUNTS)}
    text = {c: blank_to_null(x) for c, x in col.items()}
    checks: list[Column] = []

    def fails(name: str, bad: Column, message: str) -> None:
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {message}")))

    out: dict[str, Column] = {"id": F.when(whole(col["id_norma"]) > 0, whole(col["id_norma"])), "type": text["tipo_norma"]}
    fails("id_norma", out["id"].isNull(), "expected a whole number above 0")
    fails("tipo_norma", out["type"].isNull(), "expected a text")
    for c, name in TEXTS.items():
        out[name] = text[c]
    for c, name in DATES.items():
        out[name] = real_date(col[c])
        fails(c, text[c].isNotNull() & ~col[c].rlike(r"^\d{4}-\d{2}-\d{2}$"), "expected YYYY-MM-DD")
        fails(c, col[c].rlike(r"^\d{4}-\d{2}-\d{2}$") & out[name].isNull(), "not a calendar date")
    for c, name in WHOLE.items():
        out[name] = F.when(text[c].isNotNull() & (whole(col[c]) >= 0), whole(col[c]))
        fails(c, text[c].isNotNull() & out[name].isNull(), "expected a whole number from 0")
    for c, name in URLS.items():
        good = col[c].rlike(r"^(?i:https?)://[^\s/?#]+")
        out[name] = F.when(text[c].isNotNull() & good, col[c])
        fails(c, text[c].isNotNull() & ~good, "expected an http or https URL")
    for c, name in COUNTS.items():
        out[name] = F.when(text[c].isNull(), F.lit(0)).when(whole(col[c]) >= 0, whole(col[c]))
        fails(c, out[name].isNull(), "expected a whole number from 0")
    kept = [c for c in raw.columns if c not in out]
    return raw.select(*kept, *(out[c].alias(c) for c in STORED), F.array_compact(F.array(*checks)).alias("reasons"))


@dataclass(frozen=True)
class Subset:
    """Regulations of these types (all, if none) of this date or later."""

    types: tuple[str, ...] = ()
    since: str | None = None


def effective_date(enacted_on: Column, gazette_date: Column) -> Column:
    return F.coalesce(enacted_on, gazette_date)


def in_subset(subset: Subset, kind: Column, date: Column) -> Column:
    """Types are equal without regard to case and accents; without a date nothing passes a ``since``."""
    out = F.lit(True)
    if subset.types:
        out = out & folded(kind).isin([*{_fold(t) for t in subset.types}])
    if subset.since:
        out = out & F.coalesce(date >= F.lit(subset.since).cast("date"), F.lit(False))
    return out


def _fold(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).strip().lower()


def in_any(subsets: Sequence[Subset], kind: Column, date: Column) -> Column:
    """Whether one of the subsets holds a row; each row once, whatever number of them does."""
    out = F.lit(False)
    for s in subsets:
        out = out | in_subset(s, kind, date)
    return out


def classified(raw: DataFrame, subsets: Sequence[Subset] = (Subset(),)) -> DataFrame:
    """parsed() with ``status``: rejected, filtered_out or selected."""
    rows = parsed(raw)
    date = effective_date(F.col("enacted_on"), F.col("gazette_date"))
    chosen = in_any(subsets, F.col("type"), date)
    return rows.withColumn("status", F.when(F.size("reasons") > 0, "rejected").when(~chosen, "filtered_out").otherwise("selected"))


def report(rows: DataFrame) -> DataFrame:
    """read, rejected, filtered_out, selected: one row."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count(F.lit(1)).alias("read"), *(count(s).alias(s) for s in ("rejected", "filtered_out", "selected")))


def selected_by_type(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'selected'").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def selected_by_year(rows: DataFrame) -> DataFrame:
    year = F.coalesce(F.date_format(effective_date(F.col("enacted_on"), F.col("gazette_date")), "yyyy"), F.lit("unknown"))
    return rows.where("status = 'selected'").groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def rejection_reasons(rows: DataFrame) -> DataFrame:
    """A row counts once for each of its reasons."""
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def rejected_examples(rows: DataFrame, most: int = 10, order: str = "line") -> DataFrame:
    """The first rejected rows in the order of the file, with their line and reasons."""
    return rows.where("status = 'rejected'").select(F.col(order).alias("line"), F.coalesce("id_norma", F.lit("")).alias("id"), "reasons").orderBy("line").limit(most)


def first_selected(rows: DataFrame, limit: int, order: str = "line") -> DataFrame:
    """The first ``limit`` selected rows: the limit counts what passes, not what is read."""
    return rows.where("status = 'selected'").orderBy(order).limit(limit)
