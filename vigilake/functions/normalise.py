"""Scalar normalisers as column expressions, and the same rules as SQL text where a query needs an equivalent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age units and how many of each make a year; an unknown unit counts as years.
AGE_UNITS = {"801": 1.0, "802": 12.0, "803": 52.18, "804": 365.25, "805": 8766.0}


def age_years(value: Column, unit: Column) -> Column:
    """Age in years; null if it is no number. NaN and infinities count as no number."""
    number = F.trim(value).try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    per_year = F.coalesce(F.create_map(*[F.lit(x) for kv in AGE_UNITS.items() for x in kv])[F.coalesce(unit, F.lit("801"))], F.lit(1.0))
    return number / per_year


def age_stratum(years: Column) -> Column:
    return F.when(years.isNull() | F.isnan(years), "unknown").when(years < 18, "pediatric").when(years < 65, "adult").otherwise("geriatric")


def sex(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("1", "M", "MALE"), "male").when(v.isin("2", "F", "FEMALE"), "female").otherwise("unknown")


def iso_date(value: Column) -> Column:
    """YYYYMMDD, YYYYMM or YYYY (dashes ignored) as YYYY-MM-DD text; no calendar check; else null."""
    s = F.regexp_replace(value, "-", "")
    y, m, d = F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)
    n = F.length(s)
    return F.when(n == 8, F.concat_ws("-", y, m, d)).when(n == 6, F.concat_ws("-", y, m, F.lit("01"))).when(n == 4, F.concat_ws("-", y, F.lit("01"), F.lit("01")))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def quarter_of(date: Column) -> Column:
    """YYYYQn of an ISO date; month 00 falls in no quarter and gives null."""
    month = F.substring(date, 6, 2).try_cast("int")
    return F.when(month >= 1, F.concat(F.substring(date, 1, 4), F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string")))


# Words for ages, as the analysis form takes them.
AGE_WORDS = {
    "pediatric": "pediatric", "child": "pediatric", "children": "pediatric", "infant": "pediatric", "neonatal": "pediatric",
    "adult": "adult", "geriatric": "geriatric", "elderly": "geriatric",
}


def age_text(value: Column) -> Column:
    """Free text for an age, a word or a whole number, as a stratum; else null."""
    s = F.lower(F.trim(value))
    word = F.create_map(*[F.lit(x) for kv in AGE_WORDS.items() for x in kv])[s]
    number = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))
    return F.coalesce(word, F.when(number < 18, "pediatric").when(number < 65, "adult").when(number >= 65, "geriatric"))


def clean(value: Column) -> Column:
    """Upper case without outer blanks; empty counts as missing."""
    return F.nullif(F.trim(F.upper(value)), F.lit(""))


def first_of(value: Column) -> Column:
    """The first entry of what may be a JSON list of strings, or the string itself."""
    listed = F.from_json(value, "array<string>")
    return F.when(F.ltrim(value).startswith("["), F.get(listed, F.lit(0))).otherwise(value)


# Where a name may come from, best first.
NAME_SOURCES = ["activesubstance", "medicinalproduct", "openfda.generic_name", "openfda.brand_name", "openfda.substance_name"]


def drug_name(*candidates: Column) -> tuple[Column, Column]:
    """(name, provenance): the first of five candidates that is not blank; "" and "missing" if none is."""
    cleaned = [clean(c) for c in candidates]
    source = F.lit("missing")
    for c, name in reversed(list(zip(cleaned, NAME_SOURCES))):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.coalesce(*cleaned, F.lit("")), source


def search_url(term: Column) -> Column:
    """Address of a health-encyclopaedia search for a term."""
    return F.concat(F.lit("https://medlineplus.gov/search/?query="), F.url_encode(F.lower(term)))


def one_line(text: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def band(column: Column) -> Column:
    """Weak up to 1.5, medium up to 3, strong above; only of positive values."""
    return F.when(column > 3, "strong").when(column > 1.5, "medium").when(column > 0, "weak")
