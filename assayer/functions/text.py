"""Column expressions that clean text, prices, dates, phones and e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency marks in the order they are tried, and country calling codes.
CURRENCY_MARKS = [("$", "USD"), ("US$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY"), ("￥", "JPY"), ("₹", "INR"), ("₨", "PKR"), ("Rs", "PKR"), ("PKR", "PKR"), ("AED", "AED"), ("SAR", "SAR"), ("CNY", "CNY"), ("RMB", "CNY"), ("CAD", "CAD"), ("AUD", "AUD")]
CURRENCY_CODES = "USD|EUR|GBP|JPY|INR|PKR|AED|SAR|CNY|CAD|AUD"
CALLING_CODES = {"PK": "92", "IN": "91", "US": "1", "GB": "44", "AE": "971"}
KIND_HINTS = {
    "currency": ("price", "cost", "amount", "fee"),
    "date": ("date", "published", "created", "updated", "modified", "release", "posted", "timestamp", "time"),
    "email": ("email", "mail"),
    "phone": ("phone", "tel", "mobile", "contact_number"),
}
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_text(c: Column) -> Column:
    """Straight quotes, plain spaces, no zero-width characters, single inner spaces, no outer ones."""
    c = F.translate(c, "\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a0", "''\"\"\"\" ")
    c = F.regexp_replace(c, "[\u200b\u200c\u200d\ufeff]", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def currency_of(c: Column, default: str | None = None) -> Column:
    """An ISO code in the text wins over a mark; marks are tried in order."""
    code = F.upper(F.regexp_extract(c, rf"(?i)\b({CURRENCY_CODES})\b", 1))
    found = F.when(code != "", code)
    for mark, name in CURRENCY_MARKS:
        found = found.when(F.contains(c, F.lit(mark)), name)
    return F.when(c.isNotNull(), F.coalesce(found, F.lit(default))).otherwise(F.lit(default))


def amount_of(c: Column) -> Column:
    """The first number of a text, thousands separators removed."""
    return F.regexp_replace(F.regexp_extract(c, NUMBER, 0), ",", "").try_cast("double")


def normalize_date(c: Column) -> Column:
    """yyyy-MM-dd from an ISO prefix (taken as it is) or D/M/Y; other texts give null."""
    c = F.trim(c)
    dmy = r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})$"
    year = F.regexp_extract(c, dmy, 3)
    year = F.lpad(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), 4, "0")
    parts = F.concat_ws("-", year, F.lpad(F.regexp_extract(c, dmy, 2), 2, "0"), F.lpad(F.regexp_extract(c, dmy, 1), 2, "0"))
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(c, 1, 10)).when(c.rlike(dmy), parts)


def is_real_date(c: Column) -> Column:
    """Whether a yyyy-MM-dd text is a day of the calendar."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def normalize_phone(c: Column, country: str | None = None) -> Column:
    """+ and 8 to 15 digits as they are; other digits get the country's calling code and lose leading zeros."""
    s = F.regexp_replace(c, "[^0-9+]", "")
    digits = F.substring(s, F.lit(2), F.length(s))
    local = F.regexp_replace(s, "^0+", "")
    code = CALLING_CODES.get((country or "").upper())
    home = F.when(local != "", F.concat(F.lit(f"+{code}"), local)) if code else F.lit(None)
    return F.when(s.startswith("+"), F.when(F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))).when(s != "", home)


def normalize_email(c: Column) -> Column:
    c = F.trim(c)
    at = F.instr(c, "@")
    return F.when(c.rlike(EMAIL), F.concat(F.substring(c, F.lit(1), at), F.lower(F.substring(c, at + 1, F.length(c)))))


def kind_of_column(name: str) -> str | None:
    """The kind that a column's name hints at, decided once for a table."""
    return next((kind for kind, hints in KIND_HINTS.items() if any(h in name.lower() for h in hints)), None)


def comparison_value(c: Column, kind: Column, canonical_url: Column | None = None) -> Column:
    """A coarse form for equality: numbers to four places, date prefixes, lower case; empty text is null."""
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    lower = F.lower(s)
    number = F.when(kind == "currency", F.regexp_replace(s, r"[^0-9.\-+]", "")).otherwise(s).try_cast("double")
    date = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(s, 1, 10)).otherwise(lower)
    url = lower if canonical_url is None else F.coalesce(F.lower(canonical_url), lower)
    form = F.when(kind.isin("currency", "number"), F.when(number.isNotNull(), F.format_string("%.4f", number)).otherwise(lower)).when(kind == "date", date).when(kind == "url", url).otherwise(lower)
    return F.when(s != "", form)
