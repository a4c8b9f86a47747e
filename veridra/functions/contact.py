"""Phones, e-mail addresses and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_given, strip

#: fixed values: patterns that validation and extraction use
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
E164 = r"^\+[1-9]\d{1,14}$"
PHONES = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+?\d{2}[-.\s]?\d{10}|\b\d{10}\b"
FOUND_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]*[a-zA-Z0-9]"

#: fixed values: country calling codes of the numbering plan that are not three digits long
SHORT_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98"
).split()
#: fixed values: first two digits of the three-digit calling codes
LONG_CODES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
REGION_CODES = {"US": "1", "CA": "1", "IN": "91", "GB": "44", "DE": "49", "FR": "33", "ES": "34", "AU": "61"}


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def is_e164(text: Column) -> Column:
    return F.coalesce(text.rlike(E164), F.lit(False))


def to_e164(text: Column, region: str = "US") -> Column:
    """The number in E.164 form; null where none can be read.

    Reads from the first plus sign or digit. With a plus sign the digits must begin
    with a calling code; without one they are a number of ``region``.
    """
    shown = F.regexp_extract(text, r"[+\d].*", 0)
    letters = F.regexp_replace(shown, r"(?i)\s*(?:ext|x|#).*$", "").rlike(r"[A-Za-z]")
    digits = F.regexp_replace(F.regexp_replace(shown, r"(?i)\s*(?:ext|x|#).*$", ""), r"\D", "")
    known = digits.rlike("^(?:" + "|".join(SHORT_CODES + [f"{c}\\d" for c in LONG_CODES]) + ")")
    size = F.length(digits)
    abroad = F.when(known & size.between(7, 15), F.concat(F.lit("+"), digits))
    code = REGION_CODES.get(region, "1")
    home = F.regexp_replace(digits, "^1(?=\\d{10}$)" if code == "1" else f"^(?:0|{code}(?=\\d{{10}}$))", "")
    local = F.when(F.length(home).between(4, 14), F.concat(F.lit(f"+{code}"), home))
    found = F.when(F.startswith(shown, F.lit("+")), abroad).otherwise(local)
    return F.when(size.between(3, 17) & ~letters, found)


#: fixed values: forms of dates that are read, most specific first; months come before days where both could be meant
DATE_FORMS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "MM.dd.yyyy", "dd.MM.yyyy", "MMM d, yyyy",
    "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy/MM", "MM/yyyy", "MM-yyyy", "MM.yyyy", "yyyy",
)
#: fixed values: English names of months
MONTH = (
    r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
)
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def _month_within(text: Column) -> Column:
    """Month and year that stand somewhere in a text; its year's January where no month does."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    numbers = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, f"{i + 1:02}")))
    named = F.try_element_at(numbers, F.lower(F.substring(F.regexp_extract(text, MONTH, 1), 1, 3)))
    year = F.regexp_extract(text, YEAR, 1)
    return F.when(year != "", F.concat(year, F.lit("-"), F.coalesce(named, F.lit("01"))))


def to_month(text: Column) -> Column:
    """``YYYY-MM``; null for an ongoing or absent date, the stripped text if unreadable.

    Words beside a date are passed over. A year alone stands for its January.
    """
    clean = strip(text)
    proper = F.initcap(F.regexp_replace(F.regexp_replace(clean, r"\bSept\b", "Sep"), r"(?<=[A-Za-z])\.", ""))
    read = F.coalesce(*(F.try_to_timestamp(proper, F.lit(form)) for form in DATE_FORMS))
    month = F.coalesce(F.date_format(read, "yyyy-MM"), _month_within(clean), clean)
    ongoing = F.lower(text).isin("present", "current", "now")
    return F.when(is_given(text) & ~ongoing, month)


def extract_emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FOUND_EMAIL), F.lit(0))


def extract_phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONES), F.lit(0))
