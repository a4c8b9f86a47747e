"""Country names and ISO 3166 alpha-2 codes."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_key, strip

#: fixed values: codes that output options spell out in full
FULL_NAMES = {"US": "United States", "IN": "India", "CA": "Canada", "GB": "United Kingdom"}
#: fixed values: names that are in use beside those of the Java runtime, by alpha-2 code
OTHER_NAMES = {
    "US": "united states of america|u.s.|u.s.a.|america", "GB": "great britain|england|scotland|wales|uk|u.k.", "NL": "holland|the netherlands",
    "CZ": "czech republic", "TR": "turkey|türkiye", "KR": "south korea|republic of korea", "KP": "north korea", "RU": "russian federation", "VN": "viet nam",
    "IR": "iran, islamic republic of", "SY": "syrian arab republic", "LA": "lao", "CI": "ivory coast", "CV": "cape verde", "MM": "burma", "SZ": "swaziland",
}


@cache
def codes() -> dict[str, str]:
    """Alpha-2 codes by name, alpha-2 and alpha-3 code in lower case: the ISO 3166 table of the Java runtime."""
    context = SparkContext._active_spark_context
    found = {name: code for code, names in OTHER_NAMES.items() for name in names.split("|")}
    locale = context._jvm.java.util.Locale
    for code in locale.getISOCountries():
        place = locale("", code)
        name = place.getDisplayCountry(locale.ENGLISH).lower()
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        found |= {name: code, plain: code, name.replace("&", "and"): code, code.lower(): code, place.getISO3Country().lower(): code}
    return found


def to_alpha2(name: Column) -> Column:
    """The code of a country name; the stripped name where it is unknown."""
    table = F.create_map(*(F.lit(x) for pair in sorted(codes().items()) for x in pair))
    return F.coalesce(F.try_element_at(table, fold_key(name)), strip(name))


def full_name(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FULL_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)
