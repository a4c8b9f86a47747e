"""String functions with the semantics of the evidence model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def title(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere: ``o'brien`` is ``O'Brien``."""
    parts = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def fold_key(text: Column) -> Column:
    """The form in which exact matches compare."""
    return strip(F.lower(text))


def quoted(text: Column) -> Column:
    """``None``, or the text in quotes as a value's display form shows it."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "\n", r"\\n")
    single = F.concat(F.lit("'"), escaped, F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    both = F.concat(F.lit("'"), F.regexp_replace(escaped, "'", r"\\'"), F.lit("'"))
    shown = F.when(~F.contains(text, F.lit("'")), single).when(~F.contains(text, F.lit('"')), double).otherwise(both)
    return F.coalesce(shown, F.lit("None"))


def is_given(text: Column) -> Column:
    """Present and not empty; white space counts as given."""
    return F.coalesce(text != "", F.lit(False))
