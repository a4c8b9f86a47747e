"""Business rules on candidate profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key
from ..schema import ARRAYS, SCALARS

#: blacklists up to this size are literals of the plan; longer ones a broadcast table
LITERAL_BLACKLIST = 1000


def _sure(items: Column, least: float) -> Column:
    return F.filter(items, lambda i: i["confidence"] >= least)


def apply(profiles: DataFrame, rules: dict) -> DataFrame:
    """``profiles`` after the rules, with ``missing_fields`` and ``rules_failed``.

    ``min_field_confidence`` drops e-mails, phones and skills and clears scalars
    below it; ``skill_blacklist`` drops skills by folded value; ``required_fields``
    are only reported.
    """
    least = rules.get("min_field_confidence") or 0.0
    blacklist = sorted({s.lower().strip() for s in rules.get("skill_blacklist") or []})
    changed = {}
    if least > 0:
        changed |= {f: _sure(F.col(f), least) for f in ("emails", "phones", "skills")}
        changed |= {f: F.when(F.col(f)["confidence"] >= least, F.col(f)) for f in SCALARS}
    if blacklist:
        if len(blacklist) > LITERAL_BLACKLIST:
            raise ValueError(f"more than {LITERAL_BLACKLIST} blacklisted skills: use drop_skills with a table")
        skills = changed.get("skills", F.col("skills"))
        changed["skills"] = F.filter(skills, lambda s: ~fold_key(s["value"]).isin(blacklist))
    kept = profiles.withColumns(changed) if changed else profiles
    known = set(SCALARS + ARRAYS)
    missing = [
        F.when((F.size(f) == 0) if f in ARRAYS else F.col(f).isNull() if f in known else F.lit(True), F.lit(f))
        for f in rules.get("required_fields") or []
    ]
    lacking = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    return kept.withColumn("missing_fields", lacking).withColumn("rules_failed", F.size("missing_fields") > 0)


def drop_skills(merged: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Merged rows without the skills of a table (column ``skill``): an anti join."""
    banned = blacklist.select(fold_key(F.col("skill")).alias("banned")).distinct()
    skill = F.when(F.col("field") == "skills", fold_key(F.col("value.text")))
    return merged.join(banned, skill == F.col("banned"), "left_anti")
