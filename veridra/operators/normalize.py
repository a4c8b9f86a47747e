"""Normalisation of evidence: canonical values and the labels of what was applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.contact import to_e164, to_month
from ..functions.text import collapse, fold_key, strip, title
from ..schema import EDUCATION, EXPERIENCE, VALUE, value_of

#: fixed values: canonical skills, aliases, and the score from which a skill is one of them
CANONICAL_SKILLS = ["Machine Learning", "Python", "PyTorch", "React", "JavaScript", "Data Science"]
SKILL_ALIASES = {"ml": "Machine Learning", "js": "JavaScript", "node": "Node.js"}
SKILL_SCORE = 80.0


def normalize_name(text: Column) -> Column:
    return title(collapse(F.regexp_replace(text, r"[^a-zA-Z\s.\-]", "")))


def normalize_email(text: Column) -> Column:
    return F.lower(strip(text))


def normalize_experience(work: Column) -> Column:
    return F.struct(
        title(collapse(work["company"])).alias("company"),
        title(collapse(work["title"])).alias("title"),
        to_month(work["start"]).alias("start"),
        to_month(work["end"]).alias("end"),
        work["summary"].alias("summary"),
    ).cast(EXPERIENCE)


def normalize_education(study: Column) -> Column:
    def kept(name: str) -> Column:
        return F.when(study[name] != "", title(collapse(study[name])))

    return F.struct(
        title(collapse(study["institution"])).alias("institution"),
        kept("degree").alias("degree"),
        kept("field").alias("field"),
        F.when(study["end_year"] != "", strip(study["end_year"])).alias("end_year"),
    ).cast(EDUCATION)


def normalize_skill(key: Column, best: Column) -> tuple[Column, Column]:
    """Canonical skill and label for a folded ``key``, ``best`` being its best canonical skill."""
    aliases = F.create_map(*(F.lit(x) for pair in SKILL_ALIASES.items() for x in pair))
    alias = F.try_element_at(aliases, key)
    near = best["score"] >= SKILL_SCORE
    # a label shows the score rounded half to even
    label = F.concat(F.lit("Fuzzy_Match_"), F.bround(best["score"], 0).cast("int").cast("string"), F.lit("pct"))
    canonical = F.coalesce(alias, F.when(near, best["choice"]), title(key))
    return canonical, F.when(alias.isNotNull(), "Canonical_Alias_Map").when(near, label).otherwise("TitleCase_Fallback")


def skill_table(skills: DataFrame) -> DataFrame:
    """skill_key, canonical, label of the distinct lower-case ``skill_key`` values."""
    scored = skills.select("skill_key").distinct().withColumn("best", fuzzy.best_of(F.col("skill_key"), CANONICAL_SKILLS))
    canonical, label = normalize_skill(F.col("skill_key"), F.col("best"))
    return scored.select("skill_key", canonical.alias("skill_canonical"), label.alias("skill_label"))


def normalize(evidence: DataFrame, default_region: str = "US") -> DataFrame:
    """``evidence`` with ``canonical`` and ``norms`` set.

    Nothing is shuffled: workers score each spelling of a skill once, everything else is
    an expression. Empty values stay as they are.
    """
    text = F.col("raw.text")
    key = F.when((F.col("field") == "skills") & (text != ""), fold_key(text))
    joined = evidence.withColumn("skill_key", key).withColumn("skill_best", fuzzy.best_of(F.col("skill_key"), CANONICAL_SKILLS))
    skill_canonical, skill_label = normalize_skill(F.col("skill_key"), F.col("skill_best"))

    phone = to_e164(strip(text), default_region)
    given = text != ""
    rules: list[tuple[Column, str, Column, Column]] = [
        (F.col("field").isin("full_name", "headline") & given, "text", normalize_name(text), F.lit("TitleCase_CleanWhitespace")),
        ((F.col("field") == "emails") & given, "text", normalize_email(text), F.lit("Lowercase_Strip")),
        (
            (F.col("field") == "phones") & given,
            "text",
            F.coalesce(phone, strip(text)),
            F.when(phone.isNotNull(), "E164_Format").otherwise("Parse_Attempt_Failed"),
        ),
        (F.col("skill_key").isNotNull(), "text", skill_canonical, skill_label),
        (F.col("raw.experience").isNotNull(), "experience", normalize_experience(F.col("raw.experience")), F.lit("Experience_Standardization")),
        (F.col("raw.education").isNotNull(), "education", normalize_education(F.col("raw.education")), F.lit("Education_Standardization")),
    ]
    canonical, label = F.lit(None).cast(VALUE), F.lit(None).cast("string")
    for applies, part, value, named in reversed(rules):
        canonical = F.when(applies, value_of(part if part != "text" else "emails", value)).otherwise(canonical)
        label = F.when(applies, named).otherwise(label)
    norms = F.when(label.isNull() | F.array_contains("norms", label), F.col("norms")).otherwise(F.array_append("norms", label))
    done = joined.withColumn("new_canonical", canonical).withColumn("new_norms", F.coalesce(norms, F.col("norms")))
    return done.select(
        *(F.col({"canonical": "new_canonical", "norms": "new_norms"}.get(c, c)).alias(c) for c in evidence.columns)
    )
