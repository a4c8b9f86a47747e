"""Links of résumés and web profiles to the rows of a recruiter CSV.

A résumé matches a row by e-mail address, or if one of the two names contains the
other; a web profile by names, or if the row's name contains its user name. The
first matching row counts. Addresses are joined by equality. So are names: a text is
cut into all its pieces that are as long as some text it may contain, and equal names
and equal pieces are reduced to their first row before they meet, so that neither
pieces that many share nor names that match many rows make pairs. Texts longer than
``LONGEST`` characters are joined on the piece of that length that fewest others hold,
and containment is checked after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, is_given

#: longer texts are joined on a piece of this length, so that a text has at most so many pieces at a place
LONGEST = 64


def _sized(texts: DataFrame, name: str, *keep: Column) -> DataFrame:
    """The distinct given texts of a column with ``size``, their lengths, and aggregates."""
    return texts.filter(is_given(F.col(name))).groupBy(name).agg(F.max(F.length(name)).alias("size"), *keep)


def _pieces(long: DataFrame, t: str, short: DataFrame) -> DataFrame:
    """``long`` once for every ``piece`` of its text ``t`` that is as long as some text of ``short``, or ``LONGEST``."""
    sizes = short.select(F.least("size", F.lit(LONGEST)).alias("cut")).distinct()  # LONGEST rows at most
    cut = long.join(F.broadcast(sizes), F.col("size") >= F.col("cut"))
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("cut") + 1)))
    return cut.withColumn("piece", F.substring(F.col(t), F.col("at"), F.col("cut"))).drop("at", "cut")


def _inside(short: DataFrame, long: DataFrame, s: str, t: str, s_key: str, t_key: str) -> DataFrame:
    """s_key, t_key of rows whose text ``s`` stands in the text ``t``, by the rarest piece of ``s``: itself, if it is not longer than ``LONGEST``.

    Estimates of sizes do not know how many pieces a text has, hence the hints: nothing is broadcast.
    """
    bodies = _pieces(long, t, short).select(t_key, t, "piece")
    held = bodies.groupBy("piece").agg(F.count("*").alias("holders"))
    spots = F.sequence(F.lit(1), F.greatest(F.col("size") - LONGEST + 1, F.lit(1)))
    heads = short.withColumn("at", F.explode(spots)).select(s_key, s, F.substring(F.col(s), F.col("at"), F.lit(LONGEST)).alias("piece")).distinct()
    heads = heads.join(held.hint("merge"), "piece")
    rarest = heads.groupBy(s_key, s).agg(F.min(F.struct("holders", "piece")).alias("rarest"))
    rarest = rarest.select(s_key, s, F.col("rarest.piece").alias("piece"))
    return rarest.join(bodies.hint("merge"), "piece").filter(F.contains(F.col(t), F.col(s))).select(s_key, t_key)


def containing(left: DataFrame, right: DataFrame, of_left: str, of_right: str) -> DataFrame:
    """left_key, right_key of all rows whose texts contain one another, either way."""
    sides = ((left, of_left), (right, of_right))
    left, right = (side.filter(is_given(F.col(name))).withColumn("size", F.length(name)) for side, name in sides)
    forth = _inside(left, right, of_left, of_right, "left_key", "right_key")
    back = _inside(right, left, of_right, of_left, "right_key", "left_key")
    return forth.unionByName(back).distinct()


def _first_rows(texts: DataFrame, inner: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """their_name, right_key of the first row whose name contains a text of ``texts``, and of the first whose name a text of ``inner`` contains."""
    theirs, outer = _sized(texts, "their_name"), _sized(inner, "their_name")
    rows = _sized(side, "row_name", F.min("right_key").alias("right_key"))
    brief, long = F.col("size") <= LONGEST, F.col("size") > LONGEST

    pieces = _pieces(rows, "row_name", theirs.filter(brief)).groupBy("piece").agg(F.min("right_key").alias("right_key"))
    held = theirs.filter(brief).join(pieces.hint("merge"), F.col("their_name") == F.col("piece")).select("their_name", "right_key")
    pieces = _pieces(outer, "their_name", rows.filter(brief)).select("their_name", "piece")
    holding = pieces.join(rows.filter(brief).hint("merge"), F.col("piece") == F.col("row_name")).groupBy("their_name").agg(F.min("right_key").alias("right_key"))

    def keyed(found: DataFrame) -> DataFrame:
        return found.filter(long).withColumn("left_key", F.col("their_name"))

    longer = rows.filter(long)
    held_longer = _inside(keyed(theirs), longer, "their_name", "row_name", "left_key", "right_key")
    holding_longer = _inside(longer, keyed(outer), "row_name", "their_name", "right_key", "left_key")
    return tuple(a.unionByName(b.withColumnRenamed("left_key", "their_name")) for a, b in ((held, held_longer), (holding, holding_longer)))


def _csv_side(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("csv_ord").alias("right_key"), F.col("candidate_id").alias("matched_id"), fold_key(F.col("full_name")).alias("row_name"), fold_key(F.col("email")).alias("row_email")
    )


def _first(pairs: DataFrame, side: DataFrame, keyed: DataFrame) -> DataFrame:
    firsts = pairs.groupBy("left_key").agg(F.min("right_key").alias("right_key"))
    firsts = firsts.join(side.select("right_key", "matched_id"), "right_key").groupBy("left_key").agg(F.min("matched_id").alias("candidate_id"))
    return keyed.join(firsts, "left_key", "left").drop("left_key")


def match_resumes(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """``parsed`` with the ``candidate_id`` of the first matching row, or null."""
    side = _csv_side(rows)
    keyed = parsed.withColumn("left_key", F.col("resume_path"))
    by_mail = keyed.select("left_key", F.explode(F.transform("emails", fold_key)).alias("row_email"))
    of_mail = side.filter(is_given(F.col("row_email"))).groupBy("row_email").agg(F.min("right_key").alias("right_key"))
    mailed = by_mail.join(of_mail, "row_email").select("left_key", "right_key")
    names = keyed.select("left_key", fold_key(F.col("name")).alias("their_name"))
    held, holding = _first_rows(names, names, side)
    named = names.join(held.unionByName(holding), "their_name").select("left_key", "right_key")
    return _first(mailed.unionByName(named), side, keyed)


def match_profiles(profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """Web profiles (username, name, …) with the ``candidate_id`` of the first matching row, or null."""
    side = _csv_side(rows)
    keyed = profiles.withColumn("left_key", F.col("username"))
    names = keyed.select("left_key", fold_key(F.col("name")).alias("their_name"))
    both = names.unionByName(keyed.select("left_key", F.lower("username").alias("their_name")))
    held, holding = _first_rows(both, names, side)
    found = both.join(held, "their_name").unionByName(names.join(holding, "their_name"))
    return _first(found.select("left_key", "right_key"), side, keyed)


def place_of(found: DataFrame) -> Column:
    """Order of résumés or web profiles: as listed where that is known, else by name."""
    return F.struct(*(c for c in ("resume_ord", "github_ord", "resume_path", "username") if c in found.columns))


def resolve_id(given: str | None, resumes: DataFrame, profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """One row, candidate_id: the given id, or else the first that sources suggest.

    ``AUTO`` or nothing means the first matched résumé's, then the first matched
    profile's, then the first row's.
    """
    spark = rows.sparkSession
    if given and given != "AUTO":
        return spark.createDataFrame([(given,)], "candidate_id string")
    firsts = [
        resumes.filter("candidate_id IS NOT NULL").agg(F.min_by("candidate_id", place_of(resumes)).alias("r")),
        profiles.filter("candidate_id IS NOT NULL").agg(F.min_by("candidate_id", place_of(profiles)).alias("g")),
        rows.agg(F.min_by("candidate_id", "csv_ord").alias("c")),
    ]
    joined = firsts[0].crossJoin(firsts[1]).crossJoin(firsts[2])  # one row each
    return joined.select(F.coalesce("r", "g", "c").alias("candidate_id"))
