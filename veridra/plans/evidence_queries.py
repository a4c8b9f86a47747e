"""Queries that run the evidence engine's own operators on the star-schema tables, with equal SQL.

Two kinds of evidence are built from the tables. Orders state their priority about their
customer (one field, many statements); customers are written as recruiter rows and as
applicant-tracking objects (all kinds of fields, two sources). Confidences are multiples
of 1/64, so that sums are exact in any order. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cluster, confidence, match, merge, normalize, profile, rules
from ..schema import display, value_of
from ..session import shared_folder, ship
from ..sources import ats_json, github_api, manifest, recruiter_csv, resume_text
from . import projection, reports, validation
from .consolidate import Sources, consolidate, gather

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# evidence of orders: priorities, as a headline and as skills

#: confidence of an order's statement by its status
STATUS_CONFIDENCE = {"F": 61 / 64, "O": 57 / 64}
OTHER_CONFIDENCE = 51 / 64
_CONF = "CAST(CASE o_orderstatus WHEN 'F' THEN 0.953125 WHEN 'O' THEN 0.890625 ELSE 0.796875 END AS DOUBLE)"


def order_evidence(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("headline",)) -> DataFrame:
    """What every order says about its customer: its priority, as each of ``fields``; as full_name its status."""
    conf = F.lit(OTHER_CONFIDENCE)
    for status, value in STATUS_CONFIDENCE.items():
        conf = F.when(F.col("o_orderstatus") == status, value).otherwise(conf)
    nothing = F.when(F.lit(False), value_of("emails", F.lit("")))
    told = [F.struct(F.lit(f).alias("field"), value_of(f, F.col("o_orderstatus" if f == "full_name" else "o_orderpriority")).alias("raw")) for f in fields]
    rows = _table(spark, sf_dir, "orders").withColumn("told", F.explode(F.array(*told)))
    return rows.select(
        F.col("o_custkey").cast("string").alias("candidate_id"),
        F.lit(2).alias("profile_ord"),
        F.col("o_orderkey").cast("int").alias("item_ord"),
        F.col("told.field").alias("field"),
        F.col("told.raw").alias("raw"),
        nothing.alias("canonical"),
        F.concat(F.lit("orders:"), "o_orderstatus").alias("source"),
        F.lit("star").alias("method"),
        conf.alias("base_conf"),
        F.array().cast("array<string>").alias("norms"),
    )


def clustered_orders(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("headline",)) -> DataFrame:
    return cluster.cluster(merge.with_value(cluster.order(order_evidence(spark, sf_dir, fields))))


def voted_orders(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("headline",)) -> DataFrame:
    return merge.vote(clustered_orders(spark, sf_dir, fields))


def _said(field: str, value: str = "o_orderpriority", group: str = "''") -> str:
    """SQL for one field of ``order_evidence``; ``cl`` names the cluster within the field."""
    return (
        f"SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, '{field}' AS field, {group} AS cl, {value} AS v, 'orders:' || o_orderstatus AS source, "
        f"{_CONF} AS conf, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS seq FROM orders"
    )


#: SQL: the vote on evidence e (candidate_id, field, cl, v, source, conf, seq), winners in m
_VOTE = """
    s AS (SELECT candidate_id, field, cl, v, sum(conf) AS score, count(*) AS n, max(conf) AS best FROM e GROUP BY candidate_id, field, cl, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, field, cl ORDER BY score DESC, v DESC) AS place,
                 sum(n) OVER (PARTITION BY candidate_id, field, cl) AS total FROM s),
    w AS (SELECT e.*, r.place FROM e JOIN r USING (candidate_id, field, cl, v)),
    p AS (SELECT candidate_id, field, cl, string_agg(source, ', ' ORDER BY conf DESC, seq) FILTER (WHERE place = 1) AS supporters,
                 first(source ORDER BY conf DESC, seq) FILTER (WHERE place = 1) AS source,
                 coalesce(string_agg(v || '|' || source, ',' ORDER BY place, seq) FILTER (WHERE place > 1), '') AS rejected,
                 list(DISTINCT source) FILTER (WHERE place > 1) AS rejected_from
          FROM w GROUP BY candidate_id, field, cl),
    m AS (SELECT r.candidate_id, r.field, r.cl, r.v, r.score, r.best, CAST(r.n AS INTEGER) AS n, CAST(r.total - r.n AS INTEGER) AS lost,
                 p.supporters, p.source, p.rejected, p.rejected_from
          FROM r JOIN p USING (candidate_id, field, cl) WHERE place = 1)
"""
#: SQL: bonus, penalty and final confidence of a row of m
_BONUS = "CASE WHEN n > 1 THEN least(0.20::DOUBLE, 0.05::DOUBLE * (n - 1)) ELSE 0.0::DOUBLE END"
_PENALTY = "CASE WHEN lost > 0 THEN greatest(-0.15::DOUBLE, -0.05::DOUBLE * lost) ELSE 0.0::DOUBLE END"
_FINAL = f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, best + {_BONUS} + {_PENALTY})), 2)"


def _two(number: str) -> str:
    """SQL: a number with two decimals, ties away from zero."""
    return f"CAST(round(CAST({number} AS DECIMAL(18, 8)), 2) AS DECIMAL(18, 2))::VARCHAR"


@_query(
    f"WITH e AS ({_said('headline')}), {_VOTE}"
    + f"""
    SELECT candidate_id, v AS winner, score, n AS agreement, lost AS rejected, source AS primary_source,
           'Selected value ''' || v || ''' with aggregate confidence score ' || {_two("score")} || ' supported by ' || n || ' source(s) (' || supporters
           || '). Rejected ' || lost || ' conflicting evidence source(s).' AS decision FROM m
    """
)
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with the largest sum of confidence for each customer, and the decision in words."""
    found = voted_orders(spark, sf_dir)
    origin = F.col("provenance")
    return found.select(
        "candidate_id",
        F.col("value_key").alias("winner"),
        "score",
        origin["agreement_count"].alias("agreement"),
        F.size(origin["rejected_sources"]).alias("rejected"),
        origin["source"].alias("primary_source"),
        origin["merge_decision"].alias("decision"),
    )


@_query(f"WITH e AS ({_said('headline')}), {_VOTE} SELECT candidate_id, v AS winner, supporters, rejected FROM m")
def vote_support_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting sources by confidence, and what the winner won against, in order of rank."""
    origin = F.col("provenance")
    lost = F.transform(origin["rejected_sources"], lambda r: F.concat(r["value"], F.lit("|"), r["source"]))
    return voted_orders(spark, sf_dir).select(
        "candidate_id", F.col("value_key").alias("winner"), F.array_join(origin["supporting_sources"], ", ").alias("supporters"), F.array_join(lost, ",").alias("rejected")
    )


@_query(
    f"WITH e AS ({_said('headline')}), {_VOTE}"
    + f"""
    SELECT candidate_id, v AS winner, {_FINAL} AS confidence,
           concat_ws('; ', 'Base extraction confidence: ' || {_two("best")} || ' (' || source || ')',
                     CASE WHEN n > 1 THEN 'Agreement Bonus: +' || {_two(_BONUS)} || ' (' || n || ' matching sources)' END,
                     CASE WHEN lost > 0 THEN 'Conflict Penalty: ' || {_two(_PENALTY)} || ' (' || lost || ' conflicting sources)' END) AS evolution
    FROM m
    """
)
def agreement_conflict_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's confidence: up with agreement, down with conflict, and how it came about."""
    scored = confidence.score(voted_orders(spark, sf_dir))
    return scored.select("candidate_id", F.col("value_key").alias("winner"), "confidence", F.array_join("provenance.confidence_evolution", "; ").alias("evolution"))


@_query(
    f"WITH e AS ({_said('headline')} UNION ALL {_said('full_name', 'o_orderstatus')} UNION ALL {_said('skills', group='o_orderpriority')}), {_VOTE},"
    + f"""
    f AS (SELECT *, {_FINAL} AS final FROM m),
    firsts AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, o_orderpriority AS cl, min(place) AS first FROM
               (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS place FROM orders) GROUP BY 1, 2),
    o AS (SELECT f.*, coalesce(first, 0) AS first FROM f LEFT JOIN firsts ON field = 'skills' AND firsts.candidate_id = f.candidate_id AND firsts.cl = f.cl),
    c AS (SELECT candidate_id, list_reduce(list_prepend(0.0::DOUBLE, list(final ORDER BY field, first)), lambda a, b: a + b) / count(*) AS mean,
                 len(list_distinct(flatten(list(list_append(coalesce(rejected_from, []), source))))) AS sources FROM o GROUP BY candidate_id)
    SELECT candidate_id, CAST(round(CAST(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, mean + CASE WHEN sources > 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END))
           AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS overall_confidence FROM c
    """
)
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of all of a customer's fields, more with several sources."""
    return confidence.overall(confidence.score(voted_orders(spark, sf_dir, ("headline", "full_name", "skills"))))


@_query(
    """
    WITH e AS (SELECT user_id, event_id, event_type, lower(trim(event_type)) AS key FROM events),
    f AS (SELECT user_id, key, min(event_id) AS leader, count(*) AS members, count(DISTINCT event_type) AS spellings FROM e GROUP BY user_id, key)
    SELECT CAST(user_id AS VARCHAR) AS candidate_id, key AS cluster_key, leader, members,
           row_number() OVER (PARTITION BY user_id ORDER BY leader) AS place FROM f
    """
)
def exact_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of addresses that are equal but for case and white space, in order of their first members."""
    events = _table(spark, sf_dir, "events")
    spelled = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit("\t"))).otherwise(F.col("event_type"))
    rows = events.select(
        F.col("user_id").cast("string").alias("candidate_id"), F.lit(2).alias("profile_ord"), F.col("event_id").alias("item_ord"), F.lit("emails").alias("field"),
        value_of("emails", spelled).alias("raw"), F.when(F.lit(False), value_of("emails", F.lit(""))).alias("canonical"), F.lit("s").alias("source"), "event_id",
    )
    found = cluster.cluster(merge.with_value(cluster.order(rows)))
    led = found.groupBy("candidate_id", "cluster").agg(F.min("event_id").alias("leader"), F.count("*").alias("members"), F.min(F.lower(F.trim(F.replace("value.text", F.lit("\t"), F.lit(""))))).alias("cluster_key"))
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("cluster")).cast("long")
    return led.select("candidate_id", "cluster_key", "leader", "members", place.alias("place"))


# rules


@_query(
    f"WITH e AS ({_said('headline')} UNION ALL {_said('skills', group='o_orderpriority')}), {_VOTE},"
    + f"""
    f AS (SELECT *, {_FINAL} AS final FROM m),
    firsts AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, o_orderpriority AS cl, min(place) AS first FROM
               (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS place FROM orders) GROUP BY 1, 2),
    k AS (SELECT candidate_id, string_agg(v, ',' ORDER BY first) AS skills FROM f JOIN firsts USING (candidate_id, cl)
          WHERE field = 'skills' AND final >= 0.98 AND lower(v) NOT IN ('5-low') GROUP BY candidate_id),
    h AS (SELECT candidate_id, CASE WHEN final >= 0.98 THEN v END AS headline FROM f WHERE field = 'headline')
    SELECT candidate_id, headline, coalesce(skills, '') AS skills, concat_ws(',', CASE WHEN headline IS NULL THEN 'headline' END,
           CASE WHEN skills IS NULL THEN 'skills' END, 'emails') AS missing, true AS failed FROM h LEFT JOIN k USING (candidate_id)
    """
)
def business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure fields and listed skills go; required fields that are missing are named."""
    profiles = profile.assemble(confidence.score(voted_orders(spark, sf_dir, ("headline", "skills"))))
    kept = rules.apply(profiles, {"min_field_confidence": 0.98, "skill_blacklist": ["5-LOW "], "required_fields": ["headline", "skills", "emails"]})
    return kept.select(
        "candidate_id",
        F.col("headline.value").alias("headline"),
        F.array_join(F.transform("skills", lambda s: s["value"]), ",").alias("skills"),
        F.array_join("missing_fields", ",").alias("missing"),
        F.col("rules_failed").alias("failed"),
    )


@_query(
    """
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS candidate_id, o_orderpriority AS skill FROM orders
    WHERE lower(o_orderpriority) NOT IN (SELECT lower(trim(r_name)) FROM region UNION ALL SELECT '1-urgent' UNION ALL SELECT '5-low')
    """
)
def anti_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged skills that are not on a list kept as a table."""
    listed = _table(spark, sf_dir, "region").select(F.col("r_name").alias("skill"))
    listed = listed.unionByName(listed.limit(1).select(F.explode(F.array(F.lit(" 1-URGENT"), F.lit("5-Low"))).alias("skill")))
    kept = rules.drop_skills(voted_orders(spark, sf_dir, ("skills",)), listed)
    return kept.select("candidate_id", F.col("value_key").alias("skill"))


# evidence of customers: recruiter rows and applicant-tracking objects


def recruiter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the rows of a recruiter CSV; every eighth has a second row, which does not count."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    joined = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    columns = {
        "candidate_id": key.cast("string"),
        "full_name": F.concat(F.lit(" customer  "), F.lower("n_name"), F.lit(" ")),
        "email": F.concat(F.lit(" CUST"), key.cast("string"), F.lit("@X.org ")),
        "phone": F.when(key % 5 != 0, F.concat(F.lit("(212) 555-"), F.lpad((key % 10000).cast("string"), 4, "0"))),
        "location": F.concat_ws(", ", F.concat(F.lit("town of "), "c_mktsegment"), "r_name", "n_name"),
        "headline": F.concat(F.lower("c_mktsegment"), F.lit(" & buyer")),
        "github": F.when(key % 4 == 0, F.concat(F.lit("https://github.com/cust"), key.cast("string"))),
        "resume_file": F.lit(None).cast("string"),
        "company": F.lit("acme  works"),
        "job_title": F.when(key % 2 == 0, F.lit("builder")),
        "skills": F.lit("ml|python| cobol"),
        "experience_years": F.when(key % 6 == 0, F.lit("many")).otherwise((key % 30).cast("string")),
    }
    rows = joined.select(*(c.alias(n) for n, c in columns.items()), key.alias("line"))
    again = rows.filter("line % 8 = 0").withColumn("full_name", F.lit("another row")).withColumn("line", F.col("line") + F.lit(1 << 40))
    both = rows.unionByName(again)
    return both.withColumn("csv_path", F.lit("customers.csv")).withColumn("csv_ord", F.struct(F.lit(0).alias("file_ord"), "line")).drop("line")


def ats_objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applicant-tracking objects: members under either of their names, places as objects or texts."""
    nation = _table(spark, sf_dir, "nation")
    joined = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    text_key = key.cast("string")
    work = F.struct(F.lit("Acme Works").alias("company"), F.when(key % 2 == 0, F.lit("Builder")).alias("title"), F.lit("Sep 2020").alias("start"), F.lit("Present").alias("end"))
    idle = F.struct(F.lit(None).cast("string").alias("company"), F.lit("").alias("title"), F.lit("2019").alias("start"), F.lit(None).cast("string").alias("end"))
    study = F.struct(F.lit("x  university").alias("institution"), F.lit("bsc").alias("degree"), F.lit(" 2014 ").alias("end_year"))
    place = F.struct(F.initcap("n_name").alias("city"), F.substring("n_name", 1, 2).alias("country"))
    whole = F.to_json(
        F.struct(
            F.when(key % 3 == 0, text_key).alias("candidate_id"),
            F.when(key % 3 != 0, text_key).alias("id"),
            F.when(key % 2 == 0, F.col("c_mktsegment")).alias("full_name"),
            F.when(key % 2 == 1, F.col("c_mktsegment")).alias("name"),
            F.when(key % 7 != 0, F.concat(F.lit("cust"), text_key, F.lit("@x.org"))).otherwise(F.lit("no address")).alias("email"),
            F.lit(" call me ").alias("phone"),
            F.when(key % 3 != 2, place).alias("location"),
            (key % 7).alias("experience_years"),
            F.array(F.lit("Python "), F.lit("js")).alias("skills"),
            F.array(work, idle).alias("experience"),
            F.array(study).alias("education"),
        )
    )
    return joined.select(F.concat(F.lit("ats/"), text_key).alias("ats_path"), whole.alias("value"))


def customer_sources(spark: SparkSession, sf_dir: str) -> Sources:
    return Sources(csv=recruiter_rows(spark, sf_dir), ats=ats_json.parse(ats_objects_of(spark, sf_dir)))


def scored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(gather(ship(spark), customer_sources(spark, sf_dir)), "fixed")[2]


def _shown(**parts: str) -> str:
    """SQL: the display form of a structure; parts are SQL texts, None for an absent one."""
    return " || ' ' || ".join(f"'{n}=' || " + ("'None'" if p is None else f"coalesce('''' || ({p}) || '''', 'None')") for n, p in parts.items())


def _title(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


#: SQL: what the two sources state, before (raw) and after (v) normalisation, with the label; cl clusters within the field
_STATED = f"""
    c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS candidate_id, c_mktsegment AS seg, n_name, r_name
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    csv AS (
      SELECT k, candidate_id, 'full_name' AS field, 0 AS ord, 'customer  ' || lower(n_name) AS raw, 'Customer ' || {_title("regexp_replace(n_name, '[^a-zA-Z ]', '', 'g')")} AS v, '' AS cl, 'TitleCase_CleanWhitespace' AS label FROM c
      UNION ALL SELECT k, candidate_id, 'emails', 1, 'CUST' || k || '@X.org', 'cust' || k || '@x.org', 'cust' || k || '@x.org', 'Lowercase_Strip' FROM c
      UNION ALL SELECT k, candidate_id, 'phones', 2, '(212) 555-' || lpad((k % 10000)::VARCHAR, 4, '0'), '+1212555' || lpad((k % 10000)::VARCHAR, 4, '0'),
                '+1212555' || lpad((k % 10000)::VARCHAR, 4, '0'), 'E164_Format' FROM c WHERE k % 5 <> 0
      UNION ALL SELECT k, candidate_id, 'location', 3, {_shown(city="'town of ' || seg", region="r_name", country="n_name")},
                {_shown(city="'town of ' || seg", region="r_name", country="n_name")}, '', NULL FROM c
      UNION ALL SELECT k, candidate_id, 'links', 4, 'linkedin=None github=''https://github.com/cust' || k || ''' portfolio=None other=[]',
                'linkedin=None github=''https://github.com/cust' || k || ''' portfolio=None other=[]', '', NULL FROM c WHERE k % 4 = 0
      UNION ALL SELECT k, candidate_id, 'headline', 5, lower(seg) || ' & buyer', {_title("seg")} || ' Buyer', '', 'TitleCase_CleanWhitespace' FROM c
      UNION ALL SELECT k, candidate_id, 'years_experience', 6, (k % 30)::DOUBLE::VARCHAR, (k % 30)::DOUBLE::VARCHAR, '', NULL FROM c WHERE k % 6 <> 0
      UNION ALL SELECT k, candidate_id, 'experience', 7, {_shown(company="'acme  works'", title="CASE WHEN k % 2 = 0 THEN 'builder' ELSE '' END", start=None, end=None, summary=None)},
                {_shown(company="'Acme Works'", title="CASE WHEN k % 2 = 0 THEN 'Builder' ELSE '' END", start=None, end=None, summary=None)}, 'acme', 'Experience_Standardization' FROM c
      UNION ALL SELECT k, candidate_id, 'skills', 8, 'ml', 'Machine Learning', 'machine learning', 'Canonical_Alias_Map' FROM c
      UNION ALL SELECT k, candidate_id, 'skills', 9, 'python', 'Python', 'python', 'Fuzzy_Match_83pct' FROM c
      UNION ALL SELECT k, candidate_id, 'skills', 10, 'cobol', 'Cobol', 'cobol', 'TitleCase_Fallback' FROM c),
    ats AS (
      SELECT k, candidate_id, 'full_name' AS field, 0 AS ord, seg AS raw, {_title("seg")} AS v, '' AS cl, 'TitleCase_CleanWhitespace' AS label FROM c
      UNION ALL SELECT k, candidate_id, 'emails', 1, CASE WHEN k % 7 <> 0 THEN 'cust' || k || '@x.org' ELSE 'no address' END,
                CASE WHEN k % 7 <> 0 THEN 'cust' || k || '@x.org' ELSE 'no address' END, CASE WHEN k % 7 <> 0 THEN 'cust' || k || '@x.org' ELSE 'no address' END, 'Lowercase_Strip' FROM c
      UNION ALL SELECT k, candidate_id, 'phones', 2, 'call me', 'call me', 'call me', 'Parse_Attempt_Failed' FROM c
      UNION ALL SELECT k, candidate_id, 'location', 3, {_shown(city=_title("n_name"), region=None, country="n_name[1:2]")},
                {_shown(city=_title("n_name"), region=None, country="n_name[1:2]")}, '', NULL FROM c WHERE k % 3 <> 2
      UNION ALL SELECT k, candidate_id, 'years_experience', 5, (k % 7)::DOUBLE::VARCHAR, (k % 7)::DOUBLE::VARCHAR, '', NULL FROM c WHERE k % 7 <> 0
      UNION ALL SELECT k, candidate_id, 'skills', 6, 'Python', 'Python', 'python', 'Fuzzy_Match_83pct' FROM c
      UNION ALL SELECT k, candidate_id, 'skills', 7, 'js', 'JavaScript', 'javascript', 'Canonical_Alias_Map' FROM c
      UNION ALL SELECT k, candidate_id, 'experience', 8, {_shown(company="'Acme Works'", title="CASE WHEN k % 2 = 0 THEN 'Builder' ELSE '' END", start="'Sep 2020'", end="'Present'", summary=None)},
                {_shown(company="'Acme Works'", title="CASE WHEN k % 2 = 0 THEN 'Builder' ELSE '' END", start="'2020-09'", end=None, summary=None)}, 'acme', 'Experience_Standardization' FROM c
      UNION ALL SELECT k, candidate_id, 'education', 9, {_shown(institution="'x  university'", degree="'bsc'", field=None, end_year="' 2014 '")},
                {_shown(institution="'X University'", degree="'Bsc'", field=None, end_year="'2014'")}, 'x', 'Education_Standardization' FROM c),
    stated AS (SELECT *, 'CSV:customers.csv' AS source, 'CSV_DictReader' AS method, 0.9::DOUBLE AS conf, 2 AS profile_ord FROM csv
               UNION ALL SELECT *, 'ATS:ats/' || candidate_id, 'ATS_JSON_Parser', 0.95::DOUBLE, 3 FROM ats)
"""


def _raw_rows(evidence: DataFrame) -> DataFrame:
    return evidence.select("candidate_id", "field", display(F.col("raw")).alias("raw"), "source", "method", F.col("base_conf").alias("conf"))


_RAW = "SELECT candidate_id, field, raw, source, method, conf FROM stated"


@_query(f"WITH {_STATED} {_RAW}")
def gathered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of all customers: the first recruiter row of each, and their objects."""
    return _raw_rows(gather(ship(spark), customer_sources(spark, sf_dir)))


@_query(f"WITH {_STATED} {_RAW} WHERE source LIKE 'ATS:%'")
def ats_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant-tracking objects read as evidence."""
    objects = ats_json.for_candidates(ats_json.parse(ats_objects_of(spark, sf_dir)))
    return _raw_rows(ats_json.evidence(objects))


@_query(f"WITH {_STATED} SELECT candidate_id, field, raw, 'CSV:customers.csv' AS source, method, conf FROM stated WHERE source LIKE 'CSV:%'")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a recruiter CSV and read back as evidence."""
    path = f"{shared_folder(spark)}/recruiter-{uuid.uuid4().hex}"
    rows = recruiter_rows(spark, sf_dir).filter("full_name <> 'another row'").select(*recruiter_csv.COLUMNS)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    found = recruiter_csv.evidence(recruiter_csv.read(spark, path))
    return _raw_rows(found).withColumn("source", F.lit("CSV:customers.csv"))


@_query(
    f"""WITH {_STATED} SELECT candidate_id, field, raw, CASE WHEN label IS NOT NULL THEN v END AS canonical, coalesce(label, '') AS label, source FROM stated"""
)
def normalized_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical values and the labels of what was applied: names, addresses, phones, skills, work, studies."""
    found = normalize.normalize(gather(ship(spark), customer_sources(spark, sf_dir)))
    return found.select(
        "candidate_id", "field", display(F.col("raw")).alias("raw"), display(F.col("canonical")).alias("canonical"), F.array_join("norms", ",").alias("label"), "source"
    )


#: SQL: scored rows f of the customers' evidence
_SCORED = f"""{_STATED},
    e AS (SELECT candidate_id, field, cl, v, source, method, conf, profile_ord * 100 + ord AS seq, label FROM stated), {_VOTE},
    labels AS (SELECT candidate_id, field, cl, v, max(label) AS label FROM e GROUP BY candidate_id, field, cl, v),
    heads AS (SELECT candidate_id, field, cl, min(seq) AS head FROM e GROUP BY candidate_id, field, cl),
    f AS (SELECT m.*, label, head, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, best + {_BONUS} + {_PENALTY}
                 + CASE WHEN field = 'emails' THEN CASE WHEN contains(v, '@') THEN 0.05::DOUBLE ELSE -0.2::DOUBLE END
                        WHEN field = 'phones' THEN CASE WHEN label = 'E164_Format' THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END ELSE 0.0::DOUBLE END
                 + CASE WHEN label = 'Fuzzy_Match_83pct' THEN -0.017::DOUBLE ELSE 0.0::DOUBLE END)), 2) AS final
          FROM m JOIN labels USING (candidate_id, field, cl, v) JOIN heads USING (candidate_id, field, cl))
"""


@_query(
    f"WITH {_SCORED} SELECT candidate_id, field, v AS value_key, final AS confidence, n AS agreement, lost AS rejected, source AS primary_source, "
    "coalesce(label, '') AS norms, supporters FROM f"
)
def consolidated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on evidence of all kinds: gather, normalise, cluster, vote, score."""
    origin = F.col("provenance")
    return scored_customers(spark, sf_dir).select(
        "candidate_id",
        "field",
        "value_key",
        "confidence",
        origin["agreement_count"].alias("agreement"),
        F.size(origin["rejected_sources"]).alias("rejected"),
        origin["source"].alias("primary_source"),
        F.array_join(origin["normalization_applied"], ",").alias("norms"),
        F.array_join(origin["supporting_sources"], ", ").alias("supporters"),
    )


@_query(
    f"WITH e AS ({_said('headline', 'lower(substr(o_orderpriority, 3))')}), {_VOTE}"
    + f" SELECT candidate_id, 'headline' AS field, v AS value_key, {_FINAL} AS confidence, n AS agreement, lost AS rejected FROM m"
)
def consolidated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on orders, which state headlines only."""
    _, _, scored = consolidate(order_evidence(spark, sf_dir), "fixed")
    plain = F.lower(F.trim(F.replace("value_key", F.lit("-"), F.lit(""))))
    origin = F.col("provenance")
    return scored.select(
        "candidate_id", "field", plain.alias("value_key"), "confidence", origin["agreement_count"].alias("agreement"), F.size(origin["rejected_sources"]).alias("rejected")
    )


# profiles, projection, validation


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.assemble(scored_customers(spark, sf_dir))


SETTINGS = {
    "fields": [
        {"path": "name", "from": "full_name"},
        {"path": "primary_email", "from": "emails[0]", "required": True},
        {"path": "last_skill", "from": "skills[-1]"},
        {"path": "beyond", "from": "emails[7]"},
        {"path": "city", "from": "location.city"},
        {"path": "company", "from": "experience[0].company"},
        {"path": "emails", "type": "array"},
        {"path": "phones", "type": "array"},
        {"path": "skills", "type": "array"},
        {"path": "experience", "type": "array"},
        {"path": "education", "type": "array"},
        {"path": "location", "type": "object"},
        {"path": "headline", "type": "number"},
        {"path": "links", "type": "object"},
        {"path": "years_experience", "type": "number"},
        {"path": "n_skills", "type": "number", "computed": "calculate_skills_count"},
        {"path": "n_work", "type": "number", "computed": "calculate_experience_count"},
        {"path": "unknown", "from": "nothing.here"},
    ],
    "include_confidence": False,
    "include_provenance": False,
}


def _part(of: str, name: str) -> str:
    """SQL: a quoted part of a display form; empty if it is absent."""
    return f"regexp_extract({of}, '{name}=''([^'']*)''', 1)"


#: SQL: profiles q of the customers: winners by field, lists in order of their first statement
_PROFILES = f"""{_SCORED},
    q AS (SELECT candidate_id,
            first(v) FILTER (WHERE field = 'full_name') AS name, first(v) FILTER (WHERE field = 'headline') AS headline,
            first(v) FILTER (WHERE field = 'location') AS location, first(v) FILTER (WHERE field = 'links') AS links,
            first(v) FILTER (WHERE field = 'years_experience') AS years,
            list(v ORDER BY head) FILTER (WHERE field = 'emails') AS emails, list(v ORDER BY head) FILTER (WHERE field = 'phones') AS phones,
            list(v ORDER BY head) FILTER (WHERE field = 'skills') AS skills, list(final ORDER BY head) FILTER (WHERE field = 'skills') AS skill_scores,
            list(supporters ORDER BY head) FILTER (WHERE field = 'skills') AS skill_sources,
            list(final ORDER BY head) FILTER (WHERE field = 'emails') AS email_scores, list(final ORDER BY head) FILTER (WHERE field = 'phones') AS phone_scores,
            first(v) FILTER (WHERE field = 'experience') AS work,
            count(*) FILTER (WHERE field = 'experience') AS n_work, count(*) FILTER (WHERE field = 'education') AS n_study
          FROM f GROUP BY candidate_id)
"""


@_query(
    f"""WITH {_PROFILES}
    SELECT candidate_id, name, emails[1] AS primary_email, skills[-1] AS last_skill, CAST(NULL AS VARCHAR) AS beyond, {_part("location", "city")} AS city, 'Acme Works' AS company,
           array_to_string(list_transform(list_zip(emails, email_scores), lambda x: x[1] || '=' || x[2]), ',') AS emails,
           array_to_string(list_transform(list_zip(phones, phone_scores), lambda x: x[1] || '=' || x[2]), ',') AS phones,
           array_to_string(list_transform(list_zip(skills, skill_scores, skill_sources), lambda x: x[1] || '=' || x[2] || '/' || x[3]), ',') AS skills,
           {_part("location", "country")} AS country, headline, coalesce({_part("links", "github")}, '') AS github, CAST(years AS DOUBLE) AS years,
           CAST(len(skills) AS INTEGER) AS n_skills, CAST(n_work AS INTEGER) AS n_work, CAST(n_study AS INTEGER) AS n_study FROM q
    """
)
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed, nested, indexed, computed and formatted fields of every profile."""
    done = projection.project(customer_profiles(spark, sf_dir), SETTINGS)

    def pairs(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat(x["value"], F.lit("="), x["confidence"].cast("string"))), ",").alias(name)

    skills = F.transform("skills", lambda s: F.concat(s["name"], F.lit("="), s["confidence"].cast("string"), F.lit("/"), F.array_join(s["sources"], ", ")))
    return done.select(
        "candidate_id", "name", "primary_email", "last_skill", F.col("beyond").cast("string").alias("beyond"), "city", "company", pairs("emails"), pairs("phones"),
        F.array_join(skills, ",").alias("skills"), F.coalesce("location.country", F.lit("")).alias("country"), "headline", F.coalesce("links.github", F.lit("")).alias("github"),
        F.col("years_experience").alias("years"), "n_skills", "n_work", F.size("education").alias("n_study"),
    )


@_query(
    f"""WITH {_SCORED}
    SELECT candidate_id, string_agg(field || ':' || source || ':' || split_part(source, ':', 1), ';'
           ORDER BY CASE field WHEN 'full_name' THEN 0 WHEN 'location' THEN 1 WHEN 'links' THEN 2 WHEN 'headline' THEN 3 WHEN 'years_experience' THEN 4
                               WHEN 'emails' THEN 5 WHEN 'phones' THEN 6 WHEN 'skills' THEN 7 WHEN 'experience' THEN 8 ELSE 9 END, head) AS origins
    FROM f GROUP BY candidate_id
    """
)
def provenance_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field, source and method of every field, scalars first."""
    done = projection.project(customer_profiles(spark, sf_dir), {"fields": []})
    kind = F.element_at(F.create_map(F.lit("CSV_DictReader"), F.lit("CSV"), F.lit("ATS_JSON_Parser"), F.lit("ATS")), F.col("p.method"))
    rows = done.select("candidate_id", F.posexplode("provenance").alias("place", "p"))
    shown = F.concat_ws(":", "p.field", "p.source", kind)
    ordered = F.sort_array(F.collect_list(F.struct("place", shown.alias("shown"))))
    return rows.groupBy("candidate_id").agg(F.array_join(F.transform(ordered, lambda r: r["shown"]), ";").alias("origins"))


_POLICY = [{"path": "links"}, {"path": "n", "computed": "calculate_skills_count"}, {"path": "phones"}, {"path": "nothing"}]


@_query(
    f"""WITH {_PROFILES},
    j AS (SELECT candidate_id, links, CAST(len(skills) AS VARCHAR) AS n,
                 '{{"linkedin":null,"github":"' || {_part("links", "github")} || '","portfolio":null,"other":[]}}' AS shown FROM q)
    SELECT candidate_id, CASE WHEN links IS NULL THEN '{{' ELSE '{{"links":' || shown || ',' END || '"n":' || n || ',' AS omitted,
           '{{"links":' || CASE WHEN links IS NULL THEN 'null' ELSE shown END || ',"n":' || n || ',' AS nulled, true AS omits, true AS nulls FROM j
    """
)
def missing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields left out of the JSON output, or null there."""
    profiles = customer_profiles(spark, sf_dir)
    shown = {}
    for policy in ("omit", "null"):
        settings = {"fields": _POLICY, "on_missing": policy}
        shown[policy] = projection.payload(projection.project(profiles, settings), settings).withColumnRenamed("payload", policy)
    both = shown["omit"].join(shown["null"], "candidate_id")
    head = r'^(.*?"n":\d+,)'
    return both.select(
        "candidate_id",
        F.regexp_extract("omit", head, 1).alias("omitted"),
        F.regexp_extract("null", head, 1).alias("nulled"),
        (~F.contains("omit", F.lit('"nothing"'))).alias("omits"),
        F.contains("null", F.lit('"nothing":null')).alias("nulls"),
    )


@_query(
    f"""WITH {_PROFILES}
    SELECT candidate_id, array_to_string(list_transform(phones, lambda p: CASE WHEN p = 'call me' THEN p ELSE '(' || p[3:5] || ') ' || p[6:8] || '-' || p[9:] END), ',') AS phones,
           array_to_string(list_transform(skills, lambda s: CASE s WHEN 'Machine Learning' THEN 'ml' WHEN 'JavaScript' THEN 'js' WHEN 'Cobol' THEN 'cobol' ELSE s END), ',') AS skills,
           CASE {_part("location", "country")} WHEN 'IN' THEN 'India' WHEN 'CA' THEN 'Canada' ELSE {_part("location", "country")} END AS country,
           CASE WHEN {_part("work", "start")} = '' THEN '' ELSE '01/09/2020' END AS started, '01/01/2014' AS studied FROM q
    """
)
def reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles in another form: phones and skills as stated, countries in full, dates by day."""
    settings = {
        "fields": [{"path": p} for p in ("phones", "skills", "location", "experience", "education")],
        "include_confidence": False, "include_provenance": False,
        "phone_norm": "Raw", "skills_norm": "Original", "country_norm": "Full", "dates_norm": "DD/MM/YYYY",
    }
    done = projection.reproject(customer_profiles(spark, sf_dir), settings)
    return done.select(
        "candidate_id",
        F.array_join("phones", ",").alias("phones"),
        F.array_join("skills", ",").alias("skills"),
        F.coalesce("location.country", F.lit("")).alias("country"),
        F.coalesce(F.get("experience", F.lit(0))["start"], F.lit("")).alias("started"),
        F.get("education", F.lit(0))["end_year"].alias("studied"),
    )


@_query(
    f"""WITH {_PROFILES}
    SELECT candidate_id, len(list_filter(emails, lambda e: NOT contains(e, '@'))) = 0 AS is_valid,
           array_to_string(list_transform(list_filter(emails, lambda e: NOT contains(e, '@')), lambda e: 'Email List Syntax Error: ''' || e || ''' is not a valid email address.'), ';') AS errors,
           concat_ws(';', CASE WHEN links IS NULL THEN 'Required field ''links'' was missing and has been set to null.' END,
                     nullif(array_to_string(list_transform(list_filter(phones, lambda p: p = 'call me'),
                            lambda p: 'Phone List Format Warning: ''' || p || ''' does not comply with international E164 format.'), ';'), ''),
                     CASE WHEN length({_part("location", "country")}) NOT IN (0, 2) THEN 'ISO Country Code Warning: Location country '''
                          || {_part("location", "country")} || ''' is not a standard ISO-3166 2-character code.' END) AS warnings FROM q
    """
)
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of projected profiles: required fields, addresses, numbers, countries."""
    settings = {
        "fields": [{"path": "primary_email", "from": "emails[0]", "required": True}, {"path": "emails", "type": "array"}, {"path": "phones", "type": "array"},
                   {"path": "location", "type": "object"}, {"path": "links", "type": "object", "required": True}],
        "include_confidence": False, "include_provenance": False,
    }
    told = validation.validate(projection.project(customer_profiles(spark, sf_dir), settings), settings)
    return told.select("candidate_id", "is_valid", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@_query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, 'Schema Mismatch: Field ''a'' expected string, got int;Schema Mismatch: Field ''b'' expected array, got str' AS errors,
           CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings, CAST(2 AS INTEGER) AS n_errors FROM customer
    """
)
def validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of other types than settings want, and required fields that are missing."""
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        key.cast("string").alias("candidate_id"), key.cast("int").alias("a"), F.col("c_name").alias("b"), F.when(key % 2 != 0, F.col("c_name")).alias("d"),
        F.when(key % 3 != 0, F.struct(F.lit("x").alias("value"))).alias("c"),
    )
    wanted = [{"path": "a", "type": "string"}, {"path": "b", "type": "array"}, {"path": "c", "type": "string"}, {"path": "d", "required": True}, {"path": "e", "type": "array"}]
    whole = validation.validate(rows, {"fields": wanted, "on_missing": "omit"})
    told = validation.counts(whole).select("candidate_id", F.col("warnings_count").alias("n_warnings"), F.col("errors_count").alias("n_errors"))
    return whole.select("candidate_id", F.array_join("errors", ";").alias("errors")).join(told, "candidate_id")


@_query(
    f"""WITH {_PROFILES}
    SELECT candidate_id, CAST(1 AS INTEGER) AS full_name, CASE WHEN links IS NULL THEN 0 ELSE 1 END AS links, CASE WHEN years IS NULL THEN 0 ELSE 1 END AS years_experience,
           CAST(len(emails) AS INTEGER) AS emails, CAST(coalesce(len(phones), 0) AS INTEGER) AS phones, CAST(len(skills) AS INTEGER) AS skills FROM q
    """
)
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each profile holds."""
    found = reports.summary(customer_profiles(spark, sf_dir))
    return found.select("candidate_id", "full_name", "links", "years_experience", "emails", "phones", "skills")


@_query(
    f"""WITH {_STATED},
    shown AS (SELECT candidate_id, source, field, ord, CASE
                WHEN field = 'location' THEN {_part("raw", "city")} || ', ' || coalesce(nullif({_part("raw", "region")}, ''), 'None') || ', ' || {_part("raw", "country")}
                WHEN field = 'links' THEN 'github: ' || {_part("raw", "github")}
                WHEN field = 'experience' THEN {_part("raw", "company")} || ' - ' || {_part("raw", "title")}
                WHEN field = 'education' THEN {_part("raw", "institution")} ELSE raw END AS shown FROM stated)
    SELECT candidate_id, source, field, string_agg(shown, ';' ORDER BY ord) AS "values" FROM shown GROUP BY candidate_id, source, field
    """
)
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source states, field by field."""
    found = reports.extraction(gather(ship(spark), customer_sources(spark, sf_dir)))
    rows = found.select("candidate_id", "source", F.explode("report").alias("field", "listed"))
    return rows.select("candidate_id", "source", "field", F.array_join("listed", ";").alias("values"))


# matching


def _match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recruiter rows with their plain names and addresses."""
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("candidate_id"), F.col("c_name").alias("full_name"),
        F.concat(F.lit(" CUST"), F.col("c_custkey").cast("string"), F.lit("@x.org ")).alias("email"), F.col("c_custkey").alias("csv_ord"),
    )


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as résumés: known by address, by a part of a name, by a longer name, or not at all."""
    key = F.col("s_suppkey")
    number = F.lpad(key.cast("string"), 9, "0")
    name = F.when(key % 4 == 0, F.concat(F.lit("#"), number)).when(key % 4 == 1, F.concat(F.lit("Mr CUSTOMER#"), number, F.lit(" junior"))).when(key % 4 == 2, F.lit(""))
    emails = F.when(key % 4 == 2, F.array(F.lit("other@y.org"), F.concat(F.lit("Cust"), key.cast("string"), F.lit("@X.org")))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "supplier").select(F.concat(F.lit("cv-"), number, F.lit(".pdf")).alias("resume_path"), name.alias("name"), emails.alias("emails"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as web profiles: known by user name, by name, or not at all."""
    key = F.col("s_suppkey")
    number = F.lpad(key.cast("string"), 9, "0")
    user = F.when(key % 3 == 0, F.concat(F.lit("R#"), number)).otherwise(F.concat(F.lit("user"), number))
    name = F.when(key % 3 == 1, F.concat(F.lit(" customer#"), number, F.lit(" "))).when(key % 9 == 2, F.substring(number, 7, 3))
    return _table(spark, sf_dir, "supplier").select(user.alias("username"), name.alias("name"))


_MATCHED = """
    c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS row_name, 'cust' || c_custkey || '@x.org' AS row_email FROM customer),
    n AS (SELECT s_suppkey AS s, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS num FROM supplier),
    cv AS (SELECT s, 'cv-' || num || '.pdf' AS resume_path, CASE s % 4 WHEN 0 THEN '#' || num WHEN 1 THEN 'mr customer#' || num || ' junior' WHEN 2 THEN '' END AS name,
                  CASE WHEN s % 4 = 2 THEN 'cust' || s || '@x.org' END AS email FROM n),
    cv_hit AS (SELECT resume_path, min(c_custkey) AS hit FROM cv JOIN c ON (name <> '' AND (contains(row_name, name) OR contains(name, row_name))) OR row_email = email GROUP BY 1),
    gh AS (SELECT CASE WHEN s % 3 = 0 THEN 'R#' || num ELSE 'user' || num END AS username, CASE WHEN s % 3 = 1 THEN 'customer#' || num WHEN s % 9 = 2 THEN num[7:9] END AS name FROM n),
    gh_hit AS (SELECT username, min(c_custkey) AS hit FROM gh JOIN c ON (name <> '' AND (contains(row_name, name) OR contains(name, row_name))) OR contains(row_name, lower(username)) GROUP BY 1)
"""


@_query(f"WITH {_MATCHED} SELECT cv.resume_path, CAST(hit AS VARCHAR) AS candidate_id FROM cv LEFT JOIN cv_hit USING (resume_path)")
def theta_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that each résumé matches, by address or by names of which one contains the other."""
    return match.match_resumes(_resumes(spark, sf_dir), _match_rows(spark, sf_dir)).select("resume_path", "candidate_id")


@_query(f"WITH {_MATCHED} SELECT gh.username, CAST(hit AS VARCHAR) AS candidate_id FROM gh LEFT JOIN gh_hit USING (username)")
def match_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that each web profile matches, by names or by its user name."""
    return match.match_profiles(_profiles(spark, sf_dir), _match_rows(spark, sf_dir)).select("username", "candidate_id")


@_query(
    f"""WITH {_MATCHED},
    r AS (SELECT min_by(CAST(hit AS VARCHAR), resume_path) AS id FROM cv_hit), g AS (SELECT min_by(CAST(hit AS VARCHAR), username) AS id FROM gh_hit),
    o AS (SELECT min_by(id, c_custkey) AS id FROM c)
    SELECT 'all' AS given, coalesce(r.id, g.id, o.id) AS candidate_id FROM r, g, o UNION ALL SELECT 'profiles', coalesce(g.id, o.id) FROM g, o
    UNION ALL SELECT 'rows', id FROM o UNION ALL SELECT 'stated', '77'
    """
)
def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that a run for one is about: as stated, or as the first matched source suggests."""
    rows = _match_rows(spark, sf_dir)
    resumes, profiles = match.match_resumes(_resumes(spark, sf_dir), rows), match.match_profiles(_profiles(spark, sf_dir), rows)
    no_resumes, no_profiles = resumes.filter(F.lit(False)), profiles.filter(F.lit(False))
    asked = {
        "all": match.resolve_id("AUTO", resumes, profiles, rows),
        "profiles": match.resolve_id(None, no_resumes, profiles, rows),
        "rows": match.resolve_id("AUTO", no_resumes, no_profiles, rows),
        "stated": match.resolve_id("77", resumes, profiles, rows),
    }
    return reduce(DataFrame.unionByName, (one.select(F.lit(name).alias("given"), "candidate_id") for name, one in asked.items()))


# recruiter rows and web profiles


@_query("SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, 'customer  ' || lower(n_name) AS full_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def csv_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first recruiter row of each candidate."""
    return recruiter_csv.first_rows(recruiter_rows(spark, sf_dir)).select("candidate_id", F.trim("full_name").alias("full_name"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, CASE WHEN c_custkey % 10 = 0 THEN 'Unknown Name' ELSE c_name END AS name FROM customer")
def upload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate and name of every row of an upload."""
    rows = _match_rows(spark, sf_dir)
    return recruiter_csv.scan_upload(rows.withColumn("full_name", F.when(F.col("csv_ord") % 10 != 0, F.col("full_name")).otherwise(F.lit(""))))


@_query(
    """
    WITH r AS (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS language, ts, event_id FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM r),
    d AS (SELECT user_id, language, min(place) AS place FROM p WHERE place <= 15 AND language IS NOT NULL GROUP BY user_id, language)
    SELECT CAST(user_id AS VARCHAR) AS username, string_agg(language, ',' ORDER BY place) AS languages FROM d GROUP BY user_id
    """
)
def recent_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct languages of a user's fifteen latest repositories, as first seen."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    repos = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("username"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("language"), at.alias("updated_at")
    )
    return github_api.recent_languages(repos).select("username", F.array_join("languages", ",").alias("languages"))


@_query(
    """
    WITH g AS (SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT candidate_id, 'full_name' AS field, s_name AS shown, 0.85::DOUBLE AS conf, 'REST_GET_Profile' AS method FROM g
    UNION ALL SELECT candidate_id, 'location', 'city=''' || n_name || ''' region=None country=None', 0.85, 'REST_GET_Profile' FROM g WHERE k % 2 = 0
    UNION ALL SELECT candidate_id, 'links', 'linkedin=None github=''https://github.com/u' || k || ''' portfolio=None other=[]', 0.85, 'REST_GET_Profile' FROM g
    UNION ALL SELECT candidate_id, 'skills', l, 0.95, 'REST_GET_Repo_Language_Inference' FROM g, (SELECT unnest(['Go', 'Rust']) AS l) WHERE k % 3 = 0
    UNION ALL SELECT candidate_id, 'username', 'u' || k, 0.0, 'url' FROM g
    """
)
def web_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured profiles as evidence, and the user names of their addresses."""
    nation = _table(spark, sf_dir, "nation")
    joined = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    url = F.concat(F.lit("https://github.com/u"), key.cast("string"))
    captured = joined.select(
        key.cast("string").alias("candidate_id"), F.col("s_name").alias("name"), F.lit("").alias("bio"), F.when(key % 2 == 0, F.col("n_name")).alias("location"),
        url.alias("html_url"), F.when(key % 3 == 0, F.array(F.lit("Go"), F.lit("Rust"))).alias("languages"),
    )
    found = github_api.evidence(captured).select("candidate_id", "field", display(F.col("raw")).alias("shown"), F.col("base_conf").alias("conf"), "method")
    user = github_api.username(F.concat(F.col("html_url"), F.lit("/?tab=repositories")))
    return found.unionByName(captured.select("candidate_id", F.lit("username").alias("field"), user.alias("shown"), F.lit(0.0).alias("conf"), F.lit("url").alias("method")))


# résumés


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as résumé texts."""
    key = F.col("c_custkey").cast("string")
    plain = F.concat(
        F.initcap("c_mktsegment"), F.lit(" Person\n\ncust"), key, F.lit("@x.org | 415-555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"),
        F.lit(" | github.com/cust"), key, F.lit(" | linkedin.com/in/c"), key, F.lit("\nSenior "), F.lower("c_mktsegment"), F.lit(" engineer 7\nPorto Alegre, Rio Grande - 123456\n"),
        F.lit("Technical Skills\nPython, react & SQL; more\nWork Experience\n Acme"), key, F.lit(" - Builder Jan 2019 - Mar 2020\ndid things\n\nand others\n"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Beta | Tester Sep 2020 – Present\n")).otherwise(F.lit("")), F.lit("last line\nEducation\nX University - BSc\nno such place\nhigh school\n"),
    )
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("cv"), key, F.lit(".pdf")).alias("resume_path"), F.lit("Resume_PDF").alias("kind"), plain.alias("text"), key.alias("candidate_id"))


@_query(
    """
    WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS candidate_id, lower(c_mktsegment) AS seg FROM customer)
    SELECT candidate_id, 'full_name' AS field, upper(seg[1]) || seg[2:] || ' Person' AS raw FROM c
    UNION ALL SELECT candidate_id, 'links', 'linkedin=''linkedin.com/in/c' || k || ''' github=''github.com/cust' || k || ''' portfolio=None other=[]' FROM c
    UNION ALL SELECT candidate_id, 'headline', 'Senior ' || seg || ' engineer 7' FROM c
    UNION ALL SELECT candidate_id, 'location', 'city=''Porto Alegre'' region=''Rio Grande'' country=None' FROM c
    UNION ALL SELECT candidate_id, 'emails', 'cust' || k || '@x.org' FROM c
    UNION ALL SELECT candidate_id, 'phones', '415-555-' || lpad((k % 10000)::VARCHAR, 4, '0') FROM c
    UNION ALL SELECT candidate_id, 'skills', s FROM c, (SELECT unnest(['python', 'react', 'sql']) AS s)
    UNION ALL SELECT candidate_id, 'experience', 'company=''Acme' || k || ''' title=''Builder Jan 2019'' start=''Jan 2019'' end=''Mar 2020'' summary=''did things\\nand others'
              || CASE WHEN k % 2 = 0 THEN '' ELSE '\\nlast line' END || '''' FROM c
    UNION ALL SELECT candidate_id, 'experience', 'company=''Beta'' title=''Tester Sep 2020'' start=''Sep 2020'' end=''Present'' summary=''last line''' FROM c WHERE k % 2 = 0
    UNION ALL SELECT candidate_id, 'education', 'institution=''X University'' degree=''BSc'' field=None end_year=None' FROM c
    UNION ALL SELECT candidate_id, 'education', 'institution=''high school'' degree=None field=None end_year=None' FROM c
    """
)
def resume_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, names, addresses, links, places, skills, work and studies that the rules find in résumés."""
    found = resume_text.evidence(resume_text.parse(resume_texts(spark, sf_dir)))
    return found.select("candidate_id", "field", display(F.col("raw")).alias("raw"))


@_query(
    """
    WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
    b AS (SELECT *, sum(CASE WHEN event_type = 'error' OR place = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM l)
    SELECT user_id, CAST(block - 1 AS INTEGER) AS block, first(CASE WHEN event_type = 'error' THEN 'e' ELSE 'x' END || event_id ORDER BY event_id) AS head,
           CAST(count(*) AS INTEGER) AS n_lines FROM b GROUP BY user_id, block
    """
)
def blocks_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the lines of a résumé's work: a line with a date range begins a block."""
    event = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("e"), event, F.lit(" - Jan 2020 to Present"))).otherwise(F.concat(F.lit("x"), event))
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    texts = rows.select("user_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    blocks = texts.select("user_id", F.posexplode(resume_text.experience_blocks(F.col("text"))).alias("block", "b"))
    more = F.when(F.col("b.summary") == "", 0).otherwise(F.size(F.split("b.summary", "\n")))
    return blocks.select("user_id", "block", F.col("b.company").alias("head"), (more + 1).alias("n_lines"))


@_query(
    """
    SELECT p_partkey, p_name AS whole, lower(array_to_string(string_split(p_name, ' '), ' ')) AS joined FROM part
    """
)
def spaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that were extracted letter by letter, rejoined; plain ones stay."""
    parts = _table(spark, sf_dir, "part")
    letters = F.array_join(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.array_join(F.split(w, ""), " ")), "   ")
    return parts.select("p_partkey", resume_text.respace(F.col("p_name")).alias("whole"), resume_text.respace(letters).alias("joined"))


# sources of a run


@_query(
    """
    SELECT * FROM (VALUES (0, 0, 'CSV', 'a.csv'), (0, 1, 'CSV', 'b.csv'), (1, 0, 'GitHub', 'https://github.com/x'), (2, 0, 'PDF Resume', 'cv1.pdf'), (2, 2, 'PDF Resume', 'cv2.pdf'),
                   (3, 0, 'ATS', 'c.json')) AS t(kind_ord, part, kind, location)
    """
)
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources a run reads, in order."""
    found = manifest.discover(ship(spark), "a.csv, b.csv", "https://github.com/x", "cv1.pdf,,cv2.pdf", "c.json")
    return found.select("ord.kind_ord", "ord.part", "kind", "location")


@_query(
    """
    WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS id FROM supplier),
    told AS (
      SELECT id AS candidate_id, 'CSV:s.csv' AS source, 2 AS profile_ord FROM s
      UNION ALL SELECT CAST(k AS VARCHAR), 'Resume_PDF:' || CASE WHEN k % 3 = 0 THEN 'z' ELSE 'a' END || k, 0 FROM s WHERE k % 2 = 0
      UNION ALL SELECT id, 'GitHub_API_Live', 1 FROM s WHERE k % 5 = 0
      UNION ALL SELECT id, 'GitHub_API_Live', 4 FROM s WHERE k % 2 = 0 AND k % 5 <> 0 AND k % 4 = 0)
    SELECT candidate_id, source, profile_ord FROM told
    """
)
def attached_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which résumés and web profiles a run attaches to whom: the last of two résumés, matched profiles, and those that a résumé links to."""
    key = F.col("s_suppkey")
    number = F.concat(F.lit("q"), F.lpad(key.cast("string"), 6, "0"), F.lit("q"))
    base = _table(spark, sf_dir, "supplier").select(key, key.cast("string").alias("id"), number.alias("number"))
    blank = {c: F.lit(None).cast("string") for c in recruiter_csv.COLUMNS}
    told = blank | {"candidate_id": F.col("id"), "full_name": F.concat(F.lit("person "), F.col("number")), "email": F.concat(F.col("number"), F.lit("@x.org"))}
    rows = base.select(*(c.alias(n) for n, c in told.items()), F.lit("s.csv").alias("csv_path"), F.struct(F.lit(0).alias("file_ord"), F.col("s_suppkey").alias("line")).alias("csv_ord"))
    link = F.when(key % 4 == 0, F.concat(F.lit("\nhttps://github.com/u"), F.col("id"))).otherwise(F.lit(""))
    text = F.concat(F.lit("Someone Else\n"), F.col("number"), F.lit("@x.org"), link)
    paths = F.when(key % 3 == 0, F.array(F.concat(F.lit("b"), F.col("id")), F.concat(F.lit("z"), F.col("id")))).otherwise(F.array(F.concat(F.lit("a"), F.col("id"))))
    resumes = base.filter("s_suppkey % 2 = 0").select(F.explode(paths).alias("resume_path"), F.lit("Resume_PDF").alias("kind"), text.alias("text"))
    name = F.when(key % 5 == 0, F.concat(F.lit("Person "), F.col("number"))).otherwise(F.lit("nobody known"))
    nothing = F.lit(None).cast("string")
    web = base.select(
        F.concat(F.lit("u"), F.col("id")).alias("username"), name.alias("name"), nothing.alias("bio"), nothing.alias("location"),
        F.concat(F.lit("https://github.com/u"), F.col("id")).alias("html_url"), F.array().cast("array<string>").alias("languages"),
    )
    found = gather(ship(spark), Sources(csv=rows, resumes=resumes, github=web))
    return found.select("candidate_id", "source", "profile_ord").distinct()

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner, its confidence and its support for every customer, by the evidence engine."""
    origin = F.col("provenance")
    scored = confidence.score(voted_orders(spark, sf_dir))
    return scored.select(
        F.col("candidate_id").cast("long").alias("o_custkey"), F.col("value_key").alias("winner"), "score", "confidence",
        origin["agreement_count"].alias("agreement"), F.size(origin["rejected_sources"]).alias("rejected"),
    ).orderBy("o_custkey")
