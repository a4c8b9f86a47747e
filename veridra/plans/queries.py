"""Queries that show the engine's functions on the driver's tables, with equal SQL.

Those that run its operators on evidence are in ``evidence_queries``; every query runs
over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, fuzzy, text
from ..functions.country import full_name, to_alpha2
from ..operators import cluster, normalize
from ..session import ship
from ..sources import recruiter_csv, resume_text
from . import evidence_queries

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


# scans


@_query(
    """
    SELECT s_suppkey, string_split(t, ', ')[1] AS city,
           CASE WHEN len(string_split(t, ', ')) >= 3 THEN string_split(t, ', ')[2] END AS region,
           CASE WHEN len(string_split(t, ', ')) >= 3 THEN string_split(t, ', ')[3]
                WHEN len(string_split(t, ', ')) = 2 THEN string_split(t, ', ')[2] END AS country
    FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ', ' || r_name || ', ' || n_name
                                 WHEN 1 THEN s_name || ', ' || n_name ELSE s_name END AS t
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    """
)
def csv_split_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one to three parts, made from suppliers and their nations."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    places = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    shape = F.col("s_suppkey") % 3
    joined = F.when(shape == 0, F.concat_ws(", ", "s_name", "r_name", "n_name")).when(shape == 1, F.concat_ws(", ", "s_name", "n_name"))
    located = places.select("s_suppkey", recruiter_csv.split_location(F.coalesce(joined, F.col("s_name"))).alias("place"))
    return located.select("s_suppkey", "place.city", "place.region", "place.country")


@_query(
    """
    SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w AS skill
    FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', '|'), '|')) AS w,
                 generate_subscripts(string_split(replace(p_name, ' ', '|'), '|'), 1) AS i FROM part)
    """
)
def split_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, written as a list with bars."""
    parts = _table(spark, sf_dir, "part").withColumn("listed", F.replace("p_name", F.lit(" "), F.lit("|")))
    return parts.select("p_partkey", F.posexplode(recruiter_csv.split_skills(F.col("listed"))).alias("place", "skill"))


@_query(
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number
    FROM events
    """
)
def json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member of a JSON object, as text and as a number where it is one."""
    parsed = _table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    k = F.try_variant_get("v", "$.k", "string")
    return parsed.select("event_id", k.alias("k_text"), k.try_cast("double").alias("k_number"))


# scalar functions


@_query(
    r"""
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' O-Sons Co.' AS name,
           lower(trim(p_name)) || ' & o-s2ons co.' AS folded FROM part
    """
)
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without signs, digits and surplus space, in title case; and folded for comparison."""
    shown = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" & o-s2ons\tco. "))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", normalize.normalize_name(shown).alias("name"), F.replace(text.fold_key(shown), F.lit("\t"), F.lit(" ")).alias("folded")
    )


@_query(
    r"""
    SELECT doc_id, CAST(len(e) AS INTEGER) AS n_emails, array_to_string(list_sort(list_transform(e, lambda x: lower(x))), ',') AS emails
    FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]*[a-zA-Z0-9]') AS e FROM documents WHERE text IS NOT NULL)
    """
)
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found in documents, normalised."""
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("e", contact.extract_emails(F.col("text")))
    return docs.select("doc_id", F.size("e").alias("n_emails"), F.array_join(F.array_sort(F.transform("e", normalize.normalize_email)), ",").alias("emails"))


@_query(
    r"""
    SELECT doc_id, array_to_string(regexp_extract_all(text, '\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+?\d{2}[-.\s]?\d{10}|\b\d{10}\b'), ';') AS phones
    FROM documents WHERE text IS NOT NULL
    """
)
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(contact.extract_phones(F.col("text")), ";").alias("phones"))


@_query(
    r"""
    SELECT kind, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(v, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+')) AS n_email,
           count(*) FILTER (WHERE regexp_full_match(v, '\+[1-9]\d{1,14}')) AS n_e164
    FROM (SELECT 'name' AS kind, c_name AS v FROM customer UNION ALL SELECT 'mail', lower(c_name) || '@x.org' FROM customer
          UNION ALL SELECT 'mail', replace(lower(c_name), '#', '.') || '@x.org' FROM customer
          UNION ALL SELECT 'phone', '+1' || CAST(4150000000 + c_custkey AS VARCHAR) FROM customer
          UNION ALL SELECT 'phone', '0' || CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY kind
    """
)
def contact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers by whether their form is valid."""
    c = _table(spark, sf_dir, "customer")
    made = [("name", F.col("c_name")), ("mail", F.concat(F.lower("c_name"), F.lit("@x.org")))]
    made += [("mail", F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@x.org")))]
    made += [("phone", F.concat(F.lit("+1"), (F.lit(4150000000) + F.col("c_custkey")).cast("string"))), ("phone", F.concat(F.lit("0"), F.col("c_custkey").cast("string")))]
    rows = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in made))).alias("r")).select("r.*")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if(contact.is_email(F.col("v"))).alias("n_email"),
        F.count_if(contact.is_e164(F.col("v"))).alias("n_e164"),
    )


@_query(
    """
    SELECT c_custkey, '+1' || CAST(2000000000 + c_custkey AS VARCHAR) AS phone FROM customer
    """
)
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National numbers in brackets and dashes, brought into E.164 form."""
    digits = (F.lit(2000000000) + F.col("c_custkey")).cast("string")
    shown = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))
    return _table(spark, sf_dir, "customer").select("c_custkey", contact.to_e164(shown).alias("phone"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates shown in three forms, brought to year and month."""
    day = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd"))
    shown = F.coalesce(shown, F.date_format(day, "MM/yyyy"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", contact.to_month(shown).alias("month"))


@_query(
    """
    SELECT n_nationkey, coalesce(code, n_name) AS code,
           coalesce(CASE code WHEN 'US' THEN 'United States' WHEN 'IN' THEN 'India' WHEN 'CA' THEN 'Canada' WHEN 'GB' THEN 'United Kingdom' END, coalesce(code, n_name)) AS name
    FROM (SELECT n_nationkey, n_name, CASE upper(n_name) WHEN 'UNITED STATES' THEN 'US' WHEN 'INDIA' THEN 'IN' WHEN 'CANADA' THEN 'CA'
          WHEN 'UNITED KINGDOM' THEN 'GB' WHEN 'GERMANY' THEN 'DE' WHEN 'FRANCE' THEN 'FR' WHEN 'JAPAN' THEN 'JP' WHEN 'CHINA' THEN 'CN'
          WHEN 'BRAZIL' THEN 'BR' END AS code FROM nation)
    """
)
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").withColumn("code", to_alpha2(F.col("n_name")))
    return nations.select("n_nationkey", "code", full_name(F.col("code")).alias("name"))


_SKILLS = ("red", "small", "large", "steel", "green", "blue")


@_query(
    "SELECT p_partkey, concat_ws(','"
    + "".join(f", CASE WHEN regexp_matches(lower(p_name), '\\b{s}\\b') THEN '{s}' END" for s in _SKILLS)
    + ") AS skills FROM part"
)
def skill_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of a list stand in part names."""
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(resume_text.find_skills(F.col("p_name"), _SKILLS), ",").alias("skills"))


@_query()
def fuzzy_skill_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as skills: alias, near match or title case."""
    words = _table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("skill_key"))
    return normalize.skill_table(words)


@_query()
def leader_cluster_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of each brand and size, clustered by fuzzy score against the first."""
    parts = _table(spark, sf_dir, "part").withColumn("grp", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))
    names = parts.groupBy("grp", F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    groups = names.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("first", "name"))).alias("g"))
    keyed = groups.withColumn("heads", fuzzy.leaders(F.transform("g", lambda x: F.array(x["name"])), cluster.FUZZY_SCORE))
    rows = keyed.select("grp", F.explode(F.arrays_zip("g", "heads")).alias("z"), "g")
    return rows.select("grp", F.col("z.g.name").alias("name"), F.get("g", F.col("z.heads"))["name"].alias("leader"))


_HEADERS = r"\b(technical\s+skills|skills|work\s+experience|professional\s+experience|experience|academic\s+history|education|projects|achievements|awards|certifications|licenses)\b"


@_query(
    f"""
    WITH m AS (SELECT doc_id, text, list_transform(regexp_extract_all(lower(text), '{_HEADERS}'), lambda x: string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')[-1]) AS hits
               FROM documents)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_concat(['header'], list_transform(hits, lambda h:
               CASE h WHEN 'history' THEN 'education' WHEN 'awards' THEN 'achievements' WHEN 'licenses' THEN 'certifications' ELSE h END)))), ',') END AS labels,
           CAST(length(regexp_replace(text, '(?is){_HEADERS}.*$', '')) AS INTEGER) AS header_chars FROM m
    """
)
def section_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by header words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", resume_text.segment(F.col("text")).alias("s"))
    return docs.select("doc_id", F.array_join(F.array_sort(F.map_keys("s")), ",").alias("labels"), F.length(F.try_element_at("s", F.lit("header"))).alias("header_chars"))


@_query()
def resume_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the résumé rules find in documents."""
    docs = _table(spark, sf_dir, "documents")
    parsed = resume_text.parse(docs.select(F.col("doc_id").cast("string").alias("resume_path"), F.lit("Resume_PDF").alias("kind"), "text"))
    return parsed.select(
        F.col("resume_path").cast("long").alias("doc_id"), "name", "headline", F.size("emails").alias("n_emails"), F.size("phones").alias("n_phones"),
        F.array_join("skills", ",").alias("skills"), F.size("experience").alias("n_experience"),
    )


QUERIES |= evidence_queries.QUERIES
ORACLE_SQL |= evidence_queries.ORACLE_SQL
flagship = evidence_queries.flagship
