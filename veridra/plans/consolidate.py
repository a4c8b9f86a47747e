"""Whole runs: from sources to validated output, all candidates in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, confidence, match, merge, normalize, profile, rules
from ..schema import EVIDENCE
from ..session import ship
from ..sources import ats_json, github_api, recruiter_csv, resume_text
from . import projection, reports, validation


@dataclass
class Sources:
    """What a run reads; any may be absent.

    ``github`` holds username, name, bio, location, html_url and languages of
    captured profiles, ``resumes`` resume_path, kind and text.
    """

    csv: DataFrame | None = None
    ats: DataFrame | None = None
    github: DataFrame | None = None
    resumes: DataFrame | None = None


@dataclass
class Run:
    """The stages of a run, each a lazy table."""

    extracted: DataFrame
    normalized: DataFrame
    merged: DataFrame
    scored: DataFrame
    profiles: DataFrame
    projected: DataFrame
    validated: DataFrame
    settings: dict = field(default_factory=dict)
    sources: Sources = field(default_factory=Sources)

    def payloads(self) -> DataFrame:
        return projection.payload(self.projected, self.settings)

    def extraction_report(self) -> DataFrame:
        return reports.extraction(self.extracted)

    def report(self) -> DataFrame:
        return reports.run_report(self.profiles, self.validated)

    def stages(self) -> dict[str, DataFrame]:
        """What was given, each step of the run, and the report on it."""
        given = {f"uploaded_{name}": getattr(self.sources, name) for name in reports.UPLOADS if getattr(self.sources, name) is not None}
        if "uploaded_ats" in given:  # as text: a column format need not know VARIANT
            given["uploaded_ats"] = given["uploaded_ats"].withColumn("ats", F.to_json("ats"))
        return given | {name: getattr(self, name) for name in reports.STAGES} | {"report": self.report()}


def gather(spark: SparkSession, sources: Sources, candidate_id: str | None = None, resumes_need_csv: bool = True, every: bool = True) -> DataFrame:
    """Evidence of all candidates, or of the one that ``candidate_id`` resolves to.

    Résumés and web profiles belong to the CSV row that they match first; of several
    résumés for one candidate the last counts. A single web profile that matches
    nothing goes to the single candidate of a run for one. Web profiles that a used
    résumé links to are added where a candidate has none.
    """
    ship(spark)
    parts: list[DataFrame] = []
    rows = sources.csv
    candidates = recruiter_csv.first_rows(rows).select("candidate_id") if rows is not None else None
    parsed = matched_github = None
    if sources.resumes is not None:
        parsed = resume_text.parse(sources.resumes)
        if rows is not None:
            parsed = match.match_resumes(parsed, rows)
        elif not resumes_need_csv:
            parsed = parsed.withColumn("candidate_id", F.lit(candidate_id) if candidate_id else F.col("resume_path"))
        else:
            parsed = None
    if sources.github is not None:
        if rows is not None:
            matched_github = match.match_profiles(sources.github, rows)
        else:
            matched_github = sources.github.withColumn("candidate_id", F.lit(None).cast("string"))
    one = None
    if not every:
        if rows is not None and (not candidate_id or candidate_id == "AUTO"):
            nothing = spark.createDataFrame([], "candidate_id string, resume_path string, username string")
            one = match.resolve_id(candidate_id, nothing if parsed is None else parsed, nothing if matched_github is None else matched_github, rows)
        else:
            one = spark.createDataFrame([(candidate_id,)], "candidate_id string")
        one = F.broadcast(one)  # one row
        candidates = one if candidates is None else candidates.join(one, "candidate_id", "left_semi")

    def chosen(frame: DataFrame) -> DataFrame:
        return frame if one is None else frame.join(one, "candidate_id", "left_semi")

    if parsed is not None:
        last = parsed.filter("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.max_by(F.struct(*parsed.columns), match.place_of(parsed)).alias("r"))
        parsed = chosen(last.select("r.*"))
        parts.append(resume_text.evidence(parsed))
    if matched_github is not None:
        used = matched_github.filter("candidate_id IS NOT NULL").groupBy("candidate_id")
        used = chosen(used.agg(F.max_by(F.struct(*matched_github.columns), match.place_of(matched_github)).alias("g")).select("g.*"))
        if one is not None:
            only = matched_github.agg(F.count("*").alias("n")).filter("n = 1")
            lone = matched_github.crossJoin(F.broadcast(only)).drop("n", "candidate_id").crossJoin(one)  # one row each
            lone = lone.join(used.select("candidate_id"), "candidate_id", "left_anti")
            used = used.unionByName(lone.select(*used.columns))
        parts.append(github_api.evidence(used))
        if parsed is not None:
            linked = parsed.select("candidate_id", F.lower(github_api.username(F.col("links.github"))).alias("user"))
            linked = linked.filter("user IS NOT NULL").join(used.select("candidate_id"), "candidate_id", "left_anti")
            known = matched_github.drop("candidate_id").withColumn("user", F.lower("username"))
            parts.append(github_api.evidence(linked.join(known, "user"), discovered=True))
    if rows is not None:
        parts.append(recruiter_csv.evidence(chosen(rows)))
    if sources.ats is not None:
        parts.append(ats_json.evidence(ats_json.for_candidates(sources.ats, candidates)))
    if not parts:
        return spark.createDataFrame([], EVIDENCE)
    return reduce(DataFrame.unionByName, parts)


def consolidate(evidence: DataFrame, timestamp: str | None = None, default_region: str = "US") -> tuple[DataFrame, DataFrame, DataFrame]:
    """normalized, merged and scored tables of an evidence table."""
    ship(evidence.sparkSession)
    normalized = merge.with_value(cluster.order(normalize.normalize(evidence, default_region)))
    merged = merge.vote(cluster.cluster(normalized), timestamp)
    return normalized, merged, confidence.score(merged)


def run(spark: SparkSession, sources: Sources, settings: dict | None = None, candidate_id: str | None = None, *, every: bool | None = None, resumes_need_csv: bool = True, default_region: str = "US") -> Run:
    """Consolidate and project all candidates, or one (``candidate_id``, ``AUTO`` for the first that sources suggest)."""
    settings = projection.with_defaults(settings or {})
    every = candidate_id is None if every is None else every
    extracted = gather(spark, sources, candidate_id, resumes_need_csv, every)
    now = datetime.now(timezone.utc).isoformat()
    normalized, merged, scored = consolidate(extracted, now, default_region)
    profiles = rules.apply(profile.assemble(scored), settings.get("business_rules") or {})
    projected = projection.project(profiles, settings)
    return Run(extracted, normalized, merged, scored, profiles, projected, validation.validate(projected, settings), settings, sources)


def reproject(profiles: DataFrame, settings: dict) -> DataFrame:
    """Validated output from stored profiles; nothing is extracted or merged."""
    return validation.validate(projection.reproject(profiles, settings), settings)
