"""``python -m veridra --config out.json --csv people.csv …`` prints one JSON object a candidate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import consolidate, reports
from .sources import ats_json, github_api, manifest, recruiter_csv, resume_text


def web_profiles(spark: SparkSession, given: str) -> DataFrame:
    """Captured profiles from JSON files, or live ones from a comma list of profile URLs."""
    if "github.com" not in given.lower():
        schema = "username string, name string, bio string, location string, html_url string, languages array<string>"
        return spark.read.schema(schema).json([p.strip() for p in given.split(",")])
    urls = [u.strip() for u in given.split(",")]
    listed = spark.createDataFrame(list(enumerate(urls)), "github_ord int, url string").select(
        "github_ord", github_api.username(F.col("url")).alias("username")
    )
    names = [r["username"] for r in listed.filter("username IS NOT NULL").orderBy("github_ord").collect()]
    spark.dataSource.register(github_api.GitHubProfiles)
    return spark.read.format("github_profiles").option("usernames", ",".join(names)).load()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veridra", description=__doc__)
    parser.add_argument("--config", required=True, help="output settings, a JSON file")
    parser.add_argument("--candidate_id", help="one candidate, or AUTO; all if absent")
    parser.add_argument("--csv", help="recruiter CSV files")
    parser.add_argument("--resume", help="résumé files")
    parser.add_argument("--github", help="captured profiles (JSON files) or profile URLs")
    parser.add_argument("--ats", help="applicant-tracking JSON files")
    parser.add_argument("--stages", help="folder for the run's stages")
    given = parser.parse_args(arguments)
    try:
        settings = manifest.load_settings(given.config)
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("veridra").getOrCreate()
    sources = consolidate.Sources(
        csv=recruiter_csv.read(spark, given.csv) if given.csv else None,
        ats=ats_json.read(spark, given.ats) if given.ats else None,
        github=web_profiles(spark, given.github) if given.github else None,
        resumes=resume_text.read(spark, given.resume) if given.resume else None,
    )
    run = consolidate.run(spark, sources, settings, given.candidate_id)
    if given.stages:
        reports.write_stages(run.stages(), given.stages)
    for row in run.payloads().orderBy("candidate_id").toLocalIterator():
        print(row["payload"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
