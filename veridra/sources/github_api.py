"""Captured GitHub API responses, and a batch data source that fetches them."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_given, strip
from ..schema import CONFIDENCE, LINKS, LOCATION, PROFILE_ORDER, item, items, rows_of

RECENT_REPOS, TIMEOUT = 15, 5.0


def username(url: Column) -> Column:
    """Last path segment of a profile URL; null where it is not one."""
    parts = F.filter(F.split(F.regexp_replace(strip(url), r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.contains(F.lower(url), F.lit("github.com")), F.element_at(parts, -1))


def recent_languages(repos: DataFrame, limit: int = RECENT_REPOS) -> DataFrame:
    """username, languages: distinct languages of the latest repositories, as first seen.

    ``repos`` holds username, language and updated_at.
    """
    from pyspark.sql.window import Window

    latest = Window.partitionBy("username").orderBy(F.desc("updated_at"), "language")
    recent = repos.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= limit)
    seen = recent.filter("language IS NOT NULL").groupBy("username", "language").agg(F.min("place").alias("place"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "language")))
    return seen.groupBy("username").agg(F.transform(ordered, lambda s: s["language"]).alias("languages"))


def evidence(profiles: DataFrame, discovered: bool = False) -> DataFrame:
    """From candidate_id, name, bio, location, html_url and languages."""

    def text(field: str, name: str) -> Column:
        return item(field, strip(F.col(name)), is_given(F.col(name)))

    nothing = F.lit(None).cast("string")
    place = F.struct(strip(F.col("location")).alias("city"), nothing.alias("region"), nothing.alias("country")).cast(LOCATION)
    links = F.struct(nothing.alias("linkedin"), F.col("html_url").alias("github"), nothing.alias("portfolio"), F.array().alias("other"))
    singles = F.array(
        text("full_name", "name"),
        text("headline", "bio"),
        item("location", place, is_given(F.col("location"))),
        item("links", links.cast(LINKS), is_given(F.col("html_url"))),
    )
    skills = items("skills", F.col("languages"), "REST_GET_Repo_Language_Inference", CONFIDENCE["github_repos"])
    return rows_of(
        profiles,
        F.concat(singles, skills),
        source=F.lit("GitHub_API_Live"),
        method=F.lit("REST_GET_Profile"),
        confidence=F.lit(CONFIDENCE["github"]),
        profile_ord=F.lit(PROFILE_ORDER["discovered_github" if discovered else "github"]),
    )


class _User(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.names = [n for n in options.get("usernames", "").split(",") if n]
        self.base = options.get("endpoint", "https://api.github.com")

    def partitions(self) -> list[InputPartition]:
        return [_User(n) for n in self.names]

    def _fetch(self, path: str):
        try:
            with urllib.request.urlopen(f"{self.base}{path}", timeout=TIMEOUT) as answer:
                return json.load(answer) if answer.status == 200 else None
        except (OSError, ValueError):
            return None

    def read(self, partition: _User) -> Iterator[tuple]:
        user = self._fetch(f"/users/{partition.name}")
        if user:
            repos = self._fetch(f"/users/{partition.name}/repos?sort=updated&per_page={RECENT_REPOS}&type=owner") or []
            languages = list(dict.fromkeys(r["language"] for r in repos if r.get("language")))
            yield (partition.name, user.get("name"), user.get("bio"), user.get("location"), user.get("html_url"), languages)


class GitHubProfiles(DataSource):
    """``spark.read.format("github_profiles").option("usernames", "a,b").load()``.

    One partition per profile; a profile that cannot be fetched yields no row.
    """

    @classmethod
    def name(cls) -> str:
        return "github_profiles"

    def schema(self) -> str:
        return "username string, name string, bio string, location string, html_url string, languages array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
