"""Projection of profiles to an output that settings describe.

Settings are compiled into a select list, so unused parts of a profile are pruned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.country import full_name
from ..schema import ARRAYS, SCALARS

_STEP = re.compile(r"([^\[\]]+)(?:\[(-?\d+)\])?")
COMPUTED = {"calculate_experience_count": "experience", "calculate_skills_count": "skills"}

Typed = tuple[Column, T.DataType]


def _is_tracked(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"value", "provenance"} <= set(kind.names)


def path_of(schema: T.StructType, path: str) -> Typed | None:
    """Column and type at a dotted path; None where there is no such part.

    A tracked field is stepped into when more of the path follows. ``name[i]``
    reads an element; -1 the last one.
    """
    at: Typed | None = None
    kind: T.DataType = schema
    for part in path.split("."):
        if _is_tracked(kind):
            at, kind = (at[0]["value"], kind["value"].dataType), kind["value"].dataType
        found = _STEP.fullmatch(part)
        if not found or not isinstance(kind, T.StructType) or found[1] not in kind.names:
            return None
        kind = kind[found[1]].dataType
        column = F.col(found[1]) if at is None else at[0][found[1]]
        if found[2] is not None:
            if not isinstance(kind, T.ArrayType):
                return None
            index = int(found[2])
            column = F.get(column, F.lit(index)) if index >= 0 else F.get(column, F.size(column) + index)
            kind = kind.elementType
        at = (column, kind)
    return at


def _wrapped(value: Column, origin: Column, settings: dict) -> Column:
    """A value with what the settings want beside it, or bare."""
    beside = []
    if settings["include_confidence"]:
        beside.append(origin["confidence"].alias("confidence"))
    if settings["include_provenance"]:
        beside.append(origin.alias("provenance"))
    return F.struct(value.alias("value"), *beside) if beside else value


def _formatted(field: Column, kind: T.DataType, key: str, settings: dict) -> Column:
    listed = isinstance(kind, T.ArrayType) and _is_tracked(kind.elementType)
    if key == "skills" and listed:
        return F.transform(
            field,
            lambda s: F.struct(
                s["value"].alias("name"), s["provenance"]["confidence"].alias("confidence"), s["provenance"]["supporting_sources"].alias("sources")
            ),
        )
    if key in ("emails", "phones") and listed:
        return F.transform(field, lambda s: F.struct(s["value"].alias("value"), s["provenance"]["confidence"].alias("confidence")))
    if key in ("experience", "education") and listed:
        return F.transform(field, lambda s: s["value"])
    if key in ("location", "links", "headline", "years_experience") and _is_tracked(kind):
        return field["value"]
    if listed:
        return F.transform(field, lambda s: _wrapped(s["value"], s["provenance"], settings))
    if _is_tracked(kind):
        return F.when(field.isNotNull(), _wrapped(field["value"], field["provenance"], settings))
    return field


def provenance_list() -> Column:
    """field, source and method of every field, scalars first."""

    def short(name: str, origin: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), origin["source"].alias("source"), origin["method"].alias("method"))

    scalars = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), short(f, F.col(f)["provenance"])) for f in SCALARS)))
    return F.concat(scalars, *(_shorts(f, short) for f in ARRAYS))


def _shorts(field: str, short) -> Column:
    return F.transform(field, lambda x: short(field, x["provenance"]))


def with_defaults(settings: dict) -> dict:
    return {"fields": [], "include_confidence": True, "include_provenance": True, "on_missing": "null"} | settings


def _is_missing(column: Column, kind: T.DataType) -> Column:
    return column.isNull() | (F.size(column) == 0) if isinstance(kind, T.ArrayType) else column.isNull()


def project(profiles: DataFrame, settings: dict, instead: dict[str, Column] | None = None) -> DataFrame:
    """candidate_id, one column for each output field, provenance, overall_confidence.

    A required field that a candidate lacks fails the query under ``on_missing:
    error``. A missing array is empty under ``null``, other missing values are null;
    ``omit`` leaves fields out of ``payload`` and nulls them here. ``instead`` holds
    columns that take the place of output fields.
    """
    settings = with_defaults(settings)
    columns = []
    for definition in settings["fields"]:
        key = definition["path"]
        if "computed" in definition:
            counted = COMPUTED.get(definition["computed"])
            column, kind = (F.size(counted), T.IntegerType()) if counted else (F.lit(None).cast("int"), T.IntegerType())
        else:
            column, kind = path_of(profiles.schema, definition.get("from", key)) or (F.lit(None).cast("string"), T.StringType())
        missing = _is_missing(column, kind)
        shown = _formatted(column, kind, key, settings)
        if definition.get("required") and settings["on_missing"] == "error":
            shown = F.when(missing, F.raise_error(F.lit(f"Validation Error: Required field '{key}' is missing."))).otherwise(shown)
        elif key in ARRAYS and isinstance(kind, T.ArrayType) and settings["on_missing"] != "omit":
            shown = F.when(missing, F.slice(shown, 1, 0)).otherwise(shown)
            shown = F.coalesce(shown, F.array())
        else:
            shown = F.when(~missing, shown)
        columns.append((instead or {}).get(key, shown).alias(key))
    return profiles.select("candidate_id", *columns, provenance_list().alias("provenance"), "overall_confidence")


def reproject(profiles: DataFrame, settings: dict) -> DataFrame:
    """``project`` with the output options ``phone_norm``, ``skills_norm``, ``country_norm`` and ``dates_norm``."""
    settings = with_defaults(settings)
    keys = {d["path"] for d in settings["fields"]}
    raw = {}
    for key, option, value in (("phones", "phone_norm", "Raw"), ("skills", "skills_norm", "Original")):
        if settings.get(option) == value and key in keys:
            raw[key] = F.transform(key, lambda s: _wrapped(s["raw_value"], s["provenance"], settings))
    done = project(profiles, settings, raw)
    changes = {}
    if settings.get("country_norm") == "Full" and "location" in keys and _has(done, "location", "country"):
        changes["location"] = F.col("location").withField("country", full_name(F.col("location.country")))
    if settings.get("dates_norm") == "DD/MM/YYYY":
        if "experience" in keys:
            changes["experience"] = F.transform(
                "experience", lambda e: e.withField("start", _first_of_month(e["start"])).withField("end", _first_of_month(e["end"]))
            )
        if "education" in keys:
            changes["education"] = F.transform("education", lambda e: e.withField("end_year", _first_of_year(e["end_year"])))
    return done.withColumns(changes) if changes else done


def _has(frame: DataFrame, column: str, part: str) -> bool:
    kind = frame.schema[column].dataType
    return isinstance(kind, T.StructType) and part in kind.names


def _first_of_month(month: Column) -> Column:
    dated = (F.length(month) == 7) & F.contains(month, F.lit("-"))
    return F.when(dated, F.concat(F.lit("01/"), F.element_at(F.split(month, "-"), 2), F.lit("/"), F.split(month, "-")[0])).otherwise(month)


def _first_of_year(year: Column) -> Column:
    return F.when(F.length(year) == 4, F.concat(F.lit("01/01/"), year)).otherwise(year)


def payload(projected: DataFrame, settings: dict) -> DataFrame:
    """candidate_id and the output as a JSON text.

    Under ``omit`` a missing field is left out; otherwise it is an explicit null.
    """
    settings = with_defaults(settings)
    keys = [c for c in projected.columns if c != "candidate_id"]
    omit = settings["on_missing"] == "omit"
    parts = []
    for key in keys:
        kind = projected.schema[key].dataType
        missing = _is_missing(F.col(f"`{key}`"), kind)
        inner = F.to_json(F.struct(F.col(f"`{key}`").alias("v")), {"ignoreNullFields": "false"})
        text = F.concat(F.to_json(F.struct(F.lit(key).alias("k"))).substr(F.lit(6), F.lit(len(key) + 2)), F.lit(":"), inner.substr(F.lit(6), F.length(inner) - 6))
        parts.append(F.when(~missing, text) if omit else text)
    return projected.select("candidate_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("payload"))
