"""Validation of projected rows: required fields, types, and forms of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contact import E164, EMAIL
from .projection import with_defaults

_TYPE_NAMES = {T.IntegerType: "int", T.LongType: "int", T.DoubleType: "float", T.BooleanType: "bool", T.ArrayType: "list", T.StructType: "dict"}


def _bare(column: Column, kind: T.DataType) -> Typed:
    """A value without its wrapper."""
    if isinstance(kind, T.StructType) and "value" in kind.names:
        return column["value"], kind["value"].dataType
    return column, kind


Typed = tuple[Column, T.DataType]


def _type_name(kind: T.DataType) -> str:
    return _TYPE_NAMES.get(type(kind), "str")


def _messages(column: Column, bad: Column, before: str, after: str) -> Column:
    return F.when(bad, F.concat(F.lit(before), column, F.lit(after)))


def validate(projected: DataFrame, settings: dict) -> DataFrame:
    """``projected`` with ``is_valid``, ``errors`` and ``warnings``.

    Types are known when the plan is built; the rest is judged row by row. The wording of
    errors and warnings, here and below, is of fixed values.
    """
    settings = with_defaults(settings)
    schema, on_missing = projected.schema, settings["on_missing"]
    errors: list[Column] = []
    warnings: list[Column] = []
    for definition in settings["fields"]:
        path, wanted = definition["path"], definition.get("type", "string")
        if path not in schema.names:
            continue
        column, kind = F.col(f"`{path}`"), schema[path].dataType
        missing = column.isNull() | (F.size(column) == 0) if isinstance(kind, T.ArrayType) else column.isNull()
        if definition.get("required"):
            if on_missing == "error":
                fail = F.raise_error(F.lit(f"Post-Projection Validation Error: Required field '{path}' is missing."))
                errors.append(F.when(missing, fail.cast("string")))
            else:
                what = "has been omitted" if on_missing == "omit" else "has been set to null"
                warnings.append(F.when(missing, F.lit(f"Required field '{path}' was missing and {what}.")))
        _, bare = _bare(column, kind)
        wrong = {
            "string": not isinstance(bare, T.StringType),
            "array": not isinstance(kind, T.ArrayType),
            "object": not isinstance(kind, T.StructType),
        }.get(wanted, False)
        if wrong:
            shown = bare if wanted == "string" else kind
            errors.append(F.when(~missing, F.lit(f"Schema Mismatch: Field '{path}' expected {wanted}, got {_type_name(shown)}")))

    def each(keys: tuple[str, ...], list_key: str, pattern: str, texts: tuple[str, str, str], into: list) -> list[Column]:
        found = []
        for key in keys:
            if key in schema.names:
                value, kind = _bare(F.col(key), schema[key].dataType)
                if not isinstance(kind, T.ArrayType | T.StructType):
                    value = value.cast("string")
                    into.append(_messages(value, (value != "") & ~value.rlike(pattern), texts[0], texts[2]))
        if list_key in schema.names and isinstance(schema[list_key].dataType, T.ArrayType):
            kind = schema[list_key].dataType.elementType

            def judged(item: Column) -> Column:
                value = _bare(item, kind)[0].cast("string")
                return _messages(value, (value != "") & ~value.rlike(pattern), texts[1], texts[2])

            found.append(F.coalesce(F.array_compact(F.transform(list_key, judged)), F.array().cast("array<string>")))
        return found

    email_texts = ("Email Syntax Error: '", "Email List Syntax Error: '", "' is not a valid email address.")
    phone_texts = ("Phone Format Warning: '", "Phone List Format Warning: '", "' does not comply with international E164 format.")
    listed_errors = each(("primary_email", "email"), "emails", EMAIL, email_texts, errors)
    listed_warnings = each(("primary_phone", "phone"), "phones", E164, phone_texts, warnings)
    last: list[Column] = []
    if "location" in schema.names:
        place, kind = _bare(F.col("location"), schema["location"].dataType)
        if isinstance(kind, T.StructType) and "country" in kind.names:
            country = place["country"]
            odd = (country != "") & (F.length(country) != 2)
            last.append(
                _messages(country, odd, "ISO Country Code Warning: Location country '", "' is not a standard ISO-3166 2-character code.")
            )

    def together(single: list[Column], listed: list[Column], after: list[Column] = ()) -> Column:
        empty = F.array().cast("array<string>")
        heads = F.array_compact(F.array(*single)) if single else empty
        return F.concat(heads, *listed, *([F.array_compact(F.array(*after))] if after else []))

    told = projected.withColumns({"errors": together(errors, listed_errors), "warnings": together(warnings, listed_warnings, last)})
    return told.withColumn("is_valid", F.size("errors") == 0)


def counts(validated: DataFrame) -> DataFrame:
    """candidate_id with the numbers of its errors and warnings."""
    return validated.select("candidate_id", F.size("errors").alias("errors_count"), F.size("warnings").alias("warnings_count"), "is_valid")
