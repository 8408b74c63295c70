"""Codes, safe names, instants and evidence documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefix of a body's code, and what stands for separators in a file name.
CODE_PREFIX = "WB_DB_"
SEPARATORS, REPLACEMENT = "/\\", "__"
#: The fields of an analysis document that histories show, with their types; flags and evidence have defaults.
EVIDENCE = "turbidity double, chlorophyll double, anomaly_score double, anomaly_detected boolean, confidence double, evidence array<string>"


def body_code(body_id: Column) -> Column:
    """The code of a body in analyses and file names."""
    return F.concat(F.lit(CODE_PREFIX), body_id.cast("string"))


def safe_name(code: Column) -> Column:
    """A code without path separators."""
    return F.translate(code, SEPARATORS, REPLACEMENT)


def utc(text: Column) -> Column:
    """An ISO-8601 instant; one without an offset is UTC, whatever the session's time zone."""
    has_offset = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    return F.try_to_timestamp(F.when(has_offset, text).otherwise(F.concat(text, F.when(F.length(text) == 10, "T00:00:00Z").otherwise("Z"))))


def iso(instant: Column) -> Column:
    """An instant as ISO-8601 in UTC with an offset."""
    micros = F.unix_micros(instant)
    naive = F.timestamp_micros(micros)
    fraction = F.pmod(micros, F.lit(1_000_000))
    shown = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), naive.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(shown, F.when(fraction != 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def day_start(day: Column) -> Column:
    """A date as chosen in a form, from its first second; null and blank are no limit."""
    return F.when(F.trim(day) != "", F.to_timestamp_ntz(F.concat(F.trim(day), F.lit("T00:00:00"))))


def day_end(day: Column) -> Column:
    """A date as chosen in a form, up to its last second."""
    return F.when(F.trim(day) != "", F.to_timestamp_ntz(F.concat(F.trim(day), F.lit("T23:59:59"))))


def evidence(document: Column) -> dict[str, Column]:
    """The fields of a JSON analysis document by name: a key that is absent has its default, an explicit null stays null."""
    read = F.from_json(document, EVIDENCE)
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    found = {name: read[name] for name in ("turbidity", "chlorophyll", "anomaly_score", "confidence")}
    found["anomaly_detected"] = F.when(F.array_contains(keys, "anomaly_detected"), read["anomaly_detected"]).otherwise(F.lit(False))
    found["evidence"] = F.when(F.array_contains(keys, "evidence"), read["evidence"]).otherwise(F.array().cast("array<string>"))
    return found
