"""Names, slugs, dates and JSON access of capture catalogues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(text: Column, most: int = 80) -> Column:
    """One line, single blanks, at most `most` characters; null if nothing is left."""
    return F.nullif(F.trim(F.substr(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(1), F.lit(most))), F.lit(""))


def slug(text: Column, otherwise: Column) -> Column:
    """Letters, digits, - and _; all else becomes single dashes, none at the ends; a fallback if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{Nd}_-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^[-.]+|[-.]+$", ""), F.lit("")), otherwise)


def captured_at(directory: Column, modified: Column) -> Column:
    """The time in a folder's name, capture-<epoch milliseconds>, else when it was modified."""
    ms = F.regexp_extract(directory, r"capture-(\d{1,15})$", 1).try_cast("long")
    return F.coalesce(F.timestamp_millis(ms), modified)


def json_document(document: Column) -> Column:
    """A JSON document as a variant; null if it is none, or anything follows it: it must be all of a list of one."""
    alone = F.json_array_length(F.concat(F.lit("["), document, F.lit("]"))) == 1
    return F.when(alone, F.try_parse_json(document))


def json_number(document: Column, path: str) -> Column:
    """A number of a JSON document; null if there is none, or the document is none."""
    return F.try_variant_get(json_document(document), path, "double")


def finish_message(stored: Column, abandoned: Column, total: Column) -> Column:
    return (
        F.when(total == 0, F.lit("nothing to capture"))
        .when(stored == 0, F.lit("nothing was captured"))
        .when(abandoned > 0, F.format_string("%d of %d directions captured, %d given up", stored, total, abandoned))
        .otherwise(F.format_string("%d of %d directions captured", stored, total))
    )


def lens_line(front: Column, hfov: Column, directions: Column, tier: Column, physical: Column) -> Column:
    """One line to choose a lens by: how wide, how many stops, and what its numbers are worth."""
    width = F.when(front, "Front").when(hfov >= 95, "Ultrawide").when(hfov >= 60, "Wide").otherwise("Tele")
    worth = F.when(tier == "LINEAR_RAW", "RAW").when(tier == "MANUAL_YUV", "no RAW, relative values").otherwise("camera picks the exposure")
    caveat = F.when(physical, ", untested on this phone").otherwise("")
    return F.concat(F.format_string("%s, %.0f degrees, %d directions, %s", width, hfov, directions, worth), caveat)


def json_text(document: Column, path: str) -> Column:
    """A string of a JSON document, escapes undone; null if there is none, or anything follows the document."""
    return F.try_variant_get(json_document(document), path, "string")
