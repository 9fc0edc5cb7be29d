"""Names and numbers as text: file names, video attributes, fixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def simple_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def video_attributes(name: Column) -> Column:
    """``struct(length, resolution)`` from a name split at underscores: token 1 is the length; the
    resolution is token 2 of 30-second videos, else token 3. What is absent is null."""
    parts = F.split(name, "_")
    length = F.try_element_at(parts, F.lit(2)).try_cast("int")
    resolution = F.when(length == 30, F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(parts, F.lit(4)))
    return F.struct(length.alias("length"), resolution.alias("resolution"))


def seconds_text(x: Column) -> Column:
    """Four decimals, as in run metrics; null (not measured) is -1."""
    return F.format_string("%.4f", F.coalesce(x.cast("double"), F.lit(-1.0)))


def feature_text(vec: Column) -> Column:
    """A vector as descriptor text: six decimals, a space after each."""
    return F.concat(F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", x)), " "), F.lit(" "))


def frame_name(frame_id: Column) -> Column:
    return F.concat(F.lit("frame-"), F.lpad(frame_id.cast("string"), 6, "0"), F.lit(".jpg"))
