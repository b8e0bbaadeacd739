"""Names and paths as column expressions [F1-F3, F9, F13, P11]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def source_name(name: Column) -> Column:
    """the name before `.rf.<letters and digits>` at the end, without an image suffix such as `_jpg`, lower case; null without that mark."""
    marked = r"^(.*)\.rf\.[0-9A-Za-z]+$"
    base = F.lower(F.regexp_replace(F.regexp_extract(name, marked, 1), r"(?i)_(jpe?g|png|bmp|webp|tiff?)$", ""))
    return F.when(name.rlike(marked), base)


def photo_id(source: Column, pattern: str) -> Column:
    """the first group of a pattern that must match from the beginning, else the name itself."""
    anchored = pattern if pattern.startswith("^") else f"^(?:{pattern})"
    return F.when(source.rlike(anchored), F.regexp_extract(source, anchored, 1)).otherwise(source)


def original_name(name: Column) -> Column:
    """what stands before the first `_jpg`, lower case."""
    return F.lower(F.split(name, "(?i)_jpg", 2)[0])


def dataset_of_path(path: Column) -> Column:
    """The part under `images/`, else the first part."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 2) & (parts[0] == "images"), parts[1]).otherwise(parts[0])


def path_key(path: Column) -> Column:
    """lower case, one kind of slash, without a leading `images/`."""
    return F.regexp_replace(F.lower(F.regexp_replace(path, r"[\\/]+", "/")), "^images/", "")


def caption(classes: Column) -> Column:
    """the class names as one caption."""
    return F.concat(F.array_join(classes, " . "), F.lit(" ."))


def token_spans(caption_col: Column, classes: Column) -> Column:
    """[start, end) character spans of each class in its caption, in order."""
    step = lambda acc, c: F.struct(
        (acc["at"] + F.length(c) + 3).alias("at"),
        F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(c)).alias("end")))).alias("spans"),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.when(caption_col.isNotNull(), F.aggregate(classes, first, step, lambda a: a["spans"]))
