"""Specification identifiers cited in comments, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an identifier and a reference look like.
REFERENCE = r"ix://[A-Za-z0-9._\-]+(?:/[A-Za-z0-9._\-]+)+"
IDENTIFIER = r"(?:TC|NFR|FR|StR|US|IT|Task)-[0-9]{1,6}(?:-[A-Z]{2,3}-[0-9]{1,4})?"


def harvest(comments: DataFrame) -> DataFrame:
    """identifier, kind, source, file, line of every mention. comments: text, line, owner, owner_is_test, path."""
    trimmed = F.transform(F.regexp_extract_all("text", F.lit(f"({REFERENCE})"), 1), lambda r: F.regexp_replace(r, r"[.,;:)\]`]+$", ""))
    refs = F.transform(trimmed, lambda r: F.struct(r.alias("identifier"), F.lit("artifact_reference").alias("kind")))
    # a letter keeps the place of a reference, so that what touches it isn't taken for a whole token
    rest = F.regexp_replace("text", rf"{REFERENCE}", "x")
    tag = F.col("owner_is_test")
    found = F.transform(
        F.regexp_extract_all(rest, F.lit(rf"(?<![A-Za-z0-9_-])({IDENTIFIER})(?![A-Za-z0-9_-])"), 1),
        lambda i: F.struct(i.alias("identifier"), F.when(i.startswith("TC-") & tag, "tracking_tag").otherwise("requirement_citation").alias("kind")),
    )
    rows = comments.select(F.explode(F.concat(refs, found)).alias("m"), F.col("owner").alias("source"), F.col("path").alias("file"), "line", *(c for c in ("file_ord",) if c in comments.columns))
    return rows.select("m.identifier", "m.kind", "source", "file", "line", *(c for c in ("file_ord",) if c in comments.columns)).distinct()
