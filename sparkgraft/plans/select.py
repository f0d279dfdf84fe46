"""Extraction of selected modules only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..front.parse import Parsed, normalized, scan
from ..functions.naming import node_id
from ..operators.selection import KEY, absent_functions, account, candidates, scope
from ..sources.scratch import Tables
from .extract import Extraction, extract


def extract_selected(modules: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, Extraction | None]:
    """(scope, accounting, extraction) for modules: org, repo, path, identity, functions.

    Only accepted files are seen by name resolution. There is no extraction where the scope is
    unavailable. Files are scanned once: a file that can't be parsed is known by its rows, and
    those of accepted files are what is extracted.
    """
    tables = Tables(files.sparkSession, "select")
    parsed = Parsed(tables.cut(scan(normalized(files), identity=True), "rows"))
    held = tables.cut(candidates(parsed.files.select(*KEY, F.col("identity").alias("supplied"), "file_ord")), "candidates")
    first = held.where("place = 1")
    broken = first.join(parsed.diagnostics().select("file_ord").distinct(), "file_ord", "left_semi").select(*KEY)
    accounted = tables.cut(account(modules, held, broken), "accounted")
    accepted = first.join(accounted.where("status = 'accepted'").select(*KEY), KEY, "left_semi").select("file_ord")
    taken = extract(files, tables.cut(parsed.only(accepted).rows, "accepted"))
    facts = taken.nodes.select("object_type", F.col("name").alias("qualified_name"))
    found = scope(modules, accounted, absent_functions(modules, facts))
    if found.first()["scope"].startswith("unavailable"):
        return found, accounted, None
    return found, accounted, taken


def function_ids(modules: DataFrame) -> DataFrame:
    """function and node id of every selected function."""
    return modules.select(F.explode("functions").alias("function")).select("function", node_id(F.lit("code_function"), F.col("function")).alias("id"))
