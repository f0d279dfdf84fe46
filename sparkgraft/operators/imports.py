"""Import specifiers resolved against the paths of the batch, by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import join_relative, parent_dir
from ..schemas import IMPORT_EXTENSIONS, INDEX_STEMS


def is_relative(specifier: Column, language: Column) -> Column:
    rust = specifier.rlike("^(self|super|crate)::")
    script = specifier.startswith("./") | specifier.startswith("../")
    return F.when(language == "rust", rust).when(language == "python", specifier.startswith(".")).otherwise(script)


def rust_stem(specifier: Column, importer: Column) -> Column:
    """The module a path names: its leading lower-case segments below crate, self or super."""
    directory = parent_dir(importer)
    root = F.when(F.instr(importer, "src/") > 0, F.concat(F.substring_index(importer, "src/", 1), F.lit("src"))).otherwise(directory)
    head = F.substring_index(specifier, "::", 1)
    # each of the three is taken once, as an argument: a column that is named twice is computed twice
    base = F.when(head == "crate", root).when(head == "self", directory).when(head == "super", parent_dir(directory))
    rest = F.filter(F.split(specifier, "::"), lambda s, i: (i > 0) & (s != "") & (s != "*"))
    lower = lambda segments, n: F.when(n == 0, segments).otherwise(F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0))))
    modules = let(rest, lambda r: lower(r, F.array_position(F.transform(r, lambda s: s.rlike(r"^[\p{IsLowercase}_]")), False).cast("int")))
    joined = let(modules, lambda m: F.when(F.size(m) > 0, F.array_join(m, "/")))
    return let(F.struct(base.alias("b"), joined.alias("j")), lambda v: F.when(v["b"] == "", v["j"]).otherwise(F.concat(v["b"], F.lit("/"), v["j"])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def python_stem(specifier: Column, importer: Column) -> Column:
    """One dot is the importer's folder, each further dot its parent."""
    dots = F.length(F.regexp_extract(specifier, r"^\.*", 0))
    folder = F.aggregate(F.sequence(F.lit(1), F.greatest(dots, F.lit(1))), parent_dir(importer), lambda d, i: F.when(i == 1, d).otherwise(parent_dir(d)))
    tail = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    return F.when(dots > 0, F.when(tail == "", folder).when(folder == "", tail).otherwise(F.concat(folder, F.lit("/"), tail)))


def endings(language: str) -> list[str]:
    """What may follow a module's stem in the path of its file, in order."""
    own = [f".{e}" for e in IMPORT_EXTENSIONS[language]]
    return ["", *own, *(f"/{s}{e}" for s in INDEX_STEMS[language] for e in own)]


def stem_of(specifier: Column, importer: Column, language: Column) -> Column:
    """The path without ending that a relative specifier names; null if it isn't relative or names no module."""
    stem = F.when(language == "rust", rust_stem(specifier, importer)).when(language == "python", python_stem(specifier, importer)).otherwise(join_relative(parent_dir(importer), specifier))
    return F.when(is_relative(specifier, language), stem)


def family_of(language: Column) -> Column:
    return F.when(language.isin("rust", "python"), language).otherwise("typescript")


def stems_of_paths(paths: DataFrame) -> DataFrame:
    """family, stem, rank, target_path: every stem by which a path may be imported, and how late it is tried."""
    named = []
    for family in ("rust", "python", "typescript"):
        for rank, end in enumerate(endings(family)):
            fits = F.endswith("path", F.lit(end)) if end else F.lit(True)
            named.append(F.when(fits, F.struct(F.lit(family).alias("family"), F.expr(f"left(path, length(path) - {len(end)})").alias("stem"), F.lit(rank).alias("rank"))))
    return paths.select("path", F.explode(F.array_compact(F.array(*named))).alias("s")).select("s.*", F.col("path").alias("target_path"))


def module_index(paths: DataFrame) -> DataFrame:
    """family, stem, target_path: for each stem of a path of the batch the path that is tried first."""
    return stems_of_paths(paths).groupBy("family", "stem").agg(F.min_by("target_path", "rank").alias("target_path"))


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (with specifier, path, language) plus `relative` and `target_path`: the first candidate in the batch, or null."""
    specifier, language = F.col("specifier"), F.col("language")
    keyed = imports.withColumn("stem", stem_of(specifier, F.col("path"), language)).withColumn("family", family_of(language))
    # a path has several stems, and may be made from a number, which Spark's estimate of the index knows nothing of
    return keyed.join(module_index(paths).hint("merge"), ["family", "stem"], "left").select(*imports.columns, "target_path", is_relative(specifier, language).alias("relative"))
