"""Names, paths and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Forward slashes, no repeats, no leading ./ and no trailing slash."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/+$", "")


def file_name(org: Column, repo: Column, path: Column) -> Column:
    return F.concat_ws("/", org, repo, path)


def child_name(parent: Column, segment: Column) -> Column:
    return F.concat(parent, F.lit("::"), segment)


def anonymous_segment(kind: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("#"), ordinal.cast("string"), F.lit(">"))


def ix_ref(name: Column) -> Column:
    return F.concat(F.lit("ix://"), name)


def node_id(object_type: Column, name: Column) -> Column:
    return F.sha2(F.concat(object_type, F.lit("\x1f"), name), 256)


def content_identity(text: Column) -> Column:
    return F.sha2(text, 256)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_relative(directory: Column, specifier: Column) -> Column:
    """The specifier's segments applied to the directory; null if it climbs above the root."""
    start = F.filter(F.split(directory, "/"), lambda s: s != "")
    stack = F.aggregate(
        F.split(specifier, "/"),
        start,
        lambda seen, s: F.when((s == "") | (s == "."), seen)
        .when(s == "..", F.when(F.size(seen) > 0, F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))))
        .otherwise(F.concat(seen, F.array(s))),
    )
    return F.array_join(stack, "/")


def owning_type_segment(name: Column) -> Column:
    """The segment before a member's own, if the name has at least two segments after the path."""
    parts = F.split(name, "::")
    owner = F.get(parts, F.size(parts) - 2)
    return F.when((F.size(parts) >= 3) & (owner != ""), owner)


def simple_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def language_of_path(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    return F.when(ext == "rs", "rust").when(ext.isin("ts", "mts", "cts"), "typescript").when(ext == "tsx", "tsx").when(ext.isin("py", "pyi"), "python")


def language_of_name(name: Column) -> Column:
    return F.when(name.isin("rust", "tsx", "typescript", "python"), name).when(name == "ts", "typescript").when(name == "py", "python")


def is_plain_identifier(text: Column) -> Column:
    return text.rlike(r"^[\p{IsAlphabetic}\p{N}_$]+$")


def starts_uppercase(text: Column) -> Column:
    return text.rlike(r"^\p{IsUppercase}")


def python_visibility(name: Column) -> Column:
    dunder = name.startswith("__")
    return F.when(dunder & ~name.endswith("__"), "private").when(name.startswith("_") & ~dunder, "crate").otherwise("public")


def is_exported(visibility: Column) -> Column:
    """Whether code outside the defining module can refer to a declaration; null counts as no."""
    return F.coalesce(visibility == "public", F.lit(False))


def modifier_visibility(language: Column, modifiers: Column, member: Column, exported: Column, name: Column) -> Column:
    """Visibility from what the source says. member: stands in a trait, trait impl, class or interface."""
    rust = F.when(modifiers.rlike(r"\bpub\s*\("), "crate").when(modifiers.rlike(r"\bpub\b") | member, "public").otherwise("private")
    script = (
        F.when(name.startswith("#") | modifiers.rlike(r"\bprivate\b"), "private")
        .when(modifiers.rlike(r"\bprotected\b"), "crate")
        .when(member | exported, "public")
        .otherwise("private")
    )
    return F.when(language == "rust", rust).when(language == "python", python_visibility(name)).otherwise(script)


def file_span_end(content: Column) -> Column:
    """Lines of a text; a trailing line feed adds none."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"))) + F.when(content.endswith("\n") | (content == ""), 0).otherwise(1)
    return F.greatest(F.lit(1), n)
