"""Source files to relations: one Python stage, then one filter per relation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import content_identity, file_name, file_span_end, modifier_visibility, normalize_path
from ..operators.structure import structural_errors
from ..schemas import MAX_FILE_BYTES
from .scanner import Scan

TEXTS = ("a", "b", "c", "d", "e", "f")
COLUMNS = "path string, language string, relation string, ord int, a string, b string, c string, d string, e string, f string, line int, last int, flag boolean"
ROWS = "file_ord long, " + COLUMNS


def scan(files: DataFrame, identity: bool = False) -> DataFrame:
    """Tagged rows of every file; a file has one of relation `file`, and that alone if it is too large.

    files: org, repo, path, language, content, and file_ord if files have numbers or names of
    their own (unique); else they get numbers here, so write the rows before using them twice.
    Texts stay where they are: what is needed of them beside the rows comes from the same pass
    (identity: also the digest of each).
    """
    own = "file_ord" in files.columns
    kind = files.schema["file_ord"].dataType.simpleString() if own else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if kind == "string" else pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 6, pa.int32(), pa.int32(), pa.bool_()]
        names = ["file_ord", *(c.split()[0] for c in COLUMNS.split(", "))]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            out: list[tuple] = []
            for ordinal, org, repo, name, path, language, size, last, digest, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((ordinal, path, language, "file", -1, org, repo, name, digest, None, None, size, last, None))
                if content is not None:
                    out += [(ordinal, path, language, *row) for row in Scan(name, path, language, content).rows]
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    content = F.coalesce("content", F.lit(""))
    size = F.octet_length(content)
    given = files.select(
        (F.col("file_ord") if own else F.monotonically_increasing_id()).alias("file_ord"), "org", "repo", file_name(F.col("org"), F.col("repo"), F.col("path")).alias("name"), "path", "language", size.alias("size"), file_span_end(content).cast("int").alias("last"),
        (content_identity(content) if identity else F.lit(None).cast("string")).alias("digest"), F.when(size <= MAX_FILE_BYTES, content).alias("content"),
    )
    return given.mapInArrow(run, f"file_ord {kind}, {COLUMNS}")


class Parsed:
    """The relations of a batch, as views over its scanned rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.files = rows.where("relation = 'file'").select("file_ord", F.col("a").alias("org"), F.col("b").alias("repo"), F.col("c").alias("file_ref"), "path", "language", F.col("d").alias("identity"), F.col("line").alias("size"), "last")

    def only(self, files: DataFrame) -> Parsed:
        """The relations of some files, by file_ord."""
        return Parsed(self.rows.join(files, "file_ord", "left_semi"))

    def pick(self, relation: str, **names: str) -> DataFrame:
        return self.rows.where(F.col("relation") == relation).select("file_ord", "path", "language", "ord", *(F.col(c).alias(n) for n, c in names.items()))

    def facts(self) -> DataFrame:
        null = F.lit(None).cast("string")
        whole = self.files.select(
            "file_ord", "path", "language", F.lit(-1).alias("ord"), F.lit("code_file").alias("object_type"), F.lit("file").alias("kind"), F.col("file_ref").alias("qualified_name"),
            F.element_at(F.split("path", "/"), -1).alias("simple_name"), null.alias("parent"), F.lit("public").alias("visibility"), null.alias("signature"), F.lit(1).alias("line"), "last",
        )
        rows = self.pick("fact", object_type="a", kind="b", qualified_name="c", said="d", parent="e", signature="f", line="line", last="last", member="flag")
        simple, modifiers = F.element_at(F.split("said", "\x1f"), 1), F.element_at(F.split("said", "\x1f"), 2)
        visibility = modifier_visibility(F.col("language"), modifiers, F.col("member"), modifiers.rlike(r"\bexport\b"), simple)
        signature = F.regexp_replace("signature", r"\s+", " ")
        declared = self.reparented(rows.withColumn("simple_name", simple).withColumn("visibility", visibility).withColumn("signature", signature))
        return whole.unionByName(declared.select(*whole.columns))

    def declared(self) -> DataFrame:
        """What indexes need of the facts: object_type, qualified_name, simple_name."""
        return self.pick("fact", object_type="a", qualified_name="c", said="d").withColumn("simple_name", F.substring_index("said", "\x1f", 1)).drop("said")

    @staticmethod
    def reparented(rows: DataFrame) -> DataFrame:
        """The parent is what the name says, where the same file declares it."""
        prefix = F.regexp_extract("qualified_name", r"^(.*)::", 1)
        declared = rows.select("file_ord", F.col("qualified_name").alias("prefix")).distinct().withColumn("known", F.lit(True))
        return rows.withColumn("prefix", prefix).join(declared, ["file_ord", "prefix"], "left").withColumn("parent", F.when(F.col("known"), F.col("prefix")).otherwise(F.col("parent")))

    def comments(self) -> DataFrame:
        return self.pick("comment", text="a", owner="b", line="line", owner_is_test="flag")

    def imports(self) -> DataFrame:
        return self.pick("import", specifier="a", line="line")

    def bindings(self) -> DataFrame:
        return self.pick("binding", scope="a", name="b", kind="c", x="d", y="e")

    def calls(self) -> DataFrame:
        return self.pick("call", caller="a", scope="b", receiver="c", callee="d", line="line")

    def enclosing(self) -> DataFrame:
        return self.pick("enclosing", scope="a", owner="b")

    def returns(self) -> DataFrame:
        return self.pick("return", target="a", type="b")

    def fields(self) -> DataFrame:
        return self.pick("field", owner="a", field="b", type="c")

    def relations(self) -> DataFrame:
        return self.pick("relation", child="a", parent="b", is_trait="flag")

    def structure(self) -> DataFrame:
        """file_ord, path, errors, at of broken files: the first error that breaks the structure of declarations, null if all lie in executable bodies. Such a file's declarations can be used."""
        spans = self.pick("span", body="c", start="line", stop="last").select("file_ord", F.col("body").cast("int").alias("body"), "start", "stop")
        return structural_errors(spans, self.pick("error", at="line").select("file_ord", "at")).join(self.files.select("file_ord", "path"), "file_ord").select("file_ord", "path", "errors", "at")

    def diagnostics(self) -> DataFrame:
        null = F.lit(None)
        error = self.pick("diagnostic", line="line", column="last").select("file_ord", "ord", F.lit("parse_error").alias("code"), F.lit("syntax error").alias("message"), "path", "line", "column", F.lit("error").alias("severity"))
        large = self.files.where(F.col("size") > MAX_FILE_BYTES).select("file_ord", F.lit(0).alias("ord"), F.lit("file_too_large").alias("code"), F.lit("file exceeds the size limit").alias("message"), "path", null.cast("int").alias("line"), null.cast("int").alias("column"), F.lit("error").alias("severity"))
        return error.unionByName(large)


def normalized(files: DataFrame) -> DataFrame:
    return files.withColumn("path", normalize_path(F.col("path")))
