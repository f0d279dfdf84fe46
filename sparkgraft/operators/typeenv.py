"""Types of names within a file, by a bounded fixpoint over its bindings.

Direct bindings (annotations, constructors) need no iteration. The others are solved per file in
source order, each seeing what the round has found so far; the first writer of a name wins.
What calls of functions return is joined beforehand. What a field or a method of a type gives
isn't: a file asks for those (type, member) pairs that it comes upon, Spark joins the questions
to the members of the batch, and only files that have asked are solved again, with all answers
so far. When nothing is asked the result is exact, as every lookup has been answered. There are
as many rounds as the longest chain of different questions, each over its delta; no lists of
owners are gathered, and a popular member name is joined like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_ROUNDS
from ..sources.scratch import Tables
from .corpus import first_writer, last_writer, unique_or_nothing

SELF = ("self", "this", "Self")
OUT = "scope string, name string, type string, rounds int, bound boolean, ask string"


class Row(NamedTuple):
    file_ord: int | str
    ord: int
    scope: str
    name: str
    kind: str
    x: str | None
    y: str | None
    known: str | None


def solve(rows: list[Row]) -> list[tuple]:
    """The rows of OUT for one file, whose bindings come in source order; those with `ask` are questions: the member and the type."""
    env: dict[tuple[str, str], str] = {}
    enclosing: dict[str, str] = {}
    answers: dict[tuple[str, str, str], str | None] = {}
    for r in rows:
        if r.kind in ("annotation", "constructor"):
            env.setdefault((r.scope, r.name), r.x)
        elif r.kind == "enclosing":
            enclosing[r.scope] = r.x
        elif r.kind.startswith("answer:"):
            answers[r.kind[7:], r.x, r.y] = r.known
    asked: dict[tuple[str, str, str], None] = {}

    def lookup(scope: str, name: str) -> str | None:
        if name in SELF and scope in enclosing:
            return enclosing[scope]
        return env.get((scope, name)) or env.get(("", name))

    def resolve(r: Row) -> str | None:
        if r.kind == "copy":
            return lookup(r.scope, r.x)
        if r.kind == "call":
            return r.known
        owner = lookup(r.scope, r.x)
        if owner is None:
            return None
        question = (r.kind, owner, r.y)
        if question not in answers:
            asked[question] = None
        return answers.get(question)

    pending = [r for r in rows if r.kind in ("copy", "call", "field", "method")]
    rounds, progressed = 0, True
    while rounds < MAX_ROUNDS and (rounds == 0 or (pending and progressed)):
        rounds, left = rounds + 1, []
        for r in pending:
            found = resolve(r)
            if found is None:
                left.append(r)
            else:
                env.setdefault((r.scope, r.name), found)
        progressed, pending = len(left) < len(pending), left
    ordinal = rows[0].file_ord
    if asked:
        return [(ordinal, None, member, owner, None, None, kind) for kind, owner, member in asked]
    bound = bool(pending) and progressed and rounds == MAX_ROUNDS
    return [(ordinal, s, n, t, rounds, bound, None) for (s, n), t in env.items()] or [(ordinal, None, None, None, rounds, bound, None)]


def solve_all(key: pa.DataType):
    """Batches sorted by file and place; a file is solved when its last row has been read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for b in batches:
                yield from map(Row._make, zip(*(c.to_pylist() for c in b.columns), strict=True))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (key, pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file_ord", *(c.split()[0] for c in OUT.split(", "))])

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r.file_ord):
            out += solve(list(group))
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def type_environment(bindings: DataFrame, enclosing: DataFrame, functions: DataFrame, methods: DataFrame, returns: DataFrame, fields: DataFrame, tables: Tables | None = None) -> DataFrame:
    """file_ord, scope, name, type, rounds, bound. A file without names that resolve has one row with nulls.

    Of repeated fields and returns the last in batch order counts: by file (org and repo where
    rows have them, path), then by place.
    """
    tables = tables or Tables(bindings.sparkSession, "types")
    kind = bindings.schema["file_ord"].dataType.simpleString()
    direct = F.col("kind").isin("annotation", "constructor")
    pending = bindings.where(~direct)
    files = tables.cut(pending.select("file_ord").distinct(), "type-files")
    none = F.lit(None).cast("string")
    if not files.limit(1).count():
        plain = first_writer(bindings, ["file_ord", "scope", "name"], "x", ["ord"])
        return plain.select("file_ord", "scope", "name", F.col("x").alias("type"), F.lit(1).alias("rounds"), F.lit(False).alias("bound"))
    plain = first_writer(bindings.where(direct).join(files, "file_ord", "left_anti"), ["file_ord", "scope", "name"], "x", ["ord"])
    solved = plain.select("file_ord", "scope", "name", F.col("x").alias("type"), F.lit(1).alias("rounds"), F.lit(False).alias("bound"))

    types = last_writer(returns, ["target"], "type", batch_place(returns))
    of_function = unique_or_nothing(functions, ["simple"], "target").join(types, "target").select(F.col("simple").alias("x"), F.col("type").alias("known"), F.lit("call").alias("kind"))
    of_method = unique_or_nothing(methods, ["owner", "method"], "target").join(types, "target").select(F.lit("method").alias("ask"), F.col("method").alias("member"), "owner", F.col("type").alias("known"))
    of_field = last_writer(fields, ["owner", "field"], "type", batch_place(fields)).select(F.lit("field").alias("ask"), F.col("field").alias("member"), "owner", F.col("type").alias("known"))
    wanted = pending.where("kind IN ('field', 'method')").select(F.col("kind").alias("ask"), F.col("y").alias("member")).distinct()
    members = tables.cut(of_method.union(of_field).join(wanted, ["ask", "member"], "left_semi"), "type-members")

    columns = list(Row._fields)
    asked = pending.join(of_function, ["kind", "x"], "left")
    others = bindings.where(direct).join(files, "file_ord", "left_semi").withColumn("known", none)
    around = enclosing.join(files, "file_ord", "left_semi").select("file_ord", "ord", "scope", F.lit("").alias("name"), F.lit("enclosing").alias("kind"), F.col("owner").alias("x"), none.alias("y"), none.alias("known"))
    rows = tables.cut(asked.select(*columns).union(others.select(*columns)).union(around.select(*columns)), "type-rows")
    step = 0
    while True:
        dealt = rows.repartition("file_ord").sortWithinPartitions("file_ord", "ord")
        found = tables.cut(dealt.mapInArrow(solve_all(pa.string() if kind == "string" else pa.int64()), f"file_ord {kind}, {OUT}"), f"type-round{step}")
        solved = solved.union(found.where("ask IS NULL").drop("ask"))
        questions = found.where("ask IS NOT NULL").select("file_ord", "ask", F.col("name").alias("member"), F.col("type").alias("owner"))
        if not questions.limit(1).count():
            return solved
        answers = questions.join(members, ["ask", "member", "owner"], "left").select("file_ord", F.lit(-1).alias("ord"), F.lit("").alias("scope"), F.lit("").alias("name"), F.concat(F.lit("answer:"), "ask").alias("kind"), F.col("owner").alias("x"), F.col("member").alias("y"), "known")
        open_files = questions.select("file_ord").distinct()
        rows = tables.cut(rows.join(open_files, "file_ord", "left_semi").union(answers.select(*columns)), f"type-open{step}")
        step += 1


def batch_place(rows: DataFrame) -> list[str]:
    """The columns that say where a row stands in the batch's order."""
    return [c for c in ("org", "repo", "path", "file_ord", "ord") if c in rows.columns]
