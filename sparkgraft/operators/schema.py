"""JSON documents checked against a JSON Schema by column expressions over VARIANT.

A schema is compiled into one expression that gives every problem of a document as (path, rule).
The keywords are those that records here need: type, const, enum, required, properties,
additionalProperties (false), pattern, minLength, minimum, maximum, items, minItems, allOf, not,
if / then / else, and $ref into $defs. Unknown keywords are an error, so that no rule is
passed over. Nothing runs in Python but the compilation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<path:string,rule:string>>"
HEAD = ("$schema", "$id", "title", "$defs", "description")


def kind_of(value: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers, also those written with a fraction of zeros."""
    shown = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(shown.isNull() | (shown == "VOID"), "null")
        .when(shown.startswith("OBJECT"), "object")
        .when(shown.startswith("ARRAY"), "array")
        .when(shown == "STRING", "string")
        .when(shown == "BOOLEAN", "boolean")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def literal(value: Column, wanted) -> Column:
    """Whether a variant equals a scalar of the schema."""
    if wanted is None:
        return kind_of(value) == "null"
    if isinstance(wanted, bool):
        return (kind_of(value) == "boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (kind_of(value) == "string") & (F.try_variant_get(value, "$", "string") == wanted)
    return kind_of(value).isin("integer", "number") & (F.try_variant_get(value, "$", "double") == float(wanted))


class Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def valid(self, schema: dict, value: Column) -> Column:
        return F.size(self.problems(schema, value, F.lit(""))) == 0

    def problems(self, schema: dict, value: Column, path: Column) -> Column:
        """All problems of a value that is there."""
        found: list[Column] = []

        def unless(good: Column, rule: str, at: Column = path) -> None:
            here = F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule")))
            found.append(F.when(F.coalesce(good, F.lit(False)), F.array().cast(PROBLEMS)).otherwise(here.cast(PROBLEMS)))

        def where(applies: Column, more: Column) -> None:
            found.append(F.when(applies, more).otherwise(F.array().cast(PROBLEMS)))

        kind = kind_of(value)
        is_object, is_array, is_text, is_number = kind == "object", kind == "array", kind == "string", kind.isin("integer", "number")
        keys = F.map_keys(F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)")))
        for word, rule in schema.items():
            if word in HEAD or word in ("then", "else"):
                continue
            if word == "$ref":
                found.append(self.problems(self.root["$defs"][rule.rpartition("/")[2]], value, path))
            elif word == "type":
                named = [rule] if isinstance(rule, str) else list(rule)
                unless(kind.isin(*named, *(["integer"] if "number" in named else [])), "type")
            elif word == "const":
                unless(literal(value, rule), "const")
            elif word == "enum":
                good = F.lit(False)
                for one in rule:
                    good = good | literal(value, one)
                unless(good, "enum")
            elif word == "required":
                for key in rule:
                    unless(~is_object | F.array_contains(keys, key), "required", F.concat(path, F.lit(f"/{key}")))
            elif word == "properties":
                for key, inner in rule.items():
                    where(is_object & F.array_contains(keys, key), self.problems(inner, F.try_variant_get(value, f"$['{key}']", "variant"), F.concat(path, F.lit(f"/{key}"))))
            elif word == "additionalProperties" and rule is False:
                known = F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>")
                where(is_object, F.transform(F.array_except(keys, known), lambda k: F.struct(F.concat(path, F.lit("/"), k).alias("path"), F.lit("additionalProperties").alias("rule"))))
            elif word == "pattern":
                unless(~is_text | F.try_variant_get(value, "$", "string").rlike(rule), "pattern")
            elif word == "minLength":
                unless(~is_text | (F.length(F.try_variant_get(value, "$", "string")) >= rule), "minLength")
            elif word == "minimum":
                unless(~is_number | (F.try_variant_get(value, "$", "double") >= rule), "minimum")
            elif word == "maximum":
                unless(~is_number | (F.try_variant_get(value, "$", "double") <= rule), "maximum")
            elif word == "minItems":
                unless(~is_array | (F.size(F.try_variant_get(value, "$", "array<variant>")) >= rule), "minItems")
            elif word == "items":
                held = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))
                where(is_array, F.flatten(F.transform(held, lambda x, i: self.problems(rule, x, F.concat(path, F.lit("/"), i.cast("string"))))))
            elif word == "allOf":
                found += [self.problems(inner, value, path) for inner in rule]
            elif word == "not":
                unless(~self.valid(rule, value), "not")
            elif word == "if":
                holds = self.valid(rule, value)
                if "then" in schema:
                    where(holds, self.problems(schema["then"], value, path))
                if "else" in schema:
                    where(~holds, self.problems(schema["else"], value, path))
            else:
                raise ValueError(f"keyword {word} is not supported")
        return F.concat(*found) if found else F.array().cast(PROBLEMS)


def schema_problems(records: DataFrame, schema: dict, record: str = "record") -> DataFrame:
    """The other columns of records, path and rule of each problem of their documents (JSON text), once each; text that is no JSON has the rule json at the root."""
    parsed = records.withColumn("__value", F.try_parse_json(F.col(record)))
    found = F.when(F.col("__value").isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"))).cast(PROBLEMS)).otherwise(Compiler(schema).problems(schema, F.col("__value"), F.lit("")))
    others = [c for c in records.columns if c != record]
    return parsed.select(*others, F.explode(F.array_distinct(found)).alias("p")).select(*others, "p.path", "p.rule")
