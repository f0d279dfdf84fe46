"""Precision and recall against known truth, and the observation that records them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import schema_problems

DIMENSIONS = ("language", "node_kind", "relation_kind", "resolver_tier")
# What lists of results must name, and the strata that hold every open call site.
RESULT_DIMENSIONS = ("overall", *DIMENSIONS)
RESULT_LANGUAGES = ("rust", "typescript", "tsx", "python", "mixed")
STRATA = (("overall", "overall"), ("node_kind", "call_site"), ("relation_kind", "calls"), ("resolver_tier", "unresolved"))


def confusion(rows: DataFrame) -> DataFrame:
    """dimension, key, true_positive, false_positive, false_negative for the total and each of four dimensions.

    rows: truth and emitted (booleans) and the dimensions. True negatives have no meaning for
    edges and are null. One expand and one partial aggregate; the keys are few.
    """
    for c in DIMENSIONS:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    counts = rows.groupingSets([[], *([F.col(c)] for c in DIMENSIONS)], *DIMENSIONS).agg(
        F.grouping_id().alias("set"), F.count_if(F.expr("truth AND emitted")).alias("true_positive"), F.count_if(F.expr("NOT truth AND emitted")).alias("false_positive"), F.count_if(F.expr("truth AND NOT emitted")).alias("false_negative")
    )
    name, full = F.lit("total"), 2 ** len(DIMENSIONS) - 1
    for i, c in enumerate(DIMENSIONS):
        name = F.when(F.col("set") == full - 2 ** (len(DIMENSIONS) - 1 - i), c).otherwise(name)
    return counts.select(name.alias("dimension"), F.coalesce(*DIMENSIONS, F.lit("all")).alias("key"), "true_positive", "false_positive", "false_negative", F.lit(None).cast("bigint").alias("true_negative"))


def recall(counts: DataFrame) -> DataFrame:
    positives = F.col("true_positive") + F.col("false_negative")
    return counts.where(positives > 0).select("dimension", "key", (F.col("true_positive") / positives).alias("recall"))


def truth_census(counts: DataFrame) -> DataFrame:
    return counts.select("dimension", "key", (F.col("true_positive") + F.col("false_negative")).alias("known"))


def decision(counts: DataFrame, state: str = "measured") -> DataFrame:
    """One row: it passes only if measured and without a false positive; recall never makes up for one."""
    wrong = counts.where("dimension = 'total'").agg(F.coalesce(F.sum("false_positive"), F.lit(0)).alias("false_positive"))
    return wrong.select(F.lit(state).alias("state"), "false_positive", F.when((F.lit(state) == "measured") & (F.col("false_positive") == 0), "pass").otherwise("fail").alias("decision"))


def differences(emitted: DataFrame, truth: DataFrame) -> DataFrame:
    """source_ref, target_ref, verdict: wrong (only emitted), missed (only known) or right."""
    key = ["source_ref", "target_ref"]
    both = emitted.select(*key).distinct().withColumn("e", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "full_outer")
    return both.select(*key, F.when(F.col("t").isNull(), "wrong").when(F.col("e").isNull(), "missed").otherwise("right").alias("verdict"))


def digest(json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(json, 256))


def reconcile(runs: DataFrame) -> DataFrame:
    """One row: whether all repetitions agree, and the first that doesn't. runs: run, report."""
    first = runs.agg(F.min_by("report", "run").alias("expected"))
    return runs.crossJoin(F.broadcast(first)).agg((F.count_if(F.col("report") != F.col("expected")) == 0).alias("agreed"), F.min(F.when(F.col("report") != F.col("expected"), F.col("run"))).alias("first_other"))


def observation(counts: DataFrame, state: str, plan: str, observed_at: str) -> DataFrame:
    """id and record (JSON with sorted keys) of an observation; results only where it was measured."""
    dimension = F.struct("dimension", "false_negative", "false_positive", "key", "true_positive")
    results = counts.agg(F.sort_array(F.collect_list(dimension)).alias("results")) if state == "measured" else counts.limit(0).agg(F.lit(None).cast("string").alias("results"))
    body = results.select(F.to_json(F.struct(F.lit(observed_at).alias("observed_at"), F.lit(plan).alias("plan"), "results", F.lit(state).alias("state"))).alias("record"))
    return body.select(digest(F.col("record")).alias("id"), "record")


def collection(observations: DataFrame) -> DataFrame:
    """id, status, value of each observation: not_computed and null unless it was measured."""
    state = F.get_json_object("record", "$.state")
    return observations.select("id", F.when(state == "measured", "computed").otherwise("not_computed").alias("status"), F.when(state == "measured", F.col("record")).alias("value"))


def valid_observations(observations: DataFrame) -> DataFrame:
    """id and problem (null if none): the id must be the record's digest, the state known, results there only if measured."""
    state = F.get_json_object("record", "$.state")
    problem = (
        F.when(F.col("id") != digest(F.col("record")), "id")
        .when(state.isNull() | ~state.isin("measured", "empty", "unreadable", "unsupported"), "state")
        .when((state == "measured") != F.get_json_object("record", "$.results").isNotNull(), "results")
    )
    return observations.select("id", problem.alias("problem"))


def open_counts(cases: DataFrame) -> DataFrame:
    """dimension, key, unresolved, ambiguous of call sites left open, by language and in the four strata that hold all of them.

    cases: name (its last part after a slash is the language), reported and expected (null: 0). Without cases the strata stand at 0.
    """
    language = F.coalesce(F.substring_index("name", "/", -1), F.lit("mixed"))
    held = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("reported", "unresolved"), ("expected", "ambiguous"))]
    by_language = cases.groupBy(language.alias("key")).agg(*held).select(F.lit("language").alias("dimension"), "key", "unresolved", "ambiguous")
    strata = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key")) for d, k in STRATA])
    total = cases.agg(*held).select(F.explode(strata).alias("s"), "unresolved", "ambiguous").select("s.dimension", "s.key", "unresolved", "ambiguous")
    return by_language.union(total)


def result_problems(items: DataFrame, dimensions: tuple[str, ...] = RESULT_DIMENSIONS, languages: tuple[str, ...] = RESULT_LANGUAGES) -> DataFrame:
    """id, problem (null if none) of lists of results. items: id, place (unique in a list, from 0 without gaps), dimension, key.

    order: an item isn't greater than the one before it, by dimension and key; dimensions: one is
    not there; language: a key is unknown. Each item meets the one before it by a join, so a long
    list is not gathered.
    """
    before = items.select("id", (F.col("place") + 1).alias("place"), F.struct(F.coalesce("dimension", F.lit("")).alias("d"), F.coalesce("key", F.lit("")).alias("k")).alias("before"))
    this = F.struct(F.coalesce("dimension", F.lit("")).alias("d"), F.coalesce("key", F.lit("")).alias("k"))
    met = items.join(before, ["id", "place"], "left").withColumn("fell", this <= F.col("before"))
    stranger = (F.col("dimension") == "language") & ~F.coalesce(F.col("key").isin(*languages), F.lit(False))
    found = met.groupBy("id").agg(F.count_if("fell").alias("fell"), F.count_if(stranger).alias("strangers"), *(F.count_if(F.col("dimension") == d).alias(f"has{i}") for i, d in enumerate(dimensions)))
    lacks = F.least(*(F.col(f"has{i}") for i in range(len(dimensions)))) == 0
    return found.select("id", F.when(F.col("fell") > 0, "order").when(lacks, "dimensions").when(F.col("strangers") > 0, "language").alias("problem"))


def plan_lines(plans: DataFrame, expected: list[str]) -> DataFrame:
    """plan_id, first_missing: the first of the expected lines that a plan's front matter does not hold whole (null if it holds all). plans: plan_id, text."""
    front = F.split(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)\A---\n(.*?)\n---", 1), "\n")
    return plans.select("plan_id", F.get(F.filter(F.array(*map(F.lit, expected)), lambda line: ~F.array_contains(front, line)), F.lit(0)).alias("first_missing"))


def plan_files(plans: DataFrame) -> DataFrame:
    """plan_id, file, plain for each file listed in a plan's front matter. plans: plan_id, text."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    listed = F.filter(F.split(front, "\n"), lambda s: s.startswith("  - "))
    file = F.trim(F.substring("line", 5, 1_000_000))
    plain = ~file.startswith("/") & ~file.contains("..") & ~file.rlike(r"[*?\[\"'#]") & (file != "")
    return plans.select("plan_id", F.explode(listed).alias("line")).select("plan_id", file.alias("file"), plain.alias("plain"))


def closed(**properties: dict) -> dict:
    """An object of exactly these properties; those whose names end in an underscore may lack."""
    return {"type": "object", "required": [k for k in properties if not k.endswith("_")], "properties": {k.rstrip("_"): v for k, v in properties.items()}, "additionalProperties": False}


def given(**states: dict) -> dict:
    """A condition on the population of a record."""
    return {"properties": {"population": {"properties": states}}}


def listed(least: int, **columns: dict) -> dict:
    """A list of rows by dimension and key; the keys of two dimensions are fixed."""
    by = lambda name: {"properties": {"dimension": {"const": name}}, "required": ["dimension"]}
    keys = [{"if": by("overall"), "then": {"properties": {"key": {"const": "overall"}}}}, {"if": by("language"), "then": {"properties": {"key": LANGUAGE}}}]
    return {"type": "array", "minItems": least, "items": closed(dimension={"enum": list(RESULT_DIMENSIONS)}, key=TEXT, **columns) | {"allOf": keys}}


# The contract of an observation's record.
COUNT, TEXT, LANGUAGE = {"type": "integer", "minimum": 0}, {"type": "string", "minLength": 1}, {"type": "string", "enum": list(RESULT_LANGUAGES)}
POSITIVE, NOUGHT = {"minimum": 1}, {"const": 0}
CENSUS = {"type": "array", "items": closed(key=TEXT, count=COUNT)}
POPULATION = closed(
    state={"enum": ["measured", "empty", "unreadable", "unsupported"]}, files_seen=COUNT, supported_files=COUNT, unreadable_files=COUNT, unsupported_files=COUNT,
    census=closed(languages={"type": "array", "items": closed(key=LANGUAGE, count=COUNT)}, node_kinds=CENSUS, relation_kinds=CENSUS, resolver_tiers=CENSUS),
)
RESULTS = closed(
    confusion_matrices=listed(5, true_positive=COUNT, false_positive=COUNT, false_negative=COUNT, true_negative={"type": ["integer", "null"], "minimum": 0}),
    unresolved=listed(5, count=COUNT), ambiguous=listed(5, count=COUNT), recall=listed(1, recovered=COUNT, expected={"type": "integer", "minimum": 1}, ratio={"type": "number", "minimum": 0, "maximum": 1}),
)


def observation_schema(plan: str, definition: str) -> dict:
    """The contract for records of one plan. Which counts a population may have, and whether there are results, follows from its state."""
    state = lambda name: given(state={"const": name}) | {"required": ["population"]}
    record = closed(
        schema_version={"const": 1}, record_type={"const": "graph_quality_observation"}, observation_id={"type": "string", "pattern": "^sha256:[a-f0-9]{64}$"}, producer=closed(producer_contract_version={"type": "integer", "minimum": 1}),
        measurement_plan=closed(ref={"const": plan}, definition_version={"const": definition}), population=POPULATION, results_=RESULTS,
        raw_scorer_output=closed(path=TEXT | {"allOf": [{"not": {"pattern": r"^(?:[\\/]|[A-Za-z]:)"}}, {"not": {"pattern": r"(?:^|[\\/])\.\.(?:[\\/]|$)"}}]}),
    )
    by_state = [
        {"if": state("measured"), "then": {"required": ["results"]} | given(supported_files=POSITIVE, unreadable_files=NOUGHT), "else": {"not": {"required": ["results"]}}},
        {"if": state("empty"), "then": given(files_seen=NOUGHT, supported_files=NOUGHT, unreadable_files=NOUGHT, unsupported_files=NOUGHT)},
        {"if": state("unreadable"), "then": given(unreadable_files=POSITIVE)},
        {"if": state("unsupported"), "then": given(files_seen=POSITIVE, supported_files=NOUGHT, unreadable_files=NOUGHT, unsupported_files=POSITIVE)},
    ]
    return record | {"allOf": by_state}


def text(value: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{key}", "string"), F.lit(""))


def falling(items: Column, keys: tuple[str, ...]) -> Column:
    """Whether an item of a list isn't greater than the one before it."""
    ranked = F.transform(items, lambda x: F.struct(*(text(x, k).alias(k) for k in keys)))
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(ranked) - 2, F.lit(0))), lambda i: F.coalesce(F.get(ranked, i) >= F.get(ranked, i + 1), F.lit(False)))


def observation_problems(records: DataFrame, schema: dict) -> DataFrame:
    """The other columns, path and rule of every problem of observations (record: JSON text with sorted keys): the schema's, and what takes the whole record.

    id: the record's digest without its id; order: a list's items don't rise by dimension and key
    (census: by key); dimensions: a list of a measured record lacks one of the five.
    """
    value = F.try_parse_json(F.col("record"))
    others = [c for c in records.columns if c != "record"]
    bare = F.regexp_replace("record", r'"observation_id":"[^"]*",', "")
    checks = [(F.lit("/observation_id"), F.lit("id"), text(value, "observation_id") != digest(bare))]
    lists = [(f"/population/census/{n}", ("key",)) for n in ("languages", "node_kinds", "relation_kinds", "resolver_tiers")] + [(f"/results/{n}", ("dimension", "key")) for n in ("confusion_matrices", "unresolved", "ambiguous", "recall")]
    for path, keys in lists:
        items = F.try_variant_get(value, "$" + path.replace("/", "."), "array<variant>")
        checks.append((F.lit(path), F.lit("order"), items.isNotNull() & falling(items, keys)))
        if len(keys) == 2:
            held = F.transform(items, lambda x: text(x, "dimension"))
            lacks = F.size(F.array_except(F.array(*map(F.lit, RESULT_DIMENSIONS)), held)) > 0
            checks.append((F.lit(path), F.lit("dimensions"), (text(value, "population.state") == "measured") & items.isNotNull() & lacks))
    whole = F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.struct(path.alias("path"), rule.alias("rule"))) for path, rule, wrong in checks)))
    more = records.where(value.isNotNull()).select(*others, F.explode(whole).alias("p")).select(*others, "p.path", "p.rule")
    return schema_problems(records, schema).union(more)


def one_observation(problems_by: DataFrame) -> DataFrame:
    """collection, n, status of collections: each must hold exactly one observation. problems_by: collection and an observation's state, a row each (state null: none)."""
    counted = problems_by.groupBy("collection").agg(F.count("state").alias("n"), F.min("state").alias("state"))
    return counted.select("collection", "n", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "several").when(F.col("state") == "measured", "computed").otherwise("not_computed").alias("status"))
