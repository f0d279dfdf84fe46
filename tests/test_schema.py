import copy
import hashlib
import json

import pytest

from sparkgraft.operators.measurement import RESULT_DIMENSIONS, observation_problems, observation_schema, one_observation
from sparkgraft.operators.schema import schema_problems

SCHEMA = observation_schema("ix://o/r/MP-1", "v3")
ROWS = [{"dimension": d, "key": {"language": "rust", "overall": "overall"}.get(d, "x")} for d in sorted(RESULT_DIMENSIONS)]
GOOD = {
    "schema_version": 1, "record_type": "graph_quality_observation", "producer": {"producer_contract_version": 2}, "measurement_plan": {"ref": "ix://o/r/MP-1", "definition_version": "v3"}, "raw_scorer_output": {"path": "out/raw.json"},
    "population": {"state": "measured", "files_seen": 3, "supported_files": 2, "unreadable_files": 0, "unsupported_files": 1, "census": {"languages": [{"key": "python", "count": 1}, {"key": "rust", "count": 1}], "node_kinds": [], "relation_kinds": [{"key": "calls", "count": 0}], "resolver_tiers": []}},
    "results": {
        "confusion_matrices": [r | {"true_positive": 1, "false_positive": 0, "false_negative": 0, "true_negative": None} for r in ROWS], "unresolved": [r | {"count": 0} for r in ROWS], "ambiguous": [r | {"count": 2} for r in ROWS],
        "recall": [r | {"recovered": 1, "expected": 2, "ratio": 0.5} for r in ROWS],
    },
}


def text_of(record):
    bare = json.dumps(record, sort_keys=True, separators=(",", ":"))
    return json.dumps({"observation_id": f"sha256:{hashlib.sha256(bare.encode()).hexdigest()}"} | record, sort_keys=True, separators=(",", ":"))


def put(path, value):
    def change(r):
        *above, last = path.strip("/").split("/")
        for key in above:
            r = r[int(key) if isinstance(r, list) else key]
        if value is Ellipsis:
            del r[last]
        else:
            r[int(last) if isinstance(r, list) else last] = value

    return change


def absent(state, **counts):
    def change(r):
        del r["results"]
        r["population"] |= {"state": state} | counts

    return change


NONE = {"files_seen": 0, "supported_files": 0, "unreadable_files": 0, "unsupported_files": 0}
CASES = {
    "good": (lambda r: None, []), "no version": (put("/schema_version", ...), [("/schema_version", "required")]), "version": (put("/schema_version", 2), [("/schema_version", "const")]), "type": (put("/record_type", "x"), [("/record_type", "const")]),
    "more": (put("/extra", 1), [("/extra", "additionalProperties")]), "contract": (put("/producer/producer_contract_version", 0), [("/producer/producer_contract_version", "minimum")]), "contract type": (put("/producer/producer_contract_version", "1"), [("/producer/producer_contract_version", "type")]),
    "fraction": (put("/population/files_seen", 1.5), [("/population/files_seen", "type")]), "plan": (put("/measurement_plan/ref", "ix://x"), [("/measurement_plan/ref", "const")]), "more plan": (put("/measurement_plan/x", None), [("/measurement_plan/x", "additionalProperties")]),
    "state": (put("/population/state", "odd"), [("/population/state", "enum"), ("", "not")]), "negative": (put("/population/unsupported_files", -1), [("/population/unsupported_files", "minimum")]), "none supported": (put("/population/supported_files", 0), [("/population/supported_files", "minimum")]),
    "unreadable": (put("/population/unreadable_files", 1), [("/population/unreadable_files", "const")]), "language": (put("/population/census/languages/1/key", "basic"), [("/population/census/languages/1/key", "enum"), ("/population/census/languages", "order")]), "empty key": (put("/population/census/relation_kinds/0/key", ""), [("/population/census/relation_kinds/0/key", "minLength")]),
    "census": (put("/population/census/node_kinds", {}), [("/population/census/node_kinds", "type")]), "results": (put("/results", ...), [("/results", "required")]), "few": (put("/results/unresolved", GOOD["results"]["unresolved"][:4]), [("/results/unresolved", "minItems"), ("/results/unresolved", "dimensions")]),
    "overall": (put("/results/recall/2/key", "all"), [("/results/recall/2/key", "const")]), "dimension": (put("/results/recall/1/dimension", "n"), [("/results/recall/1/dimension", "enum"), ("/results/recall", "dimensions")]), "ratio": (put("/results/recall/0/ratio", 1.01), [("/results/recall/0/ratio", "maximum")]),
    "low ratio": (put("/results/recall/0/ratio", -0.1), [("/results/recall/0/ratio", "minimum")]), "expected": (put("/results/recall/0/expected", 0), [("/results/recall/0/expected", "minimum")]), "negatives": (put("/results/confusion_matrices/0/true_negative", "0"), [("/results/confusion_matrices/0/true_negative", "type")]),
    "item": (put("/results/ambiguous/0/count", ...), [("/results/ambiguous/0/count", "required")]), "order": (put("/results/ambiguous", GOOD["results"]["ambiguous"][::-1]), [("/results/ambiguous", "order")]), "twice": (put("/results/recall", [*GOOD["results"]["recall"], GOOD["results"]["recall"][-1]]), [("/results/recall", "order")]),
    "key language": (put("/results/unresolved/0/key", "basic"), [("/results/unresolved/0/key", "enum")]), "absolute": (put("/raw_scorer_output/path", "/x"), [("/raw_scorer_output/path", "not")]), "drive": (put("/raw_scorer_output/path", "C:x"), [("/raw_scorer_output/path", "not")]), "above": (put("/raw_scorer_output/path", "a/../b"), [("/raw_scorer_output/path", "not")]),
    "no path": (put("/raw_scorer_output/path", ""), [("/raw_scorer_output/path", "minLength")]), "empty": (absent("empty", **NONE), []), "not empty": (absent("empty"), [("/population/files_seen", "const"), ("/population/supported_files", "const"), ("/population/unsupported_files", "const")]), "not unreadable": (absent("unreadable"), [("/population/unreadable_files", "minimum")]),
    "unsupported": (absent("unsupported", **NONE | {"files_seen": 1, "unsupported_files": 1}), []), "not unsupported": (absent("unsupported", **NONE), [("/population/files_seen", "minimum"), ("/population/unsupported_files", "minimum")]), "absent with results": (put("/population/state", "unreadable"), [("", "not"), ("/population/unreadable_files", "minimum")]),
}


def test_every_rule_of_the_contract(spark):
    rows = []
    for name, (change, _) in CASES.items():
        record = copy.deepcopy(GOOD)
        change(record)
        rows.append((name, text_of(record)))
    rows += [("other id", text_of(GOOD).replace("sha256:", "sha256:0", 1)), ("no json", "{"), ("null", None)]
    want = {(n, *p) for n, (_, found) in CASES.items() for p in found} | {("other id", "/observation_id", "pattern"), ("other id", "/observation_id", "id"), ("no json", "", "json"), ("null", "", "json")}
    got = [tuple(r) for r in observation_problems(spark.createDataFrame(rows, "name string, record string"), SCHEMA).collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_unknown_keywords_are_an_error(spark):
    with pytest.raises(ValueError, match="oneOf"):
        schema_problems(spark.createDataFrame([("{}",)], "record string"), {"oneOf": []})


def test_exactly_one_observation(spark):
    rows = [("a", "measured"), ("b", "empty"), ("c", "measured"), ("c", "measured"), ("d", None)]
    got = {r.collection: (r.n, r.status) for r in one_observation(spark.createDataFrame(rows, "collection string, state string")).collect()}
    assert got == {"a": (1, "computed"), "b": (1, "not_computed"), "c": (2, "several"), "d": (0, "missing")}
