import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.functions.schematree import STEP, _assign, edit_script
from darkslide.operators import drift
from darkslide.operators.drift import common_names, file_schemas, one_table, plain_text, projections, schema_changes, with_previous


def edits(old, new, agreement=()):
    trees = [{k: set(v.split()) for k, v in t.items()} for t in (old, new)]
    return [(e.kind, e.path.replace(STEP, "/"), e.new_path.replace(STEP, "/")) for e in edit_script(*trees, dict(agreement))]


def test_scripts():
    assert edits({"a": "string"}, {"b": "string"}) == [("added", "b", ""), ("removed", "a", "")]
    assert edits({"a": "string"}, {"b": "string"}, {("a", "b"): 0.6}.items()) == [("renamed", "a", "b")]
    assert edits({"a": "string null"}, {"a": "number"}) == [("retyped", "a", "a")]
    assert edits({"a": "null"}, {"a": "number"}) == []
    a, b = {"o": "object", f"o{STEP}x": "string"}, {"p": "object", f"p{STEP}x": "string"}
    assert edits(a, b, {("o", "p"): 1.0}.items()) == [("renamed", "o", "p")]
    assert edits(a, {"o": "object", "x": "string"}, {(f"o{STEP}x", "x"): 1.0}.items()) == [("moved", "o/x", "x")]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10_000))
def test_assignment_is_cheapest(rows, columns, seed):
    rng = np.random.default_rng(seed)
    cost = np.where(rng.random((rows, columns)) < 0.3, np.inf, rng.random((rows, columns)) * 3)
    found = _assign(cost, [1.0] * rows, [1.0] * columns)
    total = lambda m: sum(cost[i, j] for i, j in m) + rows + columns - 2 * len(m)
    best = min(total(list(zip(r, c))) for k in range(min(rows, columns) + 1) for r in itertools.combinations(range(rows), k) for c in itertools.permutations(range(columns), k))
    assert abs(total(found) - best) < 1e-9


def dumps(spark):
    files = spark.createDataFrame([(1, 5, 10, "x"), (3, 5, 30, "x"), (2, 5, 20, "x"), (4, 6, 1, "x"), (7, None, 1, "x"), (8, 6, 2, "x")], "dump_id bigint, station_id bigint, dumped_at bigint, path string")
    rows = []
    for dump, name in ((1, "Date"), (2, "date_taken"), (3, "date_taken")):
        for k in range(5):
            rows.append((dump, k, k, json.dumps({name: f"2020:01:0{k + 1} 00:00:00", "n": k if dump < 3 else str(k), **({"gone": 1} if dump == 1 else {})})))
    rows += [(1, 9, 0, json.dumps({"Date": "2020:01:01 00:00:00", "n": 0, "gone": 1})), (4, 0, 0, "broken {"), (4, 1, 1, None), (4, 2, 2, "[1]"), (9, 0, 0, '{"z": 1}'), (3, 7, None, '{"n": "7"}')]
    return files, spark.createDataFrame(rows, "dump_id bigint, line_no int, file_key bigint, record_json string")


def test_changes_and_table(spark):
    files, records = dumps(spark)
    changes = schema_changes(records, files)
    found = sorted((r.dump_id, r.kind, r.path, r.new_path) for r in changes.collect())
    assert found == [(2, "removed", "gone", ""), (2, "renamed", "Date", "date_taken"), (3, "retyped", "n", "n")]
    schemas = file_schemas(records, "dump_id", "record_json")
    common = common_names(changes, schemas)
    names = {r.name: r.common for r in common.collect()}
    assert names["Date"] == names["date_taken"] == "date_taken"
    table = one_table(records, common, projections(schemas, common, "dump_id"), {"taken": "Date"})
    assert table.count() == records.count()
    assert {r.taken for r in table.where("dump_id in (1, 2, 3) and file_key = 2").collect()} == {"2020:01:03 00:00:00"}
    assert table.where("dump_id = 4 and taken is null").count() == 3
    assert schema_changes(records.limit(0), files).count() == 0
    assert schema_changes(records, files.limit(0)).count() == 0


def test_two_names_in_one_record_keep_both_values(spark):
    files = spark.createDataFrame([(1, 5, 10), (2, 5, 20), (3, 6, 10)], "dump_id bigint, station_id bigint, dumped_at bigint")
    rows = [(d, k, k, json.dumps({n: f"v{k}"})) for d, n in ((1, "X"), (2, "Y")) for k in range(4)] + [(3, 0, 0, '{"X": "x", "Y": "y", "Z": null}'), (3, 1, 1, '{"X": "only"}')]
    records = spark.createDataFrame(rows, "dump_id bigint, line_no int, file_key bigint, record_json string")
    schemas = file_schemas(records, "dump_id", "record_json")
    common = common_names(schema_changes(records, files), schemas)
    table = one_table(records, common, projections(schemas, common, "dump_id"), {"value": "Y"})
    assert {(r.dump_id, r.line_no, r.value, r.fields) for r in table.where("dump_id = 3").collect()} in ({(3, 0, "x", '{"Y": "y"}'), (3, 1, "only", "{}")}, {(3, 0, "y", '{"X": "x"}'), (3, 1, "only", "{}")})
    assert {r.value for r in table.where("dump_id < 3").collect()} == {"v0", "v1", "v2", "v3"}


def test_names_united_by_joins(spark, monkeypatch):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) if i != 9] + [("n03", "n01")], "a string, b string")
    found = {r.name: r.label for r in drift._united(links).collect()}
    monkeypatch.setattr(drift, "DRIVER_LINKS", 0)
    assert {r.name: r.label for r in drift._united(links).collect()} == found and set(found.values()) == {"n00", "n10"}


def test_renames_beneath_a_renamed_node():
    a, b = {"o": "object", f"o{STEP}x": "string"}, {"p": "object", f"p{STEP}y": "string"}
    assert edits(a, b, {("o", "p"): 1.0, (f"o{STEP}x", f"p{STEP}y"): 1.0}.items()) == [("renamed", "o", "p"), ("renamed", "o/x", "p/y")]


def test_previous_over_partitions(spark):
    files = spark.range(0, 500).selectExpr("id as dump_id", "id % 3 as station_id", "500 - id as dumped_at")
    found = {r.dump_id: r.prev_dump_id for r in with_previous(files, "station_id", ("dumped_at",), "dump_id").collect()}
    assert len(found) == 500 and all(found[i] == (i + 3 if i + 3 < 500 else None) for i in range(500))


def test_plain_text():
    assert [plain_text(x) for x in (["a"], {"name": "b"}, [], None, 20110112235204, 3.5, True, ["a", "b"])] == ["a", "b", None, None, "2011:01:12 23:52:04", "3.5", "true", '["a", "b"]']
