from __future__ import annotations

import json
from datetime import datetime

from corpusloom.operators import schema_drift as sd

T0 = datetime(2025, 1, 1)
COLS = "stream_name string, file_id bigint, recorded_at timestamp, arrived_at timestamp, content string, name string"


def at(day: int) -> datetime:
    return datetime(2025, 1, day)


def row(stream, i, day, content, arrived=None):
    text = content if content is None or isinstance(content, str) else json.dumps(content)
    return (stream, i, at(day), at(arrived or day), text, "clash")


def found(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return {(r.stream_name, r.file_id, r.change, r.field_path, r.new_path) for r in sd.schema_changes(df).collect()}


def test_layouts_are_one():
    a, b = {"name": "x", "n": 1}, {"name": "y", "n": 2}
    for text in (json.dumps([a, b]), json.dumps({"corpora": [a, b]}), f"{json.dumps(a)}\n{json.dumps(b)}\n", json.dumps([a, b], indent=2)):
        assert sd.parse_records(text) == [a, b]
    assert sd.parse_records(json.dumps(a)) == [a]
    for text in (None, "", "  \n", "[]", "not json", "[1, 2]", '"x"'):
        assert sd.parse_records(text) is None


def test_changes(spark):
    rows = [
        row("s", 1, 1, [{"name": "a", "v": {"p": "1.0"}, "k": 1, "gone": 1, "q": "t"}, {"name": "b", "v": {"p": "2.0"}, "k": 2, "q": "u"}]),
        row("s", 2, 2, [{"name": "a", "r": {"p": "1.0"}, "k": "1", "q": {"x": 1}, "new": None}, {"name": "c", "r": {"p": "9"}, "k": "3"}]),
    ]
    assert found(spark, rows) == {
        ("s", 2, "renamed", "v.p", "r.p"),
        ("s", 2, "type_changed", "k", ""),
        ("s", 2, "type_changed", "q", ""),
        ("s", 2, "removed", "gone", ""),
        ("s", 2, "added", "new", ""),
    }


def test_numbers_nulls_and_lists_are_no_change():
    assert sd.compare_files([{"name": "a", "n": 1, "m": None, "l": [1]}], [{"name": "a", "n": 1.5, "m": "x", "l": ["y"]}]) == []
    assert sd.compare_files([{"name": "a"}], [{"name": "a"}, {"name": "b"}]) == []


def test_object_that_turns_plain():
    assert sd.compare_files([{"name": "a", "v": {"x": 1, "y": 2}}], [{"name": "a", "v": "1.2"}]) == [("type_changed", "v", "", "object", "string")]


def test_rename_needs_the_same_values():
    assert {c[0] for c in sd.compare_files([{"name": "a", "x": 1}], [{"name": "a", "y": 2}])} == {"added", "removed"}
    assert {c[0] for c in sd.compare_files([{"name": "a", "x": 1}], [{"name": "b", "y": 1}])} == {"added", "removed"}


def test_order_redelivery_and_broken_files(spark):
    rows = [
        row("s", 3, 3, {"name": "a", "x": 1, "y": 1}, 9),
        row("s", 1, 1, {"name": "a", "x": 1}),
        row("s", 1, 1, {"name": "a", "x": 1}, 20),
        row("s", 2, 2, "{broken"),
        row("s", 4, 4, None),
        row("s", 5, 5, ""),
        row(None, 6, 1, {"name": "a"}),
        row(None, 7, 2, {"name": "a", "z": 1}),
        row("t", 8, 1, {"name": "a", "other": 1}),
    ]
    assert found(spark, rows) == {("s", 3, "added", "y", ""), (None, 7, "added", "z", "")}


def test_empty(spark):
    assert found(spark, []) == set()
    df = spark.createDataFrame([], COLS)
    assert sd.union_table(df).count() == 0


def test_promotion_is_a_lattice():
    kinds = list(sd.PROMOTION)
    for a in kinds:
        assert sd.promote(a, a) == a
        for b in kinds:
            assert sd.promote(a, b) == sd.promote(b, a)
            for c in kinds:
                assert sd.promote(sd.promote(a, b), c) == sd.promote(a, sd.promote(b, c))


def test_union_table(spark):
    rows = [
        row("s", 1, 1, [{"name": "a", "v": {"p": "1.0"}, "n": 1}, {"name": "b", "v": {"p": "2"}, "n": "x"}]),
        row("s", 2, 2, [{"name": "a", "r": {"p": "1.0"}, "n": 2.5, "l": [1, 2]}, {"name": "b", "r": {"p": "2"}}]),
    ]
    df = sd.union_table(spark.createDataFrame(rows, COLS))
    got = {(r.file_id, r.rec_key): r.asDict() for r in df.collect()}
    assert len(got) == 4
    assert got[1, "a"]["r__p"] == got[2, "a"]["r__p"] == "1.0"
    assert got[2, "a"]["n"] == "2.5"
    assert got[2, "a"]["l"] == "[1, 2]"
    assert got[2, "b"]["l"] is None
