import math

import pyarrow as pa
import pytest

from keyorder.operators import arrow


class Log(arrow.Group):
    def open(self, key):
        self.key, self.seen = key, []
        return ()

    def rows(self, rows):
        self.seen += rows
        return ()

    def close(self):
        return ((self.key, self.seen),)


def batches(*parts):
    return iter([pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in p], pa.schema([("k", pa.string()), ("v", pa.int64())])) for p in parts])


def test_groups_of_a_stream():
    found = list(arrow.stream(batches([("a", 1), ("a", 2)], [("a", 3), ("b", 4)], [], [("b", 5)]), 1, Log))
    assert found == [(("a",), [(1,), (2,), (3,)]), (("b",), [(4,), (5,)])]


def test_no_rows():
    assert list(arrow.stream(batches(), 1, Log)) == []
    assert list(arrow.stream(batches([]), 1, Log)) == []


def test_null_first_key_is_a_group():
    assert list(arrow.stream(batches([(None, 1), (None, 2), ("a", 3)]), 1, Log)) == [((None,), [(1,), (2,)]), (("a",), [(3,)])]


def test_keys_that_return_are_new_groups():
    assert [k for k, _ in arrow.stream(batches([("a", 1), ("b", 2), ("a", 3)]), 1, Log)] == [("a",), ("b",), ("a",)]


@pytest.mark.parametrize("a, b, same", [((1,), (1,), True), ((None,), (None,), True), ((math.nan,), (math.nan,), True), ((None,), (0,), False), ((math.nan,), (0.0,), False), ((0.0,), (-0.0,), True)])
def test_same_key(a, b, same):
    assert arrow.same_key(a, b) is same


@pytest.mark.parametrize(
    "kind, values",
    [
        (pa.float64(), [None, None, math.nan, math.nan, -0.0, 0.0, 1.0]), (pa.string(), ["", None, None, "a", "a", "b"]), (pa.int32(), [1]),
        (pa.bool_(), [False, False, None, True]), (pa.struct([("x", pa.int8())]), [None, {"x": None}, {"x": None}, {"x": 1}]), (pa.list_(pa.int8()), [[], [], None, [1]]),
    ],
)
def test_changes_are_those_of_same_key(kind, values):
    column = pa.array(values, kind)
    assert arrow.changed(column).tolist() == [not arrow.same_key((a,), (b,)) for a, b in zip(values, values[1:])]
