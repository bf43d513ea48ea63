import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.operators.asof import FOREVER, as_known_at, known_periods, top_periods


def expected(versions, t):
    """The definition, row by row."""
    counted = {}
    for n, (vf, vt, rec) in enumerate(versions):
        if rec <= t and (vf not in counted or (rec, n) > counted[vf][:2]):
            counted[vf] = (rec, n, vt)
    best = [(vf, n) for vf, (_, n, vt) in counted.items() if vf <= t and (vt is None or t < vt)]
    return max(best)[1] if best else None


VERSION = st.tuples(st.integers(0, 8), st.one_of(st.none(), st.integers(0, 10)), st.integers(0, 10))


@settings(max_examples=300, deadline=None)
@given(st.lists(VERSION, min_size=1, max_size=8))
def test_sweep_equals_definition(versions):
    vf, rec = (np.array([v[i] for v in versions], np.int64) for i in (0, 2))
    vt = np.array([FOREVER if v[1] is None else v[1] for v in versions], np.int64)
    e = np.zeros(len(vf), np.int64)
    order, start, end = known_periods(e, vf, vt, rec, np.arange(len(vf)))
    be, bt, br = top_periods(e, start, end, vf[order], order)
    for t in range(12):
        at = np.searchsorted(bt, t, side="right") - 1
        got = int(br[at]) if at >= 0 and br[at] >= 0 else None
        assert got == expected(versions, t)


EV, VE = "eid string, entity string, t long, row_id string", "row_id string, entity string, vf long, vt long, rec long, t long, event_id string"
ARGS = {"event_id": "eid", "event_key": "entity", "event_time": "t", "row_id": "row_id", "row_key": "entity", "valid_from": "vf", "valid_to": "vt", "recorded": "rec"}


def test_nulls_repeats_and_empty(spark):
    ve = [("v1", "e", 0, None, 1, 0, ""), ("v1", "e", 0, None, 1, 0, ""), ("v2", "e", 5, 8, 9, 0, ""), ("v3", None, 0, None, 0, 0, ""), ("v4", "e", None, None, 0, 0, ""), ("v5", "e", 0, None, None, 0, "")]
    ev = [("a", "e", 0, "x"), ("b", "e", 3, "x"), ("b", "e", 3, "x"), ("c", "e", 10, "x"), ("d", None, 3, "x"), ("f", "e", None, "x"), ("g", "zz", 3, "x")]
    e, v = spark.createDataFrame(ev, EV), spark.createDataFrame(ve, VE)
    assert rows(as_known_at(e, v, **ARGS)) == [("b", "v1"), ("c", "v1")]
    assert rows(as_known_at(e.limit(0), v, **ARGS)) == [] == rows(as_known_at(e, v.limit(0), **ARGS))


def test_hot_entity_sliced_like_unsliced(spark):
    rng = random.Random(3)
    versions = [(f"v{i:03d}", "hot", rng.randrange(100), rng.choice([None, rng.randrange(120)]), rng.randrange(120), 0, "") for i in range(120)]
    events = [(f"e{i:03d}", "hot", rng.randrange(130), "") for i in range(150)]
    e, v = spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE)
    want = []
    for eid, _, t, _ in events:
        n = expected([(x[2], x[3], x[4]) for x in versions], t)
        want += [] if n is None else [(eid, versions[n][0])]
    assert rows(as_known_at(e, v, **ARGS)) == sorted(want)
    assert rows(as_known_at(e, v, slice_rows=20, **ARGS)) == sorted(want)
    assert rows(as_known_at(e, v, slice_rows=5, **ARGS)) == sorted(want)


def test_hot_instants_are_dealt(spark):
    versions = [("v1", "hot", 0, None, 0, 0, ""), ("v2", "hot", 5, 7, 9, 0, ""), ("v3", "hot", 5, None, 9, 0, "")] + [(f"w{i}", "hot", 10 + i, None, 12 + i, 0, "") for i in range(30)]
    events = [(f"e{i:03d}", "hot", 20, "") for i in range(90)] + [("f", "hot", 9, ""), ("g", "hot", 4, "")]
    e, v = spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE)
    whole = rows(as_known_at(e, v, **ARGS))
    assert whole[0] == ("e000", "w8") and whole[-2:] == [("f", "v3"), ("g", "v1")] and len(whole) == 92
    assert rows(as_known_at(e, v, slice_rows=5, **ARGS)) == whole
