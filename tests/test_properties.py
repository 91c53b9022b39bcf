"""Property tests: order-dependent operators equal sequential simulators."""

import datetime as dt

import numpy as np
from hypothesis import example, given, settings, strategies as st

from pyspark.sql import functions as F

from stockledger.config import Params
from stockledger.operators import debounce, lifecycle
from stockledger.operators.ledger import running_on_hand

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("event_id string, event_ts timestamp_ntz, event_type string, station_id string, barcode_raw string, "
          "item_id string, qty int, user_email string")


def _frame(spark, evs):
    rows = [(f"e{i:04d}", T0 + dt.timedelta(seconds=t), typ, "S", code, item, q, None)
            for i, (t, typ, code, item, q) in enumerate(evs)]
    return spark.createDataFrame(rows, SCHEMA)


def sim_debounce(evs, w):
    last, kept = {}, set()
    for i, (t, _, code, _, _) in sorted(enumerate(evs), key=lambda x: (x[1][0], f"e{x[0]:04d}")):
        if code not in last or t - last[code] >= w:
            last[code] = t
            kept.add(f"e{i:04d}")
    return kept


def sim_lifecycle(evs, rp=10):
    out, bal, open_ = [], {}, {}
    for i, (t, typ, _, item, q) in sorted(enumerate(evs), key=lambda x: (x[1][0], f"e{x[0]:04d}")):
        b = bal.get(item, 0) + (q if typ == "INTAKE" else -q)
        bal[item] = b
        if typ == "CONSUME" and b <= rp and item not in open_:
            open_[item] = b
            out.append(("OPEN", item, b, f"e{i:04d}"))
        elif typ == "INTAKE" and b > rp and item in open_:
            out.append(("FULFILLED", item, open_.pop(item), f"e{i:04d}"))
    return sorted(out)


events = st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["INTAKE", "CONSUME"]),
                            st.sampled_from(["c1", "c2"]), st.sampled_from(["X", "Y"]), st.integers(1, 12)),
                  min_size=1, max_size=25)


@settings(max_examples=8, deadline=None)
@given(events, st.sampled_from([1, 3, 5]))
def test_debounce_equals_simulator(spark, evs, w):
    df = _frame(spark, evs)
    exp = sim_debounce(evs, w)
    for m in (1 << 20, 3):      # whole keys, and keys split into cells of about three scans
        got = {r.event_id for r in debounce.debounce(df, float(w), params=Params(scan_cell_rows=m)).select("event_id").collect()}
        assert got == exp


@settings(max_examples=8, deadline=None)
@given(events)
def test_lifecycle_equals_simulator(spark, evs):
    df = _frame(spark, evs)
    p = Params(scan_cell_rows=4)
    got = sorted((r.status, r.item_id, r.triggered_at_qty, r.trigger_event_id)
                 for r in lifecycle.signal_lifecycle(df, None, p).collect())
    assert got == sim_lifecycle(evs)


@settings(max_examples=5, deadline=None)
@given(events)
def test_split_running_equals_whole(spark, evs):
    df = _frame(spark, evs + evs[:3]).withColumn("event_ts", F.when(~F.col("event_id").endswith("3"), F.col("event_ts")))
    a = {r.event_id: r.on_hand_qty for r in running_on_hand(df, Params(scan_cell_rows=3)).collect()}
    b = {r.event_id: r.on_hand_qty for r in running_on_hand(df).collect()}
    assert a == b and len(a) == len(evs) + len(evs[:3])      # scans without a time are kept, first in order


def _walk(t, last, w):
    """Last kept time after the scans at ``t``, starting from ``last`` (None: nothing kept yet)."""
    for x in t:
        if last is None or x - last >= w:
            last = x
    return last


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30), st.integers(1, 25))
def test_cell_effect_equals_the_rule(times, w):
    t = np.array(sorted(times), dtype=np.int64)
    until, gives, first = debounce.effect(t, debounce.session_starts(t, None, w), w)
    assert first == _walk(t, None, w)
    for last in range(int(t[0]) - w + 1, int(t[0]) + 1):      # starting states whose next scan goes on the session
        if not until:
            got = gives[0]
        else:
            i = int(np.searchsorted(until, last + w))
            got = gives[i] if i < len(gives) else last
        assert got == _walk(t, last, w)


@settings(max_examples=6, deadline=None)
@given(events, st.integers(0, 40))
def test_incremental_replay_equals_full(spark, evs, cut_s):
    df = _frame(spark, evs)
    cut = T0 + dt.timedelta(seconds=cut_s)
    p = Params(scan_cell_rows=4)
    full = sorted(tuple(r) for r in lifecycle.signal_lifecycle(df, None, p).collect())
    before, after = df.filter(F.col("event_ts") < F.lit(cut)), df.filter(F.col("event_ts") >= F.lit(cut))
    first = lifecycle.signal_lifecycle(before, None, p)
    state = lifecycle.lifecycle_state(before, first, F.lit(cut))
    second = lifecycle.signal_lifecycle(after, None, p, initial=state)
    assert sorted(tuple(r) for r in first.unionByName(second).collect()) == full


def sim_adjacent(evs, w):
    """Per station: drop a scan equal to the last kept code and less than w later."""
    last, kept = {}, set()
    for i, (t, st_, code) in sorted(enumerate(evs), key=lambda x: (x[1][0], f"e{x[0]:04d}")):
        lc = last.get(st_)
        if lc is None or code != lc[0] or t - lc[1] >= w:
            last[st_] = (code, t)
            kept.add(f"e{i:04d}")
    return kept


adjacent_events = st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["S1", "S2"]),
                                     st.sampled_from(["A", "B"])), min_size=1, max_size=25)


@settings(max_examples=4, deadline=None)
@given(adjacent_events, st.sampled_from([2, 3, 6]))
@example(evs=[(0, "S1", "A"), (0, "S1", "B")], w=2)   # two codes at one instant
def test_debounce_adjacent_equals_simulator(spark, evs, w):
    rows = [(f"e{i:04d}", T0 + dt.timedelta(seconds=t), "INTAKE", stn, code, "X", 1, None)
            for i, (t, stn, code) in enumerate(evs)]
    df = spark.createDataFrame(rows, SCHEMA)
    for m in (1 << 20, 3):
        got = {r.event_id for r in debounce.debounce_adjacent(df, w * 1000, params=Params(scan_cell_rows=m)).select("event_id").collect()}
        assert got == sim_adjacent(evs, w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30), st.lists(st.integers(0, 40), min_size=1, max_size=12)), min_size=1, max_size=8), st.integers(1, 9))
def test_walk_of_many_keys_at_once(cells, w):
    """Several keys in one call, some going on from a kept time, give what each gives alone."""
    t, start, at, lasts, want = [], [], [], [], []
    for goes_on, back, times in cells:
        times, last = sorted(times), None
        if goes_on and times[0] - (times[0] - back % w) < w:
            last = times[0] - back % w
            at.append(len(t))
            lasts.append(last)
        for i, x in enumerate(times):
            start.append(last is None if i == 0 else x - times[i - 1] >= w)
            t.append(x)
            keep = last is None or x - last >= w
            want.append(keep)
            last = x if keep else last
    kept, _ = debounce.walk_on(np.array(t, dtype=np.int64), np.array(start), w, np.array(at, dtype=np.int64), np.array(lasts, dtype=np.int64))
    assert kept.tolist() == want
