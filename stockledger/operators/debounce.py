"""Repeated-scan removal with the exact "last accepted scan" rule.

A scan is kept iff no scan of the same key was kept before it, or the last
kept one is at least ``window`` older.  A dropped scan does not move the
clock, so a plain ``lag`` rule is wrong (0, 2, 4, 7 s keeps 0, 4, 7).  Scans
without a time are kept and do not move the clock.

The rule is sequential, so it runs as one ordered pass over Arrow batches:
scans are dealt by (key, cell) and sorted by (time, id) -- the only exchange --
and each task walks its rows with a key's last kept time as its whole state.
A session is never collected; its length does not matter.  All keys of a batch
are decided together: rows a gap of at least ``window`` apart by array
comparison, and the sessions that last a window or more step from kept scan to
kept scan side by side, so a key of few scans costs no call of its own.

Keys over ``scan_cell_rows`` scans are split into cells (see ``ordered``).  A
cell's effect on the last kept time depends on what it is at the cell's start;
its summary is that function, a step function of few steps (a constant when a
gap lies inside the cell).  Composing the summaries of a key in order gives
every cell its starting state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from stockledger.config import DEFAULT, Params
from stockledger.operators.ordered import CELL, join_on_keys, micros, stored, with_cells

_MICRO = 1_000_000
_NONE = np.iinfo(np.int64).min


def changes(cols: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns (NULL equals NULL); row 0 does."""
    n = len(cols[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in cols:
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        out[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return out


def walk(t: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Kept flags of timed scans in order, one session after the other, of any number of keys.

    ``start`` marks scans that begin a session (always kept); the first scan does.
    """
    kept = start.copy()
    heads = np.flatnonzero(start)
    ends = np.append(heads[1:], len(t))
    # a session shorter than the window keeps its first scan only; all others are stepped through at once
    long = t[ends - 1] - t[heads] >= window if len(t) else np.zeros(0, dtype=bool)
    at, end = heads[long], ends[long]
    if len(at):
        # the sessions' times laid end to end, so that one search serves them all
        gaps = np.diff(t, prepend=t[:1])
        gaps[heads] = window
        line = np.cumsum(gaps)
        while len(at):
            at = np.searchsorted(line, line[at] + window)
            inside = at < end
            at, end = at[inside], end[inside]
            kept[at] = True
    return kept


def walk_on(t: np.ndarray, start: np.ndarray, window: int, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
    """As ``walk``, where the scans at the places ``at`` go on from the kept times ``last``; also the last kept time of all."""
    t, start = np.insert(t, at, last), np.insert(start, at, True)
    kept = walk(t, start, window)
    own = np.ones(len(t), dtype=bool)
    own[at + np.arange(len(at))] = False
    return kept[own], int(t[np.flatnonzero(kept)[-1]])


def effect(t: np.ndarray, start: np.ndarray, window: int) -> tuple[list[int], list[int], int]:
    """A cell's last kept time as a function of the one before it, when its first scan begins no session.

    Returns (until, gives, first): starting from ``last``, the first entry with
    ``last + window <= until`` gives the result; past all entries ``last``
    stays.  ``first`` is the result when its first scan does begin a session.
    """
    inner = np.flatnonzero(start[1:]) + 1
    end = int(t[inner[-1]:][walk(t[inner[-1]:], start[inner[-1]:], window)][-1]) if len(inner) else None
    head = int(inner[0]) if len(inner) else len(t)
    if end is not None:
        return [], [end], end          # constant: a session begins inside
    nxt = np.searchsorted(t, t + window)
    gives = t.tolist()
    for i in range(len(t) - 1, -1, -1):
        if nxt[i] < len(t):
            gives[i] = gives[nxt[i]]
    last = np.append(np.flatnonzero(np.diff(gives)), head - 1)      # last place of every step
    return t[last].tolist(), [gives[i] for i in last.tolist()], gives[0]


def _runs(df: DataFrame, keys: list[str], order: list[str], break_on: str | None) -> DataFrame:
    """Scans dealt by (key, cell), in order; helper columns first."""
    cell = [*keys, CELL]
    spare = [F.col(break_on).alias("__code")] if break_on else []
    src = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(cell)], micros(order[0]).alias("__t"), *spare,
                    *[c for c in df.columns if c != CELL])
    dealt = [f"__k{i}" for i in range(len(cell))]
    return src.repartition(*dealt).sortWithinPartitions(*dealt, "__t", F.col(order[1]))


def _new_cells(b: pa.RecordBatch, n_keys: int, tail: list[pa.Array] | None) -> tuple[np.ndarray, list[pa.Array]]:
    """Whether each row begins a cell, ``tail`` being the keys of the row before the batch; the keys of its last row."""
    head = b.columns[:n_keys]
    new = changes(head) if tail is None else changes([pa.concat_arrays([x, c]) for x, c in zip(tail, head)])[1:]
    return new, [c.slice(b.num_rows - 1, 1) for c in head]


def _stretches(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, int, int, bool]]:
    """(batch, first row, end row, whether a new cell begins) of every stretch of one cell within a batch."""
    tail = None
    for b in batches:
        if not b.num_rows:
            continue
        new, tail = _new_cells(b, n_keys, tail)
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(new), [b.num_rows]))).tolist()
        for s, e in zip(cuts, cuts[1:]):
            yield b, s, e, bool(new[s])


def _timed(b: pa.RecordBatch, s: int, e: int) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """Places, times and codes of a stretch's timed rows."""
    t = b.column("__t").slice(s, e - s)
    places = np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False))
    coded = "__code" in b.schema.names
    return (places, t.drop_null().to_numpy(zero_copy_only=False).astype(np.int64),
            b.column("__code").slice(s, e - s).take(pa.array(places)) if coded else None)


def session_starts(t: np.ndarray, codes: pa.Array | None, window: int) -> np.ndarray:
    """Whether each timed row begins a session after the one before; the first does."""
    start = np.ones(len(t), dtype=bool)
    start[1:] = np.diff(t) >= window
    return start | changes([codes]) if codes is not None and len(t) else start


def debounce(scans: DataFrame, window_s: float | None = None, keys: Sequence[str] = ("barcode_raw",),
             params: Params = DEFAULT, *, id_col: str = "event_id", ts_col: str = "event_ts",
             with_flag: bool = False, initial: DataFrame | None = None,
             break_on: str | None = None) -> DataFrame:
    """Kept scans (or all scans with a ``kept`` flag when ``with_flag``).

    ``break_on``: a change of this column from the key's previous scan also
    begins a session.  ``initial`` (keys + ``last_kept_ts``, e.g. from
    ``debounce_state``) continues an earlier run: each key's last kept scan
    enters as a seed row before the new scans -- it is first in its session,
    hence kept -- and is dropped from the output.
    """
    window = int(round((params.debounce_seconds if window_s is None else window_s) * _MICRO))
    keys = list(keys)
    cols = scans.columns
    if initial is not None:
        seeds = initial.select(*keys, F.col("last_kept_ts").alias(ts_col),
                               *[F.lit("" if c == id_col else None).cast(scans.schema[c].dataType).alias(c)
                                 for c in cols if c not in keys and c != ts_col])
        kept = debounce(scans.withColumn("__seed", F.lit(False)).unionByName(
            seeds.select(*cols).withColumn("__seed", F.lit(True))), window_s, keys, params,
            id_col=id_col, ts_col=ts_col, with_flag=True)
        kept = kept.filter(~F.col("__seed")).drop("__seed")
        return kept if with_flag else kept.filter(F.col("kept")).drop("kept")

    order = [ts_col, id_col]
    cells = with_cells(scans, keys, order, params.scan_cell_rows)
    n_keys = len(keys) + 1
    if cells.split is not None:
        df = join_on_keys(cells.rows, _entries(cells.split, keys, order, break_on, window), [*keys, CELL], "left")
    else:
        df = cells.rows.withColumns({"__last": F.lit(None).cast("bigint"), "__goes_on": F.lit(False)})

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All cells of a batch at once.  Across batches: keys of the last row; of its cell, if a timed scan of it
        has come: last kept time, time and code of that scan."""
        tail, open_cell = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new, tail = _new_cells(b, n_keys, tail)
            cell = np.cumsum(new)
            if new.any() and cell[0]:
                open_cell = None
            places, t, codes = _timed(b, 0, b.num_rows)
            kept = np.ones(b.num_rows, dtype=bool)
            if len(t):
                own = cell[places]
                first = np.ones(len(t), dtype=bool)
                first[1:] = own[1:] != own[:-1]
                start = session_starts(t, codes, window) | first
                heads = np.flatnonzero(first)
                enters = b.column("__goes_on").take(pa.array(places[heads])).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                last = b.column("__last").take(pa.array(places[heads])).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
                if own[0] == 0 and open_cell is not None:
                    last[0], prev, code = open_cell
                    enters[0] = t[0] - prev < window and (codes is None or codes[0].as_py() == code)
                start[heads] = ~enters
                kept[places], clock = walk_on(t, start, window, heads[enters], last[enters])
                open_cell = (clock, int(t[-1]), codes[-1].as_py() if codes is not None else None) if own[-1] == cell[-1] else None
            elif new.any():
                open_cell = None
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(kept)], [*cols, "kept"])

    schema = StructType([*scans.schema.fields, StructField("kept", BooleanType())])
    out = _runs(df, keys, order, break_on).mapInArrow(flag, schema)
    return out if with_flag else out.filter(F.col("kept")).drop("kept")


def _entries(split: DataFrame, keys: list[str], order: list[str], break_on: str | None, window: int) -> DataFrame:
    """(keys, cell, __last, __goes_on): the last kept time before each cell of the split keys, and whether
    the cell's first scan continues a session."""
    cell = [*keys, CELL]
    names = [f"__k{i}" for i in range(len(cell))]
    ddl = ", ".join(f"{n} {split.schema[k].dataType.simpleString()}" for n, k in zip(names, cell))
    code = split.schema[break_on].dataType.simpleString() if break_on else "string"
    split = split.select(*dict.fromkeys([*cell, *order, *([break_on] if break_on else [])]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per cell; a cell's times (about scan_cell_rows) are held together."""
        own, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if own is None or not parts:
                return
            t = np.concatenate([p[0] for p in parts])
            codes = pa.concat_arrays([p[1] for p in parts]) if break_on else pa.nulls(len(t), pa.string())
            until, gives, first = effect(t, session_starts(t, codes if break_on else None, window), window)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([t[0]]), pa.array([t[-1]]), codes.slice(0, 1), codes.slice(len(t) - 1, 1),
                 pa.array([until], longs), pa.array([gives], longs), pa.array([first], pa.int64())],
                [*names, "t0", "t1", "c0", "c1", "until", "gives", "first"])

        for b, s, e, new_cell in _stretches(batches, len(cell)):
            if new_cell:
                yield from done()
                own, parts = [c.slice(s, 1) for c in b.columns[:len(cell)]], []
            _, t, codes = _timed(b, s, e)
            if len(t):
                parts.append((t, codes))
        yield from done()

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        """Starting states of one key's cells (its rows / scan_cell_rows of them), in order."""
        g = g.sort_values(names[-1])
        last, before, rows = None, None, []
        for r in g.to_dict("records"):
            same = break_on is None or (before is not None and (r["c0"] == before["c1"] or (pd.isna(r["c0"]) and pd.isna(before["c1"]))))
            goes_on = before is not None and r["t0"] - before["t1"] < window and same
            rows.append((last if goes_on else None, goes_on))
            if not goes_on:
                last = int(r["first"])
            elif not len(r["until"]):
                last = int(r["gives"][0])
            elif (i := int(np.searchsorted(r["until"], last + window))) < len(r["gives"]):
                last = int(r["gives"][i])
            before = r
        return g[names].assign(__last=pd.array([x for x, _ in rows], dtype="Int64"), __goes_on=[x for _, x in rows])

    cells = _runs(split, keys, order, break_on).mapInArrow(
        summarise, f"{ddl}, t0 long, t1 long, c0 {code}, c1 {code}, until array<long>, gives array<long>, first long")
    found = stored(cells.groupBy(*names[:-1]).applyInPandas(compose, f"{ddl}, __last long, __goes_on boolean"), "debounce-cells")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, cell)], "__last", "__goes_on")


def debounce_state(kept: DataFrame, keys: Sequence[str] = ("barcode_raw",), ts_col: str = "event_ts") -> DataFrame:
    """Per key, the time of the last kept scan (state to continue with ``initial=``)."""
    return kept.groupBy(*keys).agg(F.max(ts_col).alias("last_kept_ts")).where("last_kept_ts is not null")


def debounce_adjacent(scans: DataFrame, window_ms: int = 3000, station_col: str = "station_id",
                      params: Params = DEFAULT, *, id_col: str = "event_id", ts_col: str = "event_ts",
                      code_col: str = "barcode_raw") -> DataFrame:
    """E5: per station, drop a scan equal to the last kept code and < window later;
    any other code resets.  The first scan after a code change is always kept
    (its code differs from the last kept one), so a code change simply starts a
    new session: this is E4 keyed by station with one more session break."""
    return debounce(scans, window_ms / 1000.0, keys=[station_col], params=params, id_col=id_col,
                    ts_col=ts_col, break_on=code_col)
