"""Run parameters.

The business defaults below are fixed values taken over from the modelled
application: reorder point 10, reorder quantity 24, debounce window 3 seconds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # fixed business defaults
    reorder_point: int = 10
    reorder_qty: int = 24
    debounce_seconds: float = 3.0
    # analysis knobs
    as_of: str | None = None          # None -> max(event_ts) of the input
    # Ordered scans (running stock, lifecycle replay, debounce) split a key of more
    # rows than this into cells of about as many, so one hot item is spread over
    # many tasks (see operators/ordered.py).
    scan_cell_rows: int = 1 << 20

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()

# Fixed values of the modelled application: event types, signal statuses, and the
# alert's summary text.  STATUS_RANK is our tie-break between rows of one signal
# with the same created_ts (the later state wins).
EVENT_TYPES = ("INTAKE", "CONSUME")
SIGNAL_STATUSES = ("OPEN", "ACKNOWLEDGED", "FULFILLED")
ALERT_SUMMARY_FORMAT = "Replenishment Alert: %d open signals"
STATUS_RANK = {"OPEN": 1, "ACKNOWLEDGED": 2, "FULFILLED": 3}
