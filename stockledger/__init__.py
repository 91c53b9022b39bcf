"""stockledger: event-sourced inventory analytics as Spark DataFrame operators.

Two append-only logs -- stock movements (scan events) and replenishment
signals -- are turned into current and historical stock, the replayed life of
every signal, quality reports and operational analytics.  Every operator is a
plain function ``DataFrame(s) -> DataFrame``; Catalyst plans the work.
"""

from stockledger.config import Params

__all__ = ["Params"]
