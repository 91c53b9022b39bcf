"""Analyst questions over the gold / silver layers.

``as_of`` defaults to the newest event time of the input, taken as a scalar
subquery (planned once, no driver round trip), so results are repeatable.
Questions about a few days take ``as_of`` as a literal (``newest_event``): their
bounds on ``event_ts`` then reach the source, which skips row groups and
folders outside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockledger.config import DEFAULT, Params
from stockledger.functions.columns import seconds_between, stock_status
from stockledger.operators.latest import latest_signals, signal_order


AsOf = str | dt.datetime | Column | None


def as_of_col(scans: DataFrame, as_of: AsOf = None) -> Column:
    if as_of is not None:
        return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz")
    return scans.agg(F.max("event_ts")).scalar()


def newest_event(scans: DataFrame, by_folder: bool = False) -> Column:
    """The newest event time as a literal: one row from an aggregate over one column and those of the quality rules.

    ``by_folder``: the log is stored by ``event_date``, so only its last folder is read.
    """
    if by_folder:
        scans = scans.filter(F.col("event_date") == scans.agg(F.max("event_date")).scalar())
    return F.lit(scans.agg(F.max("event_ts").alias("t")).first()["t"]).cast("timestamp_ntz")


def days_between(silver: DataFrame, first: Column, last: Column | None = None) -> DataFrame:
    """Events from day ``first`` to day ``last`` (default: open), as bounds on the event time and on its date.

    A log stored by date prunes its folders by the one, any Parquet log its row groups by the other.
    """
    out = silver.filter((F.col("event_ts") >= first.cast("timestamp_ntz")) & (F.col("event_date") >= first))
    if last is None:
        return out
    return out.filter((F.col("event_ts") < F.date_add(last, 1).cast("timestamp_ntz")) & (F.col("event_date") <= last))


def signal_figures(signals: DataFrame, day: Column | None = None) -> DataFrame:
    """One row over one read of the log: rows, signals, those open now and, with ``day``, rows of each status that day."""
    on = F.lit(False) if day is None else F.to_date("created_ts") == day
    names = {"OPEN": "signals_opened", "ACKNOWLEDGED": "signals_acknowledged", "FULFILLED": "signals_fulfilled"}
    each = signals.groupBy("signal_id").agg(
        F.max_by("status", F.struct(*signal_order())).alias("status"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(on & (F.col("status") == s)).alias(n) for s, n in names.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return each.agg(total("n"), F.count("signal_id").alias("signals"), F.count_if(F.col("status") == "OPEN").alias("open_signals"),
                    *[total(n) for n in names.values()])


def _r(c: Column, d: int = 6) -> Column:
    return F.round(c, d)


# ---- filters on the stock summary (D1) --------------------------------------------------------

def items_at_or_below(inv: DataFrame, n: int = 10) -> DataFrame:
    """B11."""
    return inv.filter(F.col("on_hand_qty") <= n)


def stale_items(inv: DataFrame, scans: DataFrame, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """No activity within ``days`` before as_of."""
    cut = as_of_col(scans, as_of) - F.make_dt_interval(days=F.lit(days))
    return inv.filter(F.col("last_activity") < cut)


def depleting_items(inv: DataFrame) -> DataFrame:
    """B15."""
    return inv.filter(F.col("total_consumed") > F.col("total_intake"))


def balanced_items(inv: DataFrame) -> DataFrame:
    """B16."""
    return inv.filter(F.col("total_consumed") == F.col("total_intake"))


def urgent_open_signals(gold_open: DataFrame) -> DataFrame:
    """B13."""
    return gold_open.filter(F.col("current_on_hand") <= 0)


def closeable_signals(gold_open: DataFrame) -> DataFrame:
    """B14."""
    return gold_open.filter(F.col("already_restocked"))


# ---- signal analytics ------------------------------------------------------------------------

def _lifecycle_times(silver_signals: DataFrame) -> DataFrame:
    st = F.col("status")
    return silver_signals.groupBy("signal_id", "item_id").agg(
        F.min(F.when(st == "OPEN", F.col("created_ts"))).alias("opened_at"),
        F.min(F.when(st == "ACKNOWLEDGED", F.col("created_ts"))).alias("acknowledged_at"),
        F.min(F.when(st == "FULFILLED", F.col("created_ts"))).alias("fulfilled_at"))


def replenishment_sla(silver_signals: DataFrame) -> DataFrame:
    """First time in each status; seconds to fulfil and to acknowledge; fulfilled only."""
    lt = _lifecycle_times(silver_signals).filter(F.col("fulfilled_at").isNotNull())
    return lt.select("signal_id", "item_id", "opened_at", "acknowledged_at", "fulfilled_at",
                     seconds_between("fulfilled_at", "opened_at").alias("seconds_to_fulfill"),
                     seconds_between("acknowledged_at", "opened_at").alias("seconds_to_acknowledge"))


def mean_time_to_acknowledge(silver_signals: DataFrame) -> DataFrame:
    """Mean seconds from OPEN to ACKNOWLEDGED over acknowledged signals."""
    lt = _lifecycle_times(silver_signals).filter(F.col("acknowledged_at").isNotNull())
    return lt.agg(F.count(F.lit(1)).alias("acknowledged_signals"),
                  _r(F.avg(seconds_between("acknowledged_at", "opened_at")), 3).alias("avg_seconds_to_acknowledge"))


def frequent_low_items(silver_signals: DataFrame) -> DataFrame:
    """Every OPEN row (not only latest) by item, items with more than one signal."""
    return (silver_signals.filter(F.col("status") == "OPEN").groupBy("item_id")
            .agg(F.count_distinct("signal_id").alias("signal_count"),
                 _r(F.avg("qty_below_reorder")).alias("avg_qty_below"),
                 F.min("triggered_at_qty").alias("min_triggered_qty"))
            .filter(F.col("signal_count") > 1))


def signal_frequency(silver_signals: DataFrame) -> DataFrame:
    """Distinct signals per item."""
    return silver_signals.groupBy("item_id").agg(F.count_distinct("signal_id").alias("signal_count"))


def oldest_open_signals(gold_open: DataFrame, n: int = 10) -> DataFrame:
    """ascending top-k on creation time; severity from the shortfall at signal time."""
    return (gold_open.select("signal_id", "item_id", "created_ts", "qty_at_signal", "current_on_hand",
                             (F.col("reorder_point") - F.col("qty_at_signal")).alias("severity"))
            .orderBy(F.col("created_ts").asc(), F.col("signal_id")).limit(n))


# ---- scan analytics --------------------------------------------------------------------------

def consumption_rate(silver: DataFrame, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """Daily consumption per item over the last ``days`` days; mean over active days."""
    start = F.date_sub(F.to_date(as_of_col(silver, as_of)), days)
    daily = (days_between(silver, start).filter(F.col("event_type") == "CONSUME")
             .groupBy("item_id", "event_date").agg(F.sum("qty").alias("consumed_qty")))
    return daily.groupBy("item_id").agg(
        _r(F.avg("consumed_qty")).alias("avg_daily_consumption"),
        F.max("consumed_qty").alias("max_daily_consumption"),
        F.count_distinct("event_date").alias("active_days"))


def peak_hours(silver: DataFrame) -> DataFrame:
    """D7."""
    return silver.groupBy("event_hour").agg(
        F.count_if(F.col("event_type") == "INTAKE").alias("intake_events"),
        F.count_if(F.col("event_type") == "CONSUME").alias("consume_events"),
        F.count(F.lit(1)).alias("total_events"))


def usage_rate(silver: DataFrame, minutes: int = 15, as_of: AsOf = None) -> DataFrame:
    """Consumption per item in the ``minutes`` before as_of."""
    end = as_of_col(silver, as_of)
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    return (silver.filter((F.col("event_type") == "CONSUME") & (F.col("event_ts") > start)
                          & (F.col("event_ts") <= end))
            .groupBy("item_id").agg(F.sum("qty").alias("consumed_qty"),
                                    F.count(F.lit(1)).alias("consume_events")))


def time_since_last_scan(silver: DataFrame, as_of: AsOf = None) -> DataFrame:
    """D14."""
    end = as_of_col(silver, as_of)
    return silver.groupBy("item_id").agg(F.max("event_ts").alias("last_scan_ts")).select(
        "item_id", "last_scan_ts", seconds_between(end, F.col("last_scan_ts")).alias("seconds_since_last_scan"))


def total_units(inv: DataFrame) -> DataFrame:
    """D15."""
    return inv.agg(F.sum("on_hand_qty").alias("total_units"), F.count(F.lit(1)).alias("items"))


def stations_activity(silver: DataFrame) -> DataFrame:
    """D17."""
    return silver.groupBy("station_id").agg(F.count(F.lit(1)).alias("event_count"),
                                            F.sum("qty").alias("total_qty"))


def intake_vs_consume(silver: DataFrame, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """Per day in the window, the two sums and the net."""
    start = F.date_sub(F.to_date(as_of_col(silver, as_of)), days)
    intake = F.sum(F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(0))
    consume = F.sum(F.when(F.col("event_type") == "CONSUME", F.col("qty")).otherwise(0))
    return (days_between(silver, start).groupBy("event_date")
            .agg(intake.alias("intake_qty"), consume.alias("consume_qty"), (intake - consume).alias("net_qty")))


def unique_items_on(silver: DataFrame, day: str | None = None, as_of: AsOf = None) -> DataFrame:
    """Distinct items touched on ``day`` (default: the day before as_of)."""
    d = F.lit(day).cast("date") if day else F.date_sub(F.to_date(as_of_col(silver, as_of)), 1)
    return (days_between(silver, d, d)
            .agg(F.count_distinct("item_id").alias("unique_items"), F.count(F.lit(1)).alias("events"))
            .select(d.alias("day"), "unique_items", "events"))


def turnover_top_items(running: DataFrame, inv: DataFrame, n: int = 10) -> DataFrame:
    """Consumed / mean daily closing stock, top n.

    running: E2 output (event rows with on_hand_qty after each event).
    """
    closing = (running.groupBy("item_id", F.to_date("event_ts").alias("d"))
               .agg(F.max_by("on_hand_qty", F.struct("event_ts", "event_id")).alias("closing")))
    avg_close = closing.groupBy("item_id").agg(F.avg("closing").alias("avg_closing_stock"))
    j = inv.select("item_id", "total_consumed").join(avg_close, "item_id", "inner")
    return (j.select("item_id", "total_consumed", _r(F.col("avg_closing_stock")).alias("avg_closing_stock"),
                     _r(F.try_divide(F.col("total_consumed").cast("double"), F.col("avg_closing_stock")))
                     .alias("turnover"))
            .orderBy(F.col("turnover").desc_nulls_last(), F.col("item_id")).limit(n))


def daily_summary(silver: DataFrame, signals: DataFrame, day: str | None = None,
                  as_of: AsOf = None) -> DataFrame:
    """One row for ``day`` (default: as_of's day) -- activity and signal counts.

    One aggregate of each log; the signals' row comes in as a scalar subquery.
    """
    d = F.lit(day).cast("date") if day else F.to_date(as_of_col(silver, as_of))
    act = days_between(silver, d, d).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "INTAKE").alias("intake_events"),
        F.count_if(F.col("event_type") == "CONSUME").alias("consume_events"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "INTAKE", F.col("qty"))), F.lit(0)).cast("bigint")
        .alias("units_in"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "CONSUME", F.col("qty"))), F.lit(0)).cast("bigint")
        .alias("units_out"),
        F.count_distinct("item_id").alias("items_touched"))
    sig = signal_figures(signals, d)
    row = sig.select(F.struct(*sig.columns).alias("s")).scalar()
    return act.select(d.alias("day"), "*", row.alias("s")).select(
        "day", *act.columns, "s.signals_opened", "s.signals_acknowledged", "s.signals_fulfilled", "s.open_signals")


def demand_balance(silver: DataFrame, silver_signals: DataFrame) -> DataFrame:
    """Per week, intake - consume and signals opened - fulfilled (full outer join on week)."""
    wk = lambda c: F.to_date(F.date_trunc("week", F.col(c)))
    units = silver.groupBy(wk("event_ts").alias("week_start")).agg(
        F.sum(F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(0)).alias("intake_qty"),
        F.sum(F.when(F.col("event_type") == "CONSUME", F.col("qty")).otherwise(0)).alias("consume_qty"))
    sig = silver_signals.groupBy(wk("created_ts").alias("week_start")).agg(
        F.count_if(F.col("status") == "OPEN").alias("signals_opened"),
        F.count_if(F.col("status") == "FULFILLED").alias("signals_fulfilled"))
    j = units.join(sig, "week_start", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return j.select("week_start", z("intake_qty").alias("intake_qty"), z("consume_qty").alias("consume_qty"),
                    (z("intake_qty") - z("consume_qty")).alias("net_qty"),
                    z("signals_opened").alias("signals_opened"), z("signals_fulfilled").alias("signals_fulfilled"),
                    (z("signals_opened") - z("signals_fulfilled")).alias("backlog_change"))


def week_over_week(silver: DataFrame) -> DataFrame:
    """Weekly volumes by type against the previous week (window over few weeks per type)."""
    weekly = silver.groupBy(F.to_date(F.date_trunc("week", "event_ts")).alias("week_start"), "event_type") \
        .agg(F.count(F.lit(1)).alias("event_count"), F.sum("qty").alias("total_qty"))
    w = Window.partitionBy("event_type").orderBy("week_start")
    return weekly.select("week_start", "event_type", "event_count", "total_qty",
                         F.lag("event_count").over(w).alias("prev_event_count"),
                         F.lag("total_qty").over(w).alias("prev_total_qty"),
                         (F.col("event_count") - F.lag("event_count").over(w)).alias("event_count_change"))


def _day_spine(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY")))


def receiving_forecast(daily: DataFrame, window: int = 7) -> DataFrame:
    """Zero-filled daily intake and its trailing mean as next day's forecast.

    The calendar spine has one row per day of the covered span -- bounded by
    time, not by data volume -- so the ordered window over it is small.
    """
    intake = daily.filter(F.col("event_type") == "INTAKE").select("event_date", "total_qty")
    bounds = intake.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    spine = bounds.select(_day_spine(F.col("lo"), F.col("hi")).alias("event_date"))
    filled = spine.join(intake, "event_date", "left").select(
        "event_date", F.coalesce(F.col("total_qty"), F.lit(0).cast("bigint")).alias("intake_qty"))
    w = Window.orderBy("event_date").rowsBetween(-(window - 1), 0)
    return filled.select("event_date", "intake_qty",
                         F.date_add("event_date", 1).alias("forecast_date"),
                         _r(F.avg("intake_qty").over(w), 3).alias("forecast_qty"))


def daily_trend(daily: DataFrame, scans: DataFrame, event_type: str = "CONSUME", days: int = 30,
                as_of: AsOf = None) -> DataFrame:
    """Zero-filled series of the last ``days`` days for one event type."""
    if as_of is None:
        base = scans.agg(F.to_date(F.max("event_ts")).alias("__end"))
    else:
        base = scans.agg(F.to_date(F.lit(as_of)).alias("__end"))
    spine = base.select(_day_spine(F.date_sub("__end", days - 1), F.col("__end")).alias("event_date"))
    one = daily.filter(F.col("event_type") == event_type).select("event_date", "event_count", "total_qty")
    j = spine.join(one, "event_date", "left")
    return j.select("event_date", F.lit(event_type).alias("event_type"),
                    F.coalesce(F.col("event_count"), F.lit(0).cast("bigint")).alias("event_count"),
                    F.coalesce(F.col("total_qty"), F.lit(0).cast("bigint")).alias("total_qty"))


# ---- rankings --------------------------------------------------------------------------------

def lowest_stock(inv: DataFrame) -> DataFrame:
    """the summary by ascending stock (item as tie-break)."""
    return inv.select("item_id", "on_hand_qty", "total_intake", "total_consumed", "last_activity") \
        .orderBy("on_hand_qty", "item_id")


def top_stock(inv: DataFrame, n: int = 10) -> DataFrame:
    """F3."""
    return inv.select("item_id", "on_hand_qty").orderBy(F.col("on_hand_qty").desc(), "item_id").limit(n)


def high_velocity_items(inv: DataFrame, n: int = 10) -> DataFrame:
    """F4."""
    return inv.select("item_id", "total_consumed", "on_hand_qty") \
        .orderBy(F.col("total_consumed").desc(), "item_id").limit(n)


def busiest_days(daily: DataFrame, event_type: str | None = "INTAKE", month: str | None = None,
                 n: int = 10, scans: DataFrame | None = None) -> DataFrame:
    """top days by event count, optionally for one type and one month.

    ``month`` is ``yyyy-MM``, or ``"as_of"`` for the month of the newest event of ``scans``.
    """
    d = daily
    if event_type:
        d = d.filter(F.col("event_type") == event_type)
    if month == "as_of":
        d = d.filter(F.date_format("event_date", "yyyy-MM") == F.date_format(as_of_col(scans), "yyyy-MM"))
    elif month:
        d = d.filter(F.date_format("event_date", "yyyy-MM") == month)
    return d.select("event_date", "event_type", "event_count", "total_qty") \
        .orderBy(F.col("event_count").desc(), "event_date", "event_type").limit(n)


def stockout_risk(inv: DataFrame, rate: DataFrame, n: int = 10) -> DataFrame:
    """consuming items ranked by days of cover (stock / mean daily consumption)."""
    j = inv.select("item_id", "on_hand_qty").join(rate.select("item_id", "avg_daily_consumption"), "item_id")
    return (j.select("item_id", "on_hand_qty", "avg_daily_consumption",
                     _r(F.try_divide(F.col("on_hand_qty").cast("double"), F.col("avg_daily_consumption")))
                     .alias("days_of_cover"))
            .orderBy(F.col("days_of_cover").asc_nulls_last(), "item_id").limit(n))


def top_issues(inv: DataFrame, gold_open: DataFrame, risk: DataFrame, scans: DataFrame, n: int = 5,
               as_of: AsOf = None) -> DataFrame:
    """F8: ranked union of out-of-stock items, oldest open signals and fast-and-low items."""
    end = as_of_col(scans, as_of)
    oos = inv.filter(F.col("on_hand_qty") <= 0).select(
        F.lit(1).alias("priority"), F.lit("out_of_stock").alias("issue"), F.col("item_id").alias("ref_id"),
        (-F.col("on_hand_qty")).cast("double").alias("score"))
    old = gold_open.select(
        F.lit(2).alias("priority"), F.lit("old_open_signal").alias("issue"), F.col("signal_id").alias("ref_id"),
        seconds_between(end, F.col("created_ts")).alias("score"))
    low = risk.filter(F.col("days_of_cover").isNotNull()).select(
        F.lit(3).alias("priority"), F.lit("fast_and_low").alias("issue"), F.col("item_id").alias("ref_id"),
        (-F.col("days_of_cover")).alias("score"))
    return oos.unionByName(old).unionByName(low) \
        .orderBy("priority", F.col("score").desc(), "ref_id").limit(n)


def table_status(scans: DataFrame, signals: DataFrame) -> DataFrame:
    """Events, signal rows, distinct signals, open signals -- one row, one read of each log."""
    sig = signal_figures(signals)
    row = sig.select(F.struct(*sig.columns).alias("s")).scalar()
    return scans.agg(F.count(F.lit(1)).alias("total_events")).select("total_events", row.alias("s")).select(
        "total_events", F.col("s.n").alias("signal_rows"), F.col("s.signals").alias("distinct_signals"), "s.open_signals")


def dashboard_kpis(inventory: DataFrame, signals: DataFrame, reorder_point: int = 10) -> DataFrame:
    """Items, critical, low, open -- over all items (not a page)."""
    q = F.col("on_hand_qty")
    st = stock_status(q, q <= reorder_point)
    k = inventory.agg(F.count(F.lit(1)).alias("total_items"),
                      F.count_if(st == "critical").alias("critical_items"),
                      F.count_if(st == "low").alias("low_items"))
    open_now = latest_signals(signals).agg(F.count_if(F.col("status") == "OPEN")).scalar()
    return k.select("*", open_now.alias("open_signals"))


def data_freshness(scans: DataFrame, signals: DataFrame, as_of: AsOf = None) -> DataFrame:
    """G1: per log, latest time and staleness in seconds (each side aggregated before the union)."""
    end = as_of_col(scans, as_of)
    a = scans.agg(F.max("event_ts").alias("latest_event")).select(F.lit("scan_events").alias("table_name"), "*")
    b = signals.agg(F.max("created_ts").alias("latest_event")).select(
        F.lit("replenishment_signals").alias("table_name"), "*")
    u = a.unionByName(b)
    return u.select("table_name", "latest_event",
                    seconds_between(end, F.col("latest_event")).alias("staleness_seconds"))
