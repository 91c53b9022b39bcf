"""Hand-written micro cases (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from stockledger.config import Params
from stockledger.functions import barcode, columns, slips
from stockledger.operators import debounce, ingest, latest, lifecycle

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def scans(spark, rows):
    """rows: (event_id, seconds, type, item, qty[, barcode, station])"""
    out = []
    for r in rows:
        eid, s, typ, item, qty = r[:5]
        code = r[5] if len(r) > 5 else f"ITEM={item};QTY={qty}"
        st = r[6] if len(r) > 6 else "S1"
        out.append((eid, at(s), typ, st, code, item, qty, None))
    return spark.createDataFrame(out, "event_id string, event_ts timestamp_ntz, event_type string, station_id string, "
                                      "barcode_raw string, item_id string, qty int, user_email string")


def test_barcode_cases(spark):
    cases = {
        "ITEM=PART-88219;QTY=24": ("PART-88219", 24, None),
        "  ITEM=12345;QTY=1\n": ("12345", 1, None),
        "ITEM= A B ;QTY=007": (" A B ", 7, None),
        "ITEM=A=B;QTY=3": ("A=B", 3, None),
        "ITEM=A;QTY=0": (None, None, "non_positive"),
        "ITEM=A;QTY=-1": (None, None, "bad_format"),
        "QTY=1;ITEM=A": (None, None, "bad_format"),
        "item=A;qty=1": (None, None, "bad_format"),
        "ITEM=;QTY=1": (None, None, "bad_format"),
        "ITEM=A;QTY=1;": (None, None, "bad_format"),
        "": (None, None, "bad_format"),
        "ITEM=A;QTY=99999999999": (None, None, "overflow"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "barcode_raw string")
    got = {r.barcode_raw: (r.parsed_item_id, r.parsed_qty, r.parse_error)
           for r in barcode.parse_barcodes(df).collect()}
    assert got == cases


def _kept(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_debounce_rule(spark):
    df = scans(spark, [("a", 0, "INTAKE", "X", 1), ("b", 2, "INTAKE", "X", 1), ("c", 4, "INTAKE", "X", 1),
                       ("d", 7, "INTAKE", "X", 1), ("e", 0, "INTAKE", "Y", 1), ("f", 3, "INTAKE", "Y", 1)])
    for m in (1 << 20, 1):  # whole keys and split keys
        assert _kept(debounce.debounce(df, 3.0, params=Params(scan_cell_rows=m))) == ["a", "c", "d", "e", "f"]


def test_debounce_one_plan_for_any_session(spark):
    """A session of 10^5 scans and lone scans: the same plan, one exchange, exact flags."""
    n = 100_000
    long = spark.range(n).selectExpr("cast(id AS string) AS event_id", "'L' AS barcode_raw",
                                     "timestampadd(MILLISECOND, cast(id AS int), timestamp_ntz'2024-01-01') AS event_ts")
    lone = spark.range(100).selectExpr("concat('s', id) AS event_id", "concat('S', id) AS barcode_raw", "timestamp_ntz'2024-01-01' AS event_ts")
    plans = []
    for df in (lone, long.unionByName(lone)):
        out = debounce.debounce(df, 3.0)
        plans.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        kept = out.where("barcode_raw = 'L'").count()
    assert plans == [1, 1] and kept == n // 3000 + 1
    split = debounce.debounce(long, 3.0, params=Params(scan_cell_rows=9000))
    assert split.count() == n // 3000 + 1


def test_debounce_keeps_scans_without_time_and_null_codes(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "C", None), ("c", None, at(0)), ("d", None, at(1)), ("e", "C", at(1)), ("f", "C", at(2))],
                               "event_id string, barcode_raw string, event_ts timestamp_ntz")
    for m in (1 << 20, 1):
        assert _kept(debounce.debounce(df, 3.0, params=Params(scan_cell_rows=m))) == ["a", "b", "c", "e"]


def test_debounce_across_stations_and_adjacent(spark):
    df = scans(spark, [("a", 0, "INTAKE", "X", 1, "C1", "S1"), ("b", 1, "CONSUME", "X", 1, "C1", "S2")])
    assert _kept(debounce.debounce(df, 3.0)) == ["a"]
    adj = scans(spark, [("a", 0, "INTAKE", "A", 1, "A"), ("b", 1, "INTAKE", "B", 1, "B"),
                        ("c", 2, "INTAKE", "A", 1, "A")])
    assert _kept(debounce.debounce_adjacent(adj, 3000)) == ["a", "b", "c"]
    assert _kept(debounce.debounce(adj, 3.0)) == ["a", "b"]


def test_ingest_reasons(spark):
    raw = spark.createDataFrame([("s1", at(0), "INTAKE", "S1", "junk", None), ("s2", at(1), "INTAKE", "S1", "junk", None)],
                                "scan_id string, event_ts timestamp_ntz, kind string, station_id string, "
                                "barcode_raw string, user_email string")
    ok, rej = ingest.ingest_scans(raw)
    assert ok.count() == 0
    assert {r.scan_id: r.reason for r in rej.collect()} == {"s1": "bad_format", "s2": "duplicate"}


def _life(spark, rows, acks=None, params=Params()):
    df = scans(spark, rows)
    ak = None
    if acks:
        ak = spark.createDataFrame([(e, at(s), i) for e, s, i in acks],
                                   "event_id string, event_ts timestamp_ntz, item_id string")
    out = lifecycle.signal_lifecycle(df, ak, params).orderBy("created_ts", "status").collect()
    return [(r.status, r.triggered_at_qty) for r in out]


def test_lifecycle_table(spark):
    rows = [("1", 0, "INTAKE", "X", 24), ("2", 1, "CONSUME", "X", 14), ("3", 2, "CONSUME", "X", 2),
            ("4", 3, "INTAKE", "X", 2), ("5", 4, "INTAKE", "X", 1)]
    assert _life(spark, rows) == [("OPEN", 10), ("FULFILLED", 10)]
    assert _life(spark, [("1", 0, "INTAKE", "X", 5)]) == []
    assert _life(spark, [("1", 0, "CONSUME", "X", 3)]) == [("OPEN", -3)]
    acked = _life(spark, [("1", 0, "CONSUME", "X", 3), ("3", 2, "CONSUME", "X", 1)], acks=[("2", 1, "X")])
    assert acked == [("OPEN", -3), ("ACKNOWLEDGED", -3), ("OPEN", -4)]
    no_fulfil = _life(spark, [("1", 0, "CONSUME", "X", 3), ("3", 2, "INTAKE", "X", 20)], acks=[("2", 1, "X")])
    assert no_fulfil == [("OPEN", -3), ("ACKNOWLEDGED", -3)]


def test_stock_status(spark):
    df = spark.createDataFrame([(q,) for q in (0, 5, 10, 11, 15, 16)], "on_hand_qty int")
    got = {r.on_hand_qty: r.stock_status for r in columns.with_stock_status(df, 10).collect()}
    assert got == {0: "critical", 5: "critical", 10: "critical", 11: "low", 15: "low", 16: "ok"}
    got20 = {r.on_hand_qty: r.stock_status for r in columns.with_stock_status(df, 20).collect()}
    assert got20[16] == "low" and got20[10] == "critical"


def test_latest_tie_break(spark):
    sig = spark.createDataFrame(
        [(1, "s", at(0), "X", 3, 10, 24, "e", "OPEN"), (2, "s", at(0), "X", 3, 10, 24, "e", "ACKNOWLEDGED")],
        "id bigint, signal_id string, created_ts timestamp_ntz, item_id string, triggered_at_qty bigint, "
        "reorder_point int, reorder_qty int, trigger_event_id string, status string")
    assert latest.latest_signals(sig).collect()[0].status == "ACKNOWLEDGED"


def test_actor_name(spark):
    df = spark.createDataFrame([("Ann", "a.b@x.y"), (None, "a.b@x.y"), ("", None)], "n string, e string")
    got = [r.actor_name for r in columns.with_actor_name(df, "n", "e").collect()]
    assert got == ["Ann", "a.b", "Unknown"]


SLIP = ('{"items": [{"item_id": "BOLT-M8X25-SS", "qty": 12, "confidence": "high"},'
        '{"item_id": "NUT-M8-SS", "qty": 12}, {"item_id": "WASHER-M8-FL", "qty": 6},'
        '{"item_id": "BRG-6205-2RS", "qty": 24}, {"item_id": "SEAL-OR-42X3", "qty": 8},'
        '{"item_id": "GREASE-MP2-14", "qty": 36}, {"item_id": "FILTER-HYD-10M", "qty": 4}],'
        '"po_number": "2024-78432", "ship_date": "January 14, 2025"}')


def test_slip_answer_shapes(spark):
    """Which answers are accepted: (answer, quantities of its lines, note)."""
    line = '{"item_id": "A", "qty": %s}'
    one = lambda q: '{"items": [' + line % q + "]}"
    bad, bad_json, bad_head = (f"Failed to parse response: {x}" for x in ("invalid line item", "not valid JSON", "invalid header"))
    cases = [
        ("```json\n" + one(1) + "\n```\n```json\n" + one(2) + "\n```", [1], None), ("```\n" + one(3) + "\n```\n```\n" + one(4) + "```", [3], None),
        ("```json" + one(5), [5], None), (one(1) + " x", [], bad_json), (one(1) + "}", [], bad_json), (one(1) + "] y", [], bad_json),
        ("\u00a0\n" + one(2) + "\u2003", [2], None), ("[" + one(1) + "]", [], bad_json), ("", [], bad_json), ("{oops", [], bad_json), (None, [], bad_json),
        ("{}", [], None), ('{"items": []}', [], None), ('{"items": null}', [], bad), ('{"items": {"a": 1}}', [], bad), ('{"items": [1]}', [], bad),
        ('{"items": [null]}', [], bad), (one('"+4"'), [4], None), (one('" 1_0 "'), [10], None), (one('"4.0"'), [4], None), (one("4.0"), [4], None), (one("4.5"), [], bad),
        (one('"x"'), [], bad), (one("true"), [1], None), (one("null"), [], bad), (one("0"), [], bad), (one("-1"), [], bad), (one("99999999999"), [], bad),
        ('{"items": [{"item_id": 7, "qty": 1}]}', [], bad), ('{"items": [{"item_id": null, "qty": 1}]}', [], bad), ('{"items": [{"qty": 1}]}', [], bad),
        ('{"items": [{"item_id": "A", "qty": 1, "confidence": null}]}', [], bad), ('{"items": [{"item_id": "A", "qty": 1, "confidence": "sure"}]}', [], bad),
        ('{"items": [{"item_id": "A", "qty": 1, "description": null, "more": 2}], "vendor": null, "extra": 1}', [1], None),
        ('{"items": [{"item_id": "A", "qty": 1, "description": 5}]}', [], bad), ('{"items": [], "vendor": 5}', [], bad_head),
        ('{"items": [], "notes": "n"}', [], "n"), ('{"items": [], "notes": ["n"]}', [], bad_head)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "slip_id int, response string")
    got = {r.slip_id: ([x.qty for x in r["slip"]["items"]], r.slip.notes) for r in slips.parse_slip_responses(df).collect()}
    assert {i: (q, n) for i, (_, q, n) in enumerate(cases)} == got


def test_blank_item_ids_are_dropped(spark):
    ids = ["A", " ", "\t", "\u00a0", "\u3000 \ufeff", "", None, "\x1c", " B "]
    df = spark.createDataFrame([(i, 1) for i in ids] + [("C", 0), ("D", None)], "item_id string, qty int")
    assert [r.item_id for r in slips.valid_slip_lines(df).collect()] == ["A", "\x1c", " B "]


def test_ingest_loses_nothing(spark):
    raw = spark.createDataFrame([("s1", at(0), "C"), ("s2", None, "C"), ("s3", at(1), "C"), ("s4", None, "ITEM=A;QTY=1"), ("s5", at(0), "ITEM=A;QTY=1")],
                                "scan_id string, event_ts timestamp_ntz, barcode_raw string").selectExpr(
        "scan_id", "event_ts", "'INTAKE' AS kind", "'S' AS station_id", "barcode_raw", "cast(null AS string) AS user_email")
    ok, rej = ingest.ingest_scans(raw)
    assert [r.event_id for r in ok.collect()] == ["s5"]
    assert {r.scan_id: r.reason for r in rej.collect()} == {"s1": "bad_format", "s2": "no_time", "s3": "duplicate", "s4": "no_time"}
    ok, rej = ingest.ingest_scans(raw, default_ts=F.lit(at(9)))
    assert sorted((r.event_id, r.event_ts) for r in ok.collect()) == [("s4", at(9)), ("s5", at(0))]


def test_slip_parsing(spark):
    rows = [(1, SLIP), (2, "```json\n" + SLIP + "\n```"), (3, "```\n" + SLIP + "\n```"), (4, "{oops"),
            (5, '{"items": [{"item_id": "A", "qty": 0}]}')]
    p = slips.parse_slip_responses(spark.createDataFrame(rows, "slip_id int, response string"))
    tot = {r.slip_id: (r.lines, r.units) for r in slips.slip_totals(slips.slip_lines(p)).collect()}
    assert tot == {1: (7, 102), 2: (7, 102), 3: (7, 102)}
    notes = {r.slip_id: r.n for r in p.select("slip_id", F.col("slip.notes").alias("n")).collect()}
    assert notes[4] and notes[5]
    conf = {r.item_id: r.confidence for r in slips.slip_lines(p).filter("slip_id = 1").collect()}
    assert conf["NUT-M8-SS"] == "medium"


def test_bulk_intake_dedupe(spark):
    lines = spark.createDataFrame([(1, 0, "A", 5, at(0)), (1, 1, "A", 5, at(0)), (1, 2, "A", 6, at(0))],
                                  "slip_id int, line_no int, item_id string, qty int, received_ts timestamp_ntz")
    ok, _ = ingest.bulk_intake(lines)
    assert ok.count() == 2 and ok.agg(F.sum("qty")).first()[0] == 11
    ok2, _ = ingest.bulk_intake(lines, dedupe=False)
    assert ok2.count() == 3


def test_slip_answer_is_one_value(spark):
    """Whatever stands behind the answer, also what would close the list it is parsed in, voids it."""
    one = '{"items":[{"item_id":"a","qty":1}]}'
    texts = [one, one + " ", "[" + one + "]", one + " x", one + one, one + ",0", one + "] [", one + ",0] [", one + "]", one + ",", "", "{}", one + " // end"]
    df = spark.createDataFrame(list(enumerate(texts)), "slip_id int, response string")
    got = {r.slip_id: len(r.slip["items"]) for r in slips.parse_slip_responses(df).collect()}
    assert got == {i: 1 if i in (0, 1) else 0 for i in range(len(texts))}
    notes = {r.slip_id: r.slip["notes"] for r in slips.parse_slip_responses(df).collect()}
    assert [i for i, n in notes.items() if n is None] == [0, 1, 11]


def test_slips_are_read_once_for_bulk_intake(spark):
    """The debounce reads its input twice; the slip lines behind it are read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ddl = "slip_id int, line_no int, item_id string, qty int, received_ts timestamp_ntz"
    lines = spark.createDataFrame([(1, i, f"P{i}", 5, at(0)) for i in range(20)], ddl).mapInArrow(count, ddl)
    ok, rejects = ingest.bulk_intake(lines)
    assert ok.count() == 20 and rejects.count() == 0 and seen.value == 20


def test_read_slip_odd_texts():
    """Texts as JSON has them, read without Spark."""
    read = slips.read_slip
    one = '{"items": [{"item_id": "A", "qty": %s}]}'
    assert read("x ```json" + one % "1e3" + "``` y")[0] == [("A", 1000, None, "medium")]
    assert [read(one % q)[0] for q in ("1e7", '"1.0\t"', "NaN", '"1__0"', "2147483648", "1.5")] == [[]] * 6
    assert read('{"items": [], "items": []}')[1][3] == read(None)[1][3] == "Failed to parse response: not valid JSON"
    assert read('{"vendor": 1.5}')[1][3] == "Failed to parse response: invalid header"


def test_slip_texts_with_half_a_surrogate_pair(spark):
    df = spark.createDataFrame([(1, '{"notes": "a\\ud800"}')], "slip_id int, response string")
    assert slips.parse_slip_responses(df).first()["slip"]["notes"] == "a?"
